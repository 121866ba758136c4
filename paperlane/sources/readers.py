"""Sources: file catalogs, plain-text files, raw recogniser output, model responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed, text as texts

RAW_LINE = "struct<poly:array<array<double>>,text:string,confidence:double>"
CHAT_SCHEMA = "doc_id long, status int, choices array<struct<message:struct<role:string,content:string>>>"


def document_catalog(
    spark: SparkSession, path: str, formats: list[str] | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Files below a path with size, extension and whether their format is supported.

    Contents are not read; a size limit is pushed down to the listing. Spark
    leaves out files of no bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return describe_files(files.select("path", "length", "modificationTime"), formats)


def describe_files(files: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Columns of a catalog from path, length and modificationTime."""
    allowed = ", ".join(f"'{f}'" for f in (formats or fixed.SUPPORTED_FORMATS))
    named = files.withColumn("filename", F.element_at(F.split("path", "/"), -1))
    return named.withColumn(
        "extension", F.expr(r"lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1))")
    ).selectExpr(
        "path",
        "filename",
        "length AS size_bytes",
        "bround(length / 1048576D, 2) AS size_mb",
        "extension",
        "modificationTime AS modified",
        f"ltrim('.', extension) IN ({allowed}) AS supported",
    )


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one row each; bytes that are no UTF-8 are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    named = files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("filename"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.expr(
            r"IF(is_valid_utf8(value), value, replace(make_valid_utf8(value), '\uFFFD', ''))"
        ).alias("extracted_content"),
    )
    known = ", ".join(f"'.{e}'" for e in fixed.TEXT_EXTENSIONS)
    return (
        named.withColumn("extension", F.expr(r"lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1))"))
        .where(f"extension IN ({known})")
        .withColumns({"confidence": F.lit(1.0), "pages_processed": F.lit(1)})
    )


def text_items(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines with something on them, in order, each with confidence 1."""
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "text"))
    return lines.where(F.expr(f"{texts.strip('text')} <> ''")).withColumn("confidence", F.lit(1.0))


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    """Raw recogniser output, one JSON object per page: doc_id, page, processing_time, lines."""
    schema = f"doc_id long, page int, processing_time double, lines array<{RAW_LINE}>"
    return normalize_ocr(spark.read.schema(schema).json(path))


def normalize_ocr(pages: DataFrame, lines: str = "lines") -> DataFrame:
    """Tokens with bounding boxes from lines with polygons."""
    rest = [c for c in pages.columns if c != lines]
    corner = lambda f, axis: F.expr(f"{f}(transform(line.poly, p -> p[{axis}]))")
    exploded = pages.select(*rest, F.posexplode(lines).alias("pos", "line"))
    return exploded.select(
        *rest,
        "pos",
        F.col("line.text").alias("text"),
        F.col("line.confidence").alias("confidence"),
        corner("array_min", 0).alias("x_min"),
        corner("array_min", 1).alias("y_min"),
        corner("array_max", 0).alias("x_max"),
        corner("array_max", 1).alias("y_max"),
    )


def read_chat_responses(spark: SparkSession, path: str) -> DataFrame:
    return chat_contents(spark.read.schema(CHAT_SCHEMA).json(path))


def chat_contents(responses: DataFrame) -> DataFrame:
    """First choice's text, stripped; a bad status or a response without choices is an error row."""
    content = F.try_element_at("choices", F.lit(1))["message"]["content"]
    status = F.coalesce("status", F.lit(200))
    error = F.when(status != 200, F.concat(F.lit("HTTP "), status.cast("string"))).when(
        content.isNull(), "No choices in response"
    )
    kept = [c for c in responses.columns if c not in ("choices", "status")]
    return responses.select(
        *kept, content.alias("_content"), error.alias("error")
    ).select(
        *kept, F.when(F.col("error").isNull(), F.expr(texts.strip("_content"))).alias("response"), "error"
    )
