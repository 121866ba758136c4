"""Many documents in one go: admitted, extracted, analysed, validated, compiled; failures become rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators import analysis, layout, results, validation
from ..operators.admission import rejection
from ..streaming.pages import work_folder


def dense_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """`df` with every row's place in `order`, counted from 0; no task sees more than a range of the rows.

    The ranges are written with each row's number in its range, so that places do not change when a task is run again;
    what the ranges before hold is summed over one row for each range. Equal rows of `order` get places in any order.
    """
    spark = df.sparkSession
    path = work_folder(spark, "ordered")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    number = F.shiftright("_at", 33).alias("_range")
    written = spark.read.parquet(path).select("*", number)
    counts = written.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return written.join(offsets, "_range").withColumn(name, place).drop("_range", "_at", "_before")


def _extracted(documents: DataFrame, tokens: DataFrame, wanted: Column | None = None) -> DataFrame:
    """`documents` with the `extraction` of their tokens, by each row's `extraction_type`, and its text as `text`."""
    kind = F.col("extraction_type") if "extraction_type" in documents.columns else F.lit("text")
    asked = documents if wanted is None else documents.where(wanted)
    extraction = layout.extract_each(tokens, asked.select(layout.KEY, kind.alias("extraction_type")))
    return (
        documents.drop("text", "extraction")
        .join(extraction, layout.KEY, "left")
        .withColumn("text", F.col("extraction.extracted_content"))
    )


def process_documents(
    documents: DataFrame,
    as_of: dt.date,
    extraction: DataFrame | None = None,
    validation_type: str = "comprehensive",
    tokens: DataFrame | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Compiled result per document with `response` and `requested_type`; `carry` names columns to keep.

    With `tokens`, a document's text is what is extracted from its tokens, by the branch that its `extraction_type` names;
    a document without tokens has no text. Without, it carries its `text`, and `extraction` may be a table of its own.
    Documents have an id each. Everything but the extraction and joins with it is row by row.
    """
    if tokens is not None:
        documents = _extracted(documents, tokens)
    analysed = analysis.analyze(documents)
    validated = validation.validate(analysed, as_of, validation_type)
    return results.compile_results(validated, extraction, carry=carry)


def process_batch(
    tasks: DataFrame,
    as_of: dt.date,
    start: Column | None = None,
    end: Column | None = None,
    extraction: DataFrame | None = None,
    max_mb: int | None = None,
    tokens: DataFrame | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Envelope per task: result, or the error that kept the document out; `document_path` names the file of either.

    Tasks carry `document_path`, `size_bytes`, `extension` besides the columns of `process_documents`, and are numbered by `doc_id`.
    With `order`, rows get their `position` in it, from 0. `start` and `end` are columns of the tasks that say when
    work on them began and ended; times are unknown without them. Refused tasks are neither extracted nor analysed.
    """
    if order is not None:
        tasks = dense_position(tasks, order)
    limits = {} if max_mb is None else {"max_mb": max_mb}
    refused = F.expr(
        f"IF(coalesce(length(document_path), 0) = 0, 'document_path is required', {rejection(**limits)})"
    )
    unknown = F.lit(None).cast("timestamp")
    judged = tasks.withColumns(
        {
            "_refused": refused,
            "_start": unknown if start is None else start,
            "_end": unknown if end is None else end,
        }
    )
    if tokens is not None:
        judged = _extracted(judged, tokens, F.col("_refused").isNull())
    else:
        # What is refused is carried along without its text, so no work is spent on it.
        judged = judged.withColumn("text", F.expr("IF(_refused IS NULL, text, NULL)"))
    named = ["document_path"] + (["position"] if order is not None else [])
    compiled = results.compile_results(
        validation.validate(analysis.analyze(judged), as_of), extraction, carry=["_refused", "_start", "_end", *named]
    )
    parts = [c for c in compiled.columns if c not in ("doc_id", "_refused", "_start", "_end", *named)]
    wrapped = results.envelope(
        F.struct(*parts), F.col("_refused"), "coordinator", F.col("doc_id"), F.col("_start"), F.col("_end"),
        F.col("overall_confidence"),
    )
    return compiled.select("doc_id", *named, wrapped.alias("envelope")).select("doc_id", *named, "envelope.*")
