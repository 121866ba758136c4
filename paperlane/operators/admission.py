"""What is let in: size and format limits, required input, choice of branch. Rejects stay visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.sql import case, lit

ERROR = "struct<message:string,type:string>"


def rejection(
    size_bytes: str = "size_bytes",
    extension: str = "extension",
    formats: list[str] | None = None,
    max_mb: int = fixed.MAX_FILE_MB,
) -> str:
    """Why a file is not admitted, else NULL; the size is looked at before the format."""
    allowed = ", ".join(lit(f) for f in (formats or fixed.SUPPORTED_FORMATS))
    return case(
        [
            (f"{size_bytes} > {max_mb * 1024 * 1024}", f"'File size exceeds maximum allowed ({max_mb}MB)'"),
            (
                f"NOT (ltrim('.', lower({extension})) IN ({allowed}))",
                f"concat('Unsupported file format: ', {extension})",
            ),
        ]
    )


def admit(catalog: DataFrame, formats: list[str] | None = None, max_mb: int = fixed.MAX_FILE_MB) -> tuple[DataFrame, DataFrame]:
    """Accepted files, and rejected files with the reason."""
    judged = catalog.withColumn("reason", F.expr(rejection(formats=formats, max_mb=max_mb)))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def require_input(tasks: DataFrame, stage: str = "ocr") -> DataFrame:
    """Add `error`: a struct where the task lacks what its stage needs, else NULL. No row is dropped.

    `stage` is `ocr` (document_path or image), `analysis` (extracted_text) or
    `validation` (a non-empty map `extracted_data`); every task needs `type`.
    """
    empty = lambda c: F.coalesce(F.length(F.col(c)), F.lit(0)) == 0
    if stage == "ocr":
        image = F.col("image").isNull() if "image" in tasks.columns else F.lit(True)
        lacking, message = empty("document_path") & image, "Either document_path or image data is required for OCR task"
    elif stage == "analysis":
        lacking, message = empty("extracted_text"), "extracted_text is required for analysis task"
    else:
        lacking = F.coalesce(F.size("extracted_data"), F.lit(0)) <= 0
        message = "extracted_data is required for validation task"
    problem = F.when(F.col("type").isNull(), f"Invalid task format for {stage}").when(lacking, message)
    error: Column = F.when(
        problem.isNotNull(), F.struct(problem.alias("message"), F.lit("processing_error").alias("type"))
    )
    return tasks.withColumn("error", error)


def extraction_branch(extraction_type: str) -> str:
    """text, table, structure or full; anything else means text."""
    known = ", ".join(lit(t) for t in fixed.EXTRACTION_TYPES)
    return f"IF({extraction_type} IN ({known}), {extraction_type}, 'text')"
