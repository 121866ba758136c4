"""Final records: quality scores, one nested row per document, envelopes, page folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed

DEFAULT_CONFIDENCE = 0.8


def quality_recommendations(score: Column, is_valid: Column) -> Column:
    advice = fixed.QUALITY_ADVICE
    return F.array_compact(
        F.array(
            F.when(score < 0.7, advice["low"]),
            F.when(~is_valid, advice["invalid"]),
            F.when(score < 0.8, advice["improve"]),
            F.when(score >= 0.9, advice["high"]),
        )
    )


def quality_score(ocr: Column, analysis: Column, validation: Column) -> Column:
    """Weighted mean, freed of binary noise so that the level limits are exact."""
    return F.round(ocr * 0.3 + analysis * 0.3 + validation * 0.4, 12)


def quality_metrics(ocr: Column, analysis: Column, validation: Column, is_valid: Column) -> Column:
    score = quality_score(ocr, analysis, validation)
    known = score.isNotNull()
    level = (
        F.when(score >= 0.9, "excellent")
        .when(score >= 0.8, "good")
        .when(score >= 0.7, "fair")
        .when(known, "poor")
        .otherwise("unknown")
    )
    return F.struct(
        F.coalesce(score, F.lit(0.0)).alias("overall_quality_score"),
        level.alias("quality_level"),
        F.when(known, quality_recommendations(score, is_valid)).alias("recommendations"),
        F.struct(ocr.alias("ocr"), analysis.alias("analysis"), validation.alias("validation")).alias(
            "confidence_breakdown"
        ),
        (F.coalesce(score, F.lit(0.0)) * F.when(is_valid, 0.9).otherwise(0.5)).alias("reliability_score"),
    )


def overall_confidence(ocr: Column, analysis: Column, validation: Column) -> Column:
    """Weighted confidence capped at 1; a missing part counts as 0.8."""
    part = lambda c: F.coalesce(c, F.lit(DEFAULT_CONFIDENCE))
    return F.least(F.lit(1.0), part(ocr) * 0.25 + part(analysis) * 0.35 + part(validation) * 0.4)


def envelope(
    result: Column,
    error: Column,
    agent: str,
    task_id: Column,
    start: Column,
    end: Column,
    confidence: Column | None = None,
) -> Column:
    """Success row or error row of one shape."""
    ok = error.isNull()
    seconds = (F.unix_micros(end) - F.unix_micros(start)).cast("double") / 1000000
    sure = F.lit(None).cast("double") if confidence is None else confidence
    return F.struct(
        ok.alias("success"),
        task_id.cast("string").alias("task_id"),
        F.lit(agent).alias("agent_name"),
        F.struct(start.alias("start"), end.alias("end"), seconds.alias("duration")).alias("timestamp"),
        F.when(ok, "completed").otherwise("error").alias("status"),
        F.when(~ok, F.struct(error.alias("message"), F.lit("processing_error").alias("type"))).alias("error"),
        F.when(ok, result).alias("result"),
        F.struct(
            F.when(ok, F.coalesce(sure, F.lit(DEFAULT_CONFIDENCE))).otherwise(F.lit(0.0)).alias("confidence"),
            seconds.alias("processing_time"),
        ).alias("metrics"),
    )


def run_metadata(
    df: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    workflow_type: str = "standard",
    output_format: str = "json",
) -> DataFrame:
    """Add `metadata`: what was run, when and how long.

    `start` and `end` are what the rows themselves say about their work; what is not known is NULL. One clock for the whole query would
    give all documents the same time.
    """
    unknown = F.lit(None).cast("timestamp")
    began, ended = (unknown if c is None else c for c in (start, end))
    seconds = (F.unix_micros(ended) - F.unix_micros(began)).cast("double") / 1000000
    return df.withColumn(
        "metadata",
        F.struct(
            seconds.alias("processing_time"),
            ended.alias("timestamp"),
            F.col("document_information.filename").alias("document_path"),
            F.col("extraction_results.extraction_type").alias("extraction_type"),
            F.lit(output_format).alias("output_format"),
            F.lit(workflow_type).alias("workflow_type"),
            F.array(F.lit("ocr"), F.lit("analysis"), F.lit("validation")).alias("agents_involved"),
            F.coalesce(F.col("overall_confidence"), F.lit(DEFAULT_CONFIDENCE)).alias("overall_confidence"),
        ),
    )


def compile_results(
    documents: DataFrame,
    extraction: DataFrame | None = None,
    key: str = "doc_id",
    workflow_type: str = "standard",
    carry: list[str] | None = None,
) -> DataFrame:
    """One nested row per document out of the stages' results; `carry` names columns to keep as they are.

    `documents` carries `analysis` and `validation` structs, and optionally
    `filename`, `size_mb`, `extension`, `pages`, `document_type`. The extraction
    result is either in its `extraction` column or a table of its own, one row
    per document, joined on the key. Missing parts take their defaults.
    """
    df = documents
    if extraction is not None:
        packed = extraction.select(key, F.struct(*[c for c in extraction.columns if c != key]).alias("extraction"))
        df = df.join(packed, key, "left")

    def optional(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)

    parts = df.schema["extraction"].dataType.fieldNames() if "extraction" in df.columns else []

    def extracted(name: str, kind: str, default) -> Column:
        given = F.col(f"extraction.{name}").cast(kind) if name in parts else F.lit(None).cast(kind)
        return F.coalesce(given, F.lit(default).cast(kind))

    failed = F.col("analysis.error").isNotNull()
    analysed = F.when(failed, F.lit(None)).otherwise(F.col("analysis.confidence_score"))
    validated = F.when(F.col("validation.error").isNull(), F.col("validation.overall_score"))
    is_valid = F.coalesce(F.col("validation.is_valid"), F.lit(False))
    ocr = F.col("extraction.confidence") if "confidence" in parts else F.lit(None).cast("double")
    zero = F.lit(0.0)
    compiled = df.select(
        key,
        *(carry or []),
        F.lit("completed").alias("processing_status"),
        F.lit(True).alias("success"),
        F.struct(
            optional("filename", "string").alias("filename"),
            optional("size_mb", "double").alias("file_size"),
            optional("pages", "int").alias("pages"),
            optional("extension", "string").alias("format"),
        ).alias("document_information"),
        F.struct(
            extracted("extracted_content", "string", "").alias("extracted_text"),
            extracted("confidence", "double", 0.0).alias("extraction_confidence"),
            extracted("pages_processed", "int", 0).alias("pages_processed"),
            extracted("processing_time", "double", 0.0).alias("processing_time"),
            extracted("extraction_type", "string", "text").alias("extraction_type"),
            extracted("total_items", "int", 0).alias("items_extracted"),
        ).alias("extraction_results"),
        F.struct(
            F.coalesce(optional("document_type", "string"), F.col("analysis.analysis_type"), F.lit("unknown")).alias(
                "document_type"
            ),
            F.when(failed, "general").otherwise(F.col("analysis.category")).alias("category"),
            F.when(failed, "").otherwise(F.col("analysis.summary")).alias("summary"),
            F.col("analysis.entities").alias("entities"),
            F.col("analysis.detailed_analysis").alias("detailed_analysis"),
            F.coalesce(analysed, zero).alias("analysis_confidence"),
            F.coalesce(F.col("analysis.analysis_type"), F.lit("general")).alias("analysis_type"),
        ).alias("analysis_results"),
        F.struct(
            is_valid.alias("is_valid"),
            F.coalesce(validated, zero).alias("validation_score"),
            F.when(F.col("validation.error").isNotNull(), "unknown")
            .otherwise(F.when(is_valid, "passed").otherwise("failed"))
            .alias("validation_status"),
            F.flatten(F.transform("validation.categories", lambda c: c["issues"])).alias("issues"),
            F.col("validation.recommendations").alias("recommendations"),
            F.col("validation.missing_fields").alias("missing_fields"),
            F.col("validation.rule_violations").alias("rule_violations"),
        ).alias("validation_results"),
        F.col("analysis.text_stats").alias("text_statistics"),
        F.struct(
            F.array(F.lit("ocr"), F.lit("analysis"), F.lit("validation")).alias("agents_used"),
            F.lit(workflow_type).alias("workflow_type"),
        ).alias("workflow_metadata"),
        quality_metrics(
            F.coalesce(ocr, zero), F.coalesce(analysed, zero), F.coalesce(validated, zero), is_valid
        ).alias("quality_metrics"),
        overall_confidence(ocr, analysed, validated).alias("overall_confidence"),
    )
    return compiled


PAGES_PER_PART = 1024


def page_parts(pages: DataFrame, extra_keys: list[Column] | None = None, key: str = "doc_id") -> DataFrame:
    """Page results of a document folded over runs of pages; also the state of a page stream.

    Pages carry `page`, `success`, `extracted_content`, `confidence` and
    `entities`, a map from kind to found strings. A page has two outcomes: text and confidence count if it was
    read (`success`), entities if it was analysed (`analysis_success`; without that column, if it was read).
    """
    ok = F.col("success")
    analysed = F.col("analysis_success") if "analysis_success" in pages.columns else ok
    found = F.expr("flatten(map_values(entities))")
    part = F.floor((F.col("page") - 1) / PAGES_PER_PART)
    return pages.groupBy(key, part.alias("part"), *(extra_keys or [])).agg(
        F.array_sort(F.collect_list(F.when(ok, F.struct("page", "extracted_content")))).alias("texts"),
        F.array_sort(F.collect_list(F.when(analysed & F.col("entities").isNotNull(), F.struct("page", found.alias("found"))))).alias(
            "found"
        ),
        F.sum(F.when(ok, F.col("confidence"))).alias("confidence"),
        F.count(F.lit(1)).alias("pages"),
    )


def fold_parts(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents from their parts, whatever their length: text in page order, entity values, confidence over all pages.

    A part may come in several rows, of several sessions: pages keep their numbers, so their order does too.
    """
    folded = parts.groupBy(key).agg(
        (F.coalesce(F.sum("confidence"), F.lit(0.0)) / F.sum("pages")).alias("average_confidence"),
        F.sum("pages").alias("pages_processed"),
        F.array_sort(F.flatten(F.collect_list("texts"))).alias("texts"),
        F.array_sort(F.flatten(F.collect_list("found"))).alias("found"),
    )
    return folded.select(
        key,
        F.expr("array_join(transform(filter(texts, t -> t.extracted_content IS NOT NULL), t -> t.extracted_content), ' ')").alias("extracted_content"),
        F.expr("flatten(transform(found, f -> f.found))").alias("combined_entities"),
        "average_confidence",
        "pages_processed",
        F.lit(True).alias("streaming_workflow"),
    )


def combine_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Page results folded to documents, in parts first, so no task gathers a long document page by page.

    Text of successful pages in page order, entity values concatenated,
    confidence summed over successes and divided by all pages.
    """
    return fold_parts(page_parts(pages, key=key), key)
