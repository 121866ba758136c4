"""Sinks: results as JSON, Markdown, HTML, entity CSV, and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from .versions import write_version


def write_json(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, keys with null too; VARIANT columns are written as the JSON they hold."""
    results.write.mode(mode).json(path, ignoreNullFields=False)


def write_json_run(results: DataFrame, path: str, run: str) -> bool:
    """The results of a run as a version of the table at `path`; a run that failed is simply written again.

    Each row repeats all keys and fixed texts, so files are written with gzip, which Spark's readers undo.
    """
    return write_version(results, path, run, "json", ignoreNullFields=False, compression="gzip")


def pretty_json(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """The whole row as indented JSON text."""
    return results.select(key, F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", F.bround(value, 2))


def _fill(template: str, cut: int, escape: bool, **parts: Column) -> Column:
    """Template split at its placeholders and joined with the columns; values are never searched."""

    def shown(name: str) -> Column:
        value = F.coalesce(parts[name], F.lit(""))
        if name == "text":
            value = F.substring(value, 1, cut)
        if escape:
            for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
                value = F.replace(value, F.lit(raw), F.lit(safe))
        return value

    pieces, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(before), shown(name)]
    return F.concat(*pieces, F.lit(rest))


def render_markdown(
    summary: Column, filename: Column, document_type: Column, confidence: Column, text: Column, chars: int = fixed.MARKDOWN_CHARS
) -> Column:
    """Report with the first `chars` of the text."""
    return _fill(
        fixed.MARKDOWN_REPORT, chars, False,
        summary=summary, filename=filename, type=document_type, confidence=two_decimals(confidence), text=text,
    )


def render_html(
    summary: Column, filename: Column, document_type: Column, confidence: Column, text: Column, chars: int = fixed.HTML_CHARS
) -> Column:
    """Page with the first `chars` of the text, values escaped."""
    return _fill(
        fixed.HTML_REPORT, chars, True,
        summary=summary, filename=filename, type=document_type, confidence=two_decimals(confidence), text=text,
    )


def report_columns(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """Compiled results with their Markdown and HTML reports."""
    parts = [
        F.col("analysis_results.summary"),
        F.col("document_information.filename"),
        F.col("analysis_results.document_type"),
        F.col("overall_confidence"),
        F.col("extraction_results.extracted_text"),
    ]
    return results.select(key, render_markdown(*parts).alias("markdown"), render_html(*parts).alias("html"))


def entity_rows(documents: DataFrame, key: str = "doc_id", entities: str = "entities") -> DataFrame:
    """One row per found entity: Type, Entity."""
    kinds = documents.select(key, F.explode(entities).alias("Type", "found"))
    return kinds.select(key, "Type", F.explode("found").alias("Entity"))


def write_entities_csv(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    entity_rows(documents).write.mode(mode).option("header", True).csv(path)


def agent_activity_events(log: DataFrame) -> DataFrame:
    """Event rows of kind agent_activity from log columns agent, activity, start_ts and details."""
    payload = F.struct(F.col("agent").cast("string").alias("agent"), "activity", "details")
    return _event("agent_activity", log, payload)


def processing_events(log: DataFrame) -> DataFrame:
    """One event per processed document; failures are logged with type unknown and their error."""
    ok = F.col("error").isNull()
    payload = F.struct(
        F.when(ok, F.col("document_type")).otherwise("unknown").alias("document_type"),
        F.col("duration").alias("processing_time"),
        ok.alias("success"),
        "error",
    )
    return _event("processing_metrics", log, payload)


def api_call_events(calls: DataFrame) -> DataFrame:
    payload = F.struct("endpoint", "method", "status_code", F.col("duration").alias("response_time"))
    return _event("api_call", calls, payload)


def _event(kind: str, rows: DataFrame, payload: Column) -> DataFrame:
    return rows.select(
        "task_id", F.lit(kind).alias("event_type"), F.to_json(payload).alias("payload"), F.col("start_ts").alias("timestamp")
    )


EVENTS = "task_id long, event_type string, payload string, timestamp timestamp"


def write_events(events: DataFrame, path: str, run: str) -> bool:
    """Add the events of one kind and run to the event table; a second time they are left out."""
    kind = events.select("event_type").first()
    return kind is not None and write_version(events, path, f"{run}-{kind[0]}")
