"""Page streams: pages are analysed as they arrive and folded to documents."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import analysis, layout, results, validation
from ..sources.versions import write_version
from .held import hold_until_complete


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder that `spark.checkpoint.dir` names; sessions without one are refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_pages(spark: SparkSession, path: str, schema: str, glob: str = "*.parquet") -> DataFrame:
    """Unbounded rows from the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def stream_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Unbounded rows of a parquet table, whether it is one file or a folder of them.

    A stream's path has to be a folder, unless it is a pattern; this one fits its own path only.
    """
    path = path.rstrip("/")
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def join_responses(pages: DataFrame, responses: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Pages with the model's `response` that came `within` that time of them; NULL once none can come any more.

    Both are streams with doc_id, page and event time `ts`; rows may be `late` by that much. What waits for its other side
    is dropped from state when the watermark has passed its time.
    """
    came = responses.select(
        F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), F.col("ts").alias("_came"), "response"
    ).withWatermark("_came", late)
    matching = F.expr(f"doc_id = _doc AND page = _page AND _came >= ts AND _came <= ts + INTERVAL {within}")
    return pages.withWatermark("ts", late).join(came, matching, "leftOuter").drop("_doc", "_page", "_came")


def process_pages(pages: DataFrame, as_of: dt.date, text: str = "text") -> DataFrame:
    """Each page on its own: read, analysed with its `response`, validated. Stateless, so it streams as it is.

    `success` says whether the page has text, `analysis_success` whether it could be analysed, `validation_success` whether
    there was something to validate; a page without text or response is an error row with `error`. `requested_type` is
    optional.
    """
    asked = pages if "requested_type" in pages.columns else pages.withColumn("requested_type", F.lit("auto"))
    done = validation.validate(analysis.analyze(asked, text=text), as_of, text=text)
    return done.select(
        *[F.col(c) for c in pages.columns],
        (F.coalesce(F.length(text), F.lit(0)) > 0).alias("success"),
        F.col("analysis.error").isNull().alias("analysis_success"),
        F.col("validation.error").isNull().alias("validation_success"),
        F.coalesce("analysis.error", "validation.error").alias("error"),
        F.col("analysis.analysis_type").alias("document_type"),
        *[F.col(f"analysis.{n}").alias(n) for n in ("category", "text_stats", "entities", "confidence_score")],
        "validation",
    )


def stream_layout(
    tokens: DataFrame, path: str, checkpoint: str, late: str = "10 minutes", timeout_minutes: float = 30
):
    """Table cells of the pages of a token stream, a version of the table at `path` for each micro-batch.

    Ranking windows are refused on streams, so each batch is laid out as a batch. Tokens that announce how many there are
    (`page_tokens`, with event time `ts`) wait in state until their page is whole or a timeout passes, so a page may be
    spread over batches. Without that column a page's tokens have to arrive together.
    """
    given = tokens.columns
    if "page_tokens" in given:
        held = hold_until_complete(tokens.withWatermark("ts", late), ["doc_id", "page"], "pos", "page_tokens", "ts", timeout_minutes)
        tokens = held.select(*given)

    def lay_out(batch: DataFrame, number: int) -> None:
        write_version(layout.group_rows(batch), path, f"{number:012d}")

    return tokens.writeStream.foreachBatch(lay_out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_documents(pages: DataFrame, late: str = "10 minutes", timeout_minutes: float = 30) -> DataFrame:
    """Page results given back in append mode when all pages of their part of a document are there; `combine_pages` folds them.

    Pages announce how many their document has (`pages_total`) and carry an event time `ts`. State holds open parts
    of at most `results.PAGES_PER_PART` pages, so a long document leaves part by part.
    """
    per_part = results.PAGES_PER_PART
    part = F.floor((F.col("page") - 1) / per_part)
    numbered = pages.withColumns({"_part": part, "_due": F.least(F.lit(per_part), F.col("pages_total") - part * per_part)})
    held = hold_until_complete(numbered.withWatermark("ts", late), ["doc_id", "_part"], "page", "_due", "ts", timeout_minutes)
    return held.drop("_part", "_due")


def stream_parts(pages: DataFrame, watermark: str | None = None, gap: str = "30 minutes") -> DataFrame:
    """Running fold of page results, one row per document and run of pages.

    State per row is bounded by the pages of a part. Without a watermark parts
    stay open (update or complete mode). With one, on the event time `ts`,
    parts close after `gap` without pages and can be appended.
    """
    if watermark is None:
        return results.page_parts(pages)
    return results.page_parts(pages.withWatermark("ts", watermark), [F.session_window("ts", gap).alias("session")])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain what is there into parquet.

    Complete results are whole versions of the table, one for each batch, so the one before can be read meanwhile;
    `read_versions(..., latest=True)` gives the newest.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, number: write_version(batch, path, f"{number:012d}") and None).start()
    query.awaitTermination()
