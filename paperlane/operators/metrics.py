"""Figures over processing logs.

Log rows: `task_id`, `agent`, `start_ts`, `duration`, `status` (completed or
error), `error`, `document_type`. An agent may own a third of the log, so
counts are combined before the shuffle and "last n" is taken in two rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

LAST = ["start_ts", "task_id"]


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def agent_status(log: DataFrame) -> DataFrame:
    """Per agent: tasks, errors, success rate, last activity and the status it left behind."""
    failed = F.col("status") == "error"
    grouped = log.groupBy("agent").agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(failed).alias("error_count"),
        F.max(F.struct(*LAST, "status")).alias("last"),
    )
    return grouped.select(
        "agent",
        "total_tasks",
        "error_count",
        _rate(F.col("total_tasks") - F.col("error_count"), F.col("total_tasks")).alias("success_rate"),
        F.col("last.start_ts").alias("last_activity"),
        F.col("last.status").alias("status"),
    )


def last_n(log: DataFrame, n: int = 1000, keys: list[str] | None = None, spread: int = 256) -> DataFrame:
    """The last n rows per key, exactly, with `recency` counted from the newest (1).

    First round per key and group of input partitions: Spark drops rows beyond
    n before the shuffle and a large key is ranked by `spread` tasks. The
    second round ranks what is left, at most n * spread rows per key.
    """
    keys = keys or ["agent"]
    newest = [F.col(c).desc() for c in LAST]
    share = F.pmod(F.spark_partition_id(), F.lit(spread))
    first = Window.partitionBy(*keys, "_share").orderBy(*newest)
    second = Window.partitionBy(*keys).orderBy(*newest)
    kept = (
        log.withColumn("_share", share)
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= n)
        .drop("_share", "_rank")
    )
    return kept.withColumn("recency", F.row_number().over(second)).where(F.col("recency") <= n)


def performance_metrics(log: DataFrame, window: int = 100, errors: int = 5) -> DataFrame:
    """Per agent over its last tasks: successes, failures, rate, mean time of successes, last errors."""
    recent = last_n(log, window)
    failed = F.col("status") == "error"
    done = F.col("status") == "completed"
    entry = F.struct(F.col("recency"), "task_id", "error", F.col("start_ts").alias("timestamp"))
    grouped = recent.groupBy("agent").agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(done).alias("successful_tasks"),
        F.count_if(failed).alias("failed_tasks"),
        F.coalesce(F.avg(F.when(done, F.col("duration"))), F.lit(0.0)).alias("average_processing_time"),
        F.collect_list(F.when(failed, entry)).alias("failures"),
    )
    # The newest come first in the sorted list; the report wants the oldest of them first.
    newest = F.reverse(F.slice(F.array_sort("failures"), 1, errors))
    return grouped.select(
        "agent",
        F.lit(f"last_{window}_tasks").alias("period"),
        "total_tasks",
        "successful_tasks",
        "failed_tasks",
        _rate(F.col("successful_tasks"), F.col("total_tasks")).alias("success_rate"),
        "average_processing_time",
        F.transform(newest, lambda e: F.struct(e["task_id"], e["error"], e["timestamp"])).alias("recent_errors"),
    )


def health(status: DataFrame) -> DataFrame:
    return status.select(
        "agent",
        "status",
        ((F.col("status") != "error") & (F.col("success_rate") > 0.5)).alias("healthy"),
        "success_rate",
        "last_activity",
    )


def system_health(status: DataFrame) -> DataFrame:
    return status.agg(
        F.coalesce(F.bool_and(F.col("status") != "error"), F.lit(True)).alias("all_agents_healthy"),
        F.count(F.lit(1)).alias("total_agents"),
        F.count_if(F.col("status") == "completed").alias("active_agents"),
    )


def overall_statistics(status: DataFrame) -> DataFrame:
    tasks = F.coalesce(F.sum("total_tasks"), F.lit(0))
    errors = F.coalesce(F.sum("error_count"), F.lit(0))
    return status.agg(
        tasks.alias("total_tasks_processed"),
        errors.alias("total_errors"),
        _rate(tasks - errors, tasks).alias("overall_success_rate"),
        F.count_if(F.col("status") != "error").alias("active_agents"),
    )


def recent_history(results: DataFrame, n: int = 5) -> DataFrame:
    """The newest n documents: type, confidence, time taken."""
    return results.orderBy(F.col("start_ts").desc(), F.col("task_id").desc()).limit(n)


def run_report(results: DataFrame) -> DataFrame:
    """Totals, and time and confidence figures over successes."""
    ok = F.col("success")
    figures = []
    for name in ("processing_time", "confidence"):
        value = F.when(ok, F.col(name))
        figures += [F.avg(value).alias(f"avg_{name}"), F.min(value).alias(f"min_{name}"), F.max(value).alias(f"max_{name}")]
    total = F.count(F.lit(1))
    return results.agg(
        total.alias("total_tests"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        _rate(F.count_if(ok), total).alias("success_rate"),
        *figures,
    )


def observe_run(results: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """`results` as they are, and the figures of `run_report` as what was seen when they were written; no second pass.

    Ask the observation after an action on the frame: it waits for the first one. Times come from the rows'
    `processing_time`; a figure of no row is None.
    """
    seen = Observation(name)
    ok = F.col("success")
    figures = [F.count(F.lit(1)).alias("total_tests"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed")]
    for column in ("processing_time", "confidence"):
        value = F.when(ok, F.col(column))
        figures += [F.avg(value).alias(f"avg_{column}"), F.min(value).alias(f"min_{column}"), F.max(value).alias(f"max_{column}")]
    return results.observe(seen, *figures), seen


def documents_per_type(results: DataFrame) -> DataFrame:
    return results.where("success").groupBy("document_type").agg(F.count(F.lit(1)).alias("documents"))


def timing_by_document(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Average, least and most time over the successful runs of a document."""
    return (
        runs.where("success")
        .groupBy(key)
        .agg(
            F.avg("processing_time").alias("avg_processing_time"),
            F.min("processing_time").alias("min_processing_time"),
            F.max("processing_time").alias("max_processing_time"),
        )
    )


def extraction_matrix(runs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Document by extraction type: did any run succeed; NULL where none was made."""
    from ..functions import fixed

    return runs.groupBy(key).agg(
        *[F.max(F.when(F.col("extraction_type") == t, F.col("success"))).alias(t) for t in fixed.EXTRACTION_TYPES]
    )


def entity_counts(documents: DataFrame, key: str = "doc_id", entities: str = "entities") -> DataFrame:
    """Entities found per document and kind; kinds without any are left out."""
    return (
        documents.select(key, F.explode(entities).alias("entity_type", "found"))
        .where(F.size("found") > 0)
        .select(key, "entity_type", F.size("found").alias("entities"))
    )


def entity_totals(documents: DataFrame, key: str = "doc_id", entities: str = "entities") -> DataFrame:
    return (
        entity_counts(documents, key, entities)
        .groupBy("entity_type")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("entities").alias("entities"))
    )


def issue_counts(validated: DataFrame, key: str = "doc_id") -> DataFrame:
    """Issues per document and category, counted in the row; categories without issues are left out."""
    return (
        validated.select(key, F.explode("validation.categories").alias("c"))
        .where(F.size("c.issues") > 0)
        .select(key, F.col("c.category").alias("category"), F.size("c.issues").alias("issues"))
    )
