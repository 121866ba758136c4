"""Documents to packed sequences: language, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame, which is written and read again for the next one.
All but the last return the columns of documents, extra ones too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlane.llm import group_join, language_id, packing, secret_scan, templates
from paperlane.llm._store import batches_of, new_folder, written
from paperlane.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without documents that have no language: null texts and those without a letter.

    Filters are learned from the stage's own rows with a lang, those not held out.
    """
    filters = language_id.learn(docs.where(~language_id.held_out(F.col("doc_id"))))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.select(*[F.col(c).alias(n) for n, c in zip(names, docs.columns)])
    known = language_id.predict(renamed, filters, names, text=names[docs.columns.index("text")])
    kept = known.where(F.col("lang_pred") != language_id.UNDETERMINED)
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group: that of the smallest id, null ids last. Texts without words are groups of their own.

    Rows are told apart by a number of their own, so rows that share an id or have none are judged each by its text.
    """
    numbered = written(docs.withColumn("_row_no", F.monotonically_increasing_id()), "numbered")
    groups = group_join.join_groups(numbered.select(F.col("_row_no").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("_row_no"), "component_id")
    ranked = numbered.select("_row_no", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash")).join(groups, "_row_no")
    first = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_hash", "_row_no")).alias("first"))
    return numbered.join(first.select("first._row_no"), "_row_no", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without documents in which a benchmark item leaks."""
    leaks = templates.find_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    leaking = written(leaks.select(F.col("text_hash").alias("_leak")).distinct(), "leaks")
    return docs.join(leaking, F.xxhash64("text") == F.col("_leak"), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids."""
    return packing.pack(docs, tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("pack", pack),
]

TEXTS_AT_ONCE = 2000

# Tokens, filters and lexing are not expressible in SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with batches_of(spark, TEXTS_AT_ONCE):  # texts and ids travel in small batches in every stage
        for name, stage in STAGES:
            to = new_folder(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(to)
            docs = spark.read.parquet(to)
    return docs
