"""URL rules by host suffix and path prefix, found through short hash prefixes.

Each distinct (host, path) expands to those host suffixes that have as many labels as some rule's host, joined with
those beginnings of its path that have the length of some rule's path. An expression meets a rule by an equi-join on the first bytes of its SHA-256; the full digest
confirms it, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or url."""
    return F.coalesce(_lower(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", prefix: int = 8) -> DataFrame:
    """Host, path, rule and verdict for every row of `urls` (page_id, url).

    `rules`: host, path, verdict. A rule fits its host and all subdomains if the path starts with the rule's; the longest
    host and path together win, then the longer host, then `block` before `allow` (the later word). Urls without a rule
    get a null rule and `default`. A null url, or one without `://`, has an empty host and path. Rows are kept as they
    are, repeated ones too; other columns are not looked at; with empty rules all rows get the default.
    Rules are distributed by their own size: Spark broadcasts them below its threshold and joins by shuffle above it.
    Judging is done once for each distinct host and path, so a url that many pages share costs one row.
    `prefix`: hex digits of the digest that are joined on.
    """
    pages = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = rules.select(_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).where("r_host is not null")
    known = known.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("short", F.substring("r_digest", 1, prefix))
    # lengths of rules' paths and labels of rules' hosts: at most as many as the longest of them has characters
    labels_of = lambda host: F.split(host, r"\.", -1)
    measures = known.agg(F.collect_set(F.length("r_path")).alias("lengths"), F.collect_set(F.size(labels_of("r_host"))).alias("labels")).first()
    lengths, counts = sorted(measures["lengths"]), sorted(measures["labels"])
    seen = pages.select("host", "path").where("host <> ''").distinct()
    labels = labels_of("host")
    several = F.filter(F.array(*map(F.lit, counts)).cast("array<int>"), lambda n: n <= F.size(labels))
    suffixes = F.transform(several, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    expressions = seen.select("host", "path", fitting.alias("sizes"), F.explode(suffixes).alias("suffix"))
    expressions = expressions.select("host", "path", "suffix", F.explode("sizes").alias("n"))
    expressions = expressions.select("host", "path", _digest(F.col("suffix"), F.substring("path", F.lit(1), F.col("n"))).alias("digest"))
    expressions = expressions.withColumn("short", F.substring("digest", 1, prefix))
    hits = expressions.join(known, "short").where("digest = r_digest")
    rank = F.struct(F.length(F.concat("r_host", "r_path")).alias("size"), F.length("r_host").alias("host_size"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    out = pages.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
