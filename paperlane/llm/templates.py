"""Benchmark decontamination by templates, in DataFrame functions alone.

Texts are cut to tokens; numbers, units after numbers and names become typed placeholders, so a question with other
numbers or names keeps its template. Windows of template tokens are joined by hash. Matches of one document and item
that lie on one diagonal are one leak, if the values that fill its placeholders are replaced consistently. A window that is
half placeholders says too little as a template and is joined by its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._store import written

WINDOW = 8
LEAST_WINDOWS = 3  # on one diagonal: ten tokens
SHORTEST = 5

# Units that count as such after a number
UNITS = """mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours
day days week weeks month months year years percent usd eur dollar dollars euro euros cent cents mph kmh kw kwh w v hz""".split()


def raw_tokens(text: Column) -> Column:
    """Runs of letters and digits, split where a digit meets a letter; a number keeps its points and commas, as `#`; a name starts with `#`.

    A name is a capitalised word after a word, a comma or a semicolon: not at the start of a sentence.
    """
    t = F.translate(F.coalesce(text, F.lit("")), "#", " ")
    # patterns start with what is rare or cheap to test; what stands before is looked at last
    t = F.regexp_replace(t, r"(\s)(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;]\s)", "$1#")
    t = F.regexp_replace(t, r"([0-9])(?=\p{L})", "$1 ")
    t = F.regexp_replace(t, r"[.,](?=[0-9])(?<=[0-9].)", "#")
    return F.filter(F.split(t, r"[^\p{L}\p{N}#]+"), lambda w: w != "")


def template_tokens(raw: Column) -> Column:
    def placeholder(w: Column, i: Column) -> Column:
        digit = lambda x: F.ascii(x).between(48, 57)
        lower = F.lower(w)
        return F.when(F.ascii(w) == 35, "#p").when(digit(w), "#n").when((i > 0) & digit(F.get(raw, i - 1)) & lower.isin(UNITS), "#u").otherwise(lower)

    return F.transform(raw, placeholder)


def _windows(tokens: Column, hashes: Column, size: int, values: Column | None = None) -> Column:
    """Hash of each run of `size` tokens, from the hashes of the tokens; with `values`, of those where half are placeholders."""
    n = F.size(tokens)
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    by_template = lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])
    if values is None:
        return F.transform(starts, by_template)
    slots = lambda i: sum((F.get(tokens, i + k).startswith("#").cast("int") for k in range(size)), F.lit(0))
    by_values = lambda i: F.xxhash64(*[F.get(values, i + k) for k in range(size)])
    return F.transform(starts, lambda i: F.when(2 * slots(i) < size, by_template(i)).otherwise(by_values(i)))


def value_hashes(raw: Column) -> Column:
    return F.transform(raw, lambda w: F.xxhash64(F.lit("value"), F.lower(w)))


def item_windows(items: DataFrame) -> DataFrame:
    """(size, hash, item_id, at, dense, windows) of every item of at least `SHORTEST` tokens.

    Windows that are half placeholders or more are left out, unless all windows of the item are: then they are hashed with their values and `dense`.
    """
    rows = items.select("item_id", raw_tokens(F.col("text")).alias("raw")).withColumn("tokens", template_tokens(F.col("raw")))
    size = F.least(F.size("tokens"), F.lit(WINDOW))
    rows = rows.withColumn("size", size).where(F.col("size") >= SHORTEST).withColumn("values", value_hashes(F.col("raw")))
    rows = rows.select("item_id", "tokens", "values", "size", F.posexplode(F.sequence(F.lit(1), F.size("tokens") - F.col("size") + 1)).alias("at", "from"))
    run = F.slice("tokens", F.col("from"), F.col("size"))
    slots = F.size(F.filter(run, lambda w: w.startswith("#")))
    dense = 2 * slots >= F.col("size")
    hashes = F.when(dense, F.slice("values", F.col("from"), F.col("size"))).otherwise(F.transform(run, lambda w: F.xxhash64(w)))
    rows = rows.select("item_id", "size", "at", dense.alias("dense"), hashes.alias("hashes"))
    hash_of = F.coalesce(*[F.when(F.col("size") == k, F.xxhash64(*[F.get("hashes", F.lit(i)) for i in range(k)])) for k in range(SHORTEST, WINDOW + 1)])
    of_item = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("dense")).alias("sparse"))
    rows = rows.select("item_id", "size", "at", "dense", hash_of.alias("hash")).join(of_item, "item_id").where(~F.col("dense") | (F.col("sparse") == 0))
    return rows.select("size", "hash", "item_id", "at", "dense", F.when(F.col("dense"), F.col("all")).otherwise(F.col("sparse")).alias("windows"))


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, item_id, matched, windows, first_token, slots, replaced), one for each leaking document and item.

    Leaks are `LEAST_WINDOWS` matching windows on one diagonal, or all windows of an item that has fewer, with every value of a
    kind of placeholder always standing for the same value, and no two for one (`replaced`: how many stand for another one). Null and empty texts leak
    nothing; an item that is half placeholders in every window is found with its own values only; items without `SHORTEST` tokens cannot be found; equal rows give one row, rows with one id and different texts a row each
    by text hash. `docs` (doc_id, text) and `items` (item_id, text) may have other columns. A text is cut to tokens in its own row, whatever
    its length; of several leaks of an item in a text the one with most windows counts, then the first. The windows of the
    items and the matches are written tables, so Spark knows their size when it chooses how to join.
    """
    items = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    known = written(item_windows(items), "item-windows")
    docs = docs.select("doc_id", F.col("text").alias("text"), F.xxhash64("text").alias("text_hash"))
    kinds = known.select("size", "dense").distinct().collect()  # at most two for each size up to WINDOW
    sizes, valued = {r["size"] for r in kinds}, {r["size"] for r in kinds if r["dense"]}
    # a column of its own for each step: inside lambdas it is read for every token
    templates = docs.select("doc_id", "text_hash", raw_tokens(F.col("text")).alias("raw"))
    templates = templates.select("doc_id", "text_hash", template_tokens(F.col("raw")).alias("tokens"), *[value_hashes(F.col("raw")).alias("values")] * bool(valued))
    templates = templates.withColumn("hashes", F.transform("tokens", lambda w: F.xxhash64(w)))
    by_size = [F.struct(F.lit(s).cast("int").alias("size"), _windows(F.col("tokens"), F.col("hashes"), s, F.col("values") if s in valued else None).alias("seen")) for s in sorted(sizes) or [WINDOW]]
    seen = templates.select("doc_id", "text_hash", F.inline(F.array(*by_size))).select("doc_id", "text_hash", "size", F.posexplode("seen").alias("doc_at", "hash"))
    hits = seen.join(known, ["size", "hash"])
    diagonal = (F.col("doc_at") - F.col("at")).alias("shift")
    runs = hits.groupBy("doc_id", "text_hash", "item_id", "windows", "size", diagonal).agg(F.countDistinct("at").alias("matched"), F.min("at").alias("low"), F.max("at").alias("high"))
    runs = written(runs.where(F.col("matched") >= F.least("windows", F.lit(LEAST_WINDOWS))), "runs")  # read twice; the documents are tokenized once

    texts = docs.join(runs.select("text_hash").distinct(), "text_hash", "left_semi").dropDuplicates(["doc_id", "text_hash"])
    texts = texts.select(F.col("doc_id").alias("its_id"), "text_hash", raw_tokens(F.col("text")).alias("doc_raw"))
    asked = items.select("item_id", raw_tokens(F.col("text")).alias("item_raw"))
    both = runs.join(texts, ["text_hash"]).where(F.col("doc_id").eqNullSafe(F.col("its_id"))).join(asked, "item_id")
    both = both.withColumns({"doc_tokens": template_tokens(F.col("doc_raw")), "item_tokens": template_tokens(F.col("item_raw"))})
    places = F.sequence(F.col("low"), F.col("high") + F.col("size") - 1)
    slot = lambda i: F.get("item_tokens", i).startswith("#") & (F.get("item_tokens", i) == F.get("doc_tokens", i + F.col("shift")))
    pairs = F.transform(F.filter(places, slot), lambda i: F.struct(F.get("item_tokens", i).alias("kind"), F.get("item_raw", i).alias("was"), F.get("doc_raw", i + F.col("shift")).alias("now")))
    both = both.withColumn("pairs", F.array_distinct(pairs))
    different = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p[side]))))
    consistent = (F.size("pairs") == different("was")) & (F.size("pairs") == different("now"))
    replaced = F.size(F.filter("pairs", lambda p: p["was"] != p["now"]))
    leaks = both.where(consistent).select("doc_id", "text_hash", "item_id", "matched", "windows", (F.col("low") + F.col("shift")).cast("long").alias("first_token"), F.size("pairs").cast("long").alias("slots"), replaced.cast("long").alias("replaced"))
    best = F.max(F.struct("matched", (-F.col("first_token")).alias("early"), "windows", "slots", "replaced"))
    out = leaks.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b"))
    return out.select("doc_id", "text_hash", "item_id", "b.matched", "b.windows", (-F.col("b.early")).alias("first_token"), "b.slots", "b.replaced")
