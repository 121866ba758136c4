"""Phrase collocations of each language by best-first growth with exact bounds.

A phrase of two to five words is worth its weakest cut, 1000 * a * n / (l * r). Whatever follows a first word w, l of the first cut is
f(w) and r is at least a, so no phrase that starts with w is worth more than 1000 * n / f(w): the rarest first words, of those frequent
enough, bound the most. Each round takes the next first words of every language in that order and grows their
phrases word by word, keeping prefixes that occur `least` times. A language is settled when its `top`-th surviving score is above the bound of all
first words left, so that not even a tie can come from them; the others go on with more words.

Texts are tokenised once, into written blocks of word numbers, and the counts of frequent words go back to the blocks. A pass over the
blocks counts grams whose prefix is in a set of at most `KEYS` keys, sent to the tasks; a larger set takes more
passes. One more pass counts the right-hand parts of the cuts and looks at the neighbours of each phrase: a longer phrase is
as frequent only if every occurrence has the same word on one side.

Words and phrases are known by 64-bit hashes; equal hashes of different phrases are not told apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ._ids import slices
from ._store import written

LONGEST = 5
BLOCK = 2_000_000  # words of a block, after which it ends at the next break
AT_ONCE = 500_000  # places of a block that are looked at at once
KEYS = 1 << 20  # prefixes or phrases that one pass looks for: 8 MB
ONE = {"batch_rows": 1, "read_rows": 1}  # blocks are large rows: a task decodes and sends them one by one, however many its files hold
EXACT = 1 << 20  # frequencies up to this are told apart when first words are dealt to rounds
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n\n ")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a prefix and the word after it."""
    x = prefix.view(np.uint64) * _A + word.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return (x ^ (x >> np.uint64(32))).view(np.int64)


class _Codes(dict):
    """Numbers of words in order of first use; 0 is a break and None stands for no word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self) - 1
        return code


def _parts(text: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """`text` in parts of about `size` bytes that end where a word does, before a break if one comes within another `size` bytes."""
    at = 0
    for end in range(size, len(text), size):
        if end <= at:
            continue
        cut = text.find(b"\n", end, end + size)
        if cut < 0:
            cut = text.find(b" ", end)
        if cut >= 0:
            yield text[at:cut]
            at = cut
    yield text[at:]


def _blocks(docs: DataFrame) -> DataFrame:
    """Written blocks: block, lang, words and their counts, codes (from 1 the word's place, 0 a break between pieces)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_blocks: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for lang, (codes, rows) in open_blocks.items():
                words = np.concatenate(rows)
                counts = np.bincount(words, minlength=len(codes) - 1)[1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([lang]), pa.array([[w for w in codes if w not in (b"", b"\n")]], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int32()))],
                    ["block", "lang", "words", "counts", "codes"],
                )
                number += 1
            open_blocks.clear()

        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for part in _parts(text.lower().translate(_BREAKS)):
                    if held > BLOCK and part[:1] == b"\n":
                        yield from flush()
                        held = 0
                    codes, rows = open_blocks.setdefault(lang, (_Codes(), []))
                    found = part.replace(b"\n", b" \n ").split(b" ")
                    found = np.fromiter(map(codes.__getitem__, found), np.int32, len(found))
                    rows.append(found[found >= 0])
                    held += len(rows[-1])
                rows.append(np.zeros(1, np.int32))
            if held > BLOCK:
                yield from flush()
                held = 0
        yield from flush()

    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return written(docs.mapInArrow(build, "block long, lang string, words array<binary>, counts array<long>, codes array<int>"), "blocks", batch_rows=2000)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, int, int]]:
    """(lang, ids, frequencies, first, end) of stretches of blocks, word by word; both 0 for breaks and rare words.

    Phrases that start at `first` up to `end` are the stretch's own; a word before and the words after them are there to be looked at.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            codes = one.column(1).flatten().to_numpy()
            known = one.column(2).flatten()
            ids, often = np.zeros((2, int(codes.max(initial=0)) + 1), np.int64)
            code, id_, f = (c.to_numpy(zero_copy_only=False) for c in known.flatten())
            ids[code], often[code] = id_, f
            for at in range(0, len(codes), AT_ONCE):
                first, end = min(at, 1), min(AT_ONCE, len(codes) - at)
                some = codes[at - first : at + end + LONGEST]
                yield one.column(0)[0].as_py(), ids[some], often[some], first, first + end


def _inside(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of `keys` are in the sorted array `wanted`."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def _counted(parent: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (parent, last) and how often each occurs."""
    _, first, n = np.unique(_mix(parent, last), return_index=True, return_counts=True)
    return parent[first], last[first], n


def _in_passes(keys: DataFrame, run: Callable[[np.ndarray], DataFrame]) -> DataFrame | None:
    """`run` over sorted arrays of at most KEYS or so of the column `key`, results put together."""
    keys = written(keys.select("key").distinct(), "keys")
    passes = -(-keys.count() // KEYS)
    done = None
    for i in range(passes):
        some = keys.where(F.pmod(F.hash("key"), F.lit(passes)) == i)
        found = run(np.sort(np.asarray(some.toArrow().column(0).to_numpy(), np.int64)))
        done = found if done is None else done.unionByName(found)
    return done


def _grown(blocks: DataFrame, size: int, window: dict[str, tuple[int, int]], prefixes: DataFrame | None, least: int) -> DataFrame | None:
    """Written (parent, last, f): phrases of `size` words with a first word of the round, a known prefix and `least` occurrences."""

    def counting(wanted: np.ndarray | None) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for lang, ids, often, first, end in _arrays(batches):
                low, high = window.get(lang, (0, 0))
                at = first + np.flatnonzero((often[first:end] > low) & (often[first:end] <= high))
                at = at[at <= len(ids) - size]
                for k in range(1, size):
                    at = at[ids[at + k] != 0]
                parent = ids[at]
                for k in range(1, size - 1):
                    parent = _mix(parent, ids[at + k])
                if wanted is not None:
                    hit = _inside(parent, wanted)
                    at, parent = at[hit], parent[hit]
                found = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _counted(parent, ids[at + size - 1])], ["parent", "last", "f"])
                yield from slices([found], rows=100_000)

        return blocks.mapInArrow(count, "parent long, last long, f long")

    found = counting(None) if prefixes is None else _in_passes(prefixes, counting)
    if found is None:
        return None
    return written(found.groupBy("parent", "last").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "grown", **ONE)


def _keyed(phrases: DataFrame) -> DataFrame:
    """`phrases` with `key` of the whole and `rests`, the keys of what is left behind each cut."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(b.schema.get_field_index("words"))
            if not b.num_rows:
                continue
            each = words.flatten().to_numpy().reshape(b.num_rows, -1)
            keys = []
            for k in range(each.shape[1]):
                keys.append(each[:, k].copy())
                for j in range(k + 1, each.shape[1]):
                    keys[-1] = _mix(keys[-1], each[:, j].copy())
            rests = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * (len(keys) - 1), pa.int32()), pa.array(np.column_stack(keys[1:]).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys[0]), rests], [*b.schema.names, "key", "rests"])

    return phrases.mapInArrow(key, "lang string, words array<long>, lefts array<long>, f long, key long, rests array<long>")


def _seen(blocks: DataFrame, phrases: DataFrame) -> DataFrame | None:
    """(key, f, closed) of phrases and of their parts, of two to four words: how often, and whether one neighbour is always the same word."""
    parts = phrases.where(F.size("words") < LONGEST).select("key").union(phrases.select(F.explode(F.expr("slice(rests, 1, size(rests) - 1)")).alias("key")))

    def counting(wanted: np.ndarray) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, ids, _, first, end in _arrays(batches):
                at = first + np.flatnonzero(ids[first:end])
                key = ids[at]
                for size in range(2, LONGEST):
                    stay = at <= len(ids) - size
                    at, key = at[stay], key[stay]
                    stay = ids[at + size - 1] != 0
                    at = at[stay]
                    key = _mix(key[stay], ids[at + size - 1])
                    hit = _inside(key, wanted)
                    here, mine = at[hit], key[hit]
                    order = np.argsort(mine, kind="stable")
                    here, mine = here[order], mine[order]
                    begin = np.flatnonzero(np.diff(mine, prepend=mine[:1] - 1)) if len(mine) else np.zeros(0, np.int64)
                    if not len(begin):
                        continue
                    sides = [np.where(here > 0, ids[here - 1], 0), np.where(here + size < len(ids), ids[np.minimum(here + size, len(ids) - 1)], 0)]
                    ends = [f.reduceat(s, begin) for s in sides for f in (np.minimum, np.maximum)]
                    n = np.diff(np.append(begin, len(mine)))
                    yield pa.RecordBatch.from_arrays([pa.array(mine[begin]), pa.array(n, pa.int64()), *map(pa.array, ends)], ["key", "f", "b0", "b1", "a0", "a1"])

        return blocks.mapInArrow(count, "key long, f long, b0 long, b1 long, a0 long, a1 long")

    found = _in_passes(parts, counting)
    if found is None:
        return None
    found = found.groupBy("key").agg(F.sum("f").alias("f"), F.min("b0").alias("b0"), F.max("b1").alias("b1"), F.min("a0").alias("a0"), F.max("a1").alias("a1"))
    return found.select("key", "f", F.expr("(b0 = b1 AND b0 <> 0) OR (a0 = a1 AND a0 <> 0)").alias("closed"))


def _survivors(blocks: DataFrame, vocabulary: DataFrame, totals: DataFrame, window: dict[str, tuple[int, int]], least: int) -> DataFrame | None:
    """Written (lang, words, a, l, r, n, score): surviving phrases that start with a word of the round."""
    found, prefixes = [], None
    for size in range(2, LONGEST + 1):
        grown = _grown(blocks, size, window, prefixes, least)
        if grown is None:
            break
        if prefixes is None:
            before = vocabulary.select("lang", F.col("id").alias("parent"), F.array("id").alias("before"), F.array("f").alias("lefts"))
        else:
            before = prefixes.select("lang", F.col("key").alias("parent"), F.col("words").alias("before"), F.concat("lefts", F.array("f")).alias("lefts"))
        phrases = grown.join(before, "parent").select("lang", F.concat("before", F.array("last")).alias("words"), "lefts", "f")
        prefixes = written(_keyed(phrases), "phrases")
        found.append(prefixes)
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    seen = _seen(blocks, phrases)
    if seen is None:
        return None
    seen = written(seen, "seen", **ONE)
    rights = seen.select("key", "f").unionByName(vocabulary.select(F.col("id").alias("key"), "f")).withColumnsRenamed({"key": "rest", "f": "r"})
    cuts = phrases.select("lang", "key", "words", F.col("f").alias("a"), "lefts", F.posexplode("rests").alias("at", "rest")).join(rights, "rest").join(totals, "lang")
    a, n, l, r = (F.expr(f"cast({c} AS decimal(19, 0))") for c in ("a", "n", "lefts[at]", "r"))
    cuts = cuts.withColumns({"l": F.expr("lefts[at]"), "over": a * n * F.lit(1000).cast("decimal(4, 0)"), "under": l * r}).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "key", "words", "a", "n").agg(F.min(F.struct("score", "at", "l", "r")).alias("best"))
    best = best.join(seen.where("closed").select("key"), "key", "left_anti") if LONGEST > 2 else best
    return written(best.select("lang", "words", "a", "best.l", "best.r", "n", "best.score"), "survivors")


def mine(docs: DataFrame, least: int = 100, top: int = 2000, first_words: int = 1 << 15, growth: int = 4) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Columns lang and text are read, others are not looked at. Null texts are empty; a null language counts as `und`. Rows
    that repeat count as often as they stand there. Ties in score and frequency are ordered by the bytes of the phrase, so ranks are
    unique. A text without words, an empty table, or a language without frequent phrases gives no row. A piece without breaks stays
    in one block, four bytes a word, whatever its length. `first_words` and `growth` set how many first words a round takes, not the result.
    """
    spark = docs.sparkSession
    blocks = _blocks(docs)
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "word"))
    counts = words.groupBy("lang", F.col("word.words").alias("word")).agg(F.sum("word.counts").alias("f"))
    vocabulary = written(counts.where(F.col("f") >= least).withColumn("id", F.xxhash64("lang", "word")), "vocabulary", **ONE)
    totals = written(blocks.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (s, x) -> s + x)")).alias("n")), "totals", **ONE)
    everywhere = F.sum("word.counts").over(W.partitionBy("lang", "word.words"))  # a narrow row for each block that has the word
    known = words.select("block", (F.col("at") + 1).alias("code"), F.xxhash64("lang", "word.words").alias("id"), everywhere.alias("f")).where(F.col("f") >= least)
    known = known.groupBy("block").agg(F.collect_list(F.struct("code", "id", "f")).alias("known"))  # at most the distinct words of a block
    grams = written(blocks.select("block", "lang", "codes").join(known, "block").select("lang", "codes", "known"), "grams", **ONE)
    # first words of each language by frequency, rarest first, with the number of words up to there
    steps = vocabulary.groupBy("lang", F.least("f", F.lit(EXACT)).alias("step")).agg(F.count(F.lit(1)).alias("words"))
    steps = written(steps.withColumn("words", F.sum("words").over(W.partitionBy("lang").orderBy("step"))), "steps")

    size = {r["lang"]: r["n"] for r in totals.collect()}  # a row for each language
    reached = {r["lang"]: 0 for r in steps.select("lang").distinct().collect()}
    found, taken, everything = None, first_words, (1 << 63) - 1
    while reached:
        stops = steps.where((F.col("words") >= taken) & (F.col("step") < EXACT)).groupBy("lang").agg(F.min("step").alias("step"))
        stops = {r["lang"]: r["step"] for r in stops.collect()}
        window = {lang: (low, stops.get(lang, everything)) for lang, low in reached.items()}
        survivors = _survivors(grams, vocabulary, totals, window, least)
        if survivors is not None:
            found = survivors if found is None else found.unionByName(survivors)
        settled = {lang for lang, (_, high) in window.items() if high == everything}
        if found is not None and len(settled) < len(window):
            nth = found.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score")))).where(F.col("nth") <= top)
            for r in nth.where(F.col("nth") == top).select("lang", "score").collect():
                if r["lang"] in window and r["score"] > 1000 * size[r["lang"]] // (window[r["lang"]][1] + 1):
                    settled.add(r["lang"])
        reached = {lang: high for lang, (_, high) in window.items() if lang not in settled}
        taken *= growth
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if found is None:
        return spark.createDataFrame([], schema)
    by_worth = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    ahead = written(found.withColumn("place", F.rank().over(by_worth)).where(F.col("place") <= top), "ahead")  # ties at the end included
    spelled = ahead.select("lang", "words", F.posexplode("words").alias("at", "id")).join(vocabulary.select("id", F.col("word").cast("string").alias("word")), "id")
    spelled = spelled.groupBy("lang", "words").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    ranked = ahead.join(spelled, ["lang", "words"]).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
