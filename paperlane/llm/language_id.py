"""Language identification by bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of its n-grams; the filters lie side by side, one bit per language at each position, so
one lookup (the AND of a few rows) gives all languages that contain an n-gram. A text's n-grams are counted for each
language, corrected for the filter's false positives, and the largest count decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._ids import slices
from ._store import written

SIZES = (2, 3, 4)
HASHES = 4
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
WORDS_KEPT = 150_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def grams(word: str) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1)]


def words_of(text: str | None) -> list[str]:
    """Runs of letters; signs for numbers, which the pattern takes for letters, part them."""
    if not text:
        return []
    found = _WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


@dataclass
class Filters:
    languages: list[str]
    rows: np.ndarray  # position -> bits of languages, packed
    false_rate: np.ndarray  # of each language

    @classmethod
    def build(cls, languages: list[str], kept: list[tuple[str, str]]) -> Filters:
        """From (gram, language) pairs; 16 positions for each gram of the fullest language, at least."""
        most = max(Counter(lang for _, lang in kept).values(), default=1)
        size = 1 << max(10, (16 * most - 1).bit_length())
        bits = np.zeros((size, max(1, len(languages))), bool)
        number = {lang: i for i, lang in enumerate(languages)}
        if kept:
            at = positions(hashes_at(*laid_out([g for g, _ in kept])), size)
            bits[at.ravel(), np.repeat([number[lang] for _, lang in kept], HASHES)] = True
        return cls(languages, np.packbits(bits, axis=1), bits.mean(axis=0) ** HASHES)

    def languages_of(self, texts: list[str]) -> np.ndarray:
        """Row for each gram: 1 where the language's filter contains it."""
        return self.of_hashes(hashes_at(*laid_out(texts)))

    def of_hashes(self, hashes: np.ndarray) -> np.ndarray:
        found = self.rows[positions(hashes, len(self.rows))]
        return np.unpackbits(np.bitwise_and.reduce(found, axis=1), axis=1)[:, : max(1, len(self.languages))]


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in a row, where each text starts, and its length."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return codes, np.cumsum(sizes) - sizes, sizes


def hashes_at(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of `sizes` code points from `starts` on."""
    h = sizes.astype(np.uint64)
    for k in range(int(sizes.max(initial=0))):
        inside = sizes > k
        at = slice(None) if inside.all() else inside
        x = h[at] * _ODD[0] + codes[starts[at] + k]
        h[at] = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def positions(hashes: np.ndarray, size: int) -> np.ndarray:
    """The HASHES positions of each hash in a filter whose size is a power of two."""
    step = hashes >> np.uint64(33) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(size - 1) for i in range(HASHES)], axis=1).astype(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts of `docs` (text, lang)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        total: dict[str, Counter] = {}

        def fold() -> None:
            for lang, words in seen.items():
                into = total.setdefault(lang, Counter())
                for word, n in words.items():
                    for g in grams(word):
                        into[g] += n
            seen.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            fold()
            for lang, found in total.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found)), "gram": pa.array(list(found)), "n": pa.array(list(found.values()), pa.int64())})
            total.clear()

        for b in slices(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > WORDS_KEPT:
                fold()
            if sum(map(len, total.values())) > 400_000:
                yield from flush()
        yield from flush()

    return docs.select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, least_share: float = 1e-5, of_most: float = 0.5) -> Filters:
    """Filters from all rows of `docs` with text and lang.

    A gram belongs to a language if it makes up `least_share` of the language's grams and `of_most` of its largest share
    in any language. At most 1/least_share grams of a language can pass, which bounds what comes to the driver.
    """
    counted = written(count_grams(docs.where("text is not null and lang is not null")), "grams")  # read twice
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    if not totals:
        return Filters.build([], [])
    sizes = docs.sparkSession.createDataFrame(list(totals.items()), "lang string, total long")
    shares = counted.join(F.broadcast(sizes), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= of_most * least_share)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("all"))  # languages of a gram
    kept = most.select("gram", "most", F.inline("all")).where((F.col("share") >= least_share) & (F.col("share") >= of_most * F.col("most")))
    pairs = sorted((r["gram"], r["lang"]) for r in kept.select("gram", "lang").collect())
    return Filters.build(sorted(totals), pairs)


class Judge:
    """Counts for texts, each distinct word once."""

    def __init__(self, filters: Filters):
        self.filters = filters
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.hits = np.zeros((0, 1 + max(1, len(self.filters.languages))), np.int32)

    def add(self, words: list[str]) -> None:
        codes, starts, sizes = laid_out([f"_{w}_" for w in words])
        counts = np.zeros((len(words), 1), np.int32)
        sums = np.zeros((len(words), max(1, len(self.filters.languages))), np.int32)
        for n in SIZES:
            many = np.maximum(sizes - n + 1, 0)  # grams of n letters in each word
            edges = np.concatenate([[0], np.cumsum(many)])
            at = np.repeat(starts - edges[:-1], many) + np.arange(edges[-1])
            found = self.filters.of_hashes(hashes_at(codes, at, np.full(len(at), n)))
            before = np.vstack([np.zeros((1, found.shape[1]), np.int32), np.cumsum(found, axis=0, dtype=np.int32)])
            sums += before[edges[1:]] - before[edges[:-1]]
            counts += many[:, None].astype(np.int32)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.hits = np.vstack([self.hits, np.hstack([counts, sums])])

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [words_of(t) for t in texts]
        if not self.filters.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        missing = list(set().union(*words).difference(self.number))
        if len(self.number) + len(missing) > WORDS_KEPT:
            self.forget()
            missing = list(set().union(*words))
        if missing:
            self.add(sorted(missing))
        out = []
        for ws in words:
            if not ws:
                out.append((UNDETERMINED, 0.0))
                continue
            n, *hits = self.hits[np.fromiter(map(self.number.__getitem__, ws), np.int64, len(ws))].sum(axis=0, dtype=np.int64)
            true = np.clip((np.array(hits) - n * self.filters.false_rate) / (1 - np.minimum(self.filters.false_rate, 0.999)), 0, None)
            best = int(np.argmax(true))
            out.append((self.filters.languages[best], float(true[best] / true.sum()) if true.sum() > 0 else 0.0))
        return out


def predict(docs: DataFrame, filters: Filters, keep: list[str] = ["doc_id"], text: str = "text") -> DataFrame:
    """`keep` columns of every row with lang_pred and score (the language's part of all corrected counts).

    Only the column `text` is looked at, the whole of it; if it is kept, it travels once. Null texts and texts without a letter are `und` with score 0; repeated rows get equal
    answers; ties go to the first language by name, also that of a text whose n-grams no language has (score 0); without learned languages all are `und`.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double"
    spread = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the shares in learn()
    at = keep.index(text) if text in keep else len(keep)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(spread.value)
        for b in slices(batches):
            found = judge.judge(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([x for x, _ in found]), pa.array([s for _, s in found], pa.float64())], [*keep, "lang_pred", "score"])

    sent = keep if text in keep else [*keep, F.col(text).alias("_text")]
    return docs.select(*sent).mapInArrow(answer, schema)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo `folds`. Null ids never are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
