"""Packing along a space-filling curve.

Each document is hashed to a vector of signed counts of its token ids, projected to a few dimensions, and placed on a
Hilbert curve; documents are range-sorted by their place, so like follows like. The sorted ids are one stream,
cut every `length` ids; what is left at the end is cut at powers of two. So no sequence needs padding, and
neighbours on the curve share sequences.

Texts are encoded once: their ids stand in the written table of places, two bytes each if the vocabulary allows it, and
only the ids meet the sorted starts.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ._ids import encoder, slices
from ._store import written

DIMENSIONS, BITS, BUCKETS = 4, 10, 64
TEXTS_AT_ONCE = 2000  # rows with a text that go to Python together


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned grid coordinates (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@functools.cache
def _planes() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((BUCKETS, DIMENSIONS))


def project(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A point for each document: signed counts of its hashed ids, damped and of length one, on a few fixed planes."""
    n = len(bounds) - 1
    bucket = ((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % (2 * BUCKETS)
    bucket += np.repeat(np.arange(n) * (2 * BUCKETS), np.diff(bounds))
    counts = np.bincount(bucket, minlength=n * 2 * BUCKETS).reshape(n, 2 * BUCKETS)
    vectors = (counts[:, :BUCKETS] - counts[:, BUCKETS:]).astype(float)
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9) @ _planes()


def running_start(df: DataFrame, order: list[str], size: str) -> tuple[DataFrame, int]:
    """`df` with column `start`, the sum of `size` over all rows before in `order`, and the sum over all rows.

    Rows are range-sorted into a written table with the number of their range; totals of ranges come to the driver,
    one small row for each range.
    """
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = 0
        for b in batches:
            values = b.column(b.schema.names.index(size)).to_numpy()
            start = before + np.cumsum(values) - values
            before += int(values.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start, pa.int64()), pa.array(np.full(b.num_rows, part), pa.int32())], [*b.schema.names, "start", "range_no"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", start long, range_no int"
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema)
    ranges = written(ranges, "ranges")
    totals, before = [], 0
    for r in sorted(ranges.groupBy("range_no").agg(F.sum(size).alias("n")).collect()):
        totals.append((r["range_no"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(totals, "range_no int, earlier long")
    joined = ranges.join(F.broadcast(offsets), "range_no")  # a row for each range
    return joined.select(*df.columns, (F.col("start") + F.col("earlier")).alias("start")), before


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of `length` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty: their end id alone is packed. Rows that repeat an id, or whole rows, are packed each for
    itself, ties on the curve by id and text hash. Columns other than doc_id and text are not looked at; an empty table gives
    no piece. With `with_ids` each piece carries its ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    width = encoder(tokenizer).width

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for b in slices(batches, rows=TEXTS_AT_ONCE, size=4 << 20):
            ids, bounds = code.encode_flat(b.column(2))
            sizes = np.diff(bounds) + 1
            at = project(ids, bounds)
            ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((bounds * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), *(pa.array(at[:, d]) for d in range(DIMENSIONS)), ids], ["doc_id", "text_hash", "doc_tokens", *(f"p{d}" for d in range(DIMENSIONS)), "ids"])

    schema = "doc_id long, text_hash long, doc_tokens long" + "".join(f", p{d} double" for d in range(DIMENSIONS)) + ", ids binary"
    placed = written(docs.select("doc_id", "text_hash", "text").mapInArrow(place, schema), "placed", TEXTS_AT_ONCE)
    stats = placed.agg(*(f(f"p{d}") for d in range(DIMENSIONS) for f in (F.avg, F.stddev_pop))).first()
    middle = [(stats[2 * d] or 0.0, stats[2 * d + 1] or 1.0) for d in range(DIMENSIONS)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = np.frompyfunc(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), 1, 1)  # of a normal distribution below z
        for b in batches:
            z = np.column_stack([(b.column(3 + d).to_numpy() - m) / s for d, (m, s) in enumerate(middle)])
            grid = np.minimum(share(np.round(z, 6)).astype(float) * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(hilbert_key(grid, BITS))], ["doc_id", "text_hash", "doc_tokens", "curve"])

    rows = placed.drop("ids").mapInArrow(keyed, "doc_id long, text_hash long, doc_tokens long, curve long")
    rows = rows.groupBy("doc_id", "text_hash", "doc_tokens", "curve").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("size", F.col("doc_tokens") * F.col("times"))
    starts, total = running_start(rows, ["curve", "doc_id", "text_hash"], "size")
    # one key of plain columns for the join and for the numbers of equal rows, so the ids are shuffled once
    key = [F.coalesce("doc_id", F.lit(0)).alias("id_or_0"), F.col("doc_id").isNull().alias("no_id"), "text_hash"]
    key_names = ["id_or_0", "no_id", "text_hash"]
    starts = starts.select(*key, "doc_tokens", "start")
    nth = F.row_number().over(W.partitionBy(*key_names).orderBy("start")) - 1
    at = placed.select(*key, "ids").join(starts, key_names)
    at = at.select(F.when(~F.col("no_id"), F.col("id_or_0")).alias("doc_id"), "ids", (F.col("start") + nth * F.col("doc_tokens")).alias("start"))
    # whole sequences, then the powers of two that the rest is made of
    whole, rest = divmod(total, length)
    cuts = [whole * length]
    for b in range(rest.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            cuts.append(cuts[-1] + (1 << b))
    tail = np.array(cuts[1:], np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            rows, pieces = [], []
            for doc, ids, begin in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids = np.frombuffer(ids, width).astype("<u4").tobytes() + end
                n = len(ids) // 4
                inner = np.arange((begin // length + 1) * length, min(begin + n, whole * length + 1), length)
                edges = [begin, *(int(x) for x in inner if x < begin + n), *(int(x) for x in tail if max(begin, whole * length) < x < begin + n), begin + n]
                for low, high in zip(edges, edges[1:]):
                    k = int(np.searchsorted(tail, low, "right"))
                    sequence, first = (low // length, low // length * length) if low < whole * length else (whole + k, cuts[k])
                    piece = ids[4 * (low - begin) : 4 * (high - begin)]
                    rows.append((doc, low - begin, high - low, zlib.crc32(piece), n, sequence, low - first))
                    pieces.append(piece)
            out = [pa.array(c, pa.int64()) for c in zip(*rows)]
            if with_ids:
                out.append(pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in pieces], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return at.mapInArrow(cut, schema + ", ids array<long>" * with_ids)
