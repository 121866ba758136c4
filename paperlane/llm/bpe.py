"""Byte-level BPE of whole texts by overlapping chunks, and back to bytes.

A text longer than a chunk is cut into chunks that run on into the next one. Chunks are pre-tokenised in parallel, each from its own
first character, so its first pre-tokens may be wrong. A pre-token depends on the text from its start on only, so two scans that have
one boundary in common agree ever after: neighbours are stitched at the first boundary that both have in their overlap. Chunks that
have none (a run of letters or blanks longer than the overlap) are joined and scanned again until all neighbours meet. The pieces
between the stitches are encoded on their own; their ids, put end to end, are those of the whole text. Decoding puts the
bytes of tokens end to end, in which a character may be split between tokens but never between pieces.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ._ids import slices
from ._store import written

CHUNK, OVERLAP = 1 << 16, 1 << 10  # characters
SEEN_BEHIND = 8  # characters behind a pre-token that may have a say in its end
PIECES = "doc_id long, row_key string, piece long, ids binary"


@functools.cache
def codec(ranks: str, pattern: str):
    """The tiktoken encoding of a file of ranks."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@functools.cache
def _class(name: str) -> str:
    """Ranges of the characters of a class such as `\\s`, asked of the engine that tiktoken splits with: versions of Unicode differ."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = bytes(tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}).encode_ordinary(every))
    codes = np.frombuffer(found.decode().encode("utf-32-le"), "<u4").astype(np.int64)
    cuts = np.flatnonzero(np.diff(codes) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[[0, *cuts + 1]].tolist(), codes[[*cuts, -1]].tolist()))


@functools.cache
def scanner(pattern: str) -> re.Pattern:
    """The pre-token pattern with its classes written out, for Python's own engine."""
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        if part.startswith(("\\p", "\\s")):
            out.append(_class(part) if inside else f"[{_class(part)}]")
        elif part == "\\S":
            out.append(f"[^{_class(chr(92) + 's')}]")
        else:
            inside = part == "[" or (inside and part != "]")
            out.append(part)
    return re.compile("".join(out))


def boundaries(text: str, pattern: str, ends: bool) -> np.ndarray:
    """Where pre-tokens of `text` start, 0 included; if the text goes on behind it (not `ends`), only those that cannot change."""
    found = np.array([0, *(m.end() for m in scanner(pattern).finditer(text))], np.int64)
    return found if ends else found[found <= max(0, len(text) - SEEN_BEHIND)]


def _cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of long texts: row_key, doc_id, chunk, next (null: the last), size up to the next chunk, text with the overlap."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key, starts = uuid.uuid4().hex, range(0, len(text), chunk)
                for many in (starts[i : i + 64] for i in range(0, len(starts), 64)):
                    yield pa.RecordBatch.from_pylist(
                        [{"row_key": key, "doc_id": doc, "chunk": at // chunk, "next": at // chunk + 1 if at + chunk < len(text) else None, "size": min(chunk, len(text) - at), "text": text[at : at + chunk + overlap]} for at in many],
                        pa.schema([("row_key", pa.string()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("next", pa.int64()), ("size", pa.int64()), ("text", pa.string())]),
                    )

    return docs.mapInArrow(cut, "row_key string, doc_id long, chunk long, next long, size long, text string")


def _stitched(chunks: DataFrame, pattern: str, overlap: int) -> DataFrame:
    """Chunks with `start` and `stop`, the piece of each that its own scan is right for."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = re.compile(f"[{_class(chr(92) + 's')}]")
        for b in slices(batches, 64):
            rows = []
            for key, number, following, size, text in zip(*(b.column(c).to_pylist() for c in ("row_key", "chunk", "next", "size", "text"))):
                at = boundaries(text, pattern, len(text) == size if following is None else len(text) < size + overlap)
                late = [int(x) - size for x in at[at >= size] if not blank.match(text, int(x) - 1)]
                rows.append({"row_key": key, "chunk": number, "next": following, "early": at[at <= overlap], "late": late})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("row_key", pa.string()), ("chunk", pa.int64()), ("next", pa.int64()), ("early", pa.list_(pa.int64())), ("late", pa.list_(pa.int64()))]))

    while True:
        chunks = written(chunks.repartition("row_key", "chunk"), "chunks")
        scans = written(chunks.drop("doc_id").mapInArrow(scan, "row_key string, chunk long, next long, early array<long>, late array<long>"), "scans")
        before = scans.select("row_key", F.col("next").alias("chunk"), "late")
        meet = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("early", "late")))
        meets = written(scans.drop("late").join(before, ["row_key", "chunk"], "left").select("row_key", "chunk", meet.alias("start")), "meets")
        if meets.where("start IS NULL").isEmpty():
            break
        order = W.partitionBy("row_key").orderBy("chunk")  # a small row for each chunk of one text
        heads = meets.select("row_key", "chunk", F.max(F.when(F.col("start").isNotNull(), F.col("chunk"))).over(order).alias("head"))
        parts = F.sort_array(F.collect_list(F.struct("chunk", "next", "size", "text")))
        joined = chunks.join(heads, ["row_key", "chunk"]).groupBy("row_key", "head").agg(F.first("doc_id").alias("doc_id"), parts.alias("parts"), F.sum("size").alias("size"))
        own = "concat(array_join(transform(slice(parts, 1, size(parts) - 1), p -> left(p.text, int(p.size))), ''), element_at(parts, -1).text)"
        chunks = joined.select("row_key", "doc_id", F.col("head").alias("chunk"), F.expr("element_at(parts, -1).next").alias("next"), "size", F.expr(own).alias("text"))
    after = meets.select("row_key", F.col("chunk").alias("next"), F.col("start").alias("over"))
    return chunks.join(meets, ["row_key", "chunk"]).join(after, ["row_key", "next"], "left").withColumn("stop", F.col("size") + F.coalesce("over", F.lit(0)))


def encode(docs: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Ids of the pieces of every text: doc_id, row_key, piece, ids (little-endian unsigned 32-bit integers).

    A text of at most `chunk` characters is one piece with a null row_key; the pieces of a longer one share a row_key and are in the order of
    `piece`. Null texts are empty and give one piece without ids. Rows that repeat an id, null ids and whole repeated rows are encoded
    each for itself; other columns are not looked at; an empty table gives no piece. A pre-token of any length is one unit of
    work: only a text without any boundary is encoded by one task.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be positive and no longer than a chunk")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(ranks, pattern)
        for b in slices(batches):
            texts = b.column(3).to_pylist()
            if b.num_columns > 4:
                texts = [t[start:stop] for t, start, stop in zip(texts, b.column(4).to_pylist(), b.column(5).to_pylist())]
            found = pa.array([np.asarray(code.encode_to_numpy(t, disallowed_special=()), "<u4").tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], found], ["doc_id", "row_key", "piece", "ids"])

    short = docs.where(F.length("text") <= chunk).select("doc_id", F.lit(None).cast("string").alias("row_key"), F.lit(0).cast("long").alias("piece"), "text")
    pieces = _stitched(_cut(docs.where(F.length("text") > chunk), chunk, overlap), pattern, overlap)
    pieces = pieces.select("doc_id", "row_key", F.col("chunk").alias("piece"), "text", "start", "stop")
    return short.mapInArrow(ids, PIECES).unionByName(pieces.mapInArrow(ids, PIECES))


def decode(pieces: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """`pieces` of `encode` with `raw`, the bytes their ids stand for, tokens put end to end."""

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(ranks, pattern)
        for b in slices(batches):
            found = pa.array([tokens.decode_bytes(np.frombuffer(i, "<u4").tolist()) for i in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "raw"])

    return pieces.select("doc_id", "row_key", "piece", "ids").mapInArrow(raw, PIECES + ", raw binary")


def digests(pieces: DataFrame) -> DataFrame:
    """A row for each document of `decode`: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Texts of one piece are hashed where they are. Pieces of longer ones are brought together in order and hashed one after
    the other, so a task holds a few pieces at a time, whatever the length of the text.
    """
    whole = pieces.where("row_key IS NULL").select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        key, doc, n, of_ids, of_raw = None, None, 0, None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([n], pa.int64()), pa.array([of_ids.hexdigest()]), pa.array([of_raw.hexdigest()])], names)

        for b in slices(batches, 16):
            for this, d, ids, raw in zip(*(b.column(c).to_pylist() for c in ("row_key", "doc_id", "ids", "raw"))):
                if this != key:
                    if key is not None:
                        yield row()
                    key, doc, n, of_ids, of_raw = this, d, 0, hashlib.sha256(), hashlib.sha256()
                n += len(ids) // 4
                of_ids.update(ids)
                of_raw.update(raw)
        if key is not None:
            yield row()

    parts = pieces.where("row_key IS NOT NULL").repartition("row_key").sortWithinPartitions("row_key", "piece")
    return whole.unionByName(parts.mapInArrow(fold, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
