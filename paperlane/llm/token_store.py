"""Token ids in binary shards: every document compressed alone with one shared zstandard dictionary.

A shard file holds a head (magic, SHA-256 of the dictionary), one zstandard frame for each document, and
an index of columns (doc_id, offset, length, tokens), found through the last 16 bytes. A short document
is read by one seek and decompressed without its neighbours. Shards are written under temporary names and
renamed; a manifest, written last, names the shards in order with the ids before each.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._ids import encoder, slices
from ._store import file_system, put_file

MAGIC = b"IDSHARD1"
#: doc_id, whether it is null, offset and length of the frame, tokens
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("length", "<u8"), ("tokens", "<u8")])


def _packed(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def train_dictionary(docs: DataFrame, tokenizer: str, samples: int = 512, sample_ids: int = 4096, size: int = 65536, width: int = 2) -> bytes:
    """A dictionary from the serialized ids of at most `samples` documents, those of the smallest hash of id and text.

    The sample is the only thing in the format that does not see every row, and only the size of the
    frames depends on it. Too little text for training gives the raw bytes of the sample.
    """
    order = F.xxhash64("doc_id", "text")
    # hashes alone are ranked, so that tasks send no texts that are not in the sample
    first = docs.select(order.alias("h")).orderBy("h").limit(samples).collect()
    chosen = docs.where(order <= (first[-1]["h"] if first else 0)).select(order.alias("h"), F.substring(F.coalesce("text", F.lit("")), 1, 8 * sample_ids).alias("t"))
    texts = [r["t"] for r in chosen.dropDuplicates(["h"]).orderBy("h").limit(samples).collect()]
    arrays = [_packed(x[: 4 * sample_ids], width) for x in encoder(tokenizer).encode([t for t in texts if t])] if texts else []
    arrays = [x for x in arrays if x]
    try:
        return zstandard.train_dictionary(size, arrays, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError, ZeroDivisionError):
        return b"".join(arrays)[:size]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, level: int = 3) -> dict:
    """Encode `text` (null: empty) of every row, append `end_id`, write shards in ascending doc_id order.

    Columns other than doc_id and text are not looked at. Null ids come first; rows that repeat an id follow
    each other by text; an empty table gives a manifest without shards. Documents are range-sorted by id, so
    a shard is one task's range and no task holds more than one document's ids and its index.
    Returns the manifest.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 65536 else 4
    words = train_dictionary(docs, tokenizer, width=width)
    digest = hashlib.sha256(words).hexdigest()
    filesystem, path = file_system(folder)
    filesystem.create_dir(path)
    put_file(filesystem, f"{path}/{digest}.dictionary", words)
    end = struct.pack("<I", end_id)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        files, where = file_system(folder)
        name, index, at, total = f"shard-{number:06d}.ids", [], len(MAGIC) + 32, 0
        temporary = f"{where}/{name}.{TaskContext.get().taskAttemptId()}.tmp"
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        code, out = encoder(tokenizer), None
        for batch in slices(batches):
            if out is None:
                out = files.open_output_stream(temporary)
                out.write(MAGIC + bytes.fromhex(digest))
            for doc, ids in zip(batch.column(0).to_pylist(), code.encode([t or "" for t in batch.column(1).to_pylist()])):
                frame = press.compress(_packed(ids + end, width))
                tokens = len(ids) // 4 + 1
                index.append((doc or 0, doc is None, at, len(frame), tokens))
                out.write(frame)
                at, total = at + len(frame), total + tokens
        if out is None:
            return
        out.write(np.array(index, INDEX).tobytes() + struct.pack("<Q", len(index)) + MAGIC)
        out.close()
        files.move(temporary, f"{where}/{name}")
        yield pa.RecordBatch.from_pydict({"number": [number], "name": [name], "documents": [len(index)], "tokens": [total]})

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(shard, "number long, name string, documents long, tokens long").collect()  # a row for each shard
    shards, start = [], 0
    for r in sorted(rows, key=lambda r: r["number"]):
        shards.append({"name": r["name"], "documents": r["documents"], "tokens": r["tokens"], "start": start})
        start += r["tokens"]
    manifest = {"dictionary": digest, "width": width, "shards": shards}
    put_file(filesystem, f"{path}/manifest.json", json.dumps(manifest).encode())
    return manifest


def open_shard(folder: str, name: str, dictionary: str, width: int):
    """(index, function that gives the ids of index row i) of one shard; reads only what is asked for."""
    files, where = file_system(folder)
    file = files.open_input_file(f"{where}/{name}")
    head = file.read_at(len(MAGIC) + 32, 0)
    if head[: len(MAGIC)] != MAGIC or head[len(MAGIC) :].hex() != dictionary:
        raise ValueError(f"{name} was written with another dictionary")
    tail = len(MAGIC) + 8
    (count,) = struct.unpack("<Q", file.read_at(8, file.size() - tail))
    index = np.frombuffer(file.read_at(count * INDEX.itemsize, file.size() - tail - count * INDEX.itemsize), INDEX)
    with files.open_input_stream(f"{where}/{dictionary}.dictionary") as f:
        words = f.read()
    if hashlib.sha256(words).hexdigest() != dictionary:
        raise ValueError("the dictionary's hash differs")
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)

    def ids(i: int) -> np.ndarray:
        raw = unpress.decompress(file.read_at(int(index["length"][i]), int(index["offset"][i])))
        return np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")

    return index, ids


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids of every document in the files."""
    files, where = file_system(folder)
    with files.open_input_stream(f"{where}/manifest.json") as f:
        manifest = json.loads(f.read())
    rows = [(s["name"], s["start"]) for s in manifest["shards"]]
    listing = spark.createDataFrame(rows, "name string, start long").repartition(max(1, len(rows)))
    dictionary, width = manifest["dictionary"], manifest["width"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index, ids = open_shard(folder, name, dictionary, width)
                starts = start + np.cumsum(index["tokens"].astype(np.int64)) - index["tokens"].astype(np.int64)
                for at in range(0, len(index), 500):
                    part = index[at : at + 500]
                    values = [ids(i) for i in range(at, at + len(part))]
                    if any(len(v) != n for v, n in zip(values, part["tokens"])):
                        raise ValueError(f"{name} is damaged")
                    out = {
                        "doc_id": pa.array(part["doc_id"], mask=part["null"].astype(bool)),
                        "start": pa.array(starts[at : at + 500]),
                        "n_tokens": pa.array(part["tokens"].astype(np.int64)),
                        "ids_crc32": pa.array([zlib.crc32(v.tobytes()) for v in values], pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.array([v.astype(np.int64) for v in values], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    return listing.mapInArrow(read, schema)
