"""Deterministic sharded WARC files.

Records are range-sorted by page id and digest. Where shards begin is decided by the data alone: bytes are summed along
that order, and a shard begins at the first record beyond each equal share. Each shard is written by one task, which
starts a new file when the compressed size reaches a limit. Headers and digests are made anew from the payload, record ids are
derived from it, so the same rows give the same files on any cluster. Files get their name by renaming, and a manifest
with sizes and digests, written last, commits the archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from ._ids import slices
from ._store import file_system, put_file, written

SHARDS = 1 << 14  # at most; beyond them shards grow and hold more files
KEY = ["page_id", "digest", "url_hash"]
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (UTF-8 of html, null: empty), digest, size and url_hash of every row."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    return rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long"), "url_hash": F.xxhash64("url")})


def origins(rows: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, digest, refers_to) of the rows whose payload stands elsewhere; no payload is moved for it.

    Of rows with equal payloads of at least `least` bytes those with the largest page_id have no origin and the others
    have that id; smaller payloads have none. Null page_ids never are an origin.
    """
    rows = rows.where(F.col("size") >= least).select("page_id", "digest")
    last = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    return rows.distinct().join(last, "digest").where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))


def shard_starts(rows: DataFrame, shard_bytes: int) -> list[Row]:
    """Least keys of the shards after the first, in order; at most `SHARDS`, whatever the rows are.

    `rows`: page_id, digest, url_hash, size. Sums run along the order of the keys, so the answer does not depend on how rows lie
    in partitions. Many rows of one id are told apart by digest and url; records that are alike in all stay in one shard.
    """
    keys = rows.groupBy(*KEY).agg(F.sum(F.col("size") + 500).alias("n"))
    ranges = written(keys.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "warc-keys")
    sums = {r["part"]: r["n"] for r in ranges.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each partition
    total, before = 0, []
    for part in sorted(sums):
        before.append((part, total))
        total += sums[part]
    step = max(shard_bytes, -(-total // SHARDS))
    if total <= step:
        return []
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    along = Window.partitionBy("part").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranges.withColumn("upto", F.sum("n").over(along)).join(offsets, "part")
    share = F.floor((F.col("before") + F.col("upto") - F.col("n")) / F.lit(step))
    starts = placed.groupBy(share.alias("share")).agg(F.min(F.struct(*KEY)).alias("start"))
    return [r["start"] for r in sorted(starts.collect(), key=lambda r: r["share"])][1:]


def shard_column(starts: list[Row]) -> Callable[[Column, Column, Column], Column]:
    """Number of the shard that a key belongs to: first the block of starts, then the start in it."""
    if not starts:
        return lambda *key: F.lit(0)
    width = math.isqrt(len(starts)) + 1
    blocks = [starts[i : i + width] for i in range(0, len(starts), width)]
    kind = "array<array<struct<page_id: bigint, digest: string, url_hash: bigint>>>"
    table = F.from_json(F.lit(json.dumps([[r.asDict() for r in b] for b in blocks])), kind)
    heads = F.from_json(F.lit(json.dumps([b[0].asDict() for b in blocks])), kind[6:-1])

    def number(page_id: Column, digest: Column, url_hash: Column) -> Column:
        key = F.struct(page_id.alias("page_id"), digest.alias("digest"), url_hash.alias("url_hash"))
        block = F.size(F.filter(heads, lambda e: e <= key))
        inside = F.size(F.filter(F.element_at(table, F.greatest(block, F.lit(1))), lambda e: e <= key))
        return F.when(block == 0, F.lit(0)).otherwise((block - 1) * width + inside)

    return number


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: an HTTP response, or its head alone for a revisit of an equal payload."""
    def name(i: int | None) -> str:
        return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{i}/{digest}')}>"

    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Truncated: length"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, least: int = 1000, shard_bytes: int = 16 << 20, file_bytes: int = 16 << 20, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> dict:
    """Write page_id, url, html of every row as compressed WARC files; returns the manifest.

    See `origins` for revisits; each page's origin travels as a row of its own, to every shard that its key reaches, and meets the page by
    the sort, so payloads are shuffled once. One payload is in memory at a time. Null urls give records without a target, null ids records without an id; repeated rows are
    repeated records; an empty table gives a manifest without files. Other columns are not looked at.
    """
    rows = payloads(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")))
    small = written(rows.select(*KEY, "size"), "warc-sizes")
    filesystem, path = file_system(folder)
    filesystem.create_dir(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, where = file_system(folder)
        state: dict = {"shard": None}

        def close() -> list[dict]:
            if state["shard"] is None:
                return []
            state["out"].close()
            files.move(state["temporary"], f"{where}/{state['name']}")
            return [{"name": state["name"], "records": state["records"], "bytes": state["bytes"], "sha1": state["sha1"].hexdigest()}]

        done, told, told_of = [], None, None
        for batch in slices(batches):
            for shard, page_id, digest, kind, _, url, payload, origin in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    told, told_of = origin, (page_id, digest)
                    continue
                refers_to = told if told_of == (page_id, digest) else None
                if shard != state["shard"] or state["bytes"] >= file_bytes:
                    done += close()
                    number = 0 if shard != state["shard"] else state["number"] + 1
                    name = f"pages-{shard:06d}-{number:04d}.warc.gz"
                    temporary = f"{where}/{name}.{TaskContext.get().taskAttemptId()}.tmp"
                    state = {"shard": shard, "number": number, "name": name, "temporary": temporary, "out": files.open_output_stream(temporary), "records": 0, "bytes": 0, "sha1": hashlib.sha1()}
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = press.compress(record(page_id, url, payload, digest, refers_to, date)) + press.flush()
                state["out"].write(member)
                state["sha1"].update(member)
                state["records"] += 1
                state["bytes"] += len(member)
        done += close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    starts = shard_starts(small, shard_bytes)
    shard = shard_column(starts)
    page_id, digest = F.col("page_id"), F.col("digest")
    reached = F.sequence(shard(page_id, digest, F.lit(-(1 << 63))), shard(page_id, digest, F.lit((1 << 63) - 1)))
    known = origins(small, least).select(F.explode(reached).alias("shard"), "page_id", "digest", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("url_hash"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to")
    full = rows.select(shard(page_id, digest, F.col("url_hash")).alias("shard"), "page_id", "digest", F.lit(1).alias("kind"), "url_hash", "url", "payload", F.lit(None).cast("long").alias("refers_to"))
    order = ["shard", "page_id", "digest", "kind", "url_hash", "url"]
    dealt = full.unionByName(known).repartitionById(len(starts) + 1, "shard").sortWithinPartitions(*order)
    found = dealt.select(*order, "payload", "refers_to").mapInArrow(write, "name string, records long, bytes long, sha1 string").collect()  # a row for each file
    manifest = {"files": [r.asDict() for r in sorted(found, key=lambda r: r["name"])]}
    put_file(filesystem, f"{path}/manifest.json", json.dumps(manifest).encode())
    return manifest


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads and blocks of a stream of compressed records, one record in memory at a time."""
    unpress, raw = None, b""
    while True:
        if not raw:
            raw = stream.read(1 << 20)
            if not raw:
                if unpress is not None:
                    raise ValueError("the file ends inside a record")
                return
        if unpress is None:
            unpress, parts = zlib.decompressobj(31), []
        parts.append(unpress.decompress(raw))
        raw = unpress.unused_data
        if unpress.eof:
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError("no WARC record")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            block = rest[: int(fields["Content-Length"])]
            if rest[len(block) :] != b"\r\n\r\n":
                raise ValueError("a record's length is wrong")
            yield fields, block
            unpress = None


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and the payload of every record in the manifest's files.

    Block digests, and payload digests of responses, are checked. A revisit has no payload of its own.
    """
    files, where = file_system(folder)
    with files.open_input_stream(f"{where}/manifest.json") as f:
        names = [x["name"] for x in json.loads(f.read())["files"]]
    listing = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = file_system(folder)
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()} | ({"payload": pa.binary()} if with_payload else {})
        shape = pa.schema(list(types.items()))
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with own.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for fields, block in records_of(stream):
                        if fields["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
                            raise ValueError(f"{name}: a block's digest differs")
                        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                        payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
                        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload's digest differs")
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: E731, B023
                        row = {"page_id": number("X-Page-ID"), "payload_bytes": number("X-Payload-Length"), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "url": fields.get("WARC-Target-URI")}
                        rows.append(row | ({"payload": payload} if with_payload else {}))
                        if len(rows) == 200:
                            yield pa.RecordBatch.from_pylist(rows, shape)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, shape)

    return listing.mapInArrow(read, schema + ", payload binary" * with_payload)
