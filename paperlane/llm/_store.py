"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str | None] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a temporary one only on a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _OWN.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="run-")
        _OWN[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int | None, read_rows: int | None = None) -> Iterator[None]:
    """At most so many rows go to Python at once, and `read_rows` of a Parquet file are decoded at once, for rows that are large; the session's own numbers come back after."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.parquet.columnarReaderBatchSize": read_rows}
    wanted = {key: n for key, n in wanted.items() if n}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, n in wanted.items():
            spark.conf.set(key, n)
        yield
    finally:
        for key, n in before.items():
            spark.conf.set(key, n)


def written(df: DataFrame, label: str, batch_rows: int | None = None, read_rows: int | None = None) -> DataFrame:
    """`df` as a written table: computed once, its lineage cut, safe from lost executors; with `batch_rows` or `read_rows`, see `batches_of`."""
    path = new_folder(df.sparkSession, label)
    with batches_of(df.sparkSession, batch_rows, read_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder given as a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put_file(filesystem, path: str, data: bytes) -> None:
    """Write under a temporary name, then rename: readers see the whole file or none."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(temporary) as out:
        out.write(data)
    filesystem.move(temporary, path)
