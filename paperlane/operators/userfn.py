"""Slots for a user's own code: a recogniser, a model client, anything per document or per page.

The only place where rows reach Python workers. Values arrive as plain Python
ones: whole numbers stay exact and NULL is None. A row whose code raises
becomes an error row; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Bytes of results that a task holds before they go on.
HELD = 4 << 20


def _in_turn(batches: Iterator[pa.RecordBatch], rows: int, work: Callable[[list[dict]], list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What `work` makes of `rows` rows at a time. Only these are Python objects; results are kept as Arrow until they fill a batch."""
    for batch in batches:
        held, size = [], 0
        for at in range(0, batch.num_rows, rows):
            held.append(pa.Table.from_pylist(work(batch.slice(at, rows).to_pylist()), schema=schema))
            size += held[-1].nbytes
            if size > HELD:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()


def apply_per_document(
    df: DataFrame, fn: Callable[[dict], dict], result_schema: str, key: str = "doc_id", agent: str = "user"
) -> DataFrame:
    """Envelope per row with what `fn(row)` returned or raised, and the time it took.

    `result_schema` is the DDL of the returned dict's fields.
    """
    key_type = df.schema[key].dataType.simpleString()
    envelope = (
        f"{key} {key_type}, agent string, success boolean, status string, "
        "error struct<message:string,type:string>, start timestamp, duration double, "
        f"result struct<{result_schema}>"
    )

    arrow = to_arrow_schema(StructType.fromDDL(envelope))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import datetime
        import time

        def work(rows: list[dict]) -> list[dict]:
            out = []
            for row in rows:
                start, began = datetime.datetime.now(datetime.timezone.utc), time.perf_counter()
                result, error = None, None
                try:
                    result = fn(row)
                    if not isinstance(result, dict):
                        result, error = None, "result is no dict"
                except Exception as problem:  # any failure of user code becomes a row
                    error = str(problem) or type(problem).__name__
                out.append(
                    {
                        key: row[key],
                        "agent": agent,
                        "success": error is None,
                        "status": "completed" if error is None else "error",
                        "error": None if error is None else {"message": error, "type": "processing_error"},
                        "start": start,
                        "duration": time.perf_counter() - began,
                        "result": result,
                    }
                )
            return out

        return _in_turn(batches, 20, work, arrow)

    return df.mapInArrow(run, envelope)


def apply_in_batches(
    df: DataFrame,
    fn: Callable[[list[dict]], list[list[dict]]],
    item_schema: str,
    keys: list[str] | None = None,
    batch_size: int = 5,
) -> DataFrame:
    """Items per row from a function that takes `batch_size` rows at once.

    If a batch raises, its rows are tried one by one; a row that fails alone
    yields an empty array.
    """
    keys = keys or ["doc_id", "page"]
    key_types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def attempt(rows: list[dict]) -> list[list[dict]]:
        try:
            found = fn(rows)
            if len(found) == len(rows):
                return found
        except Exception:  # handled below, row by row
            pass
        return [[]] if len(rows) == 1 else [attempt([row])[0] for row in rows]

    schema = f"{key_types}, items array<struct<{item_schema}>>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def work(rows: list[dict]) -> list[dict]:
        return [{**{k: row[k] for k in keys}, "items": found} for row, found in zip(rows, attempt(rows))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_turn(batches, batch_size, work, arrow)

    return df.mapInArrow(run, schema)
