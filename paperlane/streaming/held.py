"""Stream rows held in state until their group is whole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def hold_until_complete(
    rows: DataFrame, keys: list[str], member: str, expected: str, event_time: str = "ts", timeout_minutes: float = 30
) -> DataFrame:
    """The rows of a stream, given back in append mode when their group is whole, with `complete`.

    A group is whole when as many different `member` numbers are there as its rows announce in `expected`. One that is not whole
    leaves `timeout_minutes` after its last event, by the watermark of `event_time`, with `complete` false. A member that
    comes again is left out, also after its group has left: an empty mark stays for the same time. So state holds
    open groups and marks of the last minutes only, and a restart goes on from the checkpoint.
    """
    names = [f"`{k}`" for k in keys]
    packed = rows.select(
        *keys, F.col(member).cast("long").alias("_member"), F.col(expected).cast("long").alias("_expected"),
        F.col(event_time).alias(event_time), F.to_json(F.struct(*rows.columns), _JSON).alias("_row"),
    )
    wait = int(timeout_minutes * 60_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, wanted, members, held = state.get if state.exists else (False, 0, [], [])
        members, held = list(members), list(held)
        if state.hasTimedOut:
            state.remove()
            if held and not closed:
                yield pd.DataFrame({"_row": held, "complete": [False] * len(held)})
            return
        last = state.getCurrentWatermarkMs()
        for batch in batches:
            last = max(last, int(batch[event_time].max().timestamp() * 1000))
            for number, announced, row in zip(batch["_member"], batch["_expected"], batch["_row"]):
                if closed or number in members:
                    continue
                wanted = int(announced) if pd.notna(announced) else wanted
                members.append(int(number))
                held.append(row)
        if not closed and 0 < wanted <= len(members):
            yield pd.DataFrame({"_row": held, "complete": [True] * len(held)})
            closed, members, held = True, [], []
        state.update((closed, wanted, members, held))
        state.setTimeoutTimestamp(last + wait)

    released = packed.groupBy(*names).applyInPandasWithState(
        step, "_row string, complete boolean", "closed boolean, wanted long, members array<long>, held array<string>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    schema = rows.schema
    return released.select(F.from_json("_row", schema, _JSON).alias("r"), "complete").select("r.*", "complete")
