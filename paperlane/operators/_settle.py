"""A point in a plan behind which columns are plain values."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settle(df: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    """The frame's `keep` columns with `names` worked out once, row by row.

    The optimizer rewrites a later filter in terms of what its columns are made
    of, which for stacked expressions multiplies work and plan size. It does not
    look through a generator, so the values pass through one that yields a
    single row.
    """
    members = ", ".join(f"'{n}', `{n}`" for n in names)
    return df.selectExpr(*[f"`{c}`" for c in keep], f"inline(array(named_struct({members})))")
