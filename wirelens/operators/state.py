"""Small fitted tables inside larger plans.

A state table has one row per column of the data table, so it is read to the driver once and its
numbers become literals: the scan that applies them stays one generated stage without a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literals(state: DataFrame, key: str, fields: list[str]) -> Callable[[str, str], Column]:
    """name, field -> literal column; null where the state has no such name."""
    rows = {r[key]: r for r in state.select(key, *fields).collect()}
    types = {f: state.schema[f].dataType for f in fields}

    def lookup(name: str, field: str) -> Column:
        value = rows[name][field] if name in rows else None
        return F.lit(value).cast(types[field])

    return lookup


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A table expected to be small (classes, slices, prefixes), evaluated and marked for
    broadcast after its size was checked; a larger one is returned as it is and joined by shuffle.

    Spark's size estimate of such a table is that of the data it was counted from, so without the
    check a large table would be shuffled by a key of few values.
    """
    held = df.limit(rows + 1).collect()
    if len(held) > rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(held, df.schema))
