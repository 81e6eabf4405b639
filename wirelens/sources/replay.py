"""Cyclic replay of a bounded table: tick t gives row t mod n, stamped with the current time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.operators.derive import stamp_now
from wirelens.operators.splitting import shuffled


def numbered(df: DataFrame, key: list, seed: int = 42) -> DataFrame:
    return shuffled(df, key, seed, "position")


def replay(
    numbered_rows: DataFrame, ticks: DataFrame, rows: int, tick: str = "tick",
    stamp: str | None = None,
) -> DataFrame:
    """Join ticks (batch or stream) with the numbered table of `rows` rows."""
    placed = ticks.select(
        F.col(tick).alias("tick"), F.pmod(F.col(tick), F.lit(rows)).alias("position")
    )
    out = placed.join(numbered_rows, "position")
    return stamp_now(out, stamp) if stamp else out


def rate_ticks(spark, rows_per_second: int = 1) -> DataFrame:
    """Live ticks 0, 1, 2, ... for the streaming form."""
    return (
        spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
        .select(F.col("value").alias("tick"))
    )
