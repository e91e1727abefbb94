"""OHLCV bars from ticks or from finer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(ts: str, unit: str) -> Column:
    """Start of the calendar bucket: 'hour', 'day', 'month', or '<n> hours'. Naive UTC time in and out."""
    if unit.endswith(" hours"):
        n = int(unit.split()[0])
        start = F.date_trunc("day", ts) + F.make_dt_interval(hours=(F.floor(F.hour(ts) / n) * n).cast("int"))
    else:
        start = F.date_trunc(unit, ts)
    return start.cast("timestamp_ntz")


def ticks_to_bars(df: DataFrame, key: str, ts: str, px: str, unit: str, tie: str | None = None) -> DataFrame:
    """Ticks to bars; map-side partial aggregation absorbs hot keys. Empty buckets do not appear."""
    o = F.struct(ts, tie) if tie else F.col(ts)
    return df.groupBy(F.col(key).alias("symbol"), bucket(ts, unit).alias("ts")).agg(
        F.min_by(px, o).alias("open"),
        F.max(px).alias("high"),
        F.min(px).alias("low"),
        F.max_by(px, o).alias("close"),
        F.sum(px).alias("volume"),
    )


def resample(bars: DataFrame, unit: str, keys: list[str] | None = None) -> DataFrame:
    """Coarser bars: first, max, min, last, sum."""
    keys = keys or ["symbol"]
    return bars.groupBy(*keys, bucket("ts", unit).alias("bts")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("bts", "ts")
