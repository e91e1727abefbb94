"""Long to wide and back, with fixed value lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_to_lanes(df: DataFrame, key: str, lane: str, lanes: list[int], cols: list[str]) -> DataFrame:
    """One row per race with lane{i}_{col} columns: one aggregation, no pivot job."""
    return df.groupBy(key).agg(
        *[F.max(F.when(F.col(lane) == i, F.col(c))).alias(f"lane{i}_{c}") for i in lanes for c in cols]
    )


def lanes_to_long(df: DataFrame, key: str, lanes: list[int], cols: list[str]) -> DataFrame:
    """One row per lane from lane{i}_{col} columns."""
    rows = F.array(*[F.struct(F.lit(i).alias("lane"), *[F.col(f"lane{i}_{c}").alias(c) for c in cols]) for i in lanes])
    return df.select(key, F.explode(rows).alias("e")).select(key, "e.*")


def snapshot_columns(df: DataFrame, keys: list[str], at: str, value: str, times: list[int], prefix: str = "odds_") -> DataFrame:
    """Snapshots as columns, first value by time."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(at) == m, F.col(value))).alias(f"{prefix}{m}") for m in times])
