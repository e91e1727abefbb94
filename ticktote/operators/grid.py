"""Threshold grids without multiplying the input.

A row satisfies `value >= threshold` for all thresholds up to some index, so each
row only needs that index. Rows are pre-aggregated by index and band; the small
result is then spread over the thresholds. The grid never meets the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(x: Column, thresholds: list[float]) -> Column:
    """How many of the ascending thresholds x reaches."""
    return sum((F.when(x >= t, 1).otherwise(0) for t in thresholds), F.lit(0))


def threshold_grid(df: DataFrame, keys: list[str | Column], axes: dict[str, tuple[Column, list[float]]], sums: dict[str, Column]) -> DataFrame:
    """Sums per key and threshold combination over rows with every value >= its threshold."""
    names = [k if isinstance(k, str) else None for k in keys]
    # the value becomes a column first: thresholds then compare a column, and only the
    # lowest threshold is pushed towards the scan
    d = df.withColumns({f"_x_{a}": x for a, (x, _) in axes.items()})
    for a, (_, ts) in axes.items():
        d = d.where(F.col(f"_x_{a}") >= min(ts))
    lv = {f"_l_{a}": level(F.col(f"_x_{a}"), ts) for a, (_, ts) in axes.items()}
    d = d.withColumns(lv)
    small = d.groupBy(*names, *lv).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    for a, (_, ts) in axes.items():
        arr = F.array(*[F.lit(float(t)) for t in ts])
        small = small.withColumn(a, F.explode(F.slice(arr, F.lit(1), F.col(f"_l_{a}"))))
    return small.groupBy(*names, *axes).agg(*[F.sum(k).alias(k) for k in sums])
