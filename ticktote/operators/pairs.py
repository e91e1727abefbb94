"""Instruments on common timestamps: a few named ones side by side, or the pairs of a table, which a Gram matrix has screened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktote.operators.gram import pair_statistics


def side_by_side(bars: DataFrame, symbols: list[str], value: str = "close", key: str = "symbol", ts: str = "ts") -> DataFrame:
    """One row per timestamp with one column per named instrument."""
    return (
        bars.where(F.col(key).isin(symbols))
        .groupBy(ts)
        .agg(*[F.max(F.when(F.col(key) == s, F.col(value))).alias(s) for s in symbols])
    )


def pair_rows(bars: DataFrame, pairs: DataFrame, value: str = "close", key: str = "symbol", ts: str = "ts") -> DataFrame:
    """(left_symbol, right_symbol, ts, a, b): the named pairs of a table on the timestamps where both have a value."""
    d = bars.where(F.col(value).isNotNull())
    left = d.select(F.col(key).alias("left_symbol"), ts, F.col(value).alias("a"))
    right = d.select(F.col(key).alias("right_symbol"), ts, F.col(value).alias("b"))
    return pairs.select("left_symbol", "right_symbol").join(left, "left_symbol").join(right, ["right_symbol", ts]).select("left_symbol", "right_symbol", ts, "a", "b")


def all_pairs(bars: DataFrame, value: str = "close", *, min_common: int = 1, min_corr: float = 0.0, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Rows of every pair of instruments that passes the thresholds of the Gram matrix."""
    return pair_rows(bars, pair_statistics(bars, key, ts, value, min_common=min_common, min_corr=min_corr), value, key, ts)
