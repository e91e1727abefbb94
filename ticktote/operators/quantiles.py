"""Exact quantiles (linear interpolation) without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktote.operators.scan import prefix_scan
from ticktote.sources.storage import stored_table


def exact_quantiles(df: DataFrame, keys: list[str], x: str, qs: dict[str, float]) -> DataFrame:
    """One row per key with a column per quantile of x."""
    return column_quantiles(df, keys, {name: (x, q) for name, q in qs.items()})


def column_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per key with a column per quantile: name -> (column, share). NULLs are left out; a NULL key is a key.

    All columns are stacked and counted by value at once, so ties collapse before rows move, and one prefix scan over
    ranges of values gives the ranks of all of them. A column without values has NULL quantiles.
    """
    cols = list(dict.fromkeys(c for c, _ in wanted.values()))
    key = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_x")) for c in cols]))
    d = df.select(*keys, key.alias("_key"), rows.alias("_v")).select(*keys, "_key", "_v._col", "_v._x").where("_x is not null")
    d = stored_table(d.groupBy(*keys, "_key", "_col", "_x").agg(F.count(F.lit(1)).alias("_n")), "counts")
    d = prefix_scan(d, ["_key", "_col"], ["_x"], sums={"_hi": "_n"}, store=False).join(d.groupBy("_key", "_col").agg(F.sum("_n").alias("_total")), ["_key", "_col"])
    lo = F.col("_hi") - F.col("_n")

    def at(column: str, rank):
        return F.max(F.when((F.col("_col") == column) & (lo <= rank) & (rank < F.col("_hi")), F.col("_x")))

    out = []
    for name, (column, q) in wanted.items():
        r = F.lit(q) * (F.col("_total") - 1)
        f = F.max(F.when(F.col("_col") == column, r - F.floor(r)))
        low, high = at(column, F.floor(r)), at(column, F.least(F.floor(r) + 1, F.col("_total") - 1))
        out.append((low + f * (high - low)).alias(name))
    return d.groupBy(*keys).agg(*out)
