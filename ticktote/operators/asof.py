"""As-of joins: one union, one ordered pass, no inequality join.

Both sides are stacked and ordered by time; the last source row seen so far is
carried as one struct, so NULL values inside that row survive. Without a period
the pass runs per key, which suits tables bounded by the calendar such as bars.
With one (always, when there is no key) it runs per (key, period) and the last
source row of earlier periods is carried over one summary row per period, so a
hot key is spread over its periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktote.operators.sequence import key_join


def _unix(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def asof(
    left: DataFrame,
    right: DataFrame,
    on: str = "ts",
    by: list[str] | None = None,
    tolerance_s: float | None = None,
    forward: bool = False,
    right_ts: str | None = None,
    period: str | None = None,
    allow_exact: bool = True,
) -> DataFrame:
    """Left rows with the values of the last right row at or before them.

    forward=True takes the first right row at or after instead. If several right
    rows share a timestamp the greatest value struct wins. Unmatched rows get
    NULLs; `tolerance_s` also drops matches older than that many seconds.
    """
    by = list(by or [])
    vals = [c for c in right.columns if c not in (*by, on)]
    if not by:
        period = period or "month"
        left, right = left.withColumn("_k", F.lit(0)), right.withColumn("_k", F.lit(0))
    keys = by or ["_k"]
    lcols = [c for c in left.columns if c != "_k"]
    src = right.select(
        *keys,
        F.col(on).alias("_t"),
        F.struct(F.col(on).alias("src_ts"), F.struct(*vals).alias("v")).alias("_src"),
        F.lit(None).cast(left.select(F.struct(*lcols)).schema[0].dataType).alias("_row"),
    )
    tgt = left.select(
        *keys, F.col(on).alias("_t"), F.lit(None).cast(src.schema["_src"].dataType).alias("_src"), F.struct(*lcols).alias("_row")
    )
    slot = F.date_trunc(period, F.col("_t")) if period else F.lit(0)
    tgt, src = tgt.withColumn("_p", slot), src.withColumn("_p", slot)
    u = tgt.unionByName(src)
    sgn = -1 if forward else 1
    side = F.when(F.col("_row").isNull(), 0 if allow_exact else 2).otherwise(1)
    u = u.withColumn("_o", _unix("_t") * sgn).withColumn("_side", side)
    w = (
        Window.partitionBy(*keys, "_p").orderBy("_o", "_side", "_src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    u = u.withColumn("_loc", F.last("_src", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    if period is None:
        return _project(u, F.col("_loc"), lcols, vals, tolerance_s, right_ts)
    last = F.struct((_unix("_t") * sgn).alias("o"), F.col("_src").alias("s"))
    ends = src.groupBy(*keys, "_p").agg(F.max(last)["s"].alias("_end"))
    slots = tgt.select(*keys, "_p").distinct()
    marks = slots.select("*", F.lit(None).cast(ends.schema["_end"].dataType).alias("_end"), F.lit(0).alias("_q")).unionByName(
        ends.withColumn("_q", F.lit(1))
    )
    po = F.unix_micros(F.col("_p").cast("timestamp")) * sgn
    wk = Window.partitionBy(*keys).orderBy("_po", "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = (
        marks.withColumn("_po", po)
        .withColumn("_car", F.last("_end", ignorenulls=True).over(wk))
        .where(F.col("_q") == 0)
        .select(*keys, "_p", "_car")
    )
    out = key_join(u, carry, [*keys, "_p"])
    return _project(out, F.coalesce(F.col("_loc"), F.col("_car")), lcols, vals, tolerance_s, right_ts)


def _project(d: DataFrame, m: Column, lcols: list[str], vals: list[str], tolerance_s: float | None, right_ts: str | None) -> DataFrame:
    gap = F.abs(F.unix_micros(m["src_ts"].cast("timestamp")) - _unix("_t")) / 1e6
    d = d.withColumn("_m", F.when(gap <= tolerance_s, m) if tolerance_s is not None else m)
    res = [F.col("_row")[c].alias(c) for c in lcols] + [F.col("_m")["v"][c].alias(c) for c in vals]
    if right_ts:
        res.append(F.col("_m")["src_ts"].alias(right_ts))
    return d.select(*res)


def asof_nearest(left: DataFrame, right: DataFrame, on: str = "ts", by: list[str] | None = None, period: str | None = None) -> DataFrame:
    """The right row closest in time; a tie goes to the earlier row."""
    vals = [c for c in right.columns if c not in (*(by or []), on)]
    b = asof(left, right, on, by, right_ts="_bt", period=period)
    b = b.withColumnsRenamed({v: "_b_" + v for v in vals})
    f = asof(b, right, on, by, right_ts="_ft", period=period, forward=True)
    gb, gf = F.abs(_unix(on) - _unix("_bt")), F.abs(_unix("_ft") - _unix(on))
    early = F.col("_ft").isNull() | (F.col("_bt").isNotNull() & (gb <= gf))
    return f.select(
        *left.columns,
        *[F.when(early, F.col("_b_" + v)).otherwise(F.col(v)).alias(v) for v in vals],
        F.when(early, F.col("_bt")).otherwise(F.col("_ft")).alias("src_ts"),
    )
