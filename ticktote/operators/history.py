"""Strictly-past history of participants.

History is pre-aggregated to one row per (participant, day) before any window,
so a participant's window holds at most one row per calendar day however many
rows that participant has, and same-day rows never see each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktote.operators.sequence import key_join, running


def day_number(c: str | Column) -> Column:
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))


def daily(df: DataFrame, keys: list[str], date: str, aggs: dict[str, Column]) -> DataFrame:
    """One row per key and day, with the given aggregates."""
    return df.groupBy(*keys, F.to_date(date).alias("_day")).agg(*[v.alias(k) for k, v in aggs.items()])


def past_sums(df: DataFrame, keys: list[str], date: str, values: dict[str, tuple[Column, int | None]]) -> DataFrame:
    """Adds sums over the participant's earlier days, without today: name -> (value, days or None for all)."""
    d = daily(df, keys, date, {k: F.sum(v) for k, (v, _) in values.items()}).withColumn("_dn", day_number("_day"))
    w = Window.partitionBy(*keys).orderBy("_dn")
    frame = {k: w.rangeBetween(Window.unboundedPreceding if n is None else -n, -1) for k, (_, n) in values.items()}
    d = d.select(*keys, "_day", *[F.coalesce(F.sum(k).over(frame[k]), F.lit(0)).alias(k) for k in values])
    out = key_join(df.withColumn("_day", F.to_date(date)), d, [*keys, "_day"])
    return out.select(*df.columns, *[F.coalesce(k, F.lit(0)).alias(k) for k in values])


def past_totals(df: DataFrame, keys: list[str], date: str, values: dict[str, Column], spread: str) -> DataFrame:
    """past_sums over all earlier days for keys of few rows, such as two racers that met: one exchange of the rows and no join.

    Rows without a key or a day have no history. Those without a key are dealt out by `spread`; those without a day come
    before all days.
    """
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    d = df.select(*df.columns, day_number(date).alias("_dn"), *[v.alias(k) for k, v in values.items()], F.when(~keyed, F.col(spread)).alias("_lone"))
    w = Window.partitionBy(*keys, "_lone").orderBy("_dn").rangeBetween(Window.unboundedPreceding, -1)
    sums = {k: F.sum(k).over(w) for k in values}
    known = keyed & F.col("_dn").isNotNull()
    return d.select(*df.columns, *[F.when(known, F.coalesce(s, F.lit(0))).otherwise(0).alias(k) for k, s in sums.items()])


def last_n_before(df: DataFrame, keys: list[str], date: str, order: list[str], value: Column, n: int, out: str) -> DataFrame:
    """Adds the array of the last n values before the day, newest first; ties in a day follow `order`.

    Each day keeps only its own newest n values, and the frame reaches back n
    days, because n days hold at least n values.
    """
    k = Window.partitionBy(*keys, "_day").orderBy(*[F.desc(o) for o in order])
    top = (
        df.select(*keys, F.to_date(date).alias("_day"), *order, value.alias("_x"))
        .where(F.col("_x").isNotNull())
        .withColumn("_r", F.row_number().over(k))
        .where(F.col("_r") <= n)
    )
    per = top.groupBy(*keys, "_day").agg(F.array_sort(F.collect_list(F.struct("_r", "_x"))).alias("_v"))
    days = df.select(*keys, F.to_date(date).alias("_day")).distinct()
    per = key_join(days, per, [*keys, "_day"])
    # only days with values count towards the n days of the frame
    w = Window.partitionBy(*keys).orderBy("_day")
    per = per.withColumn("_m", F.count("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    lists = F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_m", "_v"))).over(
        Window.partitionBy(*keys).orderBy("_m").rangeBetween(-n, -1)
    )
    hist = per.withColumn("_h", lists)
    flat = F.flatten(F.transform(F.reverse(F.array_sort("_h")), lambda e: F.transform(e["_v"], lambda q: q["_x"])))
    hist = hist.select(*keys, "_day", F.slice(flat, 1, n).alias(out))
    d = key_join(df.withColumn("_day", F.to_date(date)), hist, [*keys, "_day"])
    return d.select(*df.columns, F.coalesce(out, F.array().cast(hist.schema[out].dataType)).alias(out))


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a))


def top_n_code(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    """1..n for the n most frequent values, else 0. The code table has n rows and is broadcast."""
    codes = df.groupBy(x).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), x).limit(n)
    codes = codes.withColumn(out, F.row_number().over(Window.orderBy(F.desc("_n"), x))).drop("_n")
    return df.join(F.broadcast(codes), x, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def fill_with_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULLs to the column's overall mean (a one-row aggregate)."""
    m = df.agg(*[F.avg(c).alias("_m_" + c) for c in cols])
    d = df.join(F.broadcast(m))
    return d.withColumns({c: F.coalesce(F.col(c), F.col("_m_" + c)) for c in cols}).select(*df.columns)


def past_rate(df: DataFrame, keys: list[str], order: list[str], hit: Column, default: float, out: str) -> DataFrame:
    """Hit rate over all earlier rows of a participant in row order, own row excluded."""
    d = df.withColumns({"_h": hit.cast("double"), "_one": F.lit(1.0)})
    d = running(d, keys, order, {"_hs": "_h", "_ns": "_one"})
    rate = F.try_divide(F.col("_hs") - F.col("_h"), F.col("_ns") - 1)
    return d.withColumn(out, F.coalesce(rate, F.lit(default))).drop("_h", "_one", "_hs", "_ns")


def meets(df: DataFrame, keys: list[str], date: str, rank: str) -> DataFrame:
    """Per participant and day: day number in the chain of consecutive days, mean rank earlier
    in the chain, days since the last day (30 on the first) and a rest score peaking at ten days."""
    d = daily(df, keys, date, {"_rs": F.sum(rank), "_rn": F.count(rank), "_w": F.avg((F.col(rank) == 1).cast("double"))})
    d = d.withColumn("_dn", day_number("_day"))
    w = Window.partitionBy(*keys).orderBy("_dn")
    d = d.withColumns({"_gap": F.col("_dn") - F.lag("_dn").over(w), "_pw": F.lag("_w").over(w), "_isl": F.col("_dn") - F.row_number().over(w)})
    wi = Window.partitionBy(*keys, "_isl").orderBy("_dn")
    past = wi.rowsBetween(Window.unboundedPreceding, -1)
    bell = F.exp(-F.pow((F.col("_gap") - 10) / 10.0, 2)) * (1 + F.col("_pw"))
    return d.select(
        *keys,
        F.col("_day").alias("day"),
        F.row_number().over(wi).alias("meet_day"),
        F.coalesce(F.try_divide(F.sum("_rs").over(past), F.sum("_rn").over(past)), F.lit(0.0)).alias("meet_avg_rank"),
        F.coalesce(F.col("_gap"), F.lit(30)).alias("days_since"),
        F.coalesce(bell, F.lit(0.0)).alias("rest_quality"),
    )


def previous_meet_best(df: DataFrame, key: str, venue: str, date: str, rank: str, max_gap: int = 4) -> DataFrame:
    """Best rank of the chain before the current one; a chain is one venue with gaps of at most max_gap days."""
    d = daily(df, [key, venue], date, {"_best": F.min(rank)}).withColumn("_dn", day_number("_day"))
    w = Window.partitionBy(key).orderBy("_dn", venue)
    new = ~F.lag(venue).over(w).eqNullSafe(F.col(venue)) | F.coalesce(F.col("_dn") - F.lag("_dn").over(w) > max_gap, F.lit(False))
    d = d.withColumn("_new", F.when(new, 1).otherwise(0))
    d = d.withColumn("_ch", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = d.groupBy(key, "_ch").agg(F.min("_best").alias("_cb"))
    c = c.withColumn("prev_meet_best", F.lag("_cb").over(Window.partitionBy(key).orderBy("_ch"))).select(key, "_ch", "prev_meet_best")
    return d.join(c, [key, "_ch"], "inner").select(key, venue, F.col("_day").alias("day"), "prev_meet_best")
