"""Joins of bars with a calendar of scheduled events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktote.operators.asof import asof


def _plus(c, hours: float):
    return c + F.make_dt_interval(secs=F.lit(float(hours) * 3600).cast("decimal(18,6)"))


def blackout(df: DataFrame, events: DataFrame, before_h: float, after_h: float, min_importance: int = 1, ts: str = "ts", out: str = "blocked") -> DataFrame:
    """1 where an event lies in [ts - after, ts + before].

    All windows have one width, so a row is blocked exactly when the first event
    at or after ts - after is no later than ts + before: one forward as-of join.
    """
    ev = events.where(F.col("importance") >= min_importance).select(F.col("event_ts").alias("_at"), F.col("event_ts").alias("_ev"))
    d = df.withColumn("_at", _plus(F.col(ts), -after_h))
    d = asof(d, ev, on="_at", forward=True, period="day")
    hit = F.col("_ev") <= _plus(F.col(ts), before_h)
    return d.withColumn(out, F.coalesce(hit, F.lit(False)).cast("int")).select(*df.columns, out)


def upcoming(times: DataFrame, events: DataFrame, days: int = 7, ts: str = "ts") -> DataFrame:
    """Events in [ts, ts + days] of each query time, with the hours until each.

    The join key is the calendar day: a query time covers days + 1 of them.
    """
    q = times.withColumn("_d", F.explode(F.sequence(F.to_date(ts), F.date_add(F.to_date(ts), days))))
    e = events.withColumn("_d", F.to_date("event_ts"))
    j = q.join(e, "_d", "inner").where((F.col("event_ts") >= F.col(ts)) & (F.col("event_ts") <= _plus(F.col(ts), 24 * days)))
    hrs = (F.unix_micros(F.col("event_ts").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 3.6e9
    return j.withColumn("hours_until", hrs).drop("_d")
