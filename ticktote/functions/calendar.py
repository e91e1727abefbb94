"""Calendar columns of a timestamp."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cyc(x: Column, period: float) -> tuple[Column, Column]:
    a = x * (2 * math.pi / period)
    return F.sin(a), F.cos(a)


def time_parts(df: DataFrame, ts: str = "ts", week: int = 5) -> DataFrame:
    """Hour, weekday (Monday = 0), month and their cyclic encodings."""
    d = df.withColumns({"hour": F.hour(ts), "dow": F.weekday(ts), "month": F.month(ts)})
    out = {}
    for c, p in (("hour", 24), ("dow", week), ("month", 12)):
        out[c + "_sin"], out[c + "_cos"] = _cyc(F.col(c), p)
    return d.withColumns(out)


# Session hours in UTC, start inclusive and end exclusive: fixed values.
SESSIONS = {"tokyo": (0, 9), "london": (7, 16), "ny": (13, 22), "overlap": (13, 16)}


def session_flags(df: DataFrame, ts: str = "ts") -> DataFrame:
    h, wd = F.hour(ts), F.weekday(ts)
    day = F.to_date(ts)
    out = {k: h.between(a, b - 1).cast("int") for k, (a, b) in SESSIONS.items()}
    out["is_friday"] = (wd == 4).cast("int")
    out["is_monday"] = (wd == 0).cast("int")
    out["is_month_end"] = ((day == F.last_day(day)) | (F.date_add(day, 1) == F.last_day(F.date_add(day, 1)))).cast("int")
    return df.withColumns(out)


def hour_dow(ts: str) -> Column:
    return (F.hour(ts) * 10 + F.weekday(ts)).cast("int")


def macro_events(months: DataFrame, month: str = "month") -> DataFrame:
    """Scheduled events per month: first Friday, third Wednesday, the 15th; all at 14:00."""
    first = F.trunc(F.col(month), "month")
    fri = F.next_day(F.date_sub(first, 1), "Fri")
    wed = F.date_add(F.next_day(F.date_sub(first, 1), "Wed"), 14)
    rows = F.array(
        F.struct(F.lit("payrolls").alias("name"), fri.alias("day"), F.lit(3).alias("importance")),
        F.struct(F.lit("rate_decision").alias("name"), wed.alias("day"), F.lit(3).alias("importance")),
        F.struct(F.lit("inflation").alias("name"), F.date_add(first, 14).alias("day"), F.lit(2).alias("importance")),
    )
    return months.select(F.explode(rows).alias("e")).select(
        "e.name", (F.col("e.day").cast("timestamp") + F.make_dt_interval(hours=F.lit(14))).alias("event_ts"), "e.importance"
    )
