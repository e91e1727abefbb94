"""Windowed stream operators: bars, sliding sums, sessions, de-duplication, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    o = F.struct("ts", "event_id")
    g = ticks.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.min_by("value", o).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", o).alias("close"), F.sum("value").alias("volume"))
    return g.select(C("event_type").alias("symbol"), C("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_sums(ticks: DataFrame, size: str = "3 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    g = ticks.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.sum("value").alias("volume"), F.count(F.lit(1)).alias("n"))
    return g.select("event_type", C("window.end").alias("ts"), "volume", "n")


def sessions(ticks: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    g = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", C("w.start").alias("start"), C("w.end").alias("end"), "n", "total")


def deduplicate(ticks: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def with_blackout(ticks: DataFrame, calendar_hours: DataFrame) -> DataFrame:
    """Stream joined to a static table of blocked hours."""
    d = ticks.withColumn("hour", F.date_trunc("hour", "ts"))
    return d.join(calendar_hours, "hour", "left").withColumn("blocked", F.coalesce("blocked", F.lit(0)))


def surge_verdict(change: Column) -> Column:
    """What a rise of the odds before the close means for a bet."""
    v = F.when(change >= 0.20, "cancel").when(change >= 0.10, "half").when(change >= 0.05, "minor").otherwise("normal")
    return F.when(change.isNull(), "no history").otherwise(v)


def preclose_surge(snaps: DataFrame, before: str = "10 minutes", late: str = "3 hours") -> DataFrame:
    """Per car, once its race's close has passed: the last odds of the final minutes against the last odds before them.

    snaps: race_id, car_no, ts, close, odds. The close is the event time, so a race waits for its late snapshots, gives
    one row per car and leaves no state behind. late has to exceed the time from the first snapshot of a race to its
    close, as closes of other races move the watermark. Without a snapshot on either side there is no history.
    """
    early = C("ts") <= C("close") - F.expr(f"INTERVAL {before}")
    g = snaps.withWatermark("close", late).groupBy(F.window("close", "1 minute"), "race_id", "car_no").agg(
        F.max_by(F.when(early, C("odds")), F.when(early, C("ts"))).alias("base"), F.max_by(F.when(~early, C("odds")), F.when(~early, C("ts"))).alias("final"))
    change = F.when(C("base") > 0, C("final") / C("base") - 1)
    return g.select("race_id", "car_no", change.alias("change"), surge_verdict(change).alias("verdict"))


def outcomes(predictions: DataFrame, results: DataFrame, key: str, hours: int = 4, late: str = "1 hour") -> DataFrame:
    """Predictions with results of the same key in the next hours; unmatched ones appear once time has passed."""
    p = predictions.select(C(key), C("ts").alias("p_ts"), C("event_id").alias("p_id"), C("value").alias("p_value")).withWatermark("p_ts", late)
    r = results.select(C(key).alias("r_key"), C("ts").alias("r_ts"), C("event_id").alias("r_id"), C("value").alias("r_value")).withWatermark("r_ts", late)
    cond = (C(key) == C("r_key")) & (C("r_ts") >= C("p_ts")) & (C("r_ts") <= C("p_ts") + F.expr(f"INTERVAL {hours} HOURS"))
    return p.join(r, cond, "leftOuter").select(key, "p_id", "p_ts", "p_value", "r_id", "r_value")
