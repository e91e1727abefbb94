"""Pair trading: spreads, signals, screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktote.functions.core import Seq, sdiv
from ticktote.operators import indicators as ind
from ticktote.operators.gram import pair_statistics
from ticktote.operators.pairs import pair_rows, side_by_side
from ticktote.sources.storage import stored_table


def spread_zscore(legs: DataFrame, n: int = 60) -> DataFrame:
    """Adds the log spread of each pair and its rolling z-score. legs: left_symbol, right_symbol, ts, a, b."""
    d = legs.withColumn("spread", F.log("a") - F.log("b"))
    return d.withColumn("z", Seq(["left_symbol", "right_symbol"], "ts").zscore("spread", n))


def zone(z: Column, entry: float = 2.0, exit_: float = 0.5, stop: float = 4.0) -> Column:
    a = F.abs(z)
    return (
        F.when(z.isNull(), "NONE")
        .when(a >= stop, "FORCE_EXIT")
        .when(z >= entry, "SHORT_A_LONG_B")
        .when(z <= -entry, "LONG_A_SHORT_B")
        .when(a <= exit_, "CONVERGED")
        .otherwise("NONE")
    )


def lagged_correlation_screen(bars: DataFrame, followers: list[str], leaders: list[str], n: int = 60, min_rows: int = 120) -> DataFrame:
    """Rolling correlation of each follower's return with each leader's previous return, summarised per pair."""
    q = Seq("symbol", "ts")
    f = bars.withColumn("ret", q.pct("close")).withColumn("prev", q.lag("ret"))
    a, b = side_by_side(f, followers, "ret"), side_by_side(f, leaders, "prev")
    w = a.join(b, "ts")
    e = F.explode(F.array(*[F.struct(F.lit(x).alias("jp"), F.lit(y).alias("us"), F.col(x).alias("ret"), F.col(y).alias("prev")) for x in followers for y in leaders]))
    p = w.select("ts", e.alias("p")).select("ts", "p.*").dropna(subset=["ret", "prev"])
    p = p.withColumn("c", Seq(["jp", "us"], "ts").corr("ret", "prev", n))
    g = p.groupBy("jp", "us").agg(
        F.avg("c").alias("mean_corr"), F.stddev_samp("c").alias("std_corr"), F.max("c").alias("max_corr"), F.min("c").alias("min_corr"), F.count(F.lit(1)).alias("n")
    )
    return g.where(F.col("n") >= min_rows)


def residual_stationarity(bars: DataFrame, min_common: int = 1, min_corr: float = 0.0) -> DataFrame:
    """Slope t-statistic of the residual's change on its previous value, per pair of log prices.

    The fits come from the Gram matrix of all instruments; only pairs that pass its thresholds get rows.
    """
    k = ["left_symbol", "right_symbol"]
    logs = bars.withColumn("x", F.log("close"))
    fit = pair_statistics(logs, min_common=min_common, min_corr=min_corr)
    fit = stored_table(fit.select(*k, (F.col("sxy") / F.col("sxx")).alias("sl"), (F.col("mean_y") - F.col("sxy") / F.col("sxx") * F.col("mean_x")).alias("ic")), "pair-fits")
    e = pair_rows(logs, fit, "x").withColumnsRenamed({"a": "x", "b": "y"}).join(fit, k).withColumn("e", F.col("y") - F.col("sl") * F.col("x") - F.col("ic"))
    w = Window.partitionBy(*k).orderBy("ts")
    e = e.withColumn("e1", F.lag("e").over(w)).withColumn("de", F.col("e") - F.col("e1")).where(F.col("e1").isNotNull())
    g = e.groupBy(*k).agg(
        F.regr_slope("de", "e1").alias("slope"), F.count(F.lit(1)).alias("n"), F.regr_sxx("de", "e1").alias("sxx"), F.regr_syy("de", "e1").alias("syy")
    )
    rss = F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")
    return g.withColumn("t_stat", F.col("slope") / F.sqrt(rss / (F.col("n") - 2) / F.col("sxx")))


def pair_features(bars: DataFrame) -> DataFrame:
    q = Seq("symbol", "ts")
    d = ind.returns(ind.rsi_smoothed(bars, wilder=False, out="rsi_span"), [1, 5, 20])
    return d.select(
        "symbol", "ts", q.sd("ret_1", 5).alias("vol_5"), q.sd("ret_1", 20).alias("vol_20"), sdiv(F.col("volume"), q.mean("volume", 20)).alias("volume_ratio"), "ret_1", "ret_5", "ret_20", "rsi_span"
    )
