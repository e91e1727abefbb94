"""Signal study: bars to indicators, gated entries and trade metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktote.functions.core import Seq
from ticktote.operators import indicators as ind
from ticktote.operators.metrics import trade_metrics


def signal_study(bars: DataFrame, horizon: int = 4, low: float = 30, high: float = 70, skip_hours=(20, 23), scale: float = 0.01) -> DataFrame:
    q = Seq("symbol", "ts")
    d = ind.bollinger(ind.rsi_simple(bars))
    d = d.withColumn("fwd", q.lead("close", horizon) / F.col("close") - 1)
    side = F.when(F.col("rsi") < low, 1).when(F.col("rsi") > high, -1)
    d = d.where(F.col("fwd").isNotNull() & F.col("bb_width").isNotNull() & side.isNotNull())
    d = d.where(~F.hour("ts").isin(list(skip_hours))).withColumn("ret", side * F.col("fwd") * scale)
    m = trade_metrics(d, ["symbol"], "ret", ["ts"])
    return m.select("symbol", "n_trades", "pf", "mdd", "win_rate", "sharpe")
