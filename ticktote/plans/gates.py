"""Risk and entry gates composed from windows, as-of joins and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticktote.functions.core import Seq, code_map, first_reason, flag
from ticktote.operators.events import blackout
from ticktote.operators.indicators import rolling_pct_rank
from ticktote.operators.scan import prefix_scan

C = F.col
# Fixed values: (confidence threshold, target multiple, skip) by regime.
REGIME_PARAMETERS = {"HIGH_VOL_TREND": (0.60, 1.0, 0), "LOW_VOL_TREND": (0.75, 0.7, 0), "RANGE": (1.0, 1.0, 1)}


def trailing_stop(df: DataFrame, trade: list[str], ts: str, price: str, atr: str, mult: float) -> DataFrame:
    w = Window.partitionBy(*trade).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"long_stop": F.max(C(price) - mult * C(atr)).over(w), "short_stop": F.min(C(price) + mult * C(atr)).over(w)})


def loss_limits(df: DataFrame, key: str, date: str, tie: str, pnl: str, daily: float, weekly: float, drawdown: float) -> DataFrame:
    """Verdict from the losses before the row today and this week and from the drawdown column."""
    d = prefix_scan(df, [key, date], [tie], sums={"_d": pnl})
    d = prefix_scan(d.withColumn("_wk", F.date_trunc("week", date)), [key, "_wk"], [date, tie], sums={"_w": pnl})
    own = F.coalesce(C(pnl), F.lit(0.0))
    v = first_reason([("drawdown", C("drawdown") >= drawdown), ("daily loss", C("_d") - own <= -daily), ("weekly loss", C("_w") - own <= -weekly)])
    return d.withColumn("verdict", v).drop("_d", "_w", "_wk")


def correlation_guard(trades: DataFrame, table: list[tuple[str, str, float]], limit: float) -> DataFrame:
    """Held symbol that blocks each trade: same side and high correlation, or opposite side and high inverse correlation.

    The table is a fixed literal; each trade is matched to its few listed partners.
    """
    both = [(a, b, c) for x, y, c in table if abs(c) >= limit for a, b in ((x, y), (y, x))]
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("partner"), F.lit(c).alias("corr")) for a, b, c in both])
    mine = F.filter(arr, lambda e: e["a"] == C("symbol"))
    p = trades.select("symbol", "ts", "side", F.explode_outer(mine).alias("m")).select("symbol", "ts", "side", "m.partner", "m.corr")
    held = trades.select(C("symbol").alias("partner"), "ts", C("side").alias("held"))
    j = p.join(held, ["partner", "ts"], "left")
    hit = F.when(C("corr") > 0, C("side") == C("held")).otherwise(C("side") != C("held"))
    return j.groupBy("symbol", "ts").agg(F.coalesce(F.max(F.when(hit & C("held").isNotNull(), C("partner"))), F.lit("")).alias("blocked_by"))


def gate_stack(bars: DataFrame, trades: DataFrame, calendar: DataFrame, threshold: float = 0.6, penalty: float = 0.05, min_agree: int = 4) -> DataFrame:
    """First gate that stops a trade: hour, weekday, volatility band, event, volatility spike, confidence, agreement."""
    q = Seq("symbol", "ts")
    b = bars.withColumn("_r1", q.pct("close")).withColumn("_v", q.sd("_r1", 24))
    b = b.withColumns({"vol_pct": rolling_pct_rank("_v", 120, mode="lt_prev"), "sma": q.mean("close", 20)})
    mean = b.groupBy("symbol").agg(F.avg("_v").alias("mean_vol"))
    d = trades.join(b.select("symbol", "ts", "vol_pct", "sma"), ["symbol", "ts"]).join(mean, "symbol")
    d = blackout(d, calendar, 4, 2, 2)
    against = F.coalesce((C("side") > 0) != (C("close") > C("sma")), F.lit(False))
    need = threshold + F.when(against, penalty).otherwise(0.0)
    rules = [
        ("hour", F.hour("ts").isin(20, 23)),
        ("weekday", F.weekday("ts") == 1),
        ("volatility band", (C("vol_pct") < 0.2) | (C("vol_pct") > 0.9)),
        ("event", C("blocked") == 1),
        ("volatility spike", C("vol") > 2 * C("mean_vol")),
        ("confidence", C("conf") < need),
        ("agreement", C("agreement") < min_agree),
    ]
    return d.withColumn("verdict", first_reason(rules))


def regime_parameters(df: DataFrame) -> DataFrame:
    p = REGIME_PARAMETERS
    return df.withColumns({
        "threshold": code_map("regime", {k: v[0] for k, v in p.items()}, 1.0), "tp_mult": code_map("regime", {k: v[1] for k, v in p.items()}, 1.0), "skip": code_map("regime", {k: v[2] for k, v in p.items()}, 1)})


def wait_condition(df: DataFrame, q: Seq, train_share: float, vol_mult: float = 2.0, ret_mult: float = 3.0) -> DataFrame:
    """1 on a volatility spike, two regime changes in three bars or an outsized move; means come from the training share."""
    n = df.groupBy(*q.keys).agg(F.count(F.lit(1)).alias("_n"))
    d = df.withColumn("_rn", F.row_number().over(q.w)).join(n, q.keys)
    d = d.withColumn("_ch", flag(C("regime") != q.lag("regime")))
    m = d.where(C("_rn") <= C("_n") * train_share).groupBy(*q.keys).agg(F.avg("vol").alias("_mv"), F.avg(F.abs("ret1")).alias("_mr"))
    d = d.join(m, q.keys)
    hot = [C("vol") > vol_mult * C("_mv"), q.roll(F.sum, "_ch", 3) >= 2, F.abs("ret1") > ret_mult * C("_mr")]
    any_ = F.lit(0)
    for h in hot:
        any_ = F.greatest(any_, flag(h))
    return d.withColumn("wait", any_)


def budget(df: DataFrame, key: str, date: str, tie: str, stake: str, per_day: float, per_month: float) -> DataFrame:
    """Allowed while the running stake of the day and of the month is within its cap (prefix rule)."""
    d = prefix_scan(df, [key, date], [tie], sums={"_day": stake})
    d = prefix_scan(d.withColumn("_mo", F.trunc(date, "month")), [key, "_mo"], [date, tie], sums={"_month": stake})
    return d.withColumn("allowed", flag((C("_day") <= per_day) & (C("_month") <= per_month))).drop("_day", "_month", "_mo")


def trend_filter(df: DataFrame, sma: str, threshold: float, extra: float) -> DataFrame:
    against = F.coalesce((C("side") > 0) != (C("close") > C(sma)), F.lit(False))
    return df.withColumns({"hard_pass": flag(~against), "soft_pass": flag(C("conf") >= threshold + F.when(against, extra).otherwise(0.0))})


def daily_pause(df: DataFrame, key: str, date: str, tie: str, pnl: str, max_losses: int, max_loss: float) -> DataFrame:
    """Paused for the rest of the day after max_losses straight losses or a day loss beyond the limit."""
    d = prefix_scan(df, [key, date], [tie], sums={"_ls": flag(C(pnl) < 0), "_day": pnl}, peaks={"_base": ("_ls", C(pnl) >= 0)})
    d = d.withColumn("streak", (C("_ls") - F.coalesce("_base", F.lit(0.0))).cast("int"))
    trip = flag((C("streak") >= max_losses) | (C("_day") < -max_loss))
    return prefix_scan(d, [key, date], [tie], maxima={"paused": trip}).drop("_ls", "_day", "_base")
