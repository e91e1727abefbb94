"""Performance metrics of trades and bets.

Sums, means and deviations are plain aggregates with map-side combine; the
equity curve (running total, running peak) is a prefix scan over ranges of the
order, so one strategy with most of the trades is still spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktote.functions.core import sdiv
from ticktote.operators.sequence import running


def pf(x: Column) -> Column:
    """Gains over losses; NULL without losses."""
    return F.try_divide(F.sum(F.when(x > 0, x)), F.abs(F.sum(F.when(x < 0, x))))


def equity_curve(df: DataFrame, keys: list[str], ret: str, order: list, start: float = 1.0) -> DataFrame:
    """Adds equity (start + running total), peak and drawdown (share of the peak)."""
    d = running(df, keys, order, {"_cum": ret}, {"_pk": "_cum"})
    d = d.withColumns({"equity": F.col("_cum") + start, "peak": F.col("_pk") + start})
    return d.withColumn("drawdown", sdiv(F.col("peak") - F.col("equity"), F.col("peak"))).drop("_cum", "_pk")


def trade_metrics(df: DataFrame, keys: list[str], ret: str, order: list, fee: float = 0.0003, annual: float = 24 * 365) -> DataFrame:
    """Trade metrics per key; ratios without a denominator are NULL."""
    x = F.col(ret)
    d = equity_curve(df.where(x.isNotNull()).select(*dict.fromkeys([*keys, *order, ret])), keys, ret, order)
    win, loss = F.when(x > 0, x), F.when(x < 0, x)
    sd, nsd = F.stddev_samp(x), F.stddev_samp(loss)
    ann = float(annual) ** 0.5
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        pf(x).alias("pf"),
        (F.max("drawdown") * 100).alias("mdd"),
        (F.try_divide(F.avg(x), F.when(sd > 0, sd)) * ann).alias("sharpe"),
        (F.try_divide(F.avg(x), F.when(nsd > 0, nsd)) * ann).alias("sortino"),
        (F.avg(x) - fee).alias("exp_value_net"),
        (F.avg((x > 0).cast("int")) * 100).alias("win_rate"),
        F.try_divide(F.avg(win), -F.avg(loss)).alias("payoff"),
    )


def grouped_performance(df: DataFrame, keys: list[str], ret: str = "ret", hit: str = "hit", odds: str = "odds", ev: str = "ev") -> DataFrame:
    x = F.col(ret)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(hit).alias("wins"),
        F.avg(hit).alias("win_rate"),
        pf(x).alias("pf"),
        F.avg(x).alias("roi"),
        F.avg(odds).alias("avg_odds"),
        F.avg(ev).alias("avg_ev"),
        F.sum(x).alias("total_pnl"),
    )


def calibration(df: DataFrame, prob: str, hit: Column, bins: int = 10, clamp: bool = False) -> DataFrame:
    """Equal probability bins: count, mean prediction, hit rate, error; empty bins are kept.

    p = 1 falls outside the last bin unless clamped into it.
    """
    b = F.floor(F.col(prob) * bins)
    b = F.least(b, F.lit(bins - 1)) if clamp else b
    g = df.withColumns({"bin": b.cast("int"), "_h": hit}).where(F.col("bin") < bins)
    g = g.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("predicted"), F.avg("_h").alias("actual"))
    allb = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    d = allb.join(F.broadcast(g), "bin", "left").fillna({"n": 0}).withColumn("error", F.abs(F.col("predicted") - F.col("actual")))
    # ten rows at most from here on
    m = F.max("error").over(Window.partitionBy())
    return d.select("bin", "n", "predicted", "actual", "error", m.alias("max_error"), (m < 0.10).cast("int").alias("well_calibrated"))


def regime_profile(df: DataFrame, regime: str, fwd: str, vol: str) -> DataFrame:
    g = df.groupBy(regime).agg(F.count(F.lit(1)).alias("n"), F.avg(fwd).alias("mean_fwd"), F.avg(vol).alias("mean_vol"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def transition_matrix(df: DataFrame, q, regime: str) -> DataFrame:
    """Counts and row shares of consecutive regimes of each sequence."""
    d = df.select(F.lag(regime).over(q.w).alias("prev"), F.col(regime).alias("cur")).where(F.col("prev").isNotNull())
    g = d.groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("prev")))


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in one aggregation."""
    ps = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    g = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in ps])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in ps]))
    return g.select(rows.alias("e")).select("e.*")


def best_cell(grid: DataFrame, keys: list[str], score: str, ok: Column, params: list[str]) -> DataFrame:
    """Parameters of the best score among cells that satisfy `ok`, else among all cells."""
    v = F.struct(F.col(score), *params)
    g = grid.withColumn("_ok", ok).groupBy(*keys).agg(F.max(F.when(F.col("_ok"), v)).alias("a"), F.max(v).alias("b"))
    best = F.coalesce("a", "b")
    return g.select(*keys, *[best[p].alias(p) for p in params], best[score].alias(score))


def money_curve(df: DataFrame, keys: list[str], pnl: str, order: list) -> DataFrame:
    """Adds cum (running money) and peak (its running maximum)."""
    return running(df, keys, order, {"cum": pnl}, {"peak": "cum"})


def universal_metrics(df: DataFrame, keys: list[str], ret: str, order: list, trades_per_period: float, periods_per_year: float = 252.0, stake: Column | None = None, payout: Column | None = None) -> DataFrame:
    """ROI, drawdown, annualised Sharpe and Sortino, profit factor, win rate, mean and deviation."""
    x = F.col(ret)
    ann = (periods_per_year * trades_per_period) ** 0.5
    sd, nsd = F.stddev_samp(x), F.stddev_samp(F.when(x < 0, x))
    roi = F.try_divide(F.sum(payout) - F.sum(stake), F.sum(stake)) * 100 if stake is not None else F.avg(x) * 100
    return equity_curve(df, keys, ret, order).groupBy(*keys).agg(
        roi.alias("roi"),
        (F.max("drawdown") * 100).alias("max_drawdown"),
        (F.try_divide(F.avg(x), sd) * ann).alias("sharpe"),
        (F.try_divide(F.avg(x), nsd) * ann).alias("sortino"),
        pf(x).alias("profit_factor"),
        F.avg((x > 0).cast("int")).alias("win_rate"),
        F.count(F.lit(1)).alias("n_trades"),
        F.avg(x).alias("mean_return"),
        sd.alias("std_return"),
    )


def strategy_metrics(df: DataFrame, key: str, prob: str, label: str, move: str, ts: str, threshold: float, cost: float, horizon: int) -> DataFrame:
    """Classification and trading metrics of rows whose probability leaves the neutral band; compounded curve."""
    p = F.col(prob)
    bars = df.groupBy(key).agg(F.count(F.lit(1)).alias("_bars"))
    d = df.where((p > threshold) | (p < 1 - threshold))
    d = d.withColumns({"_yh": (p > 0.5).cast("int"), "_s": F.when(p > 0.5, 1).otherwise(-1) * F.col(move) - cost})
    d = running(d.withColumn("_ls", F.log1p("_s")), [key], [ts], {"_lc": "_ls"}, {"_lp": "_lc"})
    # the curve is monotone in its logarithm, so drawdown needs only the two running logs
    d = d.withColumn("_dd", 1 - F.exp(F.col("_lc") - F.col("_lp"))).join(bars, key)
    s, y, yh = F.col("_s"), F.col(label), F.col("_yh")
    n = F.count(F.lit(1))
    tp = F.sum(yh * y)
    return d.groupBy(key).agg(
        F.avg((yh == y).cast("int")).alias("accuracy"),
        F.try_divide(tp, F.sum(yh)).alias("precision"),
        F.try_divide(tp, F.sum(y)).alias("recall"),
        F.try_divide(2 * tp, F.sum(yh) + F.sum(y)).alias("f1"),
        (F.try_divide(F.avg(s), F.stddev_pop(s)) * F.sqrt(n / F.max("_bars") * 8760 / horizon)).alias("sharpe"),
        pf(s).alias("profit_factor"),
        F.max("_dd").alias("max_drawdown"),
        n.alias("trade_count"),
        F.avg((s > 0).cast("int")).alias("win_rate"),
        (F.exp(F.sum("_ls")) - 1).alias("total_return"),
    )


def kelly_stake(prob: str, odds: str, base: float = 500.0) -> Column:
    """Stake from the clamped quarter-Kelly fraction, in hundreds, between 100 and three bases."""
    p, o = F.col(prob), F.col(odds)
    k = F.greatest(F.lit(0.0), F.try_divide(p * o - 1, o - 1)) * 0.25
    raw = F.floor(base * F.greatest(k, F.lit(0.1)) * 4 / 100) * 100
    return F.greatest(F.lit(100.0), F.least(raw, F.lit(base * 3)))


def bet_metrics(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    d = df.withColumn("stake", kelly_stake("prob", "odds"))
    d = d.withColumn("pnl", F.when(F.col("hit") == 1, F.col("stake") * F.col("odds") - F.col("stake")).otherwise(-F.col("stake")))
    x = F.col("pnl")
    n = F.count(F.lit(1))
    return money_curve(d, keys, "pnl", order).groupBy(*keys).agg(
        n.alias("n_bets"),
        F.sum("hit").alias("n_wins"),
        pf(x).alias("pf"),
        (1 + F.try_divide(F.sum(x), F.sum("stake"))).alias("recovery"),
        (F.try_divide(F.avg(x), F.stddev_pop(x)) * F.sqrt(n)).alias("sharpe"),
        F.max(F.col("peak") - F.col("cum")).alias("mdd"),
        F.sum("stake").alias("total_bet"),
    )


def unit_score_metrics(df: DataFrame, key: str, pnl: str, chosen: Column, ts: str) -> DataFrame:
    """Metrics of +1/-1 scores; the Sharpe spreads the trades over all bars with zeros between them."""
    bars = df.groupBy(key).agg(F.count(F.lit(1)).alias("_bars"))
    d = money_curve(df.where(chosen), [key], pnl, [ts]).join(bars, key)
    x, b = F.col(pnl), F.max("_bars")
    mean, sq = F.sum(x) / b, F.sum(x * x) / b
    return d.groupBy(key).agg(
        F.count(F.lit(1)).alias("trade_count"),
        pf(x).alias("pf"),
        F.avg((x > 0).cast("int")).alias("win_rate"),
        F.max(F.col("peak") - F.col("cum")).alias("mdd"),
        (F.try_divide(mean, F.sqrt(sq - mean * mean)) * 252**0.5).alias("spread_sharpe"),
    )


def exit_metrics(df: DataFrame, keys: list[str], ret: str, reason: str) -> DataFrame:
    x = F.col(ret)
    counts = [F.count(F.when(F.col(reason) == v, 1)).alias("n_" + v) for v in ("stop_loss", "take_profit", "time_exit")]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        pf(x).alias("pf"),
        F.avg((x > 0).cast("int")).alias("win_rate"),
        F.try_divide(F.avg(F.when(x > 0, x)), -F.avg(F.when(x < 0, x))).alias("win_loss_ratio"),
        *counts,
    )


def period_report(df: DataFrame, date: str, order: list, ret: str) -> DataFrame:
    """Day, week, month and whole-history report. A row is copied to the periods that hold it (at most four)."""
    top = df.agg(F.max(date).alias("_top"))
    d = df.join(F.broadcast(top))
    age = F.datediff("_top", F.col(date))
    names = F.array_compact(F.array(F.when(age <= 0, "day"), F.when(age <= 6, "week"), F.when(age <= 29, "month"), F.lit("all")))
    d = d.withColumn("period", F.explode(names))
    x, act = F.col(ret), F.col("action") != "SKIP"
    counts = d.groupBy("period").agg(
        *[F.count(F.when(F.col("action") == a, 1)).alias(n) for a, n in (("BUY", "buys"), ("SELL", "sells"), ("SKIP", "skips"))],
        F.count(F.when(~act & (F.col("reason") == "low value"), 1)).alias("skip_low_value"),
    )
    c = money_curve(d.where(act), ["period"], ret, order)
    m = c.groupBy("period").agg(
        F.max(F.greatest("peak", F.lit(0.0)) - F.col("cum")).alias("max_drawdown"),
        F.sum(x).alias("cumulative"),
        F.max(x).alias("best"),
        F.min(x).alias("worst"),
        F.avg((x > 0).cast("int")).alias("win_rate"),
    )
    return counts.join(m, "period", "left")


# Readiness limits per market, +1 at least, -1 at most.
READINESS = [
    ("boat", "roi", 1, 0.0), ("boat", "max_drawdown", -1, 30.0), ("fx", "profit_factor", 1, 1.3), ("fx", "max_drawdown", -1, 20.0), ("fx", "sharpe", 1, 1.0),
    ("fx", "n_trades", 1, 200.0), ("stock", "roi", 1, 0.0), ("stock", "max_drawdown", -1, 20.0), ("crypto", "roi", 1, 0.0), ("crypto", "max_drawdown", -1, 30.0),
]


def readiness(metrics: DataFrame, keys: list[str], criteria: list[tuple] = READINESS) -> DataFrame:
    """Every market's limits against the metrics; a missing value fails."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("market"), F.lit(x).alias("metric"), F.coalesce((F.col(x) - lim) * s < 0, F.lit(True)).alias("bad")) for m, x, s, lim in criteria]))
    d = metrics.select(*keys, rows.alias("e")).select(*keys, "e.*")
    bad = F.sort_array(F.collect_list(F.when(F.col("bad"), F.col("metric"))))
    return d.groupBy(*keys, "market").agg((F.size(bad) == 0).cast("int").alias("ready"), F.array_join(bad, ",").alias("failed"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    r = b.select(*keys, *[F.col(c).alias("_b_" + c) for c in cols])
    return a.join(r, keys).withColumns({"d_" + c: F.col("_b_" + c) - F.col(c) for c in cols})


def metric_alerts(a: DataFrame, b: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    d = compare(a, b, keys, list(limits))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col("d_" + c).alias("delta"), F.lit(v).alias("lim")) for c, v in limits.items()]))
    return d.select(*keys, rows.alias("e")).select(*keys, "e.*").where(F.abs("delta") >= F.col("lim")).drop("lim")


def adoption(a: DataFrame, b: DataFrame, keys: list[str], min_pf: float = 1.3, min_exp: float = 0.0, min_gain: float = 0.05) -> DataFrame:
    d = compare(a, b, keys, ["pf", "roi"])
    ok = (F.col("_b_pf") > min_pf) & (F.col("_b_roi") > min_exp) & (F.col("_b_pf") >= F.col("pf") * (1 + min_gain))
    return d.select(*keys, F.coalesce(ok, F.lit(False)).cast("int").alias("adopt"), (sdiv("_b_pf", "pf") - 1).alias("improvement"))


def overfit_probability(strategies: DataFrame, name: str, score_in: str, score_out: str, draws: int = 1000) -> DataFrame:
    """Share of bootstrap draws whose in-sample best ranks in the lower half out of sample, and the deflated score.

    A draw picks as many strategies as there are, with replacement. Whether a
    strategy is in a draw follows from residues of (draw, slot), so reruns agree.
    The strategy table is one row per strategy; draws grow with its size.
    """
    w = Window.partitionBy(F.lit(0))
    s = strategies.dropna(subset=[score_in, score_out])
    s = s.withColumns({
        "_i": F.row_number().over(w.orderBy(name)) - 1, "_n": F.count(F.lit(1)).over(w), "_ro": F.rank().over(w.orderBy(F.col(score_out).desc()))})
    one = s.agg(F.max("_n").alias("n"))
    d = strategies.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(one))
    d = d.withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    d = d.withColumn("_i", F.pmod(F.pmod((F.col("draw") + 1) * 48271 * (F.col("slot") + 7919) + F.col("slot") * F.col("slot") * 69621, F.lit(2147483647)), F.col("n")).cast("int"))
    best = d.join(s, "_i").groupBy("draw").agg(F.max_by(F.struct("_ro", F.col("_n").alias("n")), F.struct(score_in, name)).alias("b"))
    pbo = best.agg(F.avg((F.col("b._ro") > F.floor(F.col("b.n") / 2)).cast("int")).alias("pbo"), F.count(F.lit(1)).alias("draws"))
    top = s.agg(F.max_by(score_out, score_in).alias("_sel"))
    return pbo.join(F.broadcast(top)).select("pbo", "draws", (F.col("_sel") * F.sqrt(1 - F.col("pbo"))).alias("deflated_sharpe"))


def cumulative_percent(df: DataFrame, key: str, v: str) -> DataFrame:
    """Share and running share of a small ranked table, largest first."""
    allr = Window.partitionBy(F.lit(0))
    run = allr.orderBy(F.col(v).desc(), F.col(key)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"pct": F.col(v) / F.sum(v).over(allr) * 100, "cum_pct": F.sum(v).over(run) / F.sum(v).over(allr) * 100})
