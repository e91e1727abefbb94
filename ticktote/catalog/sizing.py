"""Sizing, filters, gates and parameter grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ticktote.catalog.bars import _TR
from ticktote.catalog.common_sql import BARS, BETS, CALENDAR, ENTRIES, SNAPS, TRADES, lag, r, roll
from ticktote.catalog.registry import query
from ticktote.catalog.series import _ADX, _SPR
from ticktote.functions import betting as bt
from ticktote.functions.core import Seq, all_reasons, code_map, first_reason, flag, rnd, rounded, sdiv
from ticktote.operators import indicators as ind
from ticktote.operators import metrics as me
from ticktote.operators.grid import threshold_grid
from ticktote.operators.quantiles import exact_quantiles
from ticktote.operators.sequence import losing_streak, running

C = F.col


Q = Seq("symbol", "ts")
W = "OVER (PARTITION BY symbol ORDER BY ts)"
ORD = ["race_date", "race_id"]
WB = "OVER (PARTITION BY strategy ORDER BY race_date, race_id)"


def _kelly(p="prob", o="odds", cap="100000", unit="100", mr="0.05"):
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 OR {o} <= 1 OR {cap} <= 0 THEN 0 ELSE round_even(least(greatest(0, ({p} * {o} - 1) / ({o} - 1)) * 0.25 * {cap}, {cap} * {mr}) / {unit}, 0) * {unit} END)"


@query("g1_fractional_kelly", f"WITH {ENTRIES} SELECT race_id, car_no, CAST({_kelly()} AS DOUBLE) AS stake FROM entries")
def _(t):
    return t.entries().select("race_id", "car_no", bt.kelly("prob", "odds", F.lit(100000.0), unit=100.0).alias("stake"))


_EQ = BETS + f""", c0 AS (SELECT *, 1 + sum(ret) {WB} AS equity FROM bets), c1 AS (SELECT *, max(equity) {WB} AS peak FROM c0)"""


@query("g2_drawdown_adjusted_kelly", f"""WITH {_EQ}, k AS (SELECT *, {_kelly(cap='(100000 * equity)')} AS base, (peak - equity) / peak AS dd FROM c1) SELECT race_id, {r('dd')} AS drawdown, CAST(round_even(base * CASE WHEN dd >= 0.4 THEN 0 WHEN dd >= 0.3 THEN 0.25 WHEN dd >= 0.2 THEN 0.5 WHEN dd >= 0.1 THEN 0.75 ELSE 1 END / 100, 0) * 100 AS DOUBLE) AS stake FROM k""")
def _(t):
    d = me.equity_curve(t.bets(), ["strategy"], "ret", ORD)
    cap, pk = 100000 * C("equity"), 100000 * C("peak")
    return d.select("race_id", rnd("drawdown").alias("drawdown"), bt.kelly_after_drawdown("prob", "odds", cap, pk, unit=100.0).alias("stake"))


@query("g3_portfolio_scaling", f"""WITH {BETS}, k AS (SELECT race_id, race_date, {_kelly(unit='1')} AS stake FROM bets), s AS (SELECT race_date, sum(stake) AS total FROM k GROUP BY 1) SELECT race_id, {r('stake * CASE WHEN total > 20000 THEN 20000 / total ELSE 1 END')} AS stake FROM k JOIN s USING (race_date)""")
def _(t):
    d = t.bets().select("race_id", "race_date", bt.kelly("prob", "odds", F.lit(100000.0)).alias("stake"))
    s = d.groupBy("race_date").agg(F.sum("stake").alias("total"))
    return rounded(d.join(s, "race_date").select("race_id", (C("stake") * F.when(C("total") > 20000, 20000 / C("total")).otherwise(1.0)).alias("stake")))


def atr_bars(t):
    return ind.atr_simple(t.bars()).where("atr IS NOT NULL").withColumn("side", F.when(C("close") < C("open"), 1).otherwise(-1))


_AB = f"""{_TR}, ab AS (SELECT * FROM (SELECT symbol, ts, open, high, low, close, {roll('avg', 'tr', 14)} AS atr, CASE WHEN close < open THEN 1 ELSE -1 END AS side FROM tr) WHERE atr IS NOT NULL)"""


@query("g4_risk_position_size", f"""WITH {BARS}, {_AB} SELECT symbol, ts, {r('CASE WHEN close - side * atr * 0.1 <= 0 THEN 0 ELSE greatest(0, 10000 * 0.02 / (atr * 0.1) * CASE WHEN hour(ts) % 8 >= 7 THEN 0 WHEN hour(ts) % 8 >= 5 THEN 0.25 WHEN hour(ts) % 8 >= 3 THEN 0.5 ELSE 1 END) END', 2)} AS lots FROM ab""")
def _(t):
    d = atr_bars(t)
    stop = C("close") - C("side") * C("atr") * 0.1
    gap = F.abs(C("close") - stop)
    size = sdiv(F.lit(10000.0) * 0.02, gap) * bt.steps(F.hour("ts") % 8, bt.STREAK_STEPS)
    return d.select("symbol", "ts", rnd(F.when((stop > 0) & (gap > 0), F.greatest(F.lit(0.0), size)).otherwise(0.0), 2).alias("lots"))


@query("g5_stop_and_target_levels", f"WITH {BARS}, {_AB} SELECT symbol, ts, {r('close - side * atr * 1.5')} AS stop_loss, {r('close + side * atr * 2')} AS take_profit, 1.3333::DOUBLE AS reward_ratio FROM ab")
def _(t):
    lv = bt.sl_tp(C("side"), "close", "atr")
    d = atr_bars(t).withColumns(lv)
    return d.select("symbol", "ts", rnd("stop_loss").alias("stop_loss"), rnd("take_profit").alias("take_profit"), "reward_ratio")


@query("g6_trailing_stop", f"""WITH {BARS}, {_AB} SELECT symbol, ts, {r('max(close - 1.5 * atr) OVER w')} AS long_stop, {r('min(close + 1.5 * atr) OVER w')} AS short_stop FROM ab WINDOW w AS (PARTITION BY symbol, date_trunc('week', ts) ORDER BY ts)""")
def _(t):
    """One trade per symbol and week; the stop only moves in the trade's favour."""
    from ticktote.plans.gates import trailing_stop

    d = atr_bars(t).withColumn("trade", F.date_trunc("week", "ts"))
    return rounded(trailing_stop(d, ["symbol", "trade"], "ts", "close", "atr", 1.5).select("symbol", "ts", "long_stop", "short_stop"))


@query("g7_exit_decision", f"""WITH {BARS}, {_AB}, e AS (SELECT *, first(close) OVER w AS entry, first(atr) OVER w AS ea, first(side) OVER w AS es, row_number() OVER w - 1 AS held FROM ab WINDOW w AS (PARTITION BY symbol, date_trunc('day', ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT symbol, ts, coalesce(CASE WHEN (es > 0 AND close <= entry - 0.5 * ea + 1e-9) OR (es < 0 AND close >= entry + 0.5 * ea - 1e-9) THEN 'stop_loss' WHEN (es > 0 AND close >= entry + 0.5 * ea - 1e-9) OR (es < 0 AND close <= entry - 0.5 * ea + 1e-9) THEN 'take_profit' WHEN held >= 12 THEN 'time_exit' END, 'hold') AS decision FROM e""")
def _(t):
    w = Window.partitionBy("symbol", F.date_trunc("day", "ts")).orderBy("ts")
    d = atr_bars(t).withColumns({"entry": F.first("close").over(w), "ea": F.first("atr").over(w), "es": F.first("side").over(w), "held": F.row_number().over(w) - 1})
    s = C("es")
    why = bt.exit_reason(s, C("close"), C("entry") - s * (0.5 * C("ea") - 1e-9), C("entry") + s * (0.5 * C("ea") - 1e-9), C("held"), 12)
    return d.select("symbol", "ts", F.coalesce(why, F.lit("hold")).alias("decision"))


_PNL = BETS + ", pb AS (SELECT *, CASE WHEN race_id % 11 = 0 THEN 0.0 ELSE ret END AS pnl FROM bets)"


@query("g8_losing_streak", f"""WITH {_PNL}, l AS (SELECT *, sum(CAST(pnl < 0 AS INT)) {WB} AS ls FROM pb), s AS (SELECT *, ls - coalesce(max(CASE WHEN pnl > 0 THEN ls END) {WB}, 0) AS streak FROM l)
 SELECT race_id, CAST(streak AS INT) AS streak, CAST(CASE WHEN streak >= 7 THEN 0 WHEN streak >= 5 THEN 0.25 WHEN streak >= 3 THEN 0.5 ELSE 1 END AS DOUBLE) AS size_mult FROM s""")
def _(t):
    b = t.bets().withColumn("pnl", F.when(C("race_id") % 11 == 0, 0.0).otherwise(C("ret")))
    d = losing_streak(b, ["strategy"], ORD, "pnl")
    return d.select("race_id", "streak", bt.steps(C("streak"), bt.STREAK_STEPS).alias("size_mult"))


@query("g9_loss_limit_gates", f"""WITH {_EQ}, g AS (SELECT race_id, coalesce(sum(ret) OVER (PARTITION BY strategy, race_date ORDER BY race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS day_pnl, coalesce(sum(ret) OVER (PARTITION BY strategy, date_trunc('week', race_date) ORDER BY race_date, race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS week_pnl, (peak - equity) / peak AS dd FROM c1)
 SELECT race_id, CASE WHEN dd >= 0.95 THEN 'drawdown' WHEN day_pnl <= -0.05 - 1e-9 THEN 'daily loss' WHEN week_pnl <= -0.1 - 1e-9 THEN 'weekly loss' ELSE 'OK' END AS verdict FROM g""")
def _(t):
    from ticktote.plans.gates import loss_limits

    d = me.equity_curve(t.bets(), ["strategy"], "ret", ORD)
    return loss_limits(d, "strategy", "race_date", "race_id", "ret", daily=0.05 + 1e-9, weekly=0.10 + 1e-9, drawdown=0.95).select("race_id", "verdict")


_CT = "(VALUES ('click', 'view', 0.9), ('view', 'click', 0.9), ('error', 'signup', -0.8), ('signup', 'error', -0.8), ('click', 'error', 0.5)) AS ct(a, b, corr)"


@query("g10_correlation_guard", f"""WITH {TRADES}, x AS (SELECT t.symbol, t.ts, max(CASE WHEN abs(corr) >= 0.75 AND ((corr > 0 AND t.side = h.side) OR (corr < 0 AND t.side <> h.side)) THEN h.symbol END) AS blocked_by FROM trades t LEFT JOIN {_CT} ON ct.a = t.symbol LEFT JOIN trades h ON h.ts = t.ts AND h.symbol = ct.b GROUP BY 1, 2)
 SELECT symbol, ts, coalesce(blocked_by, '') AS blocked_by FROM x""")
def _(t):
    from ticktote.plans.gates import correlation_guard

    d = t.trades().select("symbol", "ts", "side")
    return correlation_guard(d, [("click", "view", 0.9), ("error", "signup", -0.8), ("click", "error", 0.5)], 0.75)


_WD = SNAPS + ", w AS (SELECT race_id, car_no, max(CASE WHEN minutes = 120 THEN odds END) AS a, max(CASE WHEN minutes = 0 THEN odds END) AS b FROM snaps GROUP BY 1, 2)"


@query("g11_odds_surge_filter", f"""WITH {_WD}, x AS (SELECT race_id, car_no, (b - a) / a AS s FROM w) SELECT race_id, car_no, CASE WHEN s >= 0.2 THEN 'surge 20%' WHEN s >= 0.1 THEN 'surge 10%' WHEN s >= 0.05 THEN 'surge 5%' ELSE 'normal' END AS reason, CAST(CASE WHEN s >= 0.2 THEN 0 WHEN s >= 0.1 THEN 0.5 WHEN s >= 0.05 THEN 0.8 ELSE 1 END AS DOUBLE) AS mult, s < 0.2 AS passed FROM x""")
def _(t):
    from ticktote.operators.shape import snapshot_columns

    w = snapshot_columns(t.odds_snapshots(), ["race_id", "car_no"], "minutes", "odds", [120, 0])
    d = w.withColumn("v", bt.odds_surge("odds_120", "odds_0"))
    return d.select("race_id", "car_no", "v.reason", "v.mult", "v.passed")


@query("g11_market_anomaly_filters", f"""WITH {BARS}, x AS (SELECT symbol, ts, volume, {roll('avg', 'volume', 20)} AS base, (high - low) / 40 AS spread, {roll('avg', '(high - low) / 40', 20)} AS sbase, (close / open - 1) * 0.01 AS fr FROM bars)
 SELECT symbol, ts, CASE WHEN base <= 0 THEN 'no baseline' WHEN volume / base >= 6 THEN 'volume x2' WHEN volume / base >= 3 THEN 'volume' WHEN volume / base >= 2.1 THEN 'volume rising' ELSE 'normal' END AS volume_reason,
 CASE WHEN spread >= 3 THEN 'spread limit' WHEN sbase <= 0 THEN 'no baseline' WHEN spread / sbase >= 3 THEN 'spread x3' WHEN spread / sbase >= 2 THEN 'spread x2' ELSE 'normal' END AS spread_reason,
 CAST(CASE WHEN abs(fr) >= 0.02 THEN 0 WHEN fr >= 0.01 THEN 0.5 WHEN fr <= -0.005 THEN 0.5 ELSE 1 END AS DOUBLE) AS funding_mult FROM x WHERE base IS NOT NULL""")
def _(t):
    b = t.bars().withColumns({"spread": (C("high") - C("low")) / 40, "fr": (C("close") / C("open") - 1) * 0.01})
    b = b.withColumns({"base": Q.mean("volume", 20), "sbase": Q.mean("spread", 20)}).where("base IS NOT NULL")
    d = b.withColumns({"v": bt.volume_surge("volume", "base"), "s": bt.spread_widening("spread", "sbase"), "f": bt.funding_extreme("fr")})
    return d.select("symbol", "ts", C("v.reason").alias("volume_reason"), C("s.reason").alias("spread_reason"), C("f.mult").alias("funding_mult"))


@query("g12_gate_stack", f"""WITH {TRADES}, {CALENDAR}, m AS (SELECT symbol, avg(vol) AS mv FROM t1 GROUP BY 1), g0 AS (SELECT symbol, ts, list(vol) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS lv, {roll('avg', 'close', 20)} AS sma FROM t1),
 x AS (SELECT t.*, CASE WHEN len(list_filter(lv, lambda v: v IS NOT NULL)) >= 120 THEN len(list_filter(lv, lambda v: v < t.vol)) / 120.0 END AS vp, mv, EXISTS (SELECT 1 FROM calendar c WHERE c.importance >= 2 AND c.event_ts BETWEEN t.ts - INTERVAL 2 HOUR AND t.ts + INTERVAL 4 HOUR) AS blk,
 CASE WHEN (side > 0) <> (close > sma) THEN 0.05 ELSE 0 END AS pen FROM trades t JOIN g0 USING (symbol, ts) JOIN m USING (symbol))
 SELECT symbol, ts, CASE WHEN hour(ts) IN (20, 23) THEN 'hour' WHEN dayofweek(ts) = 2 THEN 'weekday' WHEN vp < 0.2 OR vp > 0.9 THEN 'volatility band' WHEN blk THEN 'event' WHEN vol > 2 * mv THEN 'volatility spike' WHEN conf < 0.6 + pen - 1e-9 THEN 'confidence' WHEN agreement < 4 THEN 'agreement' ELSE 'OK' END AS verdict FROM x""")
def _(t):
    from ticktote.plans.gates import gate_stack

    return gate_stack(t.bars(), t.trades(), t.calendar(), threshold=0.6 - 1e-9).select("symbol", "ts", "verdict")


@query("g13_drawdown_stop_resume", f"""WITH RECURSIVE {TRADES}, n AS (SELECT symbol, ts, ret, row_number() {W} AS rn FROM trades), f AS (
 SELECT symbol, ts, rn, 1 AS traded, ret AS cum, greatest(ret, 0) AS peak, false AS stopped FROM n WHERE rn = 1 UNION ALL
 SELECT symbol, ts, rn, go, CASE WHEN go = 1 THEN cum + ret ELSE cum END, CASE WHEN go = 1 THEN greatest(peak, cum + ret) ELSE peak END, go = 0 FROM (SELECT n.symbol, n.ts, n.rn, n.ret, f.cum, f.peak, CASE WHEN f.stopped THEN CASE WHEN f.cum >= f.peak * 0.5 THEN 1 ELSE 0 END WHEN f.peak - f.cum > 0.1 THEN 0 ELSE 1 END AS go FROM f JOIN n ON n.symbol = f.symbol AND n.rn = f.rn + 1))
 SELECT symbol, ts, traded, {r('cum')} AS cum FROM f""")
def _(t):
    from ticktote.operators.fold import drawdown_stop

    return rounded(drawdown_stop(t.trades().select("symbol", "ts", "ret"), ["symbol"], ["ts"], "ret").select("symbol", "ts", "traded", "cum"))


@query("g13_dynamic_threshold", f"""WITH RECURSIVE {TRADES}, n AS (SELECT symbol, ts, conf, ret, row_number() {W} AS rn FROM trades), f AS (
 SELECT symbol, ts, conf, ret, rn, CAST(conf >= 0.6 AS INT) AS taken, CASE WHEN conf >= 0.6 THEN ret ELSE 0 END AS cum, greatest(CASE WHEN conf >= 0.6 THEN ret ELSE 0 END, 0) AS peak FROM n WHERE rn = 1 UNION ALL
 SELECT symbol, ts, conf, ret, rn, ok, cum + ok * ret, greatest(peak, cum + ok * ret) FROM (SELECT n.*, f.cum, f.peak, CAST(n.conf >= 0.6 + least((f.peak - f.cum) * 2, 0.15) AS INT) AS ok FROM f JOIN n ON n.symbol = f.symbol AND n.rn = f.rn + 1))
 SELECT symbol, ts, {r('conf')} AS conf, {r('ret')} AS ret, taken FROM f""")
def _(t):
    from ticktote.operators.fold import dynamic_threshold

    d = dynamic_threshold(t.trades().select("symbol", "ts", "conf", "ret"), ["symbol"], ["ts"], "conf", "ret", 0.6)
    return rounded(d)


@query("g14_regime_parameter_switch", f"""WITH {BARS}, {_TR}, {_ADX} SELECT symbol, ts, regime, CAST(CASE regime WHEN 'HIGH_VOL_TREND' THEN 0.6 WHEN 'LOW_VOL_TREND' THEN 0.75 ELSE 1.0 END AS DOUBLE) AS threshold, CAST(CASE regime WHEN 'LOW_VOL_TREND' THEN 0.7 ELSE 1.0 END AS DOUBLE) AS tp_mult, CASE WHEN regime = 'RANGE' THEN 1 ELSE 0 END AS skip FROM rg""")
def _(t):
    from ticktote.plans.features import rule_regime
    from ticktote.plans.gates import regime_parameters

    d = regime_parameters(rule_regime(ind.adx_simple(ind.atr_simple(t.bars())), 1.0, 25))
    return d.select("symbol", "ts", "regime", "threshold", "tp_mult", "skip")


@query("g15_wait_condition", f"""WITH {TRADES}, x AS (SELECT *, CASE WHEN close < 20 THEN 0 WHEN close < 60 THEN 1 ELSE 2 END AS rgm, row_number() {W} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM t1), y AS (SELECT *, CASE WHEN rgm <> {lag('rgm')} THEN 1 ELSE 0 END AS ch FROM x), m AS (SELECT symbol, avg(vol) AS mv, avg(abs(ret1)) AS mr FROM y WHERE rn <= n * 0.7 GROUP BY 1)
 SELECT y.symbol, ts, CASE WHEN coalesce(vol > 2 * mv, false) OR coalesce({roll('sum', 'ch', 3, 'y.symbol')} >= 2, false) OR coalesce(abs(ret1) > 3 * mr, false) THEN 1 ELSE 0 END AS wait FROM y JOIN m ON m.symbol = y.symbol""")
def _(t):
    from ticktote.functions.core import band
    from ticktote.plans.gates import wait_condition

    b = t.bars().withColumn("ret1", Q.pct("close"))
    b = b.withColumns({"vol": Q.sd("ret1", 24), "regime": band("close", [20, 60], [0, 1, 2])})
    return wait_condition(b, Q, 0.7).select("symbol", "ts", "wait")


@query("g16_budget_limits", f"""WITH {BETS}, s AS (SELECT race_id, strategy, race_date, {_kelly()} + 100 AS stake FROM bets) SELECT race_id, CAST(sum(stake) OVER (PARTITION BY strategy, race_date ORDER BY race_id) <= 400 AND sum(stake) OVER (PARTITION BY strategy, date_trunc('month', race_date) ORDER BY race_date, race_id) <= 5000 AS INT) AS allowed FROM s""")
def _(t):
    from ticktote.plans.gates import budget

    d = t.bets().withColumn("stake", bt.kelly("prob", "odds", F.lit(100000.0), unit=100.0) + 100)
    return budget(d, "strategy", "race_date", "race_id", "stake", 400, 5000).select("race_id", "allowed")


@query("g17_net_expected_value", f"WITH {TRADES} SELECT symbol, ts, {r('fwd * 0.01 - (high - low) / 40 / 100')} AS net_ev FROM trades")
def _(t):
    return rounded(t.trades().select("symbol", "ts", (C("fwd") * 0.01 - sdiv((C("high") - C("low")) / 40, F.lit(100.0))).alias("net_ev")))


@query("g18_volatility_scaled_position", f"""WITH {TRADES}, q AS (SELECT median(vol) AS mv FROM trades) SELECT symbol, ts, {r('least(greatest(0, 0.55 - 0.45 / 1.5) * 0.5 * greatest(0, least(1, (conf - 0.6) / 0.4)) * 10000 * greatest(0.05, least(1.0, least(1, mv / vol))), 1000)')} AS size FROM trades, q WHERE vol IS NOT NULL""")
def _(t):
    d = t.trades().where("vol IS NOT NULL")
    d = d.join(F.broadcast(exact_quantiles(d, [], "vol", {"mv": 0.5})))
    sc = F.least(F.lit(1.0), sdiv("mv", "vol"))
    return rounded(d.select("symbol", "ts", bt.scaled_position("conf", F.lit(10000.0), sc, 0.6).alias("size")))


@query("g19_confidence_threshold_search", f"""WITH {TRADES}, g AS (SELECT symbol, threshold, count(*) AS n, least(5, sum(CASE WHEN ret > 0 THEN ret END) / -sum(CASE WHEN ret < 0 THEN ret END)) AS pf FROM trades, (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85]::DOUBLE[]) AS threshold) WHERE conf >= threshold + 1e-9 GROUP BY 1, 2)
 SELECT symbol, coalesce(arg_max(threshold, pf + threshold * 1e-6) FILTER (n >= 20), arg_max(threshold, pf + threshold * 1e-6)) AS threshold, {r('coalesce(max(pf) FILTER (n >= 20), max(pf))')} AS pf FROM g GROUP BY 1""")
def _(t):
    x = C("ret")
    g = threshold_grid(t.trades(), ["symbol"], {"threshold": (C("conf") - 1e-9, [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85])}, {"n": F.lit(1), "g": F.when(x > 0, x).otherwise(0.0), "l": F.when(x < 0, -x).otherwise(0.0)})
    g = g.withColumn("pf", F.least(F.lit(5.0), sdiv("g", "l")))
    return rounded(me.best_cell(g, ["symbol"], "pf", C("n") >= 20, ["threshold"]))


@query("g20_zscore_position_size", f"""WITH {BARS}, {_SPR}, v AS (SELECT ls, rs, ts, z, least(greatest(0.3, least(0.8, 0.5 + (least(abs(z), 4) - 2) * 0.05)), 1) AS p, greatest(1.5, least(10.0, 1 / greatest(stddev_samp(s) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 0.01))) AS o FROM zz)
 SELECT ls AS left_symbol, rs AS right_symbol, ts, CAST({_kelly('p', 'o', '10000', '1', '0.1')} AS DOUBLE) AS size FROM v WHERE z IS NOT NULL""")
def _(t):
    from ticktote.operators.pairs import all_pairs
    from ticktote.plans.pair_trade import spread_zscore

    pair = ["left_symbol", "right_symbol"]
    d = spread_zscore(all_pairs(t.bars()))
    d = d.withColumn("vol", Seq(pair, "ts").sd("spread", 60)).where("z IS NOT NULL")
    return d.select(*pair, "ts", bt.zscore_size("z", F.lit(10000.0), "vol").alias("size"))


@query("g21_trend_filter", f"""WITH {TRADES}, s AS (SELECT symbol, ts, {roll('avg', 'close', 50)} AS sma FROM bars) SELECT t.symbol, t.ts, CAST(NOT coalesce((side > 0) <> (close > sma), false) AS INT) AS hard_pass, CAST(conf >= 0.6 + CASE WHEN (side > 0) <> (close > sma) THEN 0.05 ELSE 0 END - 1e-9 AS INT) AS soft_pass FROM trades t JOIN s USING (symbol, ts)""")
def _(t):
    from ticktote.plans.gates import trend_filter

    sma = t.bars().select("symbol", "ts", Q.mean("close", 50).alias("sma"))
    return trend_filter(t.trades().join(sma, ["symbol", "ts"]), "sma", 0.6 - 1e-9, 0.05).select("symbol", "ts", "hard_pass", "soft_pass")


@query("g22_weekday_volatility_filter", f"""WITH {TRADES}, l AS (SELECT symbol, ts, ret, vol, list(vol) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS v FROM trades WHERE vol IS NOT NULL), x AS (SELECT *, CASE WHEN len(v) >= 120 THEN len(list_filter(v, lambda e: e <= vol)) / 120.0 END AS pct FROM l)
 SELECT symbol, ts, {r('ret')} AS ret FROM x WHERE dayofweek(ts) <> 2 AND pct BETWEEN 0.2 AND 0.9""")
def _(t):
    d = t.trades().where("vol IS NOT NULL").withColumn("pct", ind.rolling_pct_rank("vol", 120))
    return rounded(d.where((F.weekday("ts") != 1) & C("pct").between(0.2, 0.9)).select("symbol", "ts", "ret"))


@query("g23_pause_after_losses", f"""WITH {_PNL}, l AS (SELECT *, sum(CAST(ret < 0 AS INT)) OVER d AS ls, sum(ret) OVER d AS day_pnl FROM pb WINDOW d AS (PARTITION BY strategy, race_date ORDER BY race_id)), s AS (SELECT *, ls - coalesce(max(CASE WHEN ret >= 0 THEN ls END) OVER (PARTITION BY strategy, race_date ORDER BY race_id), 0) AS streak FROM l)
 SELECT race_id, CAST(streak AS INT) AS streak, CAST(max(CAST(streak >= 3 OR day_pnl < -0.05 - 1e-9 AS INT)) OVER (PARTITION BY strategy, race_date ORDER BY race_id) AS INT) AS paused FROM s""")
def _(t):
    from ticktote.plans.gates import daily_pause

    return daily_pause(t.bets(), "strategy", "race_date", "race_id", "ret", 3, 0.05 + 1e-9).select("race_id", "streak", "paused")


@query("g24_reason_list", f"""WITH {TRADES} SELECT symbol, ts, concat_ws(';', CASE WHEN conf >= 0.8 THEN 'strong body' END, CASE WHEN agreement >= 5 THEN 'full agreement' END, CASE WHEN vol < 3 THEN 'calm market' END, CASE WHEN side > 0 THEN 'dip bought' END) AS reasons FROM trades""")
def _(t):
    why = all_reasons([("strong body", C("conf") >= 0.8), ("full agreement", C("agreement") >= 5), ("calm market", C("vol") < 3), ("dip bought", C("side") > 0)])
    return t.trades().select("symbol", "ts", why.alias("reasons"))


@query("j19_stop_target_grid", f"""WITH {BARS}, {_TR}, a AS (SELECT symbol, ts, high, low, close, {roll('avg', 'tr', 14)} AS atr, row_number() {W} AS rn FROM tr), g AS (SELECT unnest([0.5, 1.0, 1.5]::DOUBLE[]) AS sl_mult), h AS (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS tp_mult),
 x AS (SELECT e.symbol, e.ts, e.close, e.atr, sl_mult, tp_mult, p.rn - e.rn AS k, p.low <= e.close - sl_mult * e.atr AS sl, p.high >= e.close + tp_mult * e.atr AS tp, p.close AS pc FROM a e JOIN a p ON p.symbol = e.symbol AND p.rn BETWEEN e.rn + 1 AND e.rn + 12, g, h WHERE e.atr IS NOT NULL),
 f AS (SELECT symbol, ts, close, atr, sl_mult, tp_mult, arg_min(sl, k) FILTER (sl OR tp) AS sl, arg_max(pc, k) AS last FROM x GROUP BY 1, 2, 3, 4, 5, 6), t AS (SELECT symbol, sl_mult, tp_mult, CASE WHEN sl IS NULL THEN last / close - 1 WHEN sl THEN -sl_mult * atr / close ELSE tp_mult * atr / close END AS ret, sl FROM f)
 SELECT symbol, sl_mult, tp_mult, count(*) AS n, count(*) FILTER (sl) AS n_stop_loss, {r('sum(CASE WHEN ret > 0 THEN ret END) / -sum(CASE WHEN ret < 0 THEN ret END)')} AS pf FROM t GROUP BY 1, 2, 3""")
def _(t):
    from ticktote.operators.touch import exit_grid

    b = ind.atr_simple(t.bars())
    d = exit_grid(b, Q, F.lit(1), "atr", [0.5, 1.0, 1.5], [0.5, 1.0, 2.0], 12).where("atr IS NOT NULL AND exit_price IS NOT NULL")
    d = d.withColumn("ret", C("exit_price") / C("close") - 1)
    return rounded(me.exit_metrics(d, ["symbol", "sl_mult", "tp_mult"], "ret", "exit_reason").select("symbol", "sl_mult", "tp_mult", "n", "n_stop_loss", "pf"))
