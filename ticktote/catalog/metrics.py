"""Performance metrics, gates on metrics and comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ticktote.catalog.common_sql import BARS, BETS, ENTRIES, TRADES, r, roll
from ticktote.catalog.bars import _TR
from ticktote.catalog.registry import query
from ticktote.functions.core import band, flag, rnd, rounded, sdiv
from ticktote.operators import metrics as me

C = F.col


EQ = BETS + """, eq0 AS (SELECT *, sum(ret) OVER (PARTITION BY strategy ORDER BY race_date, race_id) AS cum FROM bets),
 eq AS (SELECT *, 1 + cum AS equity, max(1 + cum) OVER (PARTITION BY strategy ORDER BY race_date, race_id) AS peak FROM eq0)"""
GP, GL = "sum(CASE WHEN ret > 0 THEN ret END)", "nullif(-sum(CASE WHEN ret < 0 THEN ret END), 0)"
M1 = f"""count(*) AS n_trades, {r(f'{GP} / {GL}')} AS pf, {r('max((peak - equity) / peak) * 100')} AS mdd, {r('avg(ret) / stddev_samp(ret) * sqrt(8760)')} AS sharpe,
 {r('avg(ret) / nullif(stddev_samp(CASE WHEN ret < 0 THEN ret END), 0) * sqrt(8760)', 4)} AS sortino, {r('avg(ret) - 0.0003')} AS exp_value_net, {r('avg(CAST(ret > 0 AS INT)) * 100')} AS win_rate,
 {r('avg(CASE WHEN ret > 0 THEN ret END) / -avg(CASE WHEN ret < 0 THEN ret END)')} AS payoff"""


@query("m1_trade_metrics", f"WITH {EQ.replace('CASE WHEN finish = 1 THEN odds - 1 ELSE -1.0 END * 0.02', 'CASE WHEN finish = 1 THEN odds - 1 ELSE -1.0 - (race_id % 7) / 100.0 END * 0.02')} SELECT strategy, {M1} FROM eq GROUP BY 1")
def _(t):
    loss = -(1.0 + (C("race_id") % 7) / 100.0) * 0.02
    b = t.bets().withColumn("ret", F.when(C("hit") == 1, C("ret")).otherwise(loss))
    d = me.trade_metrics(b, ["strategy"], "ret", ["race_date", "race_id"])
    return rounded(d.withColumn("sortino", rnd("sortino", 4)), skip=["sortino"])


@query("m2_universal_metrics", f"""WITH {EQ} SELECT strategy, {r('(sum(payout) - count(*) * 100) / (count(*) * 100) * 100', 4)} AS roi, {r('max((peak - equity) / peak) * 100', 4)} AS max_drawdown, {r('avg(ret) / stddev_samp(ret) * sqrt(252.0 * 5)', 4)} AS sharpe,
 {r(f'{GP} / {GL}', 4)} AS profit_factor, {r('avg(CAST(ret > 0 AS INT))', 4)} AS win_rate, count(*) AS n_trades, {r('avg(ret)')} AS mean_return, {r('stddev_samp(ret)')} AS std_return FROM eq GROUP BY 1""")
def _(t):
    d = me.universal_metrics(t.bets(), ["strategy"], "ret", ["race_date", "race_id"], trades_per_period=5, stake=F.lit(100.0), payout=C("payout"))
    return rounded(d.drop("sortino", "mean_return", "std_return"), 4).join(rounded(d.select("strategy", "mean_return", "std_return")), "strategy")


@query("m3_strategy_metrics", f"""WITH {TRADES}, x AS (SELECT *, CASE WHEN side > 0 THEN conf ELSE 1 - conf END AS p, CAST(fwd > 0 AS INT) AS y FROM trades), m AS (SELECT *, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS yh, CASE WHEN p > 0.5 THEN 1 ELSE -1 END * fwd * 0.01 - 0.0005 AS s FROM x WHERE p > 0.6 OR p < 0.4),
 c AS (SELECT *, exp(sum(ln(1 + s)) OVER (PARTITION BY symbol ORDER BY ts)) AS curve FROM m), d AS (SELECT *, max(curve) OVER (PARTITION BY symbol ORDER BY ts) AS pk FROM c), n AS (SELECT symbol, count(*) AS bars FROM trades GROUP BY 1)
 SELECT d.symbol, {r('avg(CAST(yh = y AS INT))')} AS accuracy, {r('sum(yh * y) / nullif(sum(yh), 0)')} AS precision, {r('sum(yh * y) / nullif(sum(y), 0)')} AS recall, {r('2 * sum(yh * y) / nullif(sum(yh) + sum(y), 0)')} AS f1,
 {r('avg(s) / stddev_pop(s) * sqrt(count(*) / max(bars) * 8760 / 4)')} AS sharpe, {r('sum(CASE WHEN s > 0 THEN s END) / -sum(CASE WHEN s < 0 THEN s END)')} AS profit_factor, {r('max((pk - curve) / pk)')} AS max_drawdown, count(*) AS trade_count, {r('avg(CAST(s > 0 AS INT))')} AS win_rate, {r('arg_max(curve, ts) - 1')} AS total_return FROM d JOIN n ON n.symbol = d.symbol GROUP BY 1""")
def _(t):
    d = t.trades().withColumns({"p": F.when(C("side") > 0, C("conf")).otherwise(1 - C("conf")), "y": flag(C("fwd") > 0), "move": C("fwd") * 0.01})
    return rounded(me.strategy_metrics(d, "symbol", "p", "y", "move", "ts", threshold=0.6, cost=0.0005, horizon=4))


_KF = "greatest(100, least(floor(500 * greatest(greatest(0, (prob * odds - 1) / nullif(odds - 1, 0)) * 0.25, 0.1) * 4 / 100) * 100, 1500))"


@query("m4_bet_metrics", f"""WITH {BETS}, k AS (SELECT *, {_KF} AS stake FROM bets WHERE odds > 1), p AS (SELECT *, CASE WHEN hit = 1 THEN stake * odds - stake ELSE -stake END AS pnl FROM k), c AS (SELECT *, sum(pnl) OVER (PARTITION BY strategy ORDER BY race_date, race_id) AS cum FROM p),
 d AS (SELECT *, max(cum) OVER (PARTITION BY strategy ORDER BY race_date, race_id) AS pk FROM c) SELECT strategy, count(*) AS n_bets, CAST(sum(hit) AS BIGINT) AS n_wins, {r('sum(CASE WHEN pnl > 0 THEN pnl END) / -sum(CASE WHEN pnl < 0 THEN pnl END)')} AS pf, {r('1 + sum(pnl) / sum(stake)')} AS recovery,
 {r('avg(pnl) / stddev_pop(pnl) * sqrt(count(*))')} AS sharpe, {r('max(pk - cum)', 3)} AS mdd, {r('sum(stake)', 3)} AS total_bet FROM d GROUP BY 1""")
def _(t):
    d = me.bet_metrics(t.bets().where("odds > 1"), ["strategy"], ["race_date", "race_id"])
    return rounded(d.withColumns({"mdd": rnd("mdd", 3), "total_bet": rnd("total_bet", 3)}), skip=["mdd", "total_bet"])


@query("m5_unit_score_metrics", f"""WITH {TRADES}, x AS (SELECT symbol, ts, CASE WHEN (side > 0) = (fwd > 0) THEN 1.0 ELSE -1.0 END AS pnl FROM trades WHERE conf >= 0.7 AND agreement >= 4), c AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol ORDER BY ts) AS cum FROM x), d AS (SELECT *, max(cum) OVER (PARTITION BY symbol ORDER BY ts) AS pk FROM c),
 n AS (SELECT symbol, count(*) AS bars FROM trades GROUP BY 1) SELECT d.symbol, count(*) AS trade_count, {r('sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN 1 END)')} AS pf, {r('avg(CAST(pnl > 0 AS INT))')} AS win_rate, {r('max(pk - cum)')} AS mdd,
 {r('(sum(pnl) / max(bars)) / sqrt(count(*) / max(bars) - pow(sum(pnl) / max(bars), 2)) * sqrt(252)')} AS spread_sharpe FROM d JOIN n ON n.symbol = d.symbol GROUP BY 1""")
def _(t):
    d = t.trades().withColumn("pnl", F.when((C("side") > 0) == (C("fwd") > 0), 1.0).otherwise(-1.0))
    return rounded(me.unit_score_metrics(d, "symbol", "pnl", (C("conf") >= 0.7) & (C("agreement") >= 4), "ts"))


@query("m6_trade_exit_metrics", f"""WITH {BARS}, {_TR}, a AS (SELECT symbol, ts, high, low, close, CASE WHEN close < open THEN 1 ELSE -1 END AS side, {roll('avg', 'tr', 14)} AS atr, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM tr),
 x AS (SELECT e.symbol, e.ts, e.close, e.side, e.atr, p.rn - e.rn AS k, CASE WHEN e.side > 0 THEN p.low <= e.close - e.atr ELSE p.high >= e.close + e.atr END AS sl, CASE WHEN e.side > 0 THEN p.high >= e.close + 1.5 * e.atr ELSE p.low <= e.close - 1.5 * e.atr END AS tp, p.close AS pc FROM a e JOIN a p ON p.symbol = e.symbol AND p.rn BETWEEN e.rn + 1 AND e.rn + 24 WHERE e.atr IS NOT NULL),
 f AS (SELECT symbol, ts, close, side, atr, arg_min(sl, k) FILTER (sl OR tp) AS sl, arg_max(pc, k) AS last FROM x GROUP BY 1, 2, 3, 4, 5), t AS (SELECT symbol, sl, side * (CASE WHEN sl IS NULL THEN last WHEN sl THEN close - side * atr ELSE close + side * 1.5 * atr END / close - 1) AS ret FROM f)
 SELECT symbol, count(*) AS n, {r(f'{GP} / {GL}')} AS pf, {r('avg(CAST(ret > 0 AS INT))')} AS win_rate, {r('avg(CASE WHEN ret > 0 THEN ret END) / -avg(CASE WHEN ret < 0 THEN ret END)')} AS win_loss_ratio, count(*) FILTER (sl) AS n_stop_loss, count(*) FILTER (NOT sl) AS n_take_profit, count(*) FILTER (sl IS NULL) AS n_time_exit FROM t GROUP BY 1""")
def _(t):
    from ticktote.functions.core import Seq
    from ticktote.operators import indicators as ind
    from ticktote.operators.touch import first_touch

    q = Seq("symbol", "ts")
    b = ind.atr_simple(t.bars()).withColumn("side", F.when(C("close") < C("open"), 1).otherwise(-1))
    d = first_touch(b, q, C("close") + C("side") * C("atr") * 1.5, C("close") - C("side") * C("atr"), C("side"), 24).where("atr IS NOT NULL AND exit_price IS NOT NULL")
    d = d.withColumn("ret", C("side") * (C("exit_price") / C("close") - 1))
    return rounded(me.exit_metrics(d, ["symbol"], "ret", "exit_reason"))


_PER = """per AS (SELECT max(race_date) AS d FROM bets), pt AS (SELECT 'day' AS period, d AS lo, d AS hi FROM per UNION ALL SELECT 'week', d - INTERVAL 6 DAY, d FROM per UNION ALL SELECT 'month', d - INTERVAL 29 DAY, d FROM per UNION ALL SELECT 'all', TIMESTAMP '1900-01-01', d FROM per)"""


@query("m7_period_report", f"""WITH {BETS}, {_PER}, x AS (SELECT period, b.*, CASE WHEN ev < 0.8 THEN 'SKIP' WHEN car_no % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS action, CASE WHEN ev < 0.7 THEN 'low value' ELSE 'thin edge' END AS reason FROM bets b JOIN pt ON race_date BETWEEN lo AND hi),
 a AS (SELECT *, sum(ret) OVER (PARTITION BY period ORDER BY race_date, race_id) AS cum FROM x WHERE action <> 'SKIP'), m AS (SELECT *, greatest(max(cum) OVER (PARTITION BY period ORDER BY race_date, race_id), 0) AS pk FROM a),
 k AS (SELECT period, {r('max(pk - cum)')} AS max_drawdown, {r('sum(ret)')} AS cumulative, {r('max(ret)')} AS best, {r('min(ret)')} AS worst, {r('avg(CAST(ret > 0 AS INT))')} AS win_rate FROM m GROUP BY 1)
 SELECT x.period, count(*) FILTER (action = 'BUY') AS buys, count(*) FILTER (action = 'SELL') AS sells, count(*) FILTER (action = 'SKIP') AS skips, count(*) FILTER (action = 'SKIP' AND reason = 'low value') AS skip_low_value, any_value(max_drawdown) AS max_drawdown, any_value(cumulative) AS cumulative, any_value(best) AS best, any_value(worst) AS worst, any_value(win_rate) AS win_rate
 FROM x LEFT JOIN k ON k.period = x.period GROUP BY 1""")
def _(t):
    b = t.bets().withColumns({"action": F.when(C("ev") < 0.8, "SKIP").when(C("car_no") % 2 == 0, "BUY").otherwise("SELL"), "reason": F.when(C("ev") < 0.7, "low value").otherwise("thin edge")})
    return rounded(me.period_report(b, "race_date", ["race_date", "race_id"], "ret"))


@query("m8_ticket_signal_metrics", f"""WITH {BETS}, c AS (SELECT *, payout - 100 AS pnl, sum(payout - 100) OVER (PARTITION BY strategy ORDER BY race_date, race_id) AS cum FROM bets WHERE ev >= 0.9), d AS (SELECT *, max(cum) OVER (PARTITION BY strategy ORDER BY race_date, race_id) AS pk FROM c)
 SELECT strategy, count(*) AS n, {r('sum(payout) / (count(*) * 100) * 100', 4)} AS roi_pct, {r('sum(CASE WHEN pnl > 0 THEN pnl END) / -sum(CASE WHEN pnl < 0 THEN pnl END)')} AS pf, {r('max(pk - cum)', 3)} AS max_drawdown, {r('avg(pnl) / stddev_samp(pnl)')} AS sharpe FROM d GROUP BY 1""")
def _(t):
    sig = t.bets().where("ev >= 0.9").withColumn("pnl", C("payout") - 100)
    d = me.money_curve(sig, ["strategy"], "pnl", ["race_date", "race_id"])
    x = C("pnl")
    return d.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("payout") / (F.count(F.lit(1)) * 100) * 100, 4).alias("roi_pct"), rnd(me.pf(x)).alias("pf"), rnd(F.max(C("peak") - C("cum")), 3).alias("max_drawdown"), rnd(F.avg(x) / F.stddev_samp(x)).alias("sharpe"))


@query("m9_ev_realisation", f"WITH {BETS} SELECT strategy, {r('avg(payout / 100) / avg(ev)')} AS realisation FROM bets GROUP BY 1")
def _(t):
    return rounded(t.bets().groupBy("strategy").agg(sdiv(F.avg(C("payout") / 100), F.avg("ev")).alias("realisation")))


_CRIT = "(VALUES ('boat', 'roi', 1, 0.0), ('boat', 'max_drawdown', -1, 30.0), ('fx', 'profit_factor', 1, 1.3), ('fx', 'max_drawdown', -1, 20.0), ('fx', 'sharpe', 1, 1.0), ('fx', 'n_trades', 1, 200.0), ('stock', 'roi', 1, 0.0), ('stock', 'max_drawdown', -1, 20.0), ('crypto', 'roi', 1, 0.0), ('crypto', 'max_drawdown', -1, 30.0)) AS crit(market, metric, sgn, lim)"
_UM = EQ + f""", um AS (SELECT strategy, (sum(payout) - count(*) * 100) / (count(*) * 100) * 100 AS roi, max((peak - equity) / peak) * 100 AS max_drawdown, avg(ret) / stddev_samp(ret) * sqrt(252.0 * 5) AS sharpe, {GP} / {GL} AS profit_factor, CAST(count(*) AS DOUBLE) AS n_trades FROM eq GROUP BY 1),
 lm AS (SELECT strategy, unnest(['roi', 'max_drawdown', 'sharpe', 'profit_factor', 'n_trades']) AS metric, unnest([roi, max_drawdown, sharpe, profit_factor, n_trades]) AS v FROM um)"""


@query("m10_readiness_gate", f"""WITH {_UM} SELECT strategy, market, CAST(count(*) FILTER ((v - lim) * sgn < 0) = 0 AS INT) AS ready, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER ((v - lim) * sgn < 0), '') AS failed FROM lm JOIN {_CRIT} USING (metric) GROUP BY 1, 2""")
def _(t):
    d = me.universal_metrics(t.bets(), ["strategy"], "ret", ["race_date", "race_id"], 5, stake=F.lit(100.0), payout=C("payout"))
    return me.readiness(d, ["strategy"])


_HALF = BETS + f""", h AS (SELECT strategy, CASE WHEN race_date < TIMESTAMP '1998-01-01' THEN 'a' ELSE 'b' END AS half, {GP} / {GL} AS pf, avg(hit) AS win_rate, avg(ret) AS roi, count(*) AS n FROM bets GROUP BY 1, 2), j AS (SELECT a.strategy, a.pf AS pf_a, b.pf AS pf_b, a.win_rate AS wr_a, b.win_rate AS wr_b, a.roi AS roi_a, b.roi AS roi_b FROM h a JOIN h b ON a.strategy = b.strategy AND a.half = 'a' AND b.half = 'b')"""


def halves(t):
    half = F.when(C("race_date") < F.lit("1998-01-01").cast("timestamp_ntz"), "a").otherwise("b")
    x = C("ret")
    g = t.bets().groupBy("strategy", half.alias("half")).agg(me.pf(x).alias("pf"), F.avg("hit").alias("win_rate"), F.avg(x).alias("roi"))
    return g.where("half = 'a'").drop("half"), g.where("half = 'b'").drop("half")


@query("m11_metric_alerts", f"WITH {_HALF}, u AS (SELECT strategy, 'pf' AS metric, pf_b - pf_a AS delta, 0.05 AS lim FROM j UNION ALL SELECT strategy, 'win_rate', wr_b - wr_a, 0.01 FROM j UNION ALL SELECT strategy, 'roi', roi_b - roi_a, 0.001 FROM j) SELECT strategy, metric, {r('delta')} AS delta FROM u WHERE abs(delta) >= lim")
def _(t):
    a, b = halves(t)
    return rounded(me.metric_alerts(a, b, ["strategy"], {"pf": 0.05, "win_rate": 0.01, "roi": 0.001}))


@query("m17_model_comparison", f"WITH {_HALF} SELECT strategy, {r('pf_b - pf_a')} AS d_pf, {r('wr_b - wr_a')} AS d_win_rate, {r('roi_b - roi_a')} AS d_roi, CAST(pf_b > pf_a AND roi_b > roi_a AS INT) AS improved FROM j")
def _(t):
    a, b = halves(t)
    d = me.compare(a, b, ["strategy"], ["pf", "win_rate", "roi"])
    return rounded(d.select("strategy", "d_pf", "d_win_rate", "d_roi", flag((C("d_pf") > 0) & (C("d_roi") > 0)).alias("improved")))


@query("m16_adoption_test", f"WITH {_HALF} SELECT strategy, CAST(pf_b > 0.8 AND roi_b > -1 AND pf_b >= pf_a * 1.01 AS INT) AS adopt, {r('pf_b / pf_a - 1')} AS improvement FROM j")
def _(t):
    a, b = halves(t)
    return rounded(me.adoption(a, b, ["strategy"], min_pf=0.8, min_exp=-1.0, min_gain=0.01))


@query("m12_theoretical_roi", f"""WITH {BETS} SELECT ev_threshold, count(*) AS n_bets, CAST(sum(hit) AS BIGINT) AS n_hits, {r('sum(CASE WHEN hit = 1 THEN 0.75 / prob ELSE 0 END) / count(*) * 100')} AS roi FROM bets, (SELECT unnest([1.0, 1.1, 1.3, 1.6, 2.0]::DOUBLE[]) AS ev_threshold) WHERE prob * field_size >= ev_threshold + 1e-6 AND prob > 0.001 GROUP BY 1""")
def _(t):
    from ticktote.operators.grid import threshold_grid

    b = t.bets().where("prob > 0.001")
    g = threshold_grid(b, [], {"ev_threshold": (C("prob") * C("field_size") - 1e-6, [1.0, 1.1, 1.3, 1.6, 2.0])}, {"n_bets": F.lit(1), "n_hits": C("hit"), "ret": F.when(C("hit") == 1, 0.75 / C("prob")).otherwise(0.0)})
    return rounded(g.select("ev_threshold", "n_bets", "n_hits", (C("ret") / C("n_bets") * 100).alias("roi")))


_HALF = "avg(ret) FILTER (race_date {0} '1998-01-01') / nullif(stddev_samp(ret) FILTER (race_date {0} '1998-01-01'), 0)"


@query("m13_overfit_probability", f"""WITH {BETS}, z AS (SELECT strategy || '/' || style AS name, {_HALF.format('<')} AS si, {_HALF.format('>=')} AS so FROM bets GROUP BY 1),
 s AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS i, count(*) OVER () AS n, rank() OVER (ORDER BY so DESC) AS ro FROM z WHERE si IS NOT NULL AND so IS NOT NULL),
 d AS (SELECT draw, unnest(range(1, n + 1)) AS slot, n FROM (SELECT unnest(range(1000)) AS draw), (SELECT max(n) AS n FROM s)),
 p AS (SELECT draw, (((draw + 1) * 48271 * (slot + 7919) + slot * slot * 69621) % 2147483647) % n AS i FROM d),
 b AS (SELECT draw, ro, n, row_number() OVER (PARTITION BY draw ORDER BY si DESC, name DESC) AS k FROM p JOIN s USING (i)),
 q AS (SELECT avg(CAST(ro > n // 2 AS INT)) AS pbo, count(*) AS draws FROM b WHERE k = 1)
 SELECT {r('pbo')} AS pbo, draws, {r('(SELECT arg_max(so, si) FROM s) * sqrt(1 - pbo)')} AS deflated_sharpe FROM q""")
def _(t):
    half = F.when(C("race_date") < F.lit("1998-01-01").cast("timestamp_ntz"), C("ret"))
    other = F.when(C("race_date") >= F.lit("1998-01-01").cast("timestamp_ntz"), C("ret"))
    s = t.bets().groupBy(F.concat_ws("/", "strategy", "style").alias("strategy")).agg(sdiv(F.avg(half), F.stddev_samp(half)).alias("sharpe_is"), sdiv(F.avg(other), F.stddev_samp(other)).alias("sharpe_oos"))
    return rounded(me.overfit_probability(s, "strategy", "sharpe_is", "sharpe_oos", draws=1000))


@query("m14_screening_grid", f"""WITH {TRADES} SELECT symbol, conf_min, agree_min, count(*) AS n, {r('sum(CASE WHEN (side > 0) = (fwd > 0) THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN (side > 0) = (fwd > 0) THEN 0 ELSE 1 END), 0)')} AS pf, {r('avg(CASE WHEN (side > 0) = (fwd > 0) THEN 1.0 ELSE -1.0 END) - 0.02')} AS net_ev
 FROM trades, (SELECT unnest([0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS conf_min), (SELECT unnest([3.0, 4.0, 5.0]::DOUBLE[]) AS agree_min) WHERE conf >= conf_min AND agreement >= agree_min GROUP BY 1, 2, 3""")
def _(t):
    from ticktote.operators.grid import threshold_grid

    win = flag((C("side") > 0) == (C("fwd") > 0))
    g = threshold_grid(t.trades(), ["symbol"], {"conf_min": (C("conf"), [0.5, 0.6, 0.7, 0.8]), "agree_min": (C("agreement"), [3.0, 4.0, 5.0])}, {"n": F.lit(1), "w": win})
    lose = C("n") - C("w")
    return rounded(g.select("symbol", "conf_min", "agree_min", "n", sdiv("w", lose).alias("pf"), ((C("w") - lose) / C("n") - 0.02).alias("net_ev")))


@query("m15_portfolio_snapshot", f"""WITH {TRADES}, pos AS (SELECT symbol, ts, side, close AS entry, sum(ret) OVER (PARTITION BY symbol ORDER BY ts) AS realised FROM trades WHERE conf > 0.9)
 SELECT b.symbol, b.ts, {r('1 + coalesce(p.realised, 0.0) + coalesce(p.side * (b.close / p.entry - 1) * 0.01, 0.0)')} AS equity FROM bars b ASOF LEFT JOIN pos p ON p.symbol = b.symbol AND b.ts >= p.ts""")
def _(t):
    from ticktote.operators.asof import asof
    from ticktote.operators.sequence import running

    p = running(t.trades().where("conf > 0.9"), ["symbol"], ["ts"], {"realised": "ret"})
    p = p.select("symbol", "ts", "side", C("close").alias("entry"), "realised")
    d = asof(t.bars().select("symbol", "ts", "close"), p, by=["symbol"])
    open_ = F.coalesce(C("side") * (sdiv("close", "entry") - 1) * 0.01, F.lit(0.0))
    return rounded(d.select("symbol", "ts", (1 + F.coalesce("realised", F.lit(0.0)) + open_).alias("equity")))


@query("m18_ab_comparison", f"""WITH {TRADES}, v AS (SELECT symbol, 'A' AS variant, ts, ret FROM trades UNION ALL SELECT symbol, 'B', ts, CASE WHEN conf >= 0.75 THEN ret ELSE -ret END FROM trades), c AS (SELECT *, 1 + sum(ret) OVER w AS eq FROM v WINDOW w AS (PARTITION BY symbol, variant ORDER BY ts)), d AS (SELECT *, max(eq) OVER (PARTITION BY symbol, variant ORDER BY ts) AS pk FROM c)
 SELECT symbol, variant, {r('avg(CAST(ret > 0 AS INT))')} AS accuracy, {r(f'{GP} / {GL}')} AS pf, {r('max((pk - eq) / pk) * 100')} AS mdd, {r('avg(ret) / stddev_samp(ret) * sqrt(8760)')} AS sharpe FROM d GROUP BY 1, 2""")
def _(t):
    tr = t.trades()
    alt = F.when(C("conf") >= 0.75, C("ret")).otherwise(-C("ret"))
    v = tr.select("symbol", "ts", F.explode(F.array(F.struct(F.lit("A").alias("variant"), C("ret")), F.struct(F.lit("B").alias("variant"), alt.alias("ret")))).alias("e")).select("symbol", "ts", "e.*")
    m = me.trade_metrics(v, ["symbol", "variant"], "ret", ["ts"])
    return rounded(m.select("symbol", "variant", (C("win_rate") / 100).alias("accuracy"), "pf", "mdd", "sharpe"))


@query("m19_budget_ledger", f"WITH {BETS} SELECT strategy, count(*) * 100 AS stake, {r('sum(payout)', 3)} AS payout, {r('sum(payout) / (count(*) * 100)')} AS recovery, {r('sum(payout) / nullif(sum(CASE WHEN hit = 0 THEN 100 END), 0)')} AS pf, count(*) AS n_bets, CAST(sum(hit) AS BIGINT) AS n_hits FROM bets GROUP BY 1")
def _(t):
    n = F.count(F.lit(1))
    lost = F.sum(F.when(C("hit") == 0, 100.0))
    return t.bets().groupBy("strategy").agg((n * 100).alias("stake"), rnd(F.sum("payout"), 3).alias("payout"), rnd(F.sum("payout") / (n * 100)).alias("recovery"), rnd(sdiv(F.sum("payout"), lost)).alias("pf"), n.alias("n_bets"), F.sum("hit").alias("n_hits"))


@query("m20_period_breakdown_report", f"""WITH {BETS}, x AS (SELECT * FROM bets WHERE race_date >= TIMESTAMP '1998-03-01' AND race_date < TIMESTAMP '1998-04-01') SELECT CASE WHEN grouping(strategy) = 0 THEN 'grade' WHEN grouping(style) = 0 THEN 'style' ELSE 'all' END AS axis, coalesce(strategy, style, 'all') AS segment, count(*) AS n, CAST(sum(hit) AS BIGINT) AS wins, {r('avg(hit)')} AS hit_rate, {r('avg(ret)')} AS roi FROM x GROUP BY GROUPING SETS ((), (strategy), (style))""")
def _(t):
    from ticktote.sources.files import date_filter

    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    b = date_filter(t.bets(), "race_date", ts("1998-03-01")).where(C("race_date") < ts("1998-04-01"))
    g = b.groupingSets([[], ["strategy"], ["style"]], "strategy", "style").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("wins"), F.avg("hit").alias("hit_rate"), F.avg("ret").alias("roi"), F.grouping("strategy").alias("g1"), F.grouping("style").alias("g2"))
    axis = F.when(C("g1") == 0, "grade").when(C("g2") == 0, "style").otherwise("all")
    return rounded(g.select(axis.alias("axis"), F.coalesce("strategy", "style", F.lit("all")).alias("segment"), "n", "wins", "hit_rate", "roi"))


@query("m21_window_metrics", f"""WITH {TRADES}, w AS (SELECT symbol, date_trunc('week', ts) AS wk, {GP} / {GL} AS pf, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe, avg(CAST(ret > 0 AS INT)) AS wr, count(*) AS n FROM trades GROUP BY 1, 2) SELECT symbol, count(*) AS windows, {r('avg(pf)')} AS pf, {r('avg(sharpe)')} AS sharpe, {r('avg(wr)')} AS win_rate, CAST(sum(n) AS BIGINT) AS trades FROM w GROUP BY 1""")
def _(t):
    x = C("ret")
    sd = F.stddev_samp(x)
    w = t.trades().groupBy("symbol", F.date_trunc("week", "ts").alias("wk")).agg(me.pf(x).alias("pf"), sdiv(F.avg(x), sd).alias("sharpe"), F.avg(flag(x > 0)).alias("wr"), F.count(F.lit(1)).alias("n"))
    return rounded(w.groupBy("symbol").agg(F.count(F.lit(1)).alias("windows"), F.avg("pf").alias("pf"), F.avg("sharpe").alias("sharpe"), F.avg("wr").alias("win_rate"), F.sum("n").alias("trades")))


@query("w13_running_equity", f"WITH {EQ} SELECT race_id, strategy, {r('equity')} AS equity, {r('peak')} AS peak, {r('(peak - equity) / peak')} AS drawdown FROM eq")
def _(t):
    d = me.equity_curve(t.bets(), ["strategy"], "ret", ["race_date", "race_id"])
    return rounded(d.select("race_id", "strategy", "equity", "peak", "drawdown"))


@query("w24_rolling_accuracy_stops", f"""WITH {TRADES}, x AS (SELECT symbol, ts, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS ok, vol FROM trades), y AS (SELECT *, CASE WHEN count(*) OVER w >= 100 THEN avg(ok) OVER w END AS acc FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
 m AS (SELECT symbol, avg(vol) AS mv FROM x GROUP BY 1) SELECT y.symbol, ts, {r('acc')} AS acc, concat_ws(';', CASE WHEN acc < 0.45 THEN 'accuracy stop' END, CASE WHEN acc < 0.48 THEN 'accuracy warning' END, CASE WHEN vol > 1.5 * mv THEN 'volatility' END) AS reasons FROM y JOIN m ON m.symbol = y.symbol""")
def _(t):
    from ticktote.functions.core import Seq, all_reasons

    q = Seq("symbol", "ts")
    d = t.trades().withColumn("ok", flag(C("ret") > 0))
    d = d.join(d.groupBy("symbol").agg(F.avg("vol").alias("mv")), "symbol").withColumn("acc", q.mean("ok", 100))
    why = all_reasons([("accuracy stop", C("acc") < 0.45), ("accuracy warning", C("acc") < 0.48), ("volatility", C("vol") > 1.5 * C("mv"))])
    return rounded(d.select("symbol", "ts", "acc", why.alias("reasons")))


@query("w25_cumulative_percent", "WITH g AS (SELECT p_brand, sum(l_extendedprice) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT p_brand, " + r("v / sum(v) OVER () * 100") + " AS pct, " + r("sum(v) OVER (ORDER BY v DESC, p_brand) / sum(v) OVER () * 100") + " AS cum_pct FROM g")
def _(t):
    from ticktote.operators.metrics import cumulative_percent

    g = t.raw("lineitem").select(C("l_partkey").alias("p_partkey"), "l_extendedprice").join(t.raw("part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.sum("l_extendedprice").alias("v"))
    return rounded(cumulative_percent(g, "p_brand", "v").select("p_brand", "pct", "cum_pct"))
