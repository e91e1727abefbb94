"""Grouped performance, breakdowns, calibration, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ticktote.catalog.common_sql import AUX, BARS, BETS, ENTRIES, RE, SNAPS, TRADES, r, roll
from ticktote.catalog.registry import query
from ticktote.functions.core import Seq, band, flag, rnd, rounded, sdiv
from ticktote.operators import combos as cb
from ticktote.operators.grid import threshold_grid
from ticktote.operators.metrics import grouped_performance, pf
from ticktote.operators.quantiles import column_quantiles

C = F.col
Q = Seq("symbol", "ts")
PERF = f"""count(*) AS n, CAST(sum(hit) AS BIGINT) AS wins, {r('avg(hit)')} AS win_rate, {r('sum(CASE WHEN ret > 0 THEN ret END) / nullif(-sum(CASE WHEN ret < 0 THEN ret END), 0)')} AS pf, {r('avg(ret)')} AS roi, {r('avg(odds)')} AS avg_odds, {r('avg(ev)')} AS avg_ev, {r('sum(ret)')} AS total_pnl"""
TPF = r("sum(CASE WHEN ret > 0 THEN ret END) / nullif(-sum(CASE WHEN ret < 0 THEN ret END), 0)")


def trade_stats(g):
    x = C("ret")
    return g.agg(F.count(F.lit(1)).alias("n"), pf(x).alias("pf"), F.avg(flag(x > 0)).alias("win_rate"), F.avg(x).alias("mean_ret"))


TS = f"count(*) AS n, {TPF} AS pf, {r('avg(CAST(ret > 0 AS INT))')} AS win_rate, {r('avg(ret)')} AS mean_ret"


@query("a1_grouped_performance", f"WITH {BETS} SELECT venue_id, {PERF} FROM bets GROUP BY 1")
def _(t):
    return rounded(grouped_performance(t.bets(), ["venue_id"]))


def breakdown(t):
    b = t.bets().withColumns({"venue": C("venue_id").cast("string"), "style_": C("style"), "size_": C("field_size").cast("string")})
    x = C("ret")
    g = b.groupingSets([["venue"], ["strategy"], ["style_"], ["size_"]], "venue", "strategy", "style_", "size_").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").alias("wins"), pf(x).alias("pf"), F.avg(x).alias("roi"),
        F.grouping("venue").alias("g1"), F.grouping("strategy").alias("g2"), F.grouping("style_").alias("g3"))
    axis = F.when(C("g1") == 0, "venue").when(C("g2") == 0, "grade").when(C("g3") == 0, "style").otherwise("field_size")
    return g.select(axis.alias("axis"), F.coalesce("venue", "strategy", "style_", "size_").alias("segment"), "n", "wins", "pf", "roi")


_BRK = BETS + f""", brk AS (SELECT CASE WHEN grouping(venue_id) = 0 THEN 'venue' WHEN grouping(strategy) = 0 THEN 'grade' WHEN grouping(style) = 0 THEN 'style' ELSE 'field_size' END AS axis,
 coalesce(CAST(venue_id AS VARCHAR), strategy, style, CAST(field_size AS VARCHAR)) AS segment, count(*) AS n, CAST(sum(hit) AS BIGINT) AS wins, {TPF} AS pf, {r('avg(ret)')} AS roi FROM bets GROUP BY GROUPING SETS ((venue_id), (strategy), (style), (field_size)))"""


@query("a2_multi_axis_breakdown", f"WITH {_BRK} SELECT * FROM brk")
def _(t):
    return rounded(breakdown(t))


@query("a3_unprofitable_segments", f"WITH {_BRK} SELECT * FROM brk WHERE n >= 10 AND pf < 1")
def _(t):
    return rounded(breakdown(t)).where("n >= 10 AND pf < 1")


@query("a4_hour_metrics", f"""WITH {TRADES}, g AS (SELECT hour(ts) AS hour, {TS} FROM trades WHERE conf > 0.995 GROUP BY 1) SELECT CAST(h.hour AS INT) AS hour, CAST(coalesce(n, 0) AS BIGINT) AS n, pf, win_rate, mean_ret FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN g ON g.hour = h.hour""")
def _(t):
    g = trade_stats(t.trades().where("conf > 0.995").groupBy(F.hour("ts").alias("hour")))
    hours = t.spark.range(24).select(C("id").cast("int").alias("hour"))
    return rounded(hours.join(F.broadcast(g), "hour", "left").fillna({"n": 0}))


@query("a5_day_of_week_metrics", f"WITH {TRADES} SELECT symbol, CAST((dayofweek(ts) + 6) % 7 AS INT) AS dow, {TS} FROM trades GROUP BY 1, 2")
def _(t):
    return rounded(trade_stats(t.trades().groupBy("symbol", F.weekday("ts").alias("dow"))))


@query("a6_volatility_bucket_metrics", f"WITH {TRADES} SELECT CASE WHEN vol < 3 THEN 'low' WHEN vol < 6 THEN 'mid' WHEN vol < 12 THEN 'high' ELSE 'extreme' END AS vol_bucket, {TS} FROM trades WHERE vol IS NOT NULL GROUP BY 1")
def _(t):
    b = band("vol", [3, 6, 12], ["low", "mid", "high", "extreme"])
    return rounded(trade_stats(t.trades().where("vol IS NOT NULL").groupBy(b.alias("vol_bucket"))))


@query("a7_before_after_filter", f"""WITH {TRADES} SELECT symbol, count(*) AS n_before, {TPF} AS pf_before, count(*) FILTER (hour(ts) NOT IN (20, 23)) AS n_after,
 {r('sum(CASE WHEN ret > 0 AND hour(ts) NOT IN (20, 23) THEN ret END) / nullif(-sum(CASE WHEN ret < 0 AND hour(ts) NOT IN (20, 23) THEN ret END), 0)')} AS pf_after FROM trades GROUP BY 1""")
def _(t):
    keep = ~F.hour("ts").isin(20, 23)
    kept = F.when(keep, C("ret"))
    return rounded(t.trades().groupBy("symbol").agg(F.count(F.lit(1)).alias("n_before"), pf(C("ret")).alias("pf_before"), F.count(F.when(keep, 1)).alias("n_after"), pf(kept).alias("pf_after")))


@query("a8_monthly_roi", f"WITH {BETS} SELECT CAST(date_trunc('month', race_date) AS DATE) AS month, count(*) AS bets, CAST(sum(hit) AS BIGINT) AS hits, count(*) * 100 AS stake, {r('sum(payout)', 4)} AS payout, {r('sum(payout) / (count(*) * 100)')} AS roi FROM bets GROUP BY 1")
def _(t):
    n = F.count(F.lit(1))
    g = t.bets().groupBy(F.trunc("race_date", "month").alias("month")).agg(n.alias("bets"), F.sum("hit").alias("hits"), (n * 100).alias("stake"), rnd(F.sum("payout"), 4).alias("payout"), rnd(F.sum("payout") / (n * 100)).alias("roi"))
    return g


_MO, _EV = [1.0, 3.0, 5.0, 10.0, 20.0], [0.7, 0.9, 1.0, 1.1, 1.2]


@query("a9_sensitivity_matrix", f"""WITH {ENTRIES} SELECT min_odds, ev_threshold, count(*) AS n, CAST(sum(CAST(finish = 1 AS INT)) AS BIGINT) AS hits, {r('sum(CASE WHEN finish = 1 THEN odds ELSE 0 END) / count(*)')} AS roi FROM entries, (SELECT unnest([1.0, 3.0, 5.0, 10.0, 20.0]::DOUBLE[]) AS min_odds), (SELECT unnest([0.7, 0.9, 1.0, 1.1, 1.2]::DOUBLE[]) AS ev_threshold)
 WHERE odds >= min_odds AND prob * odds >= ev_threshold GROUP BY 1, 2""")
def _(t):
    e = t.entries()
    hit = C("finish") == 1
    g = threshold_grid(e, [], {"min_odds": (C("odds"), _MO), "ev_threshold": (C("prob") * C("odds"), _EV)}, {"n": F.lit(1), "hits": flag(hit), "ret": F.when(hit, C("odds")).otherwise(0.0)})
    return g.select("min_odds", "ev_threshold", "n", "hits", rnd(C("ret") / C("n")).alias("roi"))


_TIX = ENTRIES + """, p2 AS (SELECT a.race_id, a.car_no AS c1, b.car_no AS c2, a.prob AS q1, b.prob AS q2, a.disc AS d, a.finish AS f1, b.finish AS f2, a.prob * b.prob / nullif(1 - a.prob, 0) AS x12, b.prob * a.prob / nullif(1 - b.prob, 0) AS x21 FROM entries a JOIN entries b ON a.race_id = b.race_id AND a.car_no <> b.car_no),
 p3 AS (SELECT p.*, e.car_no AS c3, e.prob AS q3, e.finish AS f3 FROM p2 p JOIN entries e ON e.race_id = p.race_id AND e.car_no <> p.c1 AND e.car_no <> p.c2),
 p3x AS (SELECT *, x12 * q3 / nullif(1 - q1 - q2, 0) AS x123 FROM p3),
 tk AS (SELECT race_id, 'exacta' AS ticket, c1 || '-' || c2 AS combo, x12 AS prob, d, f1 = 1 AND f2 = 2 AS hit FROM p2
 UNION ALL SELECT race_id, 'quinella', c1 || '-' || c2, x12 + x21, d, f1 <= 2 AND f2 <= 2 FROM p2 WHERE c1 < c2
 UNION ALL SELECT race_id, 'wide', c1 || '-' || c2, least(1.0, 3 * (x12 + x21)), d, f1 <= 3 AND f2 <= 3 FROM p2 WHERE c1 < c2
 UNION ALL SELECT race_id, 'trifecta', c1 || '-' || c2 || '-' || c3, x123, d, f1 = 1 AND f2 = 2 AND f3 = 3 FROM p3x
 UNION ALL SELECT race_id, 'trio', least(c1, c2, c3) || '-' || (c1 + c2 + c3 - least(c1, c2, c3) - greatest(c1, c2, c3)) || '-' || greatest(c1, c2, c3), sum(x123), arg_min(d, c1), bool_and(f1 <= 3 AND f2 <= 3 AND f3 <= 3) FROM p3x GROUP BY 1, 3),
 tickets AS (SELECT race_id, ticket, combo, prob, 0.75 / prob * (0.8 + 12 * d) AS odds, CAST(hit AS INT) AS hit FROM tk WHERE prob > 1e-9)"""


EV_LIMITS = [0.9, 1.0, 1.1, 1.2, 1.3, 1.4]
MIN_ODDS, MAX_ODDS = [1.0, 5.0, 10.0, 20.0, 50.0], [100.0, 500.0, 1000.0, 99999.0]


@query("a10_ticket_ev_odds_grid", f"""WITH {_TIX} SELECT ticket, min_odds, max_odds, ev_threshold, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, {r('sum(hit * odds) / count(*)', 4)} AS roi
 FROM tickets, (SELECT unnest({EV_LIMITS}::DOUBLE[]) AS ev_threshold), (SELECT unnest({MIN_ODDS}::DOUBLE[]) AS min_odds), (SELECT unnest({MAX_ODDS}::DOUBLE[]) AS max_odds)
 WHERE prob * odds >= ev_threshold + 1e-6 AND odds + 1e-6 >= min_odds AND odds + 1e-6 < max_odds GROUP BY 1, 2, 3, 4""")
def _(t):
    """Ticket x 6 values x 20 ranges of odds; rows are summed by the narrow ranges first, which are then spread."""
    d = cb.ticket_rows(t.entries(), 1e-9)
    edges = MIN_ODDS + MAX_ODDS
    d = d.withColumn("low", band(C("odds") + 1e-6, edges, [None, *edges])).where("low is not null")
    g = threshold_grid(d, ["ticket", "low"], {"ev_threshold": (C("prob") * C("odds") - 1e-6, EV_LIMITS)}, {"n": F.lit(1), "hits": C("hit"), "ret": C("hit") * C("odds")})
    wide = g.withColumn("min_odds", F.explode(F.filter(F.array(*map(F.lit, MIN_ODDS)), lambda x: x <= C("low")))).withColumn("max_odds", F.explode(F.filter(F.array(*map(F.lit, MAX_ODDS)), lambda x: x > C("low"))))
    s = wide.groupBy("ticket", "min_odds", "max_odds", "ev_threshold").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "ret")])
    return s.select("ticket", "min_odds", "max_odds", "ev_threshold", "n", "hits", rnd(C("ret") / C("n"), 4).alias("roi"))


@query("a11_pattern_combination_grid", f"""WITH {_TIX}, x AS (SELECT *, prob * odds >= 1.1 + 1e-6 AS a, race_id % 3 = 0 AS b, odds >= 20 AS c FROM tickets WHERE ticket IN ('exacta', 'quinella'))
 SELECT ticket, pattern, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, {r('sum(hit * odds) / count(*)', 4)} AS roi FROM x, (SELECT unnest(['A', 'AB', 'AC', 'ABC']) AS pattern) WHERE a AND (pattern NOT LIKE '%B%' OR b) AND (pattern NOT LIKE '%C%' OR c) GROUP BY 1, 2""")
def _(t):
    d = cb.ticket_rows(t.entries(), 1e-9, ("exacta", "quinella"))
    b, c = C("race_id") % 3 == 0, C("odds") >= 20
    pats = F.array_compact(F.array(F.lit("A"), F.when(b, "AB"), F.when(c, "AC"), F.when(b & c, "ABC")))
    # pre-aggregate by the pattern set, then spread the few combined rows
    g = d.where(C("prob") * C("odds") - 1e-6 >= 1.1).groupBy("ticket", pats.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.sum(C("hit") * C("odds")).alias("ret"))
    g = g.withColumn("pattern", F.explode("p")).groupBy("ticket", "pattern").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("ret").alias("ret"))
    return g.select("ticket", "pattern", "n", "hits", rnd(C("ret") / C("n"), 4).alias("roi"))


@query("a12_fold_weighted_mean", f"""WITH {TRADES}, f AS (SELECT symbol, CAST(ts AS DATE) AS fold, count(*) AS n, sum(CASE WHEN ret > 0 THEN ret END) / nullif(-sum(CASE WHEN ret < 0 THEN ret END), 0) AS pf, avg(CAST(ret > 0 AS INT)) AS wr, -min(ret) AS worst FROM trades GROUP BY 1, 2)
 SELECT symbol, CAST(sum(n) AS BIGINT) AS trades, {r('sum(pf * n) / sum(CASE WHEN pf IS NOT NULL THEN n END)')} AS pf, {r('sum(wr * n) / sum(n)')} AS win_rate, {r('max(worst)')} AS worst FROM f GROUP BY 1""")
def _(t):
    x = C("ret")
    f = t.trades().groupBy("symbol", F.to_date("ts").alias("fold")).agg(F.count(F.lit(1)).alias("n"), pf(x).alias("pf"), F.avg(flag(x > 0)).alias("wr"), (-F.min(x)).alias("worst"))
    ok = F.when(C("pf").isNotNull(), C("n"))
    return rounded(f.groupBy("symbol").agg(F.sum("n").alias("trades"), sdiv(F.sum(C("pf") * C("n")), F.sum(ok)).alias("pf"), (F.sum(C("wr") * C("n")) / F.sum("n")).alias("win_rate"), F.max("worst").alias("worst")))


@query("a13_group_accuracy", f"""WITH {BETS}, x AS (SELECT strategy, CAST(venue_id AS VARCHAR) AS venue, CASE WHEN prob < 0.3 THEN 'low' WHEN prob < 0.5 THEN 'mid' ELSE 'high' END AS band, hit FROM bets)
 SELECT CASE WHEN grouping(strategy) = 0 THEN 'grade' WHEN grouping(venue) = 0 THEN 'venue' WHEN grouping(band) = 0 THEN 'confidence' ELSE 'all' END AS axis, coalesce(strategy, venue, band, 'all') AS segment, count(*) AS n, {r('avg(hit)')} AS accuracy FROM x GROUP BY GROUPING SETS ((), (strategy), (venue), (band))""")
def _(t):
    b = t.bets().select("strategy", C("venue_id").cast("string").alias("venue"), band("prob", [0.3, 0.5], ["low", "mid", "high"]).alias("band"), "hit")
    g = b.groupingSets([[], ["strategy"], ["venue"], ["band"]], "strategy", "venue", "band").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("accuracy"), F.grouping("strategy").alias("g1"), F.grouping("venue").alias("g2"), F.grouping("band").alias("g3"))
    axis = F.when(C("g1") == 0, "grade").when(C("g2") == 0, "venue").when(C("g3") == 0, "confidence").otherwise("all")
    return rounded(g.select(axis.alias("axis"), F.coalesce("strategy", "venue", "band", F.lit("all")).alias("segment"), "n", "accuracy"))


@query("a14_reporter_hit_rates", f"""WITH {ENTRIES}, w AS (SELECT race_id, max(CASE WHEN finish = 1 THEN car_no END) AS win, max(CASE WHEN car_no = 2 THEN finish END) AS fav_rank, max(CASE WHEN car_no = 1 THEN finish END) AS second_rank, max(field_size) AS fs FROM entries GROUP BY 1)
 SELECT count(*) AS n, {r('avg(CAST(fav_rank = 1 AS INT))')} AS fav_win, {r('avg(CAST(fav_rank <= 3 AS INT))')} AS fav_top3, {r('avg(CAST(win IN (1, 2, 3) AS INT))')} AS in_set, {r('avg(CAST(second_rank = 2 AS INT))')} AS second_hit FROM w WHERE fs >= 3""")
def _(t):
    from ticktote.functions.text import parse_prediction_line

    e = t.entries()
    rep = e.where("car_no <= 3 AND field_size >= 3").groupBy("race_id").agg(F.lit("2-1,3").alias("line"))
    p = parse_prediction_line(rep, "line")
    d = e.select("race_id", "car_no", "finish").join(p, "race_id")
    win = C("finish") == 1
    g = d.groupBy("race_id").agg(
        F.max(flag(win & (C("car_no") == C("favourite")))).alias("a"), F.max(flag((C("finish") <= 3) & (C("car_no") == C("favourite")))).alias("b"),
        F.max(flag(win & F.array_contains("recommended", C("car_no")))).alias("c"), F.max(flag((C("finish") == 2) & (C("car_no") == C("second")))).alias("d"))
    return rounded(g.agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("fav_win"), F.avg("b").alias("fav_top3"), F.avg("c").alias("in_set"), F.avg("d").alias("second_hit")))


@query("a15_calibration", f"""WITH {ENTRIES}, g AS (SELECT CAST(floor(prob * 10) AS INT) AS bin, count(*) AS n, avg(prob) AS predicted, avg(CAST(finish = 1 AS INT)) AS actual FROM entries WHERE prob < 1 GROUP BY 1),
 x AS (SELECT CAST(b.bin AS INT) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n, predicted, actual, abs(predicted - actual) AS error FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN g ON g.bin = b.bin)
 SELECT bin, n, {r('predicted')} AS predicted, {r('actual')} AS actual, {r('error')} AS error, {r('max(error) OVER ()')} AS max_error, CAST(max(error) OVER () < 0.10 AS INT) AS well_calibrated FROM x""")
def _(t):
    from ticktote.operators.metrics import calibration

    return rounded(calibration(t.entries(), "prob", flag(C("finish") == 1)))


@query("a15_calibration_clamped", f"""WITH {ENTRIES} SELECT CAST(least(floor(prob * 10), 9) AS INT) AS bin, count(*) AS n, {r('avg(prob)')} AS predicted, {r('avg(CAST(finish = 1 AS INT))')} AS actual FROM entries GROUP BY 1""")
def _(t):
    from ticktote.operators.metrics import calibration

    return rounded(calibration(t.entries(), "prob", flag(C("finish") == 1), clamp=True).where("n > 0").select("bin", "n", "predicted", "actual"))


@query("a16_distribution_share", f"WITH {ENTRIES} SELECT style, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()')} AS share FROM entries GROUP BY 1")
def _(t):
    g = t.raw("lineitem").groupBy(C("l_returnflag").alias("style")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(g.withColumn("share", C("n") / F.sum("n").over(Window.partitionBy())))


_REG = TRADES + ", rg AS (SELECT *, CASE WHEN close < 20 THEN 'low' WHEN close < 60 THEN 'mid' ELSE 'high' END AS regime FROM t1)"


@query("a17_regime_profile", f"""WITH {_REG} SELECT regime, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()')} AS share, {r('avg(fwd)')} AS mean_fwd, {r('avg(vol)')} AS mean_vol FROM rg GROUP BY 1""")
def _(t):
    from ticktote.operators.metrics import regime_profile

    b = t.bars().withColumns({"ret1": Q.pct("close"), "fwd": sdiv(Q.lead("close", 4), C("close")) - 1}).withColumn("vol", Q.sd("ret1", 24))
    b = b.withColumn("regime", band("close", [20, 60], ["low", "mid", "high"]))
    return rounded(regime_profile(b, "regime", "fwd", "vol"))


@query("a17_transition_matrix", f"""WITH {_REG}, p AS (SELECT lag(regime) OVER (PARTITION BY symbol ORDER BY ts) AS prev, regime FROM rg) SELECT prev, regime AS cur, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY prev)')} AS p FROM p WHERE prev IS NOT NULL GROUP BY 1, 2""")
def _(t):
    from ticktote.operators.metrics import transition_matrix

    b = t.bars().withColumn("regime", band("close", [20, 60], ["low", "mid", "high"]))
    return rounded(transition_matrix(b, Q, "regime"))


_COV = SNAPS + ", sv AS (SELECT race_id, minutes FROM snaps WHERE (race_id + minutes) % 7 <> 0)"


@query("a18_odds_coverage", f"""WITH {_COV}, a AS (SELECT minutes, count(DISTINCT race_id) AS n_races, count(*) AS n_rows FROM sv GROUP BY 1), f AS (SELECT count(*) AS full_races FROM (SELECT race_id FROM sv WHERE minutes IN (60, 30, 5, 0) GROUP BY 1 HAVING count(DISTINCT minutes) = 4)), o AS (SELECT count(*) AS total FROM orders)
 SELECT minutes, n_races, n_rows, full_races, {r('n_races / total * 100')} AS coverage_pct FROM a, f, o""")
def _(t):
    s = t.odds_snapshots().where((C("race_id") + C("minutes")) % 7 != 0).groupBy("race_id", "minutes").agg(F.count(F.lit(1)).alias("k"))
    a = s.groupBy("minutes").agg(F.count(F.lit(1)).alias("n_races"), F.sum("k").alias("n_rows"))
    full = s.where(C("minutes").isin(60, 30, 5, 0)).groupBy("race_id").agg(F.count(F.lit(1)).alias("m")).where("m = 4").agg(F.count(F.lit(1)).alias("full_races"))
    tot = t.raw("orders").agg(F.count(F.lit(1)).alias("total"))
    d = a.join(F.broadcast(full)).join(F.broadcast(tot))
    return d.select("minutes", "n_races", "n_rows", "full_races", rnd(C("n_races") / C("total") * 100).alias("coverage_pct"))


@query("a19_hourly_sentiment", f"""WITH {BARS}, n AS (SELECT date_trunc('hour', ts) AS ts, avg(value - 50) AS polarity FROM events WHERE event_type = 'signup' AND value > 60 GROUP BY 1) SELECT b.symbol, b.ts, {r('coalesce(n.polarity, 0.0)')} AS polarity FROM bars b LEFT JOIN n ON n.ts = b.ts""")
def _(t):
    from ticktote.functions.text import hourly_mean

    n = hourly_mean(t.raw("events").where("event_type = 'signup' AND value > 60").select("ts", (C("value") - 50).alias("polarity")), "ts", "polarity")
    return rounded(t.bars().select("symbol", "ts").join(n, "ts", "left").fillna({"polarity": 0.0}).select("symbol", "ts", "polarity"))


@query("a20_sales_breakdown", f"""WITH g AS (SELECT CASE WHEN p_retailprice < 950 THEN 'low' WHEN p_retailprice < 1000 THEN 'mid' ELSE 'high' END AS price_band, p_type, count(*) AS n, sum(l_extendedprice) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
 SELECT price_band, CAST(sum(n) AS BIGINT) AS n, {r('sum(revenue)', 3)} AS revenue, {r('sum(revenue) / sum(n)', 4)} AS mean_sale, arg_max(p_type, revenue) AS best_type FROM g GROUP BY 1""")
def _(t):
    d = t.raw("lineitem").select(C("l_partkey").alias("p_partkey"), "l_extendedprice").join(t.raw("part"), "p_partkey")
    g = d.groupBy(band("p_retailprice", [950, 1000], ["low", "mid", "high"]).alias("price_band"), "p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("revenue"))
    g = g.groupBy("price_band").agg(F.sum("n").alias("n"), F.sum("revenue").alias("r"), F.max_by("p_type", "revenue").alias("best_type"))
    return g.select("price_band", "n", rnd("r", 3).alias("revenue"), rnd(C("r") / C("n"), 4).alias("mean_sale"), "best_type")


_FE = ["score", "qty", "disc", "tax", "prob", "odds"]


@query("a21_correlation_matrix", f"WITH {ENTRIES} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS corr, CAST(abs(corr({a}, {b})) >= 0.3 AS INT) AS strong FROM entries" for i, a in enumerate(_FE) for b in _FE[i + 1:]))
def _(t):
    from ticktote.operators.metrics import correlation_pairs

    return rounded(correlation_pairs(t.entries(), _FE).withColumn("strong", flag(F.abs("corr") >= 0.3)))


@query("a22_quantile_baselines", f"WITH {BARS} SELECT symbol, {r('median(volume)')} AS median_volume, {r('quantile_cont(close, 0.98)')} AS q98_close, {r('quantile_cont(high - low, 0.2)')} AS q20_range FROM bars GROUP BY 1")
def _(t):
    b = t.bars().withColumn("rng", C("high") - C("low"))
    return rounded(column_quantiles(b, ["symbol"], {"median_volume": ("volume", 0.5), "q98_close": ("close", 0.98), "q20_range": ("rng", 0.2)}))


@query("a23_period_summary", f"""WITH {BETS}, m AS (SELECT max(race_date) AS d FROM bets) SELECT strategy, {', '.join(f"count(*) FILTER ({c} AND hit = 1) AS {k}_wins, count(*) FILTER ({c} AND hit = 0) AS {k}_losses" for k, c in (("day", "race_date = d"), ("wtd", "race_date >= date_trunc('week', d)"), ("mtd", "race_date >= date_trunc('month', d)")))}, {r("coalesce(sum(CASE WHEN race_date >= date_trunc('month', d) THEN ret END), 0.0)")} AS mtd_pnl FROM bets, m GROUP BY 1""")
def _(t):
    b = t.bets()
    b = b.join(F.broadcast(t.raw("orders").join(t.raw("lineitem").select(C("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").agg(F.max("o_orderdate").alias("d"))))
    conds = {"day": C("race_date") == C("d"), "wtd": C("race_date") >= F.date_trunc("week", "d"), "mtd": C("race_date") >= F.date_trunc("month", "d")}
    aggs = [F.count(F.when(c & (C("hit") == h), 1)).alias(f"{k}_{n}") for k, c in conds.items() for h, n in ((1, "wins"), (0, "losses"))]
    return rounded(b.groupBy("strategy").agg(*aggs, F.coalesce(F.sum(F.when(conds["mtd"], C("ret"))), F.lit(0.0)).alias("mtd_pnl")))


@query("a24_lane_base_rates", f"WITH {ENTRIES} SELECT car_no AS lane, count(*) AS n, {r('avg(CAST(finish = 1 AS INT))')} AS win_rate, {r('avg(CAST(finish <= 2 AS INT))')} AS top2_rate FROM entries GROUP BY 1")
def _(t):
    return rounded(t.entries().groupBy(C("car_no").alias("lane")).agg(F.count(F.lit(1)).alias("n"), F.avg(flag(C("finish") == 1)).alias("win_rate"), F.avg(flag(C("finish") <= 2)).alias("top2_rate")))


_SY = ("click", "error", "purchase", "signup", "view")


@query("a25_pivoted_correlation", f"""WITH {BARS} SELECT a.symbol AS jp, {', '.join(r(f"corr(a.close, b.close) FILTER (b.symbol = '{s}')") + f" AS {s}" for s in ('error', 'purchase', 'signup'))} FROM bars a JOIN bars b ON a.ts = b.ts WHERE a.symbol IN ('click', 'view') GROUP BY 1""")
def _(t):
    from ticktote.operators.pairs import side_by_side

    w = side_by_side(t.bars(), list(_SY))
    us = ("error", "purchase", "signup")
    g = w.agg(*[F.corr(a, b).alias(f"{a}_{b}") for a in ("click", "view") for b in us])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("jp"), *[C(f"{a}_{b}").alias(b) for b in us]) for a in ("click", "view")]))
    return rounded(g.select(rows.alias("e")).select("e.*"))


# ---- ordering ----------------------------------------------------------------
@query("k1_chronological_position", "SELECT o_orderkey AS race_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
def _(t):
    from ticktote.operators.sequence import number_rows

    o = t.raw("orders").select(C("o_orderkey").alias("race_id"), "o_orderdate")
    d = number_rows(o, [], ["o_orderdate", "race_id"], store=False)
    return d.select("race_id", C("pos").cast("bigint").alias("pos"))


@query("k2_top_k_per_race", f"WITH {ENTRIES} SELECT race_id, car_no, {r('prob * odds')} AS ev, CAST(row_number() OVER (PARTITION BY race_id ORDER BY round(prob * odds, 9) DESC, car_no) AS INT) AS rk FROM entries QUALIFY rk <= 3")
def _(t):
    e = t.entries().withColumn("ev", F.round(C("prob") * C("odds"), 9))
    k = F.row_number().over(Window.partitionBy("race_id").orderBy(C("ev").desc(), "car_no"))
    return rounded(e.withColumn("rk", k).where("rk <= 3").select("race_id", "car_no", "ev", "rk"))


@query("k3_top_pick_hits", f"""WITH {ENTRIES}, k AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY prob DESC, car_no) AS rk FROM entries), g AS (SELECT race_id, max(CASE WHEN rk = 1 AND finish = 1 THEN 1 ELSE 0 END) AS top1, max(CASE WHEN rk <= 3 AND finish = 1 THEN 1 ELSE 0 END) AS top3, max(field_size) AS fs FROM k GROUP BY 1)
 SELECT fs AS field_size, count(*) AS n, {r('avg(top1)')} AS top1_rate, {r('avg(top3)')} AS top3_rate FROM g GROUP BY 1""")
def _(t):
    k = F.row_number().over(Window.partitionBy("race_id").orderBy(C("prob").desc(), "car_no"))
    e = t.entries().withColumn("rk", k)
    g = e.groupBy("race_id").agg(F.max(flag((C("rk") == 1) & (C("finish") == 1))).alias("a"), F.max(flag((C("rk") <= 3) & (C("finish") == 1))).alias("b"), F.max("field_size").alias("field_size"))
    return rounded(g.groupBy("field_size").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("top1_rate"), F.avg("b").alias("top3_rate")))


@query("k4_global_top_picks", f"WITH {TRADES} SELECT symbol, ts, {r('conf')} AS conf, CAST(agreement AS INT) AS agreement FROM trades WHERE conf >= 0.6 AND agreement >= 4 ORDER BY agreement DESC, round(conf, 9) DESC, symbol, ts LIMIT 10")
def _(t):
    d = t.trades().where("conf >= 0.6 AND agreement >= 4").orderBy(C("agreement").desc(), F.round("conf", 9).desc(), "symbol", "ts").limit(10)
    return rounded(d.select("symbol", "ts", "conf", "agreement"))


@query("k5_best_parameters", f"""WITH {ENTRIES}, g AS (SELECT style, ev_threshold, count(*) AS n, sum(CASE WHEN finish = 1 THEN odds - 1 ELSE 0 END) / nullif(sum(CASE WHEN finish <> 1 THEN 1 END), 0) AS pf FROM entries, (SELECT unnest([0.7, 0.9, 1.0, 1.1, 1.2]::DOUBLE[]) AS ev_threshold) WHERE prob * odds >= ev_threshold + 1e-6 GROUP BY 1, 2)
 SELECT style, coalesce(arg_max(ev_threshold, pf) FILTER (n >= 4000), arg_max(ev_threshold, pf)) AS ev_threshold, {r('coalesce(max(pf) FILTER (n >= 4000), max(pf))')} AS pf FROM g GROUP BY 1""")
def _(t):
    from ticktote.operators.metrics import best_cell

    hit = C("finish") == 1
    g = threshold_grid(t.entries(), ["style"], {"ev_threshold": (C("prob") * C("odds") - 1e-6, _EV)}, {"n": F.lit(1), "g": F.when(hit, C("odds") - 1).otherwise(0.0), "l": flag(~hit)})
    g = g.withColumn("pf", sdiv(C("g"), C("l").cast("double")))
    return rounded(best_cell(g, ["style"], "pf", C("n") >= 4000, ["ev_threshold"]))


@query("k6_best_worst_trade", f"WITH {BETS} SELECT strategy, {r('max(ret)')} AS best_ret, arg_max(race_id, ret * 1e6 + race_id * 1e-9) AS best_race, {r('min(ret)')} AS worst_ret FROM bets GROUP BY 1")
def _(t):
    return rounded(t.bets().groupBy("strategy").agg(F.max("ret").alias("best_ret"), F.max_by("race_id", F.struct("ret", "race_id")).alias("best_race"), F.min("ret").alias("worst_ret")))


@query("k7_latest_per_key", f"WITH {BARS} SELECT symbol, max(ts) AS ts, {r('arg_max(close, ts)')} AS close, {r('arg_max(volume, ts)')} AS volume FROM bars GROUP BY 1")
def _(t):
    g = t.bars().groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "volume"), "ts").alias("v"))
    return rounded(g.select("symbol", "v.ts", "v.close", "v.volume"))


# ---- set operations ------------------------------------------------------------
@query("u1_union_blocks", """SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS kind, count(*) AS n, CAST(NULL AS DOUBLE) AS total FROM lineitem GROUP BY 1, 2 UNION ALL SELECT CAST(o_orderdate AS DATE), o_orderstatus, count(*), """ + r("sum(o_totalprice)", 3) + """ FROM orders GROUP BY 1, 2""")
def _(t):
    a = t.raw("lineitem").groupBy(F.to_date("l_shipdate").alias("day"), C("l_returnflag").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    b = t.raw("orders").groupBy(F.to_date("o_orderdate").alias("day"), C("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 3).alias("total"))
    return a.unionByName(b, allowMissingColumns=True).select("day", "kind", "n", "total")


@query("u2_dedup_keep", "SELECT l_orderkey, l_linenumber, arg_max(l_extendedprice, l_extendedprice) AS last_price, min(l_extendedprice) AS first_price FROM lineitem GROUP BY 1, 2")
def _(t):
    """Keep-first and keep-last by price on a key that repeats; aggregation instead of a ranked window."""
    return t.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max_by("l_extendedprice", "l_extendedprice").alias("last_price"), F.min_by("l_extendedprice", "l_extendedprice").alias("first_price"))


@query("u3_common_dates", "SELECT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '5-LOW'")
def _(t):
    o = t.raw("orders").select(F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    return o.where("o_orderpriority = '1-URGENT'").select("day").intersect(o.where("o_orderpriority = '5-LOW'").select("day"))


@query("u4_missing_dates", """SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 DAY)) AS d) EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'P'""")
def _(t):
    o = t.raw("orders").select(F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    cal = o.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return cal.join(o.where("o_orderstatus = 'P'").select("day").distinct(), "day", "left_anti")
