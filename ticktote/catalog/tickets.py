"""Combination probabilities, tickets, settlement and lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ticktote.catalog.aggregates import _TIX
from ticktote.catalog.common_sql import BETS, ENTRIES, RACES, RE, SNAPS, r
from ticktote.catalog.registry import query
from ticktote.functions import betting as bt
from ticktote.functions.core import all_reasons, band, code_map, first_reason, flag, rnd, rounded, sdiv
from ticktote.operators import combos as cb
from ticktote.operators import race as ra
from ticktote.operators.grid import threshold_grid
from ticktote.sources.storage import stored_table

C = F.col
_J2 = "FROM entries a JOIN entries b ON a.race_id = b.race_id AND a.car_no <> b.car_no"
_J3 = _J2 + " JOIN entries c ON c.race_id = a.race_id AND c.car_no <> a.car_no AND c.car_no <> b.car_no"


@query("r8_trifecta_probabilities", f"""WITH {ENTRIES}, x AS (SELECT a.race_id, a.car_no || '-' || b.car_no || '-' || c.car_no AS combo, a.prob * b.prob / nullif(1 - a.prob, 0) / (a.field_size - 2) AS raw {_J3}), n AS (SELECT *, raw / sum(raw) OVER (PARTITION BY race_id) AS p FROM x)
 SELECT race_id, count(*) AS n_combos, {r('max(p)')} AS top_prob, {r('sum(p)')} AS total, {r('-sum(p * ln(p))', 5)} AS entropy FROM n GROUP BY 1""")
def _(t):
    d = cb.triples(t.entries(), ["car_no", "prob", "field_size"])
    d = d.withColumn("raw", cb.p_exacta(C("prob1"), C("prob2")) / (C("field_size1") - 2))
    d = d.withColumn("p", C("raw") / F.sum("raw").over(ra.race()))
    g = d.groupBy("race_id").agg(F.count(F.lit(1)).alias("n_combos"), F.max("p").alias("top_prob"), F.sum("p").alias("total"), (-F.sum(C("p") * F.log("p"))).alias("entropy"))
    return g.select("race_id", "n_combos", rnd("top_prob").alias("top_prob"), rnd("total").alias("total"), rnd("entropy", 5).alias("entropy"))


@query("r8_trifecta_top5", f"""WITH {ENTRIES}, x AS (SELECT a.race_id, a.car_no || '-' || b.car_no || '-' || c.car_no AS combo, a.prob * b.prob / nullif(1 - a.prob, 0) * c.prob / nullif(1 - a.prob - b.prob, 0) AS p {_J3})
 SELECT race_id, combo, {r('p')} AS p, CAST(row_number() OVER (PARTITION BY race_id ORDER BY round(p, 10) DESC, combo) AS INT) AS rk FROM x QUALIFY rk <= 5""")
def _(t):
    d = cb.triples(t.entries(), ["car_no", "prob"])
    d = d.select("race_id", cb.combo_key(C("car_no1"), C("car_no2"), C("car_no3")).alias("combo"), cb.p_trifecta(C("prob1"), C("prob2"), C("prob3")).alias("p"))
    k = F.row_number().over(Window.partitionBy("race_id").orderBy(F.round("p", 10).desc_nulls_last(), "combo"))
    return rounded(d.withColumn("rk", k).where("rk <= 5"))


@query("r9_ordered_combo_probability", f"WITH {ENTRIES} SELECT a.race_id, a.car_no AS first_car, b.car_no AS second_car, {r('sum(a.prob * b.prob / nullif(1 - a.prob, 0) * c.prob / nullif(1 - a.prob - b.prob, 0))', 5)} AS p_pair, {r('max(a.prob * b.prob / nullif(1 - a.prob, 0) * c.prob / nullif(1 - a.prob - b.prob, 0))', 5)} AS p_best {_J3} GROUP BY 1, 2, 3")
def _(t):
    d = cb.triples(t.entries(), ["car_no", "prob"]).withColumn("p", cb.p_trifecta(C("prob1"), C("prob2"), C("prob3")))
    return rounded(d.groupBy("race_id", C("car_no1").alias("first_car"), C("car_no2").alias("second_car")).agg(F.sum("p").alias("p_pair"), F.max("p").alias("p_best")), 5)


@query("r10_unordered_combo_probability", f"""WITH {ENTRIES} SELECT a.race_id, least(a.car_no, b.car_no, c.car_no) AS c1, greatest(a.car_no, b.car_no, c.car_no) AS c3, count(*) AS n_orders, {r('sum(a.prob * b.prob / nullif(1 - a.prob, 0) * c.prob / nullif(1 - a.prob - b.prob, 0))', 5)} AS p {_J3} GROUP BY 1, 2, 3""")
def _(t):
    d = cb.triples(t.entries(), ["car_no", "prob"], ordered=False)
    p = cb.p_trio(C("prob1"), C("prob2"), C("prob3"))
    return rounded(d.groupBy("race_id", C("car_no1").alias("c1"), C("car_no3").alias("c3")).agg((F.count(F.lit(1)) * 6).alias("n_orders"), F.sum(p).alias("p")), 5)


@query("r10_quinella_closed_form", f"WITH {ENTRIES} SELECT a.race_id, a.car_no AS c1, b.car_no AS c2, {r('a.prob * b.prob / nullif(1 - a.prob, 0) + b.prob * a.prob / nullif(1 - b.prob, 0)')} AS p {_J2} WHERE a.car_no < b.car_no")
def _(t):
    d = cb.pairs(t.entries(), ["car_no", "prob"], ordered=False)
    return rounded(d.select("race_id", C("car_no1").alias("c1"), C("car_no2").alias("c2"), cb.p_quinella(C("prob1"), C("prob2")).alias("p")))


@query("r10b_two_stage_probability", f"""WITH {ENTRIES}, s2 AS (SELECT a.race_id, a.car_no AS c1, b.car_no AS c2, a.prob AS p1, b.prob AS p2, (b.prob + b.disc) / sum(b.prob + b.disc) OVER (PARTITION BY a.race_id, a.car_no) AS q {_J2}),
 x AS (SELECT s2.race_id, s2.c1, p1 * q * e.prob / nullif(1 - p1 - p2, 0) AS p FROM s2 JOIN entries e ON e.race_id = s2.race_id AND e.car_no <> c1 AND e.car_no <> c2) SELECT race_id, c1, count(*) AS n, {r('sum(p)', 5)} AS p_first, {r('max(p)', 5)} AS p_best FROM x GROUP BY 1, 2""")
def _(t):
    e = t.entries()
    s2 = cb.pairs(e, ["car_no", "prob", "disc"])
    raw = C("prob2") + C("disc2")
    s2 = s2.withColumn("q", raw / F.sum(raw).over(Window.partitionBy("race_id", "car_no1")))
    third = e.select("race_id", C("car_no").alias("car_no3"), C("prob").alias("prob3"))
    d = s2.join(third, "race_id").where((C("car_no3") != C("car_no1")) & (C("car_no3") != C("car_no2")))
    p = C("prob1") * C("q") * sdiv(C("prob3"), 1 - C("prob1") - C("prob2"))
    return rounded(d.groupBy("race_id", C("car_no1").alias("c1")).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("p_first"), F.max(p).alias("p_best")), 5)


@query("r10c_two_fixed_trifectas", f"""WITH {RE}, k AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY prob DESC, car_no) AS rk FROM re), w AS (SELECT race_id, race_date, max(CASE WHEN rk = 1 THEN prob END) AS p1, max(CASE WHEN rk = 2 THEN prob END) AS p2, max(CASE WHEN rk = 3 THEN prob END) AS p3, max(CASE WHEN rk = 1 THEN finish END) AS f1, max(CASE WHEN rk = 2 THEN finish END) AS f2, max(CASE WHEN rk = 3 THEN finish END) AS f3 FROM k GROUP BY 1, 2 HAVING count(*) >= 4),
 b AS (SELECT race_date, p1 * p2 / (1 - p1) * p3 / (1 - p1 - p2) AS p, f1 = 1 AND f2 = 2 AND f3 = 3 AS hit FROM w UNION ALL SELECT race_date, p1 * p3 / (1 - p1) * p2 / (1 - p1 - p3), f1 = 1 AND f3 = 2 AND f2 = 3 FROM w)
 SELECT CAST(date_trunc('month', race_date) AS DATE) AS month, ev_threshold, count(*) AS n, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS hits, {r('sum(CASE WHEN hit THEN 0.9 / p ELSE 0 END) / count(*)', 4)} AS roi FROM b, (SELECT unnest([1.1, 5.0, 10.0]::DOUBLE[]) AS ev_threshold) WHERE p * 120 * 0.75 >= ev_threshold + 1e-6 GROUP BY 1, 2""")
def _(t):
    e = t.race_entries()
    k = F.row_number().over(Window.partitionBy("race_id").orderBy(C("prob").desc(), "car_no"))
    e = e.withColumn("rk", k)
    pick = lambda c, i: F.max(F.when(C("rk") == i, C(c))).alias(f"{c}{i}")
    w = e.groupBy("race_id", "race_date").agg(F.count(F.lit(1)).alias("n"), *[pick(c, i) for c in ("prob", "finish") for i in (1, 2, 3)]).where("n >= 4")
    bet = lambda i, j: F.struct(cb.p_trifecta(C("prob1"), C(f"prob{i}"), C(f"prob{j}")).alias("p"), flag((C("finish1") == 1) & (C(f"finish{i}") == 2) & (C(f"finish{j}") == 3)).alias("hit"))
    b = w.select(F.trunc("race_date", "month").alias("month"), F.explode(F.array(bet(2, 3), bet(3, 2))).alias("b")).select("month", "b.*")
    g = threshold_grid(b, ["month"], {"ev_threshold": (C("p") * 120 * 0.75 - 1e-6, [1.1, 5.0, 10.0])}, {"n": F.lit(1), "hits": C("hit"), "ret": F.when(C("hit") == 1, 0.9 / C("p")).otherwise(0.0)})
    return g.select("month", "ev_threshold", "n", "hits", rnd(C("ret") / C("n"), 4).alias("roi"))


@query("r10d_probability_threshold_purchase", f"WITH {_TIX} SELECT ticket, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, {r('sum(hit * odds) / count(*)', 4)} AS roi FROM tickets WHERE prob > 0.02 + 1e-6 GROUP BY 1")
def _(t):
    d = cb.ticket_rows(t.entries(), 0.02 + 1e-6)
    return d.groupBy("ticket").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), rnd(F.sum(C("hit") * C("odds")) / F.count(F.lit(1)), 4).alias("roi"))


@query("r10e_all_tickets_by_pattern", f"""WITH {_TIX} SELECT ticket, CASE WHEN odds + 1e-6 < 20 THEN 'solid' WHEN odds + 1e-6 < 100 THEN 'middle' ELSE 'long' END AS pattern, p_threshold, count(*) AS n, CAST(sum(hit) AS BIGINT) AS hits, {r('sum(hit * odds) / count(*)', 4)} AS roi FROM tickets, (SELECT unnest([0.01, 0.03, 0.1]::DOUBLE[]) AS p_threshold) WHERE prob >= p_threshold + 1e-7 GROUP BY 1, 2, 3""")
def _(t):
    d = cb.ticket_rows(t.entries(), 0.01).withColumn("pattern", band(C("odds") + 1e-6, [20, 100], ["solid", "middle", "long"]))
    g = threshold_grid(d, ["ticket", "pattern"], {"p_threshold": (C("prob") - 1e-7, [0.01, 0.03, 0.1])}, {"n": F.lit(1), "hits": C("hit"), "ret": C("hit") * C("odds")})
    return g.select("ticket", "pattern", "p_threshold", "n", "hits", rnd(C("ret") / C("n"), 4).alias("roi"))


@query("r11_exotic_pricing_from_win_odds", f"""WITH {ENTRIES}, k AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY prob DESC, car_no) AS rk FROM entries QUALIFY rk <= 3)
 SELECT a.race_id, a.car_no AS car_no1, b.car_no AS car_no2, {r('a.prob * least(b.prob / nullif(1 - a.prob, 0), 0.95)')} AS prob, {r('greatest(3.0, least(a.odds * b.odds * 0.6, 300.0))', 5)} AS synth_odds FROM k a JOIN k b ON a.race_id = b.race_id AND a.car_no <> b.car_no""")
def _(t):
    k = F.row_number().over(Window.partitionBy("race_id").orderBy(C("prob").desc(), "car_no"))
    d = cb.pairs(t.entries().withColumn("rk", k).where("rk <= 3"), ["car_no", "prob", "odds"])
    p = C("prob1") * F.least(sdiv(C("prob2"), 1 - C("prob1")), F.lit(0.95))
    o = F.greatest(F.lit(3.0), F.least(C("odds1") * C("odds2") * 0.6, F.lit(300.0)))
    return d.select("race_id", "car_no1", "car_no2", rnd(p).alias("prob"), rnd(o, 5).alias("synth_odds"))


# Win-bet limits by lane (threshold factor, minimum probability).
LANE_FACTOR = {1: 1.0, 2: 1.25, 3: 1.10, 4: 1.0, 5: 1.15, 6: 1.30}
LANE_MIN_PROB = {1: 0.25, 2: 0.10, 3: 0.08, 4: 0.08, 5: 0.06, 6: 0.05}
_LF = "CASE car_no WHEN 2 THEN 1.25 WHEN 3 THEN 1.1 WHEN 5 THEN 1.15 WHEN 6 THEN 1.3 ELSE 1.0 END"
_LP = "CASE car_no WHEN 1 THEN 0.25 WHEN 2 THEN 0.1 WHEN 3 THEN 0.08 WHEN 4 THEN 0.08 WHEN 5 THEN 0.06 ELSE 0.05 END"


def value_bets(e, min_ev: float = 2.0, max_odds: float = 60.0, top: int = 3):
    """Win bets over the lane thresholds, best three of a race by expected value."""
    ev = F.round(C("prob") * C("odds"), 9)
    d = e.withColumn("ev", ev).where(
        (C("odds") > 1) & (C("odds") <= max_odds) & (C("prob") >= code_map("car_no", LANE_MIN_PROB, 0.05) + 1e-9)
        & (ev >= min_ev * code_map("car_no", LANE_FACTOR, 1.0) + 1e-6))
    k = F.row_number().over(Window.partitionBy("race_id").orderBy(C("ev").desc(), "car_no"))
    return d.withColumn("rk", k).where(C("rk") <= top)


_VB = f"vb AS (SELECT *, round(prob * odds, 9) AS ev, row_number() OVER (PARTITION BY race_id ORDER BY round(prob * odds, 9) DESC, car_no) AS rk FROM re WHERE odds > 1 AND odds <= 60 AND prob >= {_LP} + 1e-9 AND round(prob * odds, 9) >= 0.8 * {_LF} + 1e-6 QUALIFY rk <= 3)"


@query("r12_value_bets_win", f"WITH {RE}, {_VB} SELECT race_id, car_no, {r('ev')} AS ev, CAST(rk AS INT) AS rk, {r('greatest(0, (prob * odds - 1) / (odds - 1)) * 0.25')} AS kelly FROM vb")
def _(t):
    d = value_bets(t.entries(), 0.8)
    kf = F.greatest(F.lit(0.0), sdiv(C("prob") * C("odds") - 1, C("odds") - 1)) * 0.25
    return rounded(d.select("race_id", "car_no", "ev", "rk", kf.alias("kelly")))


@query("r13_ev_with_takeout", f"WITH {ENTRIES} SELECT race_id, car_no, {r('prob * odds * 0.75')} AS ev FROM entries")
def _(t):
    return rounded(t.entries().select("race_id", "car_no", bt.expected_value("prob", "odds").alias("ev")))


@query("r14_candidate_filter", f"WITH {_TIX} SELECT ticket, count(*) AS n, {r('avg(prob * odds)')} AS mean_ev FROM tickets WHERE prob * odds >= 1.1 + 1e-6 AND prob >= 0.01 + 1e-9 AND odds >= 5 + 1e-6 AND odds <= 500 - 1e-6 GROUP BY 1")
def _(t):
    d = cb.ticket_rows(t.entries(), 0.01).where((C("prob") * C("odds") >= 1.1 + 1e-6) & (C("prob") >= 0.01 + 1e-9) & (C("odds") >= 5 + 1e-6) & (C("odds") <= 500 - 1e-6))
    return rounded(d.groupBy("ticket").agg(F.count(F.lit(1)).alias("n"), F.avg(C("prob") * C("odds")).alias("mean_ev")))


@query("r15_predictability_score", f"""WITH {ENTRIES}, g AS (SELECT race_id, race_id % 10 AS wind, race_id % 20 AS wave, count(*) FILTER (motor_id % 6 + 1 <> car_no) AS changed, stddev_pop(post) AS sd, count(*) FILTER (disc = 0) AS flying FROM entries GROUP BY 1)
 SELECT race_id, CAST(greatest(0, 100 - CASE WHEN wind >= 7 THEN 25 ELSE 0 END - CASE WHEN wave >= 15 THEN 20 ELSE 0 END - CASE WHEN changed >= 3 THEN 30 ELSE 0 END - CASE WHEN sd < 0.5 - 1e-9 THEN 15 ELSE 0 END - CASE WHEN flying >= 2 THEN 20 ELSE 0 END) AS INT) AS predictability FROM g""")
def _(t):
    g = t.entries().groupBy("race_id").agg(
        F.count(F.when(C("motor_id") % 6 + 1 != C("car_no"), 1)).alias("changed"), F.stddev_pop("post").alias("sd"), F.count(F.when(C("disc") == 0, 1)).alias("flying"))
    d = ra.predictability(g, [(C("race_id") % 10 >= 7, 25), (C("race_id") % 20 >= 15, 20), (C("changed") >= 3, 30), (C("sd") < 0.5 - 1e-9, 15), (C("flying") >= 2, 20)])
    return d.select("race_id", "predictability")


_SIGQ = f"""sc AS (SELECT race_id, CASE WHEN race_id % 10 >= 4 THEN 15 ELSE 0 END + CASE WHEN race_id % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN avg(disc) < 0.05 - 1e-9 THEN 30 ELSE 0 END AS pen FROM entries GROUP BY 1),
 x AS (SELECT e.*, prob * odds * 0.75 AS ev, 100 - pen AS pscore, -tax * 3 * 10 / 120 * CASE WHEN car_no % 2 = 0 THEN 1 ELSE -1 END AS surge FROM entries e JOIN sc USING (race_id))"""


@query("r16_signal_generation", f"""WITH {ENTRIES}, {_SIGQ} SELECT race_id, car_no, {r('ev', 5)} AS ev, CAST(pscore AS INT) AS score, CASE WHEN pscore < 60 THEN 'predictability low' WHEN surge >= 0.015 THEN 'odds surge' WHEN odds > 100 THEN 'odds cap' ELSE 'OK' END AS reason,
 round_even(least(greatest(0, (prob * odds - 1) / (odds - 1)) * 0.25 * 100000, 5000) / 100, 0) * 100 AS stake FROM x WHERE ev >= 0.8 + 1e-6 AND prob < 1 AND odds > 1""")
def _(t):
    """Races' conditions and the late move of the odds are stand-ins, as the tables have none."""
    from ticktote.operators.race import race
    from ticktote.plans.signals import generate_signals

    e = t.entries().withColumn("_m", F.avg("disc").over(race()))
    conditions = [(C("race_id") % 10 >= 4, 15), (C("race_id") % 5 == 0, 10), (C("_m") < 0.05 - 1e-9, 30)]
    move = -C("tax") * 3 * 10 / 120 * F.when(C("car_no") % 2 == 0, 1).otherwise(-1)
    d = generate_signals(e, conditions, move, min_ev=0.8 + 1e-6)
    return d.select("race_id", "car_no", rnd("ev", 5).alias("ev"), C("score").cast("int").alias("score"), "reason", "stake")


@query("r17_combo_line_confidence", f"""WITH {ENTRIES}, m AS (SELECT race_id, car_no, racer_id % 3 AS ln FROM entries), cf AS (SELECT race_id, racer_id % 3 AS ln, 0.5 + 0.1 * (racer_id % 3) AS conf FROM entries GROUP BY 1, 2, 3)
 SELECT a.race_id, a.car_no AS car_no1, b.car_no AS car_no2, {r('CASE WHEN ma.ln = mb.ln THEN 0.5 + 0.1 * ma.ln ELSE 0.0 END')} AS line_confidence {_J2} AND a.car_no < b.car_no JOIN m ma ON ma.race_id = a.race_id AND ma.car_no = a.car_no JOIN m mb ON mb.race_id = b.race_id AND mb.car_no = b.car_no""")
def _(t):
    from ticktote.operators import lines as ln

    e = t.entries().withColumn("line_id", C("racer_id") % 3)
    g = e.groupBy("race_id", "line_id").agg(F.array_sort(F.collect_list("car_no")).alias("c"))
    lines = g.select("race_id", F.array_join(C("c").cast("array<string>"), "-").alias("line"), (0.5 + 0.1 * C("line_id")).alias("confidence"))
    p = cb.pairs(e, ["car_no"], ordered=False)
    d = ln.combo_confidence(p, ln.explode_lines(lines), ["car_no1", "car_no2"], ["race_id", "car_no1", "car_no2"])
    return rounded(d.select("race_id", "car_no1", "car_no2", "line_confidence"))


_DIST = """dl0 AS (SELECT race_id, car_no, s_nationkey % 3 AS district, motor_id % 5 AS term, row_number() OVER (PARTITION BY race_id, s_nationkey % 3 ORDER BY qty DESC, car_no) - 1 AS i, count(*) OVER (PARTITION BY race_id, s_nationkey % 3) AS n FROM entries JOIN supplier ON s_suppkey = racer_id),
 dl AS (SELECT race_id, string_agg(CAST(car_no AS VARCHAR), '-' ORDER BY i) AS line, CASE WHEN max(n) < 2 THEN 0.45 WHEN max(CASE WHEN i % 3 = 0 THEN term END) = max(CASE WHEN i % 3 = 1 THEN term END) THEN 0.8 ELSE 0.7 END AS confidence FROM dl0 GROUP BY race_id, district, i // 3)"""


def district_lines(t, entries=None):
    """entries: rows with race_id, car_no, district, term and back_count, where a caller has stored them."""
    from ticktote.operators import lines as ln

    if entries is not None:
        return ln.from_districts(entries)
    s = t.raw("supplier").select(C("s_suppkey").alias("racer_id"), (C("s_nationkey") % 3).alias("district"))
    e = t.entries().join(s, "racer_id").select("race_id", "car_no", "district", (C("motor_id") % 5).alias("term"), C("qty").alias("back_count"))
    return ln.from_districts(e)


@query("r18_lines_from_districts", f"WITH {ENTRIES}, {_DIST} SELECT race_id, line, {r('confidence')} AS confidence FROM dl")
def _(t):
    return rounded(district_lines(t))


# riders with tax over 0.07 say nothing; their lines go by district
_CML = """ci AS (SELECT race_id, car_no, CASE motor_id % 4 WHEN 0 THEN 'lead' WHEN 1 THEN 'follow' WHEN 2 THEN 'single' ELSE 'follow' END AS role, row_number() OVER (PARTITION BY race_id, CASE motor_id % 4 WHEN 0 THEN 'lead' WHEN 2 THEN 'single' ELSE 'follow' END ORDER BY car_no) AS k FROM entries WHERE tax <= 0.07),
 cs AS (SELECT race_id, string_agg(CAST(car_no AS VARCHAR), '-' ORDER BY CASE role WHEN 'lead' THEN 0 ELSE k END) AS line, 0.8 AS confidence FROM ci WHERE role <> 'single' GROUP BY race_id, CASE role WHEN 'lead' THEN k ELSE (k + 1) // 2 END HAVING bool_or(role = 'lead') UNION ALL SELECT race_id, CAST(car_no AS VARCHAR), 0.8 FROM ci WHERE role = 'single'),
 ds0 AS (SELECT race_id, car_no, s_nationkey % 3 AS district, motor_id % 5 AS term, row_number() OVER (PARTITION BY race_id, s_nationkey % 3 ORDER BY qty DESC, car_no) - 1 AS i, count(*) OVER (PARTITION BY race_id, s_nationkey % 3) AS n FROM entries JOIN supplier ON s_suppkey = racer_id WHERE tax > 0.07 AND race_id IN (SELECT race_id FROM ci)),
 ds AS (SELECT race_id, string_agg(CAST(car_no AS VARCHAR), '-' ORDER BY i) AS line, 0.6 * CASE WHEN max(n) < 2 THEN 0.45 WHEN max(CASE WHEN i % 3 = 0 THEN term END) = max(CASE WHEN i % 3 = 1 THEN term END) THEN 0.8 ELSE 0.7 END AS confidence FROM ds0 GROUP BY race_id, district, i // 3),
 cm AS (SELECT race_id, line, confidence FROM cs UNION ALL SELECT race_id, line, confidence FROM ds WHERE (race_id, line) NOT IN (SELECT (race_id, line) FROM cs))"""


def commented(t):
    """Entries with district, term, back_count and what the rider's comment says, stored: the lines read them several times."""
    from ticktote.functions.text import comment_intent

    words = code_map(C("motor_id") % 4, {0: "自力で前から", 1: "3番の後ろです", 2: "単騎で行く"}, "second wheel for me")
    s = t.raw("supplier").select(C("s_suppkey").alias("racer_id"), (C("s_nationkey") % 3).alias("district"))
    e = t.entries().join(s, "racer_id").select("race_id", "car_no", "district", (C("motor_id") % 5).alias("term"), C("qty").alias("back_count"), F.when(C("tax") <= 0.07, words).alias("comment"))
    e = comment_intent(e, "comment").withColumn("said", C("comment").isNotNull())
    return stored_table(e.select("race_id", "car_no", "district", "term", "back_count", "role", "said"), "commented")


def comment_lines(e):
    from ticktote.operators import lines as ln

    return ln.from_comments(e.where("said").select("race_id", "car_no", "role"), e)


@query("r19_lines_from_comments", f"WITH {ENTRIES}, {_CML} SELECT race_id, line, {r('CAST(confidence AS DOUBLE)')} AS confidence FROM cm")
def _(t):
    return rounded(comment_lines(commented(t)))


@query("r20_line_source_fusion", f"""WITH {ENTRIES}, {_DIST}, {_CML}, c AS (SELECT * FROM cm WHERE race_id % 2 = 0), rp AS (SELECT race_id, line, 0.9 AS confidence FROM dl WHERE race_id % 3 = 0 AND line LIKE '%-%'),
 u AS (SELECT race_id, line, 'c' AS src, confidence FROM c UNION ALL SELECT race_id, line, 'r', confidence FROM rp UNION ALL SELECT race_id, line, 's', confidence FROM dl),
 g AS (SELECT race_id, line, coalesce(max(confidence) FILTER (src = 'c'), 0) AS c, coalesce(max(confidence) FILTER (src = 'r'), 0) AS rr, coalesce(max(confidence) FILTER (src = 's'), 0) AS s, bool_or(src = 'c') AS hc, bool_or(src = 'r') AS hr FROM u GROUP BY 1, 2),
 h AS (SELECT *, bool_or(hc) OVER (PARTITION BY race_id) AS ac, bool_or(hr) OVER (PARTITION BY race_id) AS ar FROM g), f AS (SELECT race_id, line, least(1.0, CASE WHEN ac AND ar THEN 0.6 * c + 0.3 * rr + 0.1 * s WHEN ac THEN 0.75 * c + 0.25 * s WHEN ar THEN 0.5 * rr + 0.5 * s ELSE least(s, 0.3) END) AS confidence FROM h)
 SELECT race_id, line, {r('confidence', 4)} AS confidence FROM f WHERE confidence > 0""")
def _(t):
    from ticktote.operators import lines as ln

    e = commented(t)
    d = district_lines(t, e)
    rep = d.where((C("race_id") % 3 == 0) & C("line").contains("-")).select("race_id", "line", F.lit(0.9).alias("confidence"))
    return rounded(ln.fuse(comment_lines(e).where(C("race_id") % 2 == 0), rep, d), 4)


@query("r21_betrayal_rate", f"""WITH {RE}, x AS (SELECT race_id, car_no, racer_id, race_date, racer_id % 3 AS district, CAST(motor_id % 3 <> racer_id % 3 AS INT) AS off FROM re), d AS (SELECT *, sum(off) OVER w AS k, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY racer_id ORDER BY race_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
 SELECT race_id, car_no, {r('CASE WHEN n >= 5 THEN k / n ELSE 0.1 + 0.05 * district END')} AS betrayal_rate FROM d""")
def _(t):
    from ticktote.operators import history as hi
    from ticktote.operators.lines import betrayal_hit

    e = t.sized().race_entries().select("race_id", "car_no", "racer_id", "race_date", betrayal_hit(C("racer_id") % 3, C("motor_id") % 3).alias("off"))
    e = stored_table(e, "past")
    d = hi.past_sums(e, ["racer_id"], "race_date", {"k": (C("off"), None), "n": (F.lit(1), None)})
    return rounded(d.select("race_id", "car_no", F.when(C("n") >= 5, C("k") / C("n")).otherwise(0.1 + 0.05 * (C("racer_id") % 3)).alias("betrayal_rate")))


@query("r22_elo_ratings", None)
def _(t):
    from ticktote.operators.fold import elo

    e = t.race_entries().select("grade", "race_date", "race_id", "finish", "car_no", "racer_id")
    return rounded(elo(e, "grade", ["race_date", "race_id", "finish"], "race_id", "racer_id", "finish").select("race_id", "car_no", "racer_id", "elo"), 4)


@query("r23_payout_settlement", f"WITH {_TIX} SELECT race_id, ticket, count(*) AS bought, CAST(sum(hit) AS BIGINT) AS n_hits, {r('coalesce(sum(CASE WHEN hit = 1 THEN odds * 100 END), 0.0)', 3)} AS payout FROM tickets WHERE prob >= 0.05 + 1e-7 GROUP BY 1, 2")
def _(t):
    from ticktote.plans.signals import settle

    tk = cb.ticket_rows(t.entries(), 1e-9)
    pay = tk.where("hit = 1").select("race_id", "ticket", "combo", (C("odds") * 100).alias("payout"))
    d = settle(tk.where(C("prob") >= 0.05 + 1e-7).select("race_id", "ticket", "combo"), pay)
    return d.groupBy("race_id", "ticket").agg(F.count(F.lit(1)).alias("bought"), F.sum("win").cast("bigint").alias("n_hits"), rnd(F.sum("payout"), 3).alias("payout"))


@query("r24_settle_daily_signals", f"""WITH {BETS}, x AS (SELECT race_id, race_date, CASE WHEN hit = 1 THEN 'WIN' ELSE 'LOSE' END AS result, payout - 100 AS profit FROM bets WHERE ev >= 1.0), d AS (SELECT race_date, count(*) AS n, sum(profit) AS profit FROM x GROUP BY 1)
 SELECT race_date, n, {r('profit', 3)} AS profit, {r('sum(profit) OVER (ORDER BY race_date)', 3)} AS cumulative FROM d""")
def _(t):
    from ticktote.operators.sequence import running

    x = t.bets().where("ev >= 1.0").groupBy("race_date").agg(F.count(F.lit(1)).alias("n"), F.sum(C("payout") - 100).alias("profit"))
    d = running(x, [], ["race_date"], {"cumulative": "profit"})
    return d.select("race_date", "n", rnd("profit", 3).alias("profit"), rnd("cumulative", 3).alias("cumulative"))


@query("r25_backfill_paper_ledger", f"""WITH {RE}, {_VB}, s AS (SELECT race_id, car_no, race_date, venue_id, CASE WHEN finish = 1 THEN 500 * odds - 500 ELSE -500 END AS pnl FROM vb) SELECT race_id, car_no, {r('pnl', 3)} AS pnl, {r('sum(pnl) OVER (PARTITION BY venue_id ORDER BY race_date, race_id, car_no)', 3)} AS cumulative FROM s""")
def _(t):
    from ticktote.operators.sequence import running

    d = value_bets(t.race_entries(True), 0.8).withColumn("pnl", F.when(C("finish") == 1, 500 * C("odds") - 500).otherwise(-500.0))
    d = running(d, ["venue_id"], ["race_date", "race_id", "car_no"], {"cumulative": "pnl"})
    return d.select("race_id", "car_no", rnd("pnl", 3).alias("pnl"), rnd("cumulative", 3).alias("cumulative"))
