"""In-race operators, history operators and odds operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ticktote.catalog.common_sql import ENTRIES, RACES, RE, SNAPS, r
from ticktote.catalog.registry import query
from ticktote.functions.core import avg_rank, dense_rank, flag, min_rank, rnd, rounded, sdiv
from ticktote.operators import history as hi
from ticktote.operators import race as ra
from ticktote.operators.combos import pairs
from ticktote.operators.shape import snapshot_columns
from ticktote.sources.storage import stored_table
from ticktote.sources.tables import SNAPSHOTS

C = F.col
P = "OVER (PARTITION BY race_id)"


@query("w8_in_race_rank", f"""WITH {ENTRIES} SELECT race_id, car_no, CAST(rank() OVER (PARTITION BY race_id ORDER BY qty DESC) AS INT) AS rank_min, CAST(dense_rank() OVER (PARTITION BY race_id ORDER BY qty) AS INT) AS rank_dense,
 CAST(rank() OVER (PARTITION BY race_id ORDER BY disc DESC) + (count(*) OVER (PARTITION BY race_id, disc) - 1) / 2.0 AS DOUBLE) AS rank_avg FROM entries""")
def _(t):
    return t.entries().select("race_id", "car_no", min_rank("qty", ["race_id"]).alias("rank_min"), dense_rank("qty", ["race_id"], False).alias("rank_dense"), avg_rank("disc", ["race_id"]).alias("rank_avg"))


@query("w9_field_differences", f"""WITH {ENTRIES} SELECT race_id, car_no, {r(f'score - avg(score) {P}', 4)} AS score_vs_field, {r(f'avg(score) {P}', 4)} AS field_strength, {r(f'stddev_samp(score) {P}', 4)} AS field_spread,
 {r(f'max(prob) {P} - prob')} AS upset_gap FROM entries""")
def _(t):
    d = t.entries().select("race_id", "car_no", ra.vs_field("score").alias("score_vs_field"), F.avg("score").over(ra.race()).alias("field_strength"), F.stddev_samp("score").over(ra.race()).alias("field_spread"), (F.max("prob").over(ra.race()) - C("prob")).alias("upset_gap"))
    return d.select("race_id", "car_no", *[rnd(c, 4).alias(c) for c in ("score_vs_field", "field_strength", "field_spread")], rnd("upset_gap").alias("upset_gap"))


@query("w10_in_race_imputation", f"""WITH {ENTRIES}, x AS (SELECT race_id, car_no, CASE WHEN motor_id % 5 <> 0 THEN qty END AS a, disc AS b FROM entries)
 SELECT race_id, car_no, {r(f'coalesce(a, avg(a) {P})')} AS a, {r(f'CASE WHEN b = 0 THEN coalesce(avg(CASE WHEN b > 0 THEN b END) {P}, b) ELSE b END')} AS b FROM x""")
def _(t):
    d = t.entries().select("race_id", "car_no", F.when(C("motor_id") % 5 != 0, C("qty")).alias("a"), C("disc").alias("b"))
    return rounded(ra.fill_zero_from_race(ra.fill_from_race(d, ["a"]), ["b"]))


@query("w11_in_race_normalisation", f"""WITH {ENTRIES} SELECT race_id, car_no, {r(f'CASE WHEN sum(disc) {P} = 0 THEN 1.0 / count(*) {P} ELSE disc / sum(disc) {P} END')} AS p, {r(f'CASE WHEN sum(tax) {P} = 0 THEN 2.0 / count(*) {P} ELSE 2 * tax / sum(tax) {P} END')} AS top2 FROM entries""")
def _(t):
    return rounded(t.entries().select("race_id", "car_no", ra.normalise("disc").alias("p"), ra.normalise("tax", 2.0).alias("top2")))


@query("w12_softmax_temperature", f"""WITH {ENTRIES} SELECT race_id, car_no, {r(f'pow(prob, 1 / 0.7) / sum(pow(prob, 1 / 0.7)) {P}')} AS p FROM entries""")
def _(t):
    return rounded(ra.softmax(t.entries(), "prob", "p", 0.7).select("race_id", "car_no", "p"))


@query("w16_past_rates", f"""WITH {RE}, x AS (SELECT race_id, car_no, racer_id, venue_id, race_date, CAST(finish = 1 AS INT) AS win, CAST(finish <= 3 AS INT) AS place FROM re)
 SELECT race_id, car_no, {r('coalesce(sum(win) OVER w / nullif(count(*) OVER w, 0), 0.08)')} AS racer_win_rate, {r('coalesce(sum(place) OVER v / nullif(count(*) OVER v, 0), 0.25)')} AS venue_place_rate FROM x
 WINDOW w AS (PARTITION BY racer_id ORDER BY race_date, race_id, car_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY racer_id, venue_id ORDER BY race_date, race_id, car_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(t):
    e = t.race_entries(True).select("race_id", "car_no", "racer_id", "venue_id", "race_date", "finish")
    o = ["race_date", "race_id", "car_no"]
    d = hi.past_rate(e, ["racer_id"], o, C("finish") == 1, 0.08, "racer_win_rate")
    d = hi.past_rate(d, ["racer_id", "venue_id"], o, C("finish") <= 3, 0.25, "venue_place_rate")
    return rounded(d.select("race_id", "car_no", "racer_win_rate", "venue_place_rate"))


def _rng(n):
    return f"(PARTITION BY racer_id ORDER BY race_date RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"


@query("w17_date_range_rates", f"""WITH {RE}, x AS (SELECT race_id, car_no, CAST(finish = 1 AS INT) AS win, sum(CAST(finish = 1 AS INT)) OVER a AS w90, count(*) OVER a AS n90, sum(CAST(finish = 1 AS INT)) OVER b AS w365, count(*) OVER b AS n365 FROM re
 WINDOW a AS {_rng(90)}, b AS {_rng(365)}) SELECT race_id, car_no, {r('CASE WHEN n90 < 5 OR n365 < 5 THEN 0.0 ELSE w90 / n90 - w365 / n365 END', 4)} AS trend, CAST(n90 AS BIGINT) AS n90 FROM x""")
def _(t):
    e = stored_table(t.sized().race_entries().select("race_id", "car_no", "racer_id", "race_date", "finish"), "past")
    win, one = flag(C("finish") == 1), F.lit(1)
    d = hi.past_sums(e, ["racer_id"], "race_date", {"w90": (win, 90), "n90": (one, 90), "w365": (win, 365), "n365": (one, 365)})
    tr = F.when((C("n90") < 5) | (C("n365") < 5), 0.0).otherwise(sdiv("w90", "n90") - sdiv("w365", "n365"))
    return d.select("race_id", "car_no", rnd(tr, 4).alias("trend"), "n90")


@query("w18_last_n_before_date", f"""WITH {RE}, l AS (SELECT a.race_id, a.car_no, list(b.qty ORDER BY b.race_date DESC, b.race_id DESC, b.car_no DESC)[1:10] AS v FROM re a LEFT JOIN re b ON a.racer_id = b.racer_id AND b.race_date < a.race_date GROUP BY 1, 2)
 SELECT race_id, car_no, {r('list_avg(v)')} AS mean10, {r('list_avg(v[1:3]) - list_avg(v)')} AS last3_vs_10 FROM l""")
def _(t):
    e = t.race_entries().select("race_id", "car_no", "racer_id", "race_date", "qty")
    d = hi.last_n_before(e, ["racer_id"], "race_date", ["race_id", "car_no"], C("qty"), 10, "v")
    m = hi.array_mean(C("v"))
    return rounded(d.select("race_id", "car_no", m.alias("mean10"), (hi.array_mean(F.slice("v", 1, 3)) - m).alias("last3_vs_10")))


@query("w19_previous_value_and_gap", f"""WITH {RE}, x AS (SELECT race_id, car_no, finish, style, race_date, lag(finish) OVER w AS prev_finish, avg(finish) OVER (PARTITION BY racer_id ORDER BY race_date, race_id, car_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS last3_mean,
 lag(style) OVER w AS prev_style, date_diff('day', lag(race_date) OVER w, race_date) AS gap FROM re WINDOW w AS (PARTITION BY racer_id ORDER BY race_date, race_id, car_no))
 SELECT race_id, car_no, CAST(prev_finish AS DOUBLE) AS prev_finish, {r('last3_mean')} AS last3_mean, coalesce(prev_style, 'N') AS prev_style, CAST(greatest(coalesce(gap, 30), 7) AS BIGINT) AS days_since FROM x""")
def _(t):
    """Chunked keys with a three-row margin: a racer with most rows is spread over chunks."""
    from ticktote.functions.core import Seq
    from ticktote.operators.sequence import number_rows, with_halo

    e = t.race_entries().select("race_id", "car_no", "racer_id", "race_date", "finish", "style")
    e = number_rows(e, ["racer_id"], ["race_date", "race_id", "car_no"])
    e = with_halo(e, ["racer_id"], "pos", 1024, back=3)
    q = Seq(["racer_id", "chunk_id"], "pos")
    gap = F.datediff("race_date", q.lag("race_date"))
    d = e.withColumns({"prev_finish": q.lag("finish").cast("double"), "last3_mean": F.avg("finish").over(q.before(3)), "prev_style": F.coalesce(q.lag("style"), F.lit("N")), "days_since": F.greatest(F.coalesce(gap, F.lit(30)), F.lit(7)).cast("bigint")})
    return rounded(d.where("is_core").select("race_id", "car_no", "prev_finish", "last3_mean", "prev_style", "days_since"))


@query("w20_meet_sessions", f"""WITH {RE}, d AS (SELECT racer_id, CAST(race_date AS DATE) AS day, sum(finish) AS rs, count(*) AS rn, avg(CAST(finish = 1 AS INT)) AS w FROM re GROUP BY 1, 2),
 g AS (SELECT *, date_diff('day', lag(day) OVER o, day) AS gap, lag(w) OVER o AS pw, date_diff('day', DATE '1970-01-01', day) - row_number() OVER o AS isl FROM d WINDOW o AS (PARTITION BY racer_id ORDER BY day))
 SELECT racer_id, day, CAST(row_number() OVER i AS INT) AS meet_day, {r('coalesce(sum(rs) OVER p / sum(rn) OVER p, 0.0)')} AS meet_avg_rank, CAST(coalesce(gap, 30) AS INT) AS days_since, {r('coalesce(exp(-pow((gap - 10) / 10.0, 2)) * (1 + pw), 0.0)')} AS rest_quality FROM g
 WINDOW i AS (PARTITION BY racer_id, isl ORDER BY day), p AS (PARTITION BY racer_id, isl ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(t):
    return rounded(hi.meets(t.race_entries(), ["racer_id"], "race_date", "finish"))


@query("w21_previous_meet_best", f"""WITH {RE}, d AS (SELECT racer_id, venue_id, CAST(race_date AS DATE) AS day, min(finish) AS best FROM re GROUP BY 1, 2, 3),
 n AS (SELECT *, CASE WHEN lag(venue_id) OVER o IS DISTINCT FROM venue_id OR date_diff('day', lag(day) OVER o, day) > 4 THEN 1 ELSE 0 END AS nw FROM d WINDOW o AS (PARTITION BY racer_id ORDER BY day, venue_id)),
 c AS (SELECT *, sum(nw) OVER (PARTITION BY racer_id ORDER BY day, venue_id) AS ch FROM n), b AS (SELECT racer_id, ch, lag(min(best)) OVER (PARTITION BY racer_id ORDER BY ch) AS pb FROM c GROUP BY 1, 2)
 SELECT c.racer_id, venue_id, day, CAST(pb AS DOUBLE) AS prev_meet_best FROM c JOIN b ON b.racer_id = c.racer_id AND b.ch = c.ch""")
def _(t):
    d = hi.previous_meet_best(t.sized().race_entries(True), "racer_id", "venue_id", "race_date", "finish")
    return d.withColumn("prev_meet_best", C("prev_meet_best").cast("double"))


@query("w22_same_region_companions", f"""WITH {RE}, x AS (SELECT race_id, car_no, racer_id, race_date, count(*) OVER (PARTITION BY race_id, s_nationkey) - 1 AS mates FROM re JOIN supplier ON s_suppkey = racer_id)
 SELECT race_id, car_no, CAST(coalesce(sum(mates) OVER (PARTITION BY racer_id ORDER BY race_date RANGE BETWEEN INTERVAL 60 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS companions_60d FROM x""")
def _(t):
    t = t.sized()
    s = t.raw("supplier").select(C("s_suppkey").alias("racer_id"), C("s_nationkey").alias("region_id"))
    e = t.race_entries().join(s, "racer_id").select("race_id", "car_no", "racer_id", "race_date", "region_id")
    e = e.withColumn("mates", F.count(F.lit(1)).over(Window.partitionBy("race_id", "region_id")) - 1)
    e = stored_table(e.drop("region_id"), "past")
    d = hi.past_sums(e, ["racer_id"], "race_date", {"companions_60d": (C("mates"), 60)})
    return d.select("race_id", "car_no", "companions_60d")


@query("w23_head_to_head", f"""WITH {RE}, p AS (SELECT a.race_id, a.car_no, a.racer_id AS x, b.racer_id AS y, a.race_date, CAST(a.finish < b.finish AS INT) AS ahead FROM re a JOIN re b ON a.race_id = b.race_id AND a.car_no <> b.car_no),
 h AS (SELECT race_id, car_no, sum(ahead) OVER w AS wins, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY x, y ORDER BY race_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
 SELECT race_id, car_no, {r('CASE WHEN sum(n) >= 10 THEN sum(coalesce(wins, 0)) / sum(n) ELSE 0.5 END')} AS h2h_rate FROM h GROUP BY 1, 2""")
def _(t):
    e = t.sized().race_entries().select("race_id", "car_no", "racer_id", "race_date", "finish")
    p = pairs(e, ["car_no", "racer_id", "race_date", "finish"])
    p = p.select("race_id", C("car_no1").alias("car_no"), C("racer_id1").alias("x"), C("racer_id2").alias("y"), C("race_date1").alias("race_date"), flag(C("finish1") < C("finish2")).alias("ahead"))
    p = hi.past_totals(p, ["x", "y"], "race_date", {"wins": C("ahead"), "n": F.lit(1)}, spread="race_id")
    g = p.groupBy("race_id", "car_no").agg(F.sum("wins").alias("w"), F.sum("n").alias("n"))
    return rounded(g.select("race_id", "car_no", F.when(C("n") >= 10, C("w") / C("n")).otherwise(0.5).alias("h2h_rate")))


_LINE = f"""x AS (SELECT race_id, car_no, score, qty, racer_id % 3 AS line_id FROM entries)"""


@query("w27_line_aggregates", f"""WITH {ENTRIES}, {_LINE}, g AS (SELECT *, avg(score) OVER l AS line_score, sum(qty) OVER l AS line_qty, count(*) OVER l AS line_size, row_number() OVER (PARTITION BY race_id, line_id ORDER BY car_no) AS line_pos FROM x WINDOW l AS (PARTITION BY race_id, line_id))
 SELECT race_id, car_no, {r('line_score', 4)} AS line_score, line_qty, line_size, CAST(line_pos AS INT) AS line_pos, CAST(dense_rank() OVER (PARTITION BY race_id ORDER BY line_score DESC) AS INT) AS line_rank FROM g""")
def _(t):
    from ticktote.operators.lines import explode_lines, line_features, line_strings

    e = t.entries().withColumn("line_id", C("racer_id") % 3)
    lines = explode_lines(line_strings(e, "line_id"))
    d = line_features(e.select("race_id", "car_no", "score", "qty"), lines)
    return d.select("race_id", "car_no", rnd("line_score", 4).alias("line_score"), "line_qty", "line_size", "line_pos", "line_rank")


_PIV = ", ".join(f"max(CASE WHEN minutes = {m} THEN odds END) AS odds_{m}" for m in SNAPSHOTS)
_WIDE = SNAPS + f", wide AS (SELECT race_id, car_no, {_PIV} FROM snaps GROUP BY 1, 2)"
_CHG = ", ".join(f"(odds_{b} - odds_{a}) / nullif(odds_{a}, 0) AS chg_{a}_{b}" for a, b in zip(SNAPSHOTS, SNAPSHOTS[1:]))
_CH = _WIDE + f", ch AS (SELECT *, {_CHG} FROM wide)"


def wide(t):
    return snapshot_columns(t.odds_snapshots(), ["race_id", "car_no"], "minutes", "odds", SNAPSHOTS)


@query("p11_odds_snapshot_pivot", f"WITH {_WIDE} SELECT race_id, car_no, {', '.join(r(f'odds_{m}') + f' AS odds_{m}' for m in SNAPSHOTS)} FROM wide")
def _(t):
    return rounded(wide(t))


@query("r1_odds_change_chain", f"""WITH {_CH} SELECT race_id, car_no, {', '.join(r(f'chg_{a}_{b}') + f' AS chg_{a}_{b}' for a, b in zip(SNAPSHOTS, SNAPSHOTS[1:]))}, {r('(odds_0 - odds_120) / odds_120')} AS chg_total, {r('chg_5_1 - chg_15_5')} AS acceleration FROM ch""")
def _(t):
    return rounded(ra.odds_changes(wide(t), SNAPSHOTS).drop(*[f"odds_{m}" for m in SNAPSHOTS]))


@query("r2_odds_flags", f"""WITH {_CH} SELECT race_id, car_no, CAST(chg_5_1 <= -0.001 AS INT) AS sharp_drop, CAST(chg_5_1 * m < 0 AND abs(chg_5_1) > 0.002 AS INT) AS contrarian, CAST(abs(chg_1_0) >= 0.001 AS INT) AS late_surge FROM (SELECT *, avg(chg_5_1) {P} AS m FROM ch)""")
def _(t):
    d = ra.odds_changes(wide(t), SNAPSHOTS)
    m = F.avg("chg_5_1").over(ra.race())
    return d.select("race_id", "car_no", flag(C("chg_5_1") <= -0.001).alias("sharp_drop"), flag((C("chg_5_1") * m < 0) & (F.abs("chg_5_1") > 0.002)).alias("contrarian"), flag(F.abs("chg_1_0") >= 0.001).alias("late_surge"))


@query("r2_odds_flags_default", f"""WITH {_CH} SELECT sum(CAST(chg_5_1 <= -0.1 AS INT))::BIGINT AS n_sharp, sum(CAST(chg_5_1 * m < 0 AND abs(chg_5_1) > 0.1 AS INT))::BIGINT AS n_contrarian, sum(CAST(abs(chg_1_0) >= 0.05 AS INT))::BIGINT AS n_late, count(*) AS n FROM (SELECT *, avg(chg_5_1) {P} AS m FROM ch)""")
def _(t):
    d = ra.odds_flags(ra.odds_changes(wide(t), SNAPSHOTS))
    return d.agg(F.sum("sharp_drop").alias("n_sharp"), F.sum("contrarian").alias("n_contrarian"), F.sum("late_surge").alias("n_late"), F.count(F.lit(1)).alias("n"))


@query("r3_odds_stability", f"WITH {SNAPS} SELECT race_id, car_no, {r('stddev_samp(odds) / avg(odds)')} AS stability, count(odds) AS n_snaps FROM snaps GROUP BY 1, 2")
def _(t):
    g = t.odds_snapshots().groupBy("race_id", "car_no").agg(sdiv(F.stddev_samp("odds"), F.avg("odds")).alias("stability"), F.count("odds").alias("n_snaps"))
    return rounded(g)


@query("r4_odds_rank_and_implied", f"""WITH {_WIDE} SELECT race_id, car_no, {r('1 / odds_0')} AS implied_prob, CAST(rank() OVER (PARTITION BY race_id ORDER BY odds_0) AS INT) AS odds_rank,
 CAST(rank() OVER (PARTITION BY race_id ORDER BY odds_0) - rank() OVER (PARTITION BY race_id ORDER BY odds_120) AS INT) AS odds_rank_change FROM wide""")
def _(t):
    d = ra.odds_ranks(wide(t), "odds_120", "odds_0")
    return rounded(d.select("race_id", "car_no", "implied_prob", "odds_rank", "odds_rank_change"))


@query("r5_popular_surge", f"""WITH {_WIDE} SELECT race_id, max(CAST(odds_120 < 10 AND abs((odds_0 - odds_120) / odds_120) >= 0.2 AS INT)) AS surge, CAST(sum(CAST(odds_120 < 10 AND abs((odds_0 - odds_120) / odds_120) >= 0.2 AS INT)) AS BIGINT) AS n_moved FROM wide GROUP BY 1""")
def _(t):
    return ra.surge_by_race(t.odds_snapshots(), 120, 0, 10.0, 0.2)


_PAIRO = SNAPS + """, po AS (SELECT race_id, car_no AS first_car, lead(car_no) OVER w AS second_car, minutes, odds * lead(odds) OVER w / 2 AS odds FROM snaps WINDOW w AS (PARTITION BY race_id, minutes ORDER BY car_no))"""


def pair_odds(t):
    w = Window.partitionBy("race_id", "minutes").orderBy("car_no")
    return t.odds_snapshots().select("race_id", C("car_no").alias("first_car"), F.lead("car_no").over(w).alias("second_car"), "minutes", (C("odds") * F.lead("odds").over(w) / 2).alias("odds"))


@query("r6_snapshot_history_per_car", f"""WITH {_PAIRO} SELECT race_id, first_car AS car_no, {', '.join(r(f'min(CASE WHEN minutes = {m} THEN odds END)') + f' AS odds_{m}' for m in (60, 30, 15, 0))} FROM po WHERE second_car IS NOT NULL GROUP BY 1, 2""")
def _(t):
    d = pair_odds(t).where(C("second_car").isNotNull())
    g = d.groupBy("race_id", C("first_car").alias("car_no")).agg(*[F.min(F.when(C("minutes") == m, C("odds"))).alias(f"odds_{m}") for m in (60, 30, 15, 0)])
    return rounded(g)


@query("r7_latest_combo_odds", f"""WITH {_PAIRO} SELECT race_id, first_car || '-' || second_car AS combo, {r('arg_min(odds, minutes)')} AS odds, CAST(min(minutes) AS INT) AS minutes FROM po WHERE second_car IS NOT NULL AND (minutes > 0 OR race_id % 2 = 0) GROUP BY 1, 2""")
def _(t):
    d = pair_odds(t).where(C("second_car").isNotNull() & ((C("minutes") > 0) | (C("race_id") % 2 == 0)))
    return rounded(d.groupBy("race_id", F.concat_ws("-", "first_car", "second_car").alias("combo")).agg(F.min_by("odds", "minutes").alias("odds"), F.min("minutes").alias("minutes")))


# ---- joins -------------------------------------------------------------------
@query("j1_equi_left_join", f"WITH {RE} SELECT e.race_id, e.car_no, r.grade, r.venue_id FROM entries e LEFT JOIN races r ON r.race_id = e.race_id")
def _(t):
    return t.entries().join(t.races(), "race_id", "left").select("race_id", "car_no", "grade", "venue_id")


@query("j2_equi_inner_join", f"WITH {RE} SELECT a.race_id, a.car_no, {r('a.prob')} AS prob, b.finish FROM entries a JOIN entries b ON a.race_id = b.race_id AND a.car_no = b.car_no WHERE a.prob >= 0.3")
def _(t):
    e = t.entries()
    p = e.where("prob >= 0.3").select("race_id", "car_no", "prob")
    return rounded(p.join(e.select("race_id", "car_no", "finish"), ["race_id", "car_no"]))


@query("j3_full_outer_dates", """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS rate FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
 SELECT coalesce(a.day, b.day) AS day, """ + r("rate", 4) + """ AS rate, CAST(n AS DOUBLE) AS n FROM a FULL JOIN b ON a.day = b.day""")
def _(t):
    a = t.raw("orders").where("o_orderstatus = 'P'").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("rate"))
    b = t.raw("lineitem").where("l_linestatus = 'O'").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return a.join(b, "day", "full_outer").select("day", rnd("rate", 4).alias("rate"), "n")


@query("j4_anti_join", "SELECT o_orderkey AS race_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount = 0)")
def _(t):
    return t.raw("orders").select(C("o_orderkey").alias("race_id")).join(t.raw("lineitem").where("l_discount = 0").select(C("l_orderkey").alias("race_id")), "race_id", "left_anti")


@query("j5_semi_joins", "SELECT o_orderkey AS race_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_tax > 0.05) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    li = t.raw("lineitem")
    o = t.raw("orders").select(C("o_orderkey").alias("race_id"), "o_custkey")
    for cond in ("l_tax > 0.05", "l_returnflag = 'R'"):
        o = o.join(li.where(cond).select(C("l_orderkey").alias("race_id")), "race_id", "left_semi")
    return o.join(t.raw("customer").where("c_acctbal > 0").select(C("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("race_id")


@query("j9_rating_as_of", """WITH rt AS (SELECT l_suppkey AS racer_id, l_shipdate AS ts, 1500 + sum(l_quantity) AS elo FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), q AS (SELECT DISTINCT l_suppkey AS racer_id, l_shipdate AS ts FROM lineitem)
 SELECT q.racer_id, q.ts, coalesce(rt.elo, 1500.0) AS elo FROM q ASOF LEFT JOIN rt ON q.racer_id = rt.racer_id AND q.ts >= rt.ts""")
def _(t):
    from ticktote.operators.asof import asof

    li = t.raw("lineitem").select(C("l_suppkey").alias("racer_id"), C("l_shipdate").alias("ts"), "l_quantity", "l_returnflag")
    rt = li.where("l_returnflag = 'R'").groupBy("racer_id", "ts").agg((F.lit(1500) + F.sum("l_quantity")).alias("elo"))
    q = li.select("racer_id", "ts").distinct()
    return asof(q, rt, by=["racer_id"], period="year").fillna({"elo": 1500.0})


@query("j13_ordered_pairs", f"""WITH {ENTRIES} SELECT a.race_id, a.car_no AS car_no1, count(*) AS n_pairs, {r('sum(a.prob * b.prob / nullif(1 - a.prob, 0))')} AS p_first FROM entries a JOIN entries b ON a.race_id = b.race_id AND a.car_no <> b.car_no GROUP BY 1, 2""")
def _(t):
    from ticktote.operators.combos import p_exacta

    d = pairs(t.entries(), ["car_no", "prob"])
    return rounded(d.groupBy("race_id", "car_no1").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(p_exacta(C("prob1"), C("prob2"))).alias("p_first")))


@query("j15_ordered_triples", f"""WITH {ENTRIES} SELECT a.race_id, count(*) AS n_triples, {r('sum(a.prob * b.prob / nullif(1 - a.prob, 0) * c.prob / nullif(1 - a.prob - b.prob, 0))', 5)} AS total FROM entries a JOIN entries b ON a.race_id = b.race_id AND a.car_no <> b.car_no JOIN entries c ON c.race_id = a.race_id AND c.car_no <> a.car_no AND c.car_no <> b.car_no GROUP BY 1""")
def _(t):
    from ticktote.operators.combos import p_trifecta, triples

    d = triples(t.entries(), ["car_no", "prob"])
    return rounded(d.groupBy("race_id").agg(F.count(F.lit(1)).alias("n_triples"), F.sum(p_trifecta(C("prob1"), C("prob2"), C("prob3"))).alias("total")), 5)


@query("j16_finishers_by_rank", f"WITH {ENTRIES} SELECT race_id, max(CASE WHEN finish = 1 THEN car_no END) AS first_car, CAST(max(CASE WHEN finish = 2 THEN car_no END) AS DOUBLE) AS second_car, CAST(max(CASE WHEN finish = 3 THEN car_no END) AS DOUBLE) AS third_car FROM entries GROUP BY 1")
def _(t):
    pick = lambda k: F.max(F.when(C("finish") == k, C("car_no")))
    return t.entries().groupBy("race_id").agg(pick(1).alias("first_car"), pick(2).cast("double").alias("second_car"), pick(3).cast("double").alias("third_car"))


@query("j17_static_dimension_join", f"WITH {RACES} SELECT race_id, n_name AS venue, r_name AS region FROM races JOIN nation ON n_nationkey = venue_id JOIN region ON r_regionkey = n_regionkey")
def _(t):
    d = t.races().join(t.raw("nation").withColumnRenamed("n_nationkey", "venue_id"), "venue_id").join(t.raw("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return d.select("race_id", C("n_name").alias("venue"), C("r_name").alias("region"))


@query("j20_group_value_to_members", f"WITH {ENTRIES}, p AS (SELECT race_id, max(odds * 100) AS payout FROM entries WHERE finish = 1 AND style <> 'A' GROUP BY 1) SELECT e.race_id, e.car_no, {r('coalesce(p.payout, 3000.0)', 4)} AS payout FROM entries e LEFT JOIN p USING (race_id)")
def _(t):
    e = t.entries()
    p = e.where("finish = 1 AND style <> 'A'").groupBy("race_id").agg(F.max(C("odds") * 100).alias("payout"))
    d = e.select("race_id", "car_no").join(p, "race_id", "left")
    return d.select("race_id", "car_no", rnd(F.coalesce("payout", F.lit(3000.0)), 4).alias("payout"))


@query("j21_stage2_candidates", f"""WITH {ENTRIES} SELECT a.race_id, a.car_no AS car_no1, b.car_no AS car_no2, {r('a.prob * b.prob / nullif(1 - a.prob, 0)')} AS p2, {r('b.score - a.score', 4)} AS score_delta, {r('b.prob - a.prob')} AS prob_delta FROM entries a JOIN entries b ON a.race_id = b.race_id AND a.car_no <> b.car_no""")
def _(t):
    from ticktote.operators.combos import p_exacta

    d = pairs(t.entries(), ["car_no", "prob", "score"])
    return d.select("race_id", "car_no1", "car_no2", rnd(p_exacta(C("prob1"), C("prob2"))).alias("p2"), rnd(C("score2") - C("score1"), 4).alias("score_delta"), rnd(C("prob2") - C("prob1")).alias("prob_delta"))
