"""Labels, splits and training sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticktote.catalog.common_sql import BARS, BETS, ENTRIES, TRADES, r
from ticktote.catalog.registry import query
from ticktote.functions.core import Seq, band, flag, rnd, rounded
from ticktote.operators import labels as lb
from ticktote.operators.quantiles import exact_quantiles
from ticktote.operators.touch import triple_barrier

C = F.col
Q = Seq("symbol", "ts")
W = "OVER (PARTITION BY symbol ORDER BY ts)"
_ROLE = "fold, role, count(*) AS n, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos"
NUM = f"num AS (SELECT symbol, ts, row_number() {W} - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"


def numbered(t):
    return lb.positions(t.bars().select("symbol", "ts"), ["symbol"], ["ts"])


def roles(d, *keys):
    return d.groupBy(*keys, "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("bigint").alias("first_pos"), F.max("pos").cast("bigint").alias("last_pos"))


@query("l1_direction_label", f"""WITH {BARS}, x AS (SELECT symbol, ts, close, lead(close, 4) {W} AS c4, lead(close, 12) {W} AS c12, lead(close) {W} AS c1 FROM bars)
 SELECT symbol, ts, {', '.join(f"CAST(coalesce(c{k} > close, false) AS INT) AS up_{k}, {r(f'(c{k} - close) / close')} AS fwd_{k}" for k in (1, 4, 12))} FROM x WHERE c12 IS NOT NULL""")
def _(t):
    b = t.bars()
    for k in (1, 4, 12):
        b = b.withColumns({f"up_{k}": flag(Q.lead("close", k) > C("close")), f"fwd_{k}": lb.forward_return(Q, k)})
    return rounded(b.dropna(subset=["fwd_12"]).select("symbol", "ts", *[c for k in (1, 4, 12) for c in (f"up_{k}", f"fwd_{k}")]))


@query("l2_dead_zone_label", f"""WITH {TRADES}, q AS (SELECT quantile_cont(vol, 0.98) AS cap FROM t1) SELECT symbol, ts, CAST(CASE WHEN vol > cap THEN NULL WHEN fwd > 0.1 THEN 1 WHEN fwd < -0.1 THEN 0 END AS DOUBLE) AS label FROM t1, q""")
def _(t):
    b = t.bars().withColumns({"ret1": Q.pct("close"), "fwd": lb.forward_return(Q, 4)}).withColumn("vol", Q.sd("ret1", 24))
    cap = exact_quantiles(b, [], "vol", {"cap": 0.98})
    d = b.join(F.broadcast(cap))
    lab = F.when(F.coalesce(C("vol") <= C("cap"), F.lit(True)), lb.dead_zone(C("fwd"), 0.1))
    return d.select("symbol", "ts", lab.cast("double").alias("label"))


def _tb(up, dn, h):
    return f"""x AS (SELECT a.symbol, a.ts, b.rn - a.rn AS k, b.close / a.close - 1 AS rr, {up} AS u, {dn} AS d FROM v a JOIN v b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + {h} WHERE a.n - a.rn >= {h}),
 f AS (SELECT symbol, ts, arg_min(CASE WHEN rr >= u THEN 1 ELSE 0 END, k) FILTER (rr >= u OR rr <= d) AS lab FROM x GROUP BY 1, 2) SELECT v.symbol, v.ts, CAST(CASE WHEN v.n - v.rn < {h} THEN NULL ELSE coalesce(lab, 2) END AS DOUBLE) AS label FROM v LEFT JOIN f ON v.symbol = f.symbol AND v.ts = f.ts"""


@query("l3_triple_barrier", f"""WITH {BARS}, v AS (SELECT symbol, ts, close, row_number() {W} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars), {_tb('0.5', '-0.3', 24)}""")
def _(t):
    return triple_barrier(t.bars(), Q, 0.5, -0.3, 24).select("symbol", "ts", C("label").cast("double").alias("label"))


@query("l4_volatility_barrier", f"""WITH {TRADES}, v AS (SELECT symbol, ts, close, coalesce(vol, 0.005) AS vol, row_number() {W} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM t1), {_tb('a.vol * 0.6', '-a.vol * 0.3', 24)}""")
def _(t):
    b = t.bars().withColumn("ret1", Q.pct("close")).withColumn("vol", F.coalesce(Q.sd("ret1", 24), F.lit(0.005)))
    d = triple_barrier(b, Q, C("vol") * 0.6, -C("vol") * 0.3, 24)
    return d.select("symbol", "ts", C("label").cast("double").alias("label"))


@query("l5_meta_label", f"""WITH {TRADES}, q AS (SELECT quantile_cont(conf, 0.6) AS cut FROM trades) SELECT symbol, ts, CAST((side > 0) = (fwd > 0) AS INT) AS meta_label, CAST(conf >= cut AS INT) AS adopted FROM trades, q""")
def _(t):
    d = t.trades()
    d = d.join(F.broadcast(exact_quantiles(d, [], "conf", {"cut": 0.6})))
    return d.select("symbol", "ts", flag((C("side") > 0) == (C("fwd") > 0)).alias("meta_label"), flag(C("conf") >= C("cut")).alias("adopted"))


@query("l6_purged_kfold", f"""WITH {BARS}, {NUM}, f AS (SELECT *, fold * (n // 5) + least(fold, n % 5) AS s, fold * (n // 5) + least(fold, n % 5) + n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS e FROM num, (SELECT CAST(unnest(range(5)) AS INT) AS fold)),
 x AS (SELECT *, CASE WHEN pos >= s AND pos < e THEN 'test' WHEN pos < s - 24 OR pos >= e + 24 THEN 'train' END AS role FROM f) SELECT symbol, {_ROLE} FROM x WHERE role IS NOT NULL GROUP BY symbol, fold, role""")
def _(t):
    return roles(lb.purged_kfold(numbered(t)), "symbol")


@query("l7_date_gap_folds", """WITH num AS (SELECT o_orderkey, o_orderdate AS d, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
 o AS (SELECT *, CAST(least(pos // (n // 5), 4) AS INT) AS own FROM num), s AS (SELECT own AS fold, min(d) AS st FROM o GROUP BY 1), x AS (SELECT fold, pos, CASE WHEN own = fold THEN 'val' WHEN d < st - INTERVAL 7 DAY THEN 'train' END AS role FROM o, s),
 k AS (SELECT fold FROM x WHERE role = 'train' GROUP BY 1 HAVING count(*) >= 100) SELECT """ + _ROLE + """ FROM x JOIN k USING (fold) WHERE role IS NOT NULL GROUP BY fold, role""")
def _(t):
    o = t.raw("orders").select("o_orderkey", "o_orderdate")
    d = lb.positions(o, [], ["o_orderdate", "o_orderkey"], store=False)
    return roles(lb.date_gap_folds(d, "o_orderdate"))


def _wf(name, sql_cut, sql_roles, nf, fn):
    query(name, f"""WITH {BARS}, {NUM}, f AS (SELECT *, {sql_cut} AS c FROM num, (SELECT CAST(unnest(range(200)) AS INT) AS fold) WHERE fold < {nf}), x AS (SELECT *, {sql_roles} AS role FROM f)
 SELECT symbol, {_ROLE} FROM x WHERE role IS NOT NULL GROUP BY symbol, fold, role""")(lambda t: roles(fn(numbered(t)), "symbol"))


_wf("l8_walk_forward_expanding", "240 + fold * 60", "CASE WHEN pos < c THEN 'train' WHEN pos < c + 60 THEN 'test' END", "CASE WHEN n >= 300 THEN (n - 300) // 60 + 1 ELSE 0 END", lambda d: lb.walk_forward(d, 240, 60))
_wf("l9_walk_forward_rolling", "200 + fold * 50", "CASE WHEN pos < c - 200 THEN NULL WHEN pos < c THEN 'train' WHEN pos < c + 50 THEN 'val' WHEN pos < c + 100 THEN 'test' END", "CASE WHEN n >= 300 THEN (n - 300) // 50 + 1 ELSE 0 END", lambda d: lb.walk_forward(d, 200, 50, rolling=True, val=50))


@query("l10_purged_walk_forward", f"""WITH {BARS}, {NUM}, a AS (SELECT *, floor(n * 0.3) AS f0, floor((n - floor(n * 0.3)) / 5) AS sz FROM num), b AS (SELECT *, f0 + fold * sz AS c, floor(sz * 0.15 / 0.3) AS vn FROM a, (SELECT CAST(unnest(range(5)) AS INT) AS fold)),
 g AS (SELECT *, c + 20 AS v0, c + 40 + vn AS t0, least(c + 40 + sz, n) AS t1 FROM b), x AS (SELECT *, CASE WHEN pos < c THEN 'train' WHEN pos >= v0 AND pos < v0 + vn THEN 'val' WHEN pos >= t0 AND pos < t1 THEN 'test' END AS role FROM g WHERE t1 > t0 AND v0 + vn <= n)
 SELECT symbol, {_ROLE} FROM x WHERE role IS NOT NULL GROUP BY symbol, fold, role""")
def _(t):
    return roles(lb.purged_walk_forward(numbered(t)), "symbol")


@query("l11_race_folds", """WITH num AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders), f AS (SELECT *, (n // 6) * (fold + 1) AS c, n // 6 AS sz FROM num, (SELECT CAST(unnest(range(5)) AS INT) AS fold)),
 x AS (SELECT *, CASE WHEN pos < c THEN 'train' WHEN pos < least(c + sz, n) THEN 'test' END AS role FROM f) SELECT """ + _ROLE + """ FROM x WHERE role IS NOT NULL GROUP BY fold, role""")
def _(t):
    o = t.raw("orders").select("o_orderkey", "o_orderdate")
    d = lb.positions(o, [], ["o_orderdate", "o_orderkey"], store=False)
    return roles(lb.race_folds(d))


@query("l11_month_folds", """WITH k AS (SELECT (year(max(o_orderdate)) * 12 + month(max(o_orderdate)) - 1998 * 12 - 1) // 6 + 1 AS k FROM orders), g AS (SELECT unnest(range(CAST(k AS BIGINT))) AS fold FROM k),
 f AS (SELECT o_orderdate AS d, CAST(fold AS INT) AS fold, DATE '1998-01-01' + to_months(CAST(fold * 6 AS INT)) AS c, DATE '1998-01-01' + to_months(CAST(fold * 6 + 6 AS INT)) AS e FROM orders, g),
 x AS (SELECT *, CASE WHEN d < c THEN 'train' WHEN d < e THEN 'test' END AS role FROM f) SELECT fold, role, count(*) AS n FROM x WHERE role IS NOT NULL GROUP BY 1, 2""")
def _(t):
    o = t.raw("orders").select("o_orderkey", "o_orderdate")
    d = lb.month_folds(o, "o_orderdate", "1998-01-01", 6, lb.month_fold_count(o, "o_orderdate", "1998-01-01", 6))
    return d.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


@query("l12_pairwise_training_set", f"""WITH {ENTRIES} SELECT a.race_id, a.car_no AS car_no1, b.car_no AS car_no2, {r('a.prob - b.prob')} AS d_prob, {r('a.score - b.score')} AS d_score, CAST(a.finish < b.finish AS INT) AS ahead FROM entries a JOIN entries b ON a.race_id = b.race_id AND a.car_no < b.car_no""")
def _(t):
    """All pairs of each race."""
    return rounded(lb.pairwise_training(t.entries(), ["prob", "score"], None))


@query("l12_pairwise_sample", f"""WITH {ENTRIES}, p AS (SELECT a.race_id, a.car_no AS car_no1, b.car_no AS car_no2, {r('a.prob - b.prob')} AS d_prob, {r('a.score - b.score')} AS d_score, CAST(a.finish < b.finish AS INT) AS ahead,
 row_number() OVER (PARTITION BY a.race_id ORDER BY (a.race_id * 7919 + a.car_no * 5003 + b.car_no * 3571) % 1009, a.car_no, b.car_no) AS k FROM entries a JOIN entries b ON a.race_id = b.race_id AND a.car_no < b.car_no) SELECT race_id, car_no1, car_no2, d_prob, d_score, ahead FROM p WHERE k <= 20""")
def _(t):
    return rounded(lb.pairwise_training(t.entries(), ["prob", "score"], 20))


@query("l13_second_place_training_set", f"""WITH {ENTRIES} SELECT e.race_id, w.car_no AS winner, e.car_no, {r('e.prob - w.prob')} AS d_prob, {r('e.score - w.score')} AS d_score, CAST(e.finish = 2 AS INT) AS second FROM entries e JOIN entries w ON w.race_id = e.race_id AND w.finish = 1 AND e.car_no <> w.car_no""")
def _(t):
    return rounded(lb.second_place_training(t.entries(), ["prob", "score"]))


@query("l14_payout_weights", f"""WITH {BETS} SELECT race_id, CAST(CASE WHEN payout < 200 THEN 2.0 WHEN payout < 1000 THEN 1.0 ELSE 0.3 END AS DOUBLE) AS w_favourite, CAST(CASE WHEN payout >= 1000 THEN 2.5 WHEN payout >= 200 THEN 1.0 ELSE 0.3 END AS DOUBLE) AS w_underdog FROM bets""")
def _(t):
    return t.bets().select("race_id", band("payout", [200, 1000], [2.0, 1.0, 0.3]).alias("w_favourite"), band("payout", [200, 1000], [0.3, 1.0, 2.5]).alias("w_underdog"))
