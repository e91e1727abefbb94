"""Race, history, folds, betting, labels and text against brute force."""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticktote.functions import betting as bt
from ticktote.functions import text as tx
from ticktote.operators import combos as cb
from ticktote.operators import fold
from ticktote.operators import history as hi
from ticktote.operators import labels as lb
from ticktote.operators import metrics as me
from ticktote.operators import race as ra

C = F.col


def test_elo_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for race in range(60):
        pool = "xy"[race % 2]
        for rank, who in enumerate(rng.choice(12, size=rng.integers(1, 6), replace=False), 1):
            rows.append((pool, race // 3, race, rank if race % 7 else 1, int(who)))
    d = spark.createDataFrame(rows, "pool string, day int, race int, rank int, who int")
    got = {(r.race, r.who): r.elo for r in fold.elo(d, "pool", ["day", "race", "rank"], "race", "who", "rank").collect()}
    rating, want = {}, {}
    for race in range(60):
        part = [r for r in rows if r[2] == race]
        pool = part[0][0]
        pre = {r[4]: rating.get((pool, r[4]), 1500.0) for r in part}
        want.update({(race, w): e for w, e in pre.items()})
        if len(part) > 1:
            for i in part:
                delta = 0.0
                for j in part:
                    if i is not j:
                        act = 1.0 if i[3] < j[3] else 0.0 if i[3] > j[3] else 0.5
                        delta += act - 1 / (1 + 10 ** ((pre[j[4]] - pre[i[4]]) / 400))
                rating[(pool, i[4])] = pre[i[4]] + 32 / (len(part) - 1) * delta
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_drawdown_stop_absorbs_below_half_peak(spark):
    r = [0.05, -0.04, -0.08, 0.5, 0.5, 0.5]
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate(r)], "k string, t int, ret double")
    assert fold.drawdown_stop(d, ["k"], ["t"], "ret").orderBy("t").toPandas().traded.tolist() == [1, 1, 1, 0, 0, 0]


def test_combo_probabilities_sum_and_trio(spark):
    p = [0.4, 0.3, 0.2, 0.1]
    e = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(p)], "race_id int, car_no int, prob double")
    tri = cb.triples(e, ["car_no", "prob"]).withColumn("p", cb.p_trifecta(C("prob1"), C("prob2"), C("prob3"))).toPandas()
    assert len(tri) == 24 and abs(tri.p.sum() - 1) < 1e-12
    trio = cb.triples(e, ["car_no", "prob"], ordered=False).withColumn("p", cb.p_trio(C("prob1"), C("prob2"), C("prob3"))).toPandas()
    for _, r in trio.iterrows():
        cars = {r.car_no1, r.car_no2, r.car_no3}
        want = sum(x.p for _, x in tri.iterrows() if {x.car_no1, x.car_no2, x.car_no3} == cars)
        assert abs(r.p - want) < 1e-12


def test_normalise_uniform_when_zero_and_single(spark):
    d = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, 3.0), (3, 1.0), (3, 3.0)], "race_id int, x double")
    got = sorted((r.race_id, round(r.p, 6)) for r in d.withColumn("p", ra.normalise("x")).collect())
    assert got == [(1, 0.5), (1, 0.5), (2, 1.0), (3, 0.25), (3, 0.75)]


def test_history_excludes_same_day(spark):
    rows = [("a", "2024-01-01", 1, 1), ("a", "2024-01-01", 2, 0), ("a", "2024-01-02", 3, 1), ("a", "2024-01-10", 4, 0), ("b", "2024-01-10", 5, 1)]
    d = spark.createDataFrame(rows, "who string, day string, i int, win int").withColumn("day", F.to_date("day"))
    s = hi.past_sums(d, ["who"], "day", {"w": (C("win"), None), "n": (F.lit(1), None), "n5": (F.lit(1), 5)}).orderBy("i").toPandas()
    assert s.w.tolist() == [0, 0, 1, 2, 0] and s.n.tolist() == [0, 0, 2, 3, 0] and s.n5.tolist() == [0, 0, 2, 0, 0]
    n = hi.last_n_before(d, ["who"], "day", ["i"], C("i").cast("double"), 2, "v").orderBy("i").toPandas()
    assert [list(v) for v in n.v] == [[], [], [2.0, 1.0], [3.0, 2.0], []]


def test_kelly_cases(spark):
    def kelly(p, o, cap, unit=100.0):
        if p <= 0 or p >= 1 or o <= 1 or cap <= 0:
            return 0.0
        full = max(0.0, (p * o - 1) / (o - 1))
        return round(min(full * 0.25 * cap, cap * 0.05) / unit) * unit

    cases = [(0.0, 3.0, 1e5), (1.0, 3.0, 1e5), (0.5, 1.0, 1e5), (0.5, 3.0, 0.0), (0.5, 3.0, 1e5), (0.3, 4.0, 1e5), (0.1, 2.0, 1e5), (0.9, 5.0, 12345.0)]
    d = spark.createDataFrame(cases, "p double, o double, cap double")
    got = [r.k for r in d.withColumn("k", bt.kelly("p", "o", "cap", unit=100.0)).collect()]
    assert got == [kelly(*c) for c in cases]
    dd = spark.createDataFrame([(90.0,), (85.0,), (75.0,), (65.0,), (55.0,), (100.0,)], "cap double")
    out = [r.k for r in dd.withColumn("k", bt.kelly_after_drawdown(F.lit(0.6), F.lit(2.0), C("cap") * 1000, F.lit(100000.0), unit=1.0)).collect()]
    base = [kelly(0.6, 2.0, c * 1000, 1.0) for c in (90, 85, 75, 65, 55, 100)]
    assert out == [round(b * m) for b, m in zip(base, (0.75, 0.75, 0.5, 0.25, 0.0, 1.0))]


def test_trade_metrics_edges(spark):
    rows = [("w", 1, 0.1), ("w", 2, 0.2), ("x", 1, 0.5), ("x", 2, -0.3), ("x", 3, -0.2), ("x", 4, 0.1), ("o", 1, -0.1)]
    d = spark.createDataFrame(rows, "k string, t int, ret double")
    m = me.trade_metrics(d, ["k"], "ret", ["t"]).toPandas().set_index("k")
    assert pd.isna(m.loc["w", "pf"]) and m.loc["w", "mdd"] == 0 and pd.isna(m.loc["o", "sharpe"])
    eq = 1 + np.cumsum([0.5, -0.3, -0.2, 0.1])
    pk = np.maximum.accumulate(eq)
    assert abs(m.loc["x", "mdd"] - ((pk - eq) / pk).max() * 100) < 1e-9 and abs(m.loc["x", "pf"] - 0.6 / 0.5) < 1e-12


def test_overfit_probability_is_repeatable(spark):
    s = spark.createDataFrame([(f"s{i}", float(i % 5), float((i * 7) % 5)) for i in range(12)], "s string, a double, b double")
    x, y = (me.overfit_probability(s.repartition(n), "s", "a", "b", 200).first() for n in (1, 7))
    assert x == y and 0 <= x.pbo <= 1 and x.draws == 200


def test_pairwise_limit_takes_hash_order(spark):
    e = spark.createDataFrame([(r, c, c, float(c)) for r in (1, 2) for c in range(1, 9)], "race_id int, car_no int, finish int, f double")
    d = lb.pairwise_training(e, ["f"], 5).toPandas()
    full = lb.pairwise_training(e, ["f"], 100).toPandas()
    assert d.groupby("race_id").size().eq(5).all() and len(full) == 56 and (full.d_f < 0).all() and (full.ahead == 1).all()
    assert len(d.merge(full, on=["race_id", "car_no1", "car_no2"])) == 10


def test_purged_folds_keep_embargo(spark):
    d = spark.range(103).select(F.lit("k").alias("k"), C("id").alias("t"))
    x = lb.purged_kfold(lb.positions(d, ["k"], ["t"], chunks=4), 5, 4).toPandas()
    assert sorted(x[x.role == "test"].pos) == list(range(103))
    for f, g in x.groupby("fold"):
        te, tr = set(g[g.role == "test"].pos), set(g[g.role == "train"].pos)
        assert min(abs(a - b) for a in te for b in tr) >= 4 and len(te) in (20, 21)


def test_comment_scores_match_loop(spark):
    texts = ["絶好調です。自信あり、必ず勝てる", "不調で厳しい。腰に違和感", "調子は良いが勝負にならない。ありません", "", None, "かな、たぶん難しい", "普通"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = tx.keyword_sentiment(d, "t").orderBy("i").toPandas()
    import re

    for i, t in enumerate(texts):
        if not t:
            assert got.sentiment_score[i] == 0 and got.confidence_score[i] == 0 and got.length[i] == 0
            continue
        tot = sum(w * t.count(k) for k, w in {**tx.POSITIVE_KEYWORDS, **tx.NEGATIVE_KEYWORDS}.items())
        s = math.tanh(tot / 2)
        if re.search(r"ない\b|ぬ\b|ません", t) and s > 0:
            s *= 0.5
        hi_, lo = sum(t.count(k) for k in tx.CONFIDENT), sum(t.count(k) for k in tx.DOUBTFUL)
        assert abs(got.sentiment_score[i] - s) < 1e-12
        assert abs(got.confidence_score[i] - ((hi_ - lo) / (hi_ + lo + 1) * 0.5 + 0.5 if hi_ + lo else 0.5)) < 1e-12
        assert got.injury_flag[i] == max([w for k, w in tx.INJURY_KEYWORDS.items() if k in t], default=0.0)
        assert got.n_positive[i] == sum(t.count(k) for k in tx.POSITIVE_KEYWORDS)


def test_intent_precedence(spark):
    d = spark.createDataFrame([("先行します",), ("単騎で",), ("山田選手を追います",), ("番手",), ("...",)], "t string")
    assert [r.role for r in tx.comment_intent(d, "t").collect()] == ["lead", "single", "follow", "follow", "unknown"]


def test_field_size_is_a_checked_contract(spark):
    import pytest
    from pyspark.errors import PySparkException

    e = spark.createDataFrame([(1, k) for k in range(3)] + [(2, k) for k in range(5)], "race_id int, car_no int")
    assert ra.require_field_size(e, 5).count() == 8 and ra.require_field_size(e, 5).columns == e.columns
    with pytest.raises(PySparkException, match="race 2 has more than 4 starters"):
        ra.require_field_size(e, 4).collect()


def test_all_orders_of_three():
    assert len(list(permutations(range(3)))) == 6


@pytest.mark.parametrize("min_prob", [0.0, 0.004, 0.05, 0.3])
def test_tickets_above_a_probability(spark, min_prob):
    """All five tickets of each race against an enumeration of its orders; bounds cut off no ticket that counts."""
    from itertools import combinations, permutations

    from ticktote.operators.combos import ticket_rows

    rng = np.random.default_rng(3)
    rows = []
    for race, n in enumerate([1, 2, 3, 5, 7, 7]):
        w = rng.random(n) ** 3 + 0.01
        rows += [(race, car + 1, float(x), 0.01 * car, int(f) + 1) for car, (x, f) in enumerate(zip(w / w.sum(), rng.permutation(n)))]
    d = spark.createDataFrame(rows, "race_id long, car_no int, prob double, disc double, finish int")
    want = {}
    for race in range(6):
        e = {c: (p, f) for r, c, p, _, f in rows if r == race}
        order = lambda cs: float(np.prod([e[c][0] / (1 - sum(e[b][0] for b in cs[:i])) for i, c in enumerate(cs)]))
        top = lambda cs, n: int(all(e[c][1] <= n for c in cs))
        placed = lambda cs: int(all(e[c][1] == i + 1 for i, c in enumerate(cs)))
        for cs in permutations(e, 2):
            want[race, "exacta", cs] = (order(cs), placed(cs))
        for cs in combinations(sorted(e), 2):
            q = order(cs) + order(cs[::-1])
            want[race, "quinella", cs], want[race, "wide", cs] = (q, top(cs, 2)), (min(1.0, 3 * q), top(cs, 3))
        for cs in permutations(e, 3):
            want[race, "trifecta", cs] = (order(cs), placed(cs))
        for cs in combinations(sorted(e), 3):
            want[race, "trio", cs] = (sum(map(order, permutations(cs))), top(cs, 3))
    # a denominator of zero, where two or three cars are all there are, gives no probability or one up to rounding
    want = {k: v for k, v in want.items() if min_prob < v[0] < 1e6 and abs(v[0] - min_prob) > 1e-9 and len([r for r in rows if r[0] == k[0]]) > 3}
    got = {(r["race_id"], r["ticket"], tuple(map(int, r["combo"].split("-")))): (r["prob"], r["hit"]) for r in ticket_rows(d, min_prob).where("race_id >= 3").collect()}
    assert set(got) == set(want)
    assert all(abs(got[k][0] - v[0]) < 1e-9 and got[k][1] == v[1] for k, v in want.items())
    few = ticket_rows(d, min_prob, ("trio",)).select("ticket").distinct().collect()
    assert {r["ticket"] for r in few} <= {"trio"}
