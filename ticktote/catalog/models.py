"""Model scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticktote.catalog.common_sql import ENTRIES, RE, r
from ticktote.catalog.registry import query
from ticktote.functions.core import flag, rnd, rounded, sdiv
from ticktote.operators import labels as lb
from ticktote.plans import scoring as sc
from ticktote.sources import storage as st

C = F.col
FEATS = ["prob", "disc", "tax", "qty", "score", "field_size"]
_P = {"m1": "prob", "m2": "disc * 10", "m3": "tax * 12", "m4": "qty / 50", "m5": "1 / odds"}
_LIST = ", ".join(f"{v} AS {k}" for k, v in _P.items())
PSEUDO = ENTRIES + f", ps AS (SELECT race_id, car_no, finish, {_LIST} FROM entries)"


def pseudo(t):
    return t.entries().selectExpr("race_id", "car_no", "finish", *[f"{v} AS {k}" for k, v in _P.items()])


def rows(t):
    d = t.race_entries().select("race_id", "car_no", "race_date", *FEATS, flag(C("finish") == 1).alias("label"))
    return d.withColumn("ret", F.when(C("label") == 1, 1.0).otherwise(-0.3))


def split(t):
    """Rows before and from the cut, written once, as fits and scores read them many times."""
    cut = F.lit("1999-07-01").cast("timestamp_ntz")
    d = rows(t).where(C("race_date").isNotNull()).withColumn("later", C("race_date") >= cut)
    d = st.stored_table(d, "split")
    return d.where(~C("later")).drop("later"), d.where("later").drop("later")


def folds(t):
    """Half-year folds from 1999 to the last race, and their numbers."""
    d = rows(t)
    n = lb.month_fold_count(d, "race_date", "1999-01-01", 6)
    return lb.month_folds(d, "race_date", "1999-01-01", 6, n), range(n)


def blocks(t):
    """The same folds as one stored table: each row once, with the fold that tests it as its block, and their number."""
    d = st.stored_table(lb.month_blocks(rows(t), "race_date", "1999-01-01", 6), "blocks")
    return d, int(d.agg(F.coalesce(F.max("block"), F.lit(-1)) + 1).first()[0])


@query("z1_five_voter_ensemble", None)
def _(t):
    tr, te = split(t)
    m = sc.fit_voters(tr, FEATS, "label")
    d = sc.vote(sc.score_voters(m, te, FEATS), [f"p{i}" for i in range(1, 6)])
    return rounded(d.select("race_id", "car_no", "vote", "mean_proba", "agreement"), 4)


_UP = " + ".join(f"CAST({m} > 0.4 + 1e-9 AS INT)" for m in _P)


@query("z2_vote_algebra", f"WITH {PSEUDO} SELECT race_id, car_no, CAST(({_UP}) * 2 > 5 AS INT) AS vote, {r('(m1 + m2 + m3 + m4 + m5) / 5')} AS mean_proba, CAST(greatest({_UP}, 5 - ({_UP})) AS INT) AS agreement FROM ps")
def _(t):
    return rounded(sc.vote(pseudo(t), list(_P), 0.4 + 1e-9).select("race_id", "car_no", "vote", "mean_proba", "agreement"))


_LONG = PSEUDO + ", lg AS (" + " UNION ALL ".join(f"SELECT race_id, car_no, finish, '{m}' AS model, {m} AS proba FROM ps" for m in _P) + """),
 st AS (SELECT model, avg(CAST((proba > 0.4 + 1e-9) = (finish = 1) AS INT)) AS accuracy, avg(CASE WHEN proba > 0.4 + 1e-9 THEN CASE WHEN finish = 1 THEN 3 ELSE -1 END ELSE 0 END) / stddev_samp(CASE WHEN proba > 0.4 + 1e-9 THEN CASE WHEN finish = 1 THEN 3 ELSE -1 END ELSE 0 END) AS sharpe, avg(abs(proba - CAST(finish = 1 AS INT))) AS mae FROM lg GROUP BY 1),
 wt AS (SELECT model, 1.0 / count(*) OVER () AS w_equal, pow(accuracy, 3) / sum(pow(accuracy, 3)) OVER () AS w_accuracy, CASE WHEN sum(greatest(sharpe, 0)) OVER () > 0 THEN greatest(sharpe, 0) / sum(greatest(sharpe, 0)) OVER () ELSE 1.0 / count(*) OVER () END AS w_sharpe, (1 / greatest(mae, 1e-10)) / sum(1 / greatest(mae, 1e-10)) OVER () AS w_error FROM st)"""


def weights(t):
    lg = sc.long_scores(pseudo(t), ["race_id", "car_no", "finish"], {m: C(m) for m in _P})
    up, win = C("proba") > 0.4 + 1e-9, C("finish") == 1
    pnl = F.when(up, F.when(win, 3).otherwise(-1)).otherwise(0)
    st = lg.groupBy("model").agg(F.avg(flag(up == win)).alias("accuracy"), sdiv(F.avg(pnl), F.stddev_samp(pnl)).alias("sharpe"), F.avg(F.abs(C("proba") - flag(win))).alias("mae"))
    return lg, sc.model_weights(st)


@query("z3_model_weights", f"WITH {_LONG} SELECT model, {r('w_equal')} AS w_equal, {r('w_accuracy')} AS w_accuracy, {r('w_sharpe')} AS w_sharpe, {r('w_error')} AS w_error FROM wt")
def _(t):
    return rounded(weights(t)[1])


@query("z4_weighted_combination", f"WITH {_LONG} SELECT race_id, car_no, {r('sum(w_accuracy * proba)')} AS proba FROM lg JOIN wt USING (model) GROUP BY 1, 2")
def _(t):
    lg, w = weights(t)
    return rounded(sc.weighted_combine(lg, w, ["race_id", "car_no"], "w_accuracy"))


@query("z5_stacking", None)
def _(t):
    d = pseudo(t).withColumn("label", flag(C("finish") == 1))
    tr, te = d.where("race_id % 4 <> 0"), d.where("race_id % 4 = 0")
    return rounded(sc.stack(tr, te, list(_P), "label").select("race_id", "car_no", "label", "stacked"), 4)


@query("z6_walk_forward_scores", None)
def _(t):
    d, n = blocks(t)
    s = sc.walk_forward_scores(d, FEATS, "label", range(n), trees=5, depth=3)
    return rounded(s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(flag(C("vote") == C("label"))).alias("accuracy"), F.avg("agreement").alias("mean_agreement")), 4)


@query("z7_meta_model", None)
def _(t):
    tr, te = split(t)
    return rounded(sc.meta_model(tr, te, FEATS, "label").select("race_id", "car_no", "primary", "right", "meta"), 4)


@query("z8_probability_calibration", None)
def _(t):
    tr, te = split(t)
    return rounded(sc.calibrate(tr, te, "prob", "label").select("race_id", "car_no", "prob", "platt", "isotonic"), 4)


@query("z9_feature_importance", None)
def _(t):
    return rounded(sc.importances(rows(t), FEATS, "label"), 4)


_DUP = {"prob": "prob", "odds": "odds", "qty": "qty", "stake": "qty / 50 + tax / 100", "disc": "disc", "margin": "10 * disc - 0.2"}


@query("z9_duplicate_features", f"WITH {ENTRIES}, x AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _DUP.items())} FROM entries), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS corr FROM x" for i, a in enumerate(_DUP) for b in list(_DUP)[i + 1 :]) + f") SELECT a, b, {r('corr')} AS corr FROM p WHERE corr >= 0.95")
def _(t):
    return rounded(sc.duplicate_features(t.entries().selectExpr(*[f"{v} AS {k}" for k, v in _DUP.items()]), list(_DUP)))


@query("z10_grid_search", None)
def _(t):
    d, k = blocks(t)
    return rounded(sc.grid_search(d, FEATS, "label", "ret", [{"numTrees": n, "maxDepth": m} for n in (5, 10) for m in (3, 5)], range(k)), 4)


_FOLDS = """g AS (SELECT unnest(range(CAST((SELECT (year(max(race_date)) * 12 + month(max(race_date)) - 1999 * 12 - 1) // 6 + 1 FROM re) AS BIGINT))) AS fold),
 tr AS (SELECT CAST(fold AS INT) AS fold, re.* FROM re JOIN g ON race_date < DATE '1999-01-01' + to_months(CAST(fold * 6 AS INT)))"""


@query("z6_walk_forward_optimum", f"""WITH {RE}, {_FOLDS}, x AS (SELECT fold, CAST(finish = 1 AS INT) AS label, {', '.join(FEATS)} FROM tr)
 {' UNION ALL '.join(f"SELECT fold, '{f}' AS term, count(*) AS n, {r(f'avg(CASE WHEN label = 1 THEN {x} ELSE 0.0 END)', 5)} AS moment FROM x GROUP BY 1" for f, x in [('intercept', '1.0'), *[(f, f) for f in FEATS]])}""")
def _(t):
    """Logistic models of all folds, fitted together.

    At the optimum, and only there, the mean of probability times feature over the training rows is that of label
    times feature, which SQL knows without any fit.
    """
    from ticktote.operators import newton as nt

    d, k = blocks(t)
    d = d.where(C("block") < k - 1).withColumn("fold", C("block") + 1)
    m = nt.moments(d, nt.fit(d, FEATS, "label", [nt.Cell()], nested=k), nested=k).drop("cell")
    # rows by block first: a fold's are those of its block and all before
    size = d.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.sequence("fold", F.lit(k - 1))).alias("fold"), "n")
    return rounded(m.join(size.groupBy("fold").agg(F.sum("n").alias("n")), "fold"), 5)


@query("z5_stacking_optimum", f"""WITH {PSEUDO}, x AS (SELECT CAST(finish = 1 AS INT) AS label, {', '.join(_P)} FROM ps WHERE race_id % 4 <> 0)
 {' UNION ALL '.join(f"SELECT '{f}' AS term, {r(f'avg(CASE WHEN label = 1 THEN {x} ELSE 0.0 END)', 5)} AS moment FROM x" for f, x in [('intercept', '1.0'), *[(m, m) for m in _P]])}""")
def _(t):
    """The stacking model on the voters' probabilities, by its optimality conditions."""
    from ticktote.operators import newton as nt

    d = pseudo(t).where("race_id % 4 <> 0").select(F.lit(0).alias("fold"), flag(C("finish") == 1).alias("label"), *_P)
    d = st.stored_table(d, "train")
    return rounded(nt.moments(d, nt.fit(d, list(_P), "label", [nt.Cell()])).select("term", "moment"), 5)


@query("z10_random_search", None)
def _(t):
    d, n = blocks(t)
    return rounded(sc.random_search(d, FEATS, "label", sc.search_cells(FEATS, 24), n), 4)


@query("z11_auc_by_fold", f"""WITH {RE}, x AS (SELECT CAST((year(race_date) * 12 + month(race_date) - 1999 * 12 - 1) // 6 AS INT) AS fold, prob, CAST(finish = 1 AS INT) AS label FROM re WHERE race_date >= '1999-01-01'),
 k AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY prob) + (count(*) OVER (PARTITION BY fold, prob) - 1) / 2.0 AS rk FROM x)
 SELECT fold, count(*) AS n, {r('(sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label)))', 4)} AS auc, {r('avg(CAST(CAST(prob > 0.5 AS INT) = label AS INT))', 4)} AS accuracy FROM k GROUP BY fold""")
def _(t):
    d, _ = folds(t)
    return rounded(sc.auc_by_fold(d.where("role = 'test'"), "label", "prob"), 4)


@query("z12_train_standardisation", f"WITH {RE}, m AS (SELECT avg(qty) AS mq, stddev_pop(qty) AS sq, avg(disc) AS md, stddev_pop(disc) AS sd FROM re WHERE race_date < '1999-07-01') SELECT race_id, car_no, {r('(qty - mq) / sq')} AS qty, {r('(disc - md) / sd')} AS disc FROM re, m")
def _(t):
    d = t.race_entries().select("race_id", "car_no", "race_date", "qty", "disc")
    d = sc.standardise(d, C("race_date") < F.lit("1999-07-01").cast("timestamp_ntz"), ["qty", "disc"])
    return rounded(d.select("race_id", "car_no", "qty", "disc"))


@query("t32_statistical_regime", None)
def _(t):
    cut = F.lit("2024-01-21").cast("timestamp_ntz")
    return sc.regime_clusters(t.bars(), C("ts") < cut)
