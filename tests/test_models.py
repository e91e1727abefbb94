"""Keyed logistic fits against one-by-one numpy fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ticktote.operators import newton as nt
from ticktote.plans import scoring as sc

FEATURES = ["a", "b", "c", "flat"]


def sample(n=1500):
    rng = np.random.default_rng(6)
    p = pd.DataFrame({"fold": rng.integers(0, 3, n), "a": rng.standard_normal(n) * 1e4 + 5e4, "b": rng.standard_normal(n), "flat": 3.5})
    p["c"] = p.b * 0.8 + rng.standard_normal(n) * 0.3
    eta = (p.a - 5e4) / 1e4 - 0.7 * p.b + 0.4 * p.fold - 1
    p["label"] = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    return p


def frame(spark, p):
    d = spark.createDataFrame(p).withColumn("fold", F.col("fold").cast("int"))
    odd = d.limit(3).withColumn("b", F.lit(None).cast("double"))
    return d.unionByName(odd).unionByName(d.limit(2).withColumn("label", F.lit(None).cast(d.schema["label"].dataType))).repartition(5)


def slow_fit(p, cell):
    """One fit by itself, in numpy, on standardised features."""
    used = [f for f in FEATURES if (cell.features is None or f in cell.features) and f != "flat"]
    x = np.column_stack([np.ones(len(p)), *[(p[f] - p[f].mean()) / p[f].std(ddof=0) for f in used]])
    y = p.label.to_numpy()
    w = np.where(y == 1, cell.positive_weight, 1.0) / np.where(y == 1, cell.positive_weight, 1.0).sum()
    ridge = np.diag([0.0] + [cell.l2] * len(used))
    b = np.zeros(len(used) + 1)
    for _ in range(60):
        q = 1 / (1 + np.exp(-(x @ b)))
        b = b - np.linalg.solve((x * (w * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (w * (q - y)) + ridge @ b)
    return 1 / (1 + np.exp(-(x @ b)))


CELLS = [nt.Cell(), nt.Cell(l2=0.3), nt.Cell(positive_weight=4.0), nt.Cell(l2=0.01, features=("a",)), nt.Cell(features=("c", "flat"))]


def test_all_folds_and_cells_reach_their_optimum(spark):
    p = sample()
    d = frame(spark, p)
    fits = nt.fit(d, FEATURES, "label", CELLS)
    assert fits.steps < 20 and max(v.max() for v in fits.residual.values()) < 1e-10
    for c, cell in enumerate(CELLS):
        got = nt.predict(spark.createDataFrame(p), fits, c).toPandas()
        for k in range(3):
            part = p[p.fold == k]
            mine = got[got.fold == k].merge(part.assign(want=slow_fit(part, cell)), on=["fold", "a", "b", "c", "label"])
            assert len(mine) == len(part)
            np.testing.assert_allclose(mine.proba, mine.want, atol=1e-6)


def test_evaluation_and_moments(spark):
    from collections import defaultdict

    p = sample()
    d = frame(spark, p)
    fits = nt.fit(d, FEATURES, "label", CELLS)
    ev = nt.evaluate(d, fits).toPandas().set_index(["fold", "cell"])
    for c in range(len(CELLS)):
        s = nt.predict(spark.createDataFrame(p), fits, c).toPandas()
        exact = sc.auc_by_fold(spark.createDataFrame(s), "label", "proba").toPandas().set_index("fold")
        for k in range(3):
            assert ev.loc[(k, c), "n"] == (p.fold == k).sum()
            assert abs(ev.loc[(k, c), "auc"] - exact.loc[k, "auc"]) < 1e-3
            assert abs(ev.loc[(k, c), "accuracy"] - exact.loc[k, "accuracy"]) < 1e-12
    seen = defaultdict(dict)
    for r in nt.moments(d, fits).where("cell = 0").collect():
        seen[r["fold"]][r["term"]] = r["moment"]
    for k in range(3):
        part = p[p.fold == k]
        for f in FEATURES:
            assert abs(seen[k][f] - (part[f] * part.label).mean()) < 1e-6 * max(1, abs(part[f]).max())


def test_nested_folds_equal_spread_out_ones(spark):
    """A row of block k, stored once, counts in every fold from k on."""
    p = sample()
    p.loc[p.fold == 0, "c"] = 2.0  # a constant feature in the first fold only
    d = frame(spark, p)
    spread = d.withColumn("fold", F.explode(F.sequence("fold", F.lit(3))))
    one, many = nt.fit(d, FEATURES, "label", CELLS, nested=4), nt.fit(spread, FEATURES, "label", CELLS)
    assert set(one.beta) == set(many.beta) == {0, 1, 2, 3}
    for k in many.beta:
        np.testing.assert_allclose(one.center[k], many.center[k])
        np.testing.assert_allclose(one.beta[k], many.beta[k], atol=1e-7)
    order = ["fold", "cell", "term"]
    a, b = (m.toPandas().sort_values(order).reset_index(drop=True) for m in (nt.moments(d, one, nested=4), nt.moments(spread, many)))
    np.testing.assert_allclose(a.moment, b.moment, rtol=1e-8)


def test_blocks_are_the_month_folds(spark):
    from ticktote.operators import labels as lb

    days = pd.date_range("1998-11-25", "2001-09-03", freq="3D")
    d = spark.createDataFrame(pd.DataFrame({"i": range(len(days)), "day": days})).unionByName(spark.createDataFrame([(-1, None)], "i long, day timestamp"))
    for first, months in (("1999-01-01", 6), ("1999-01-31", 1), ("1999-02-15", 5)):
        n = lb.month_fold_count(d, "day", first, months) + 1
        b = lb.month_blocks(d, "day", first, months).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        b = b.withColumn("role", F.when(F.col("block") < F.col("fold"), "train").when(F.col("block") == F.col("fold"), "test")).where("role is not null")
        want = lb.month_folds(d, "day", first, months, n)
        rows = lambda x: sorted(map(tuple, x.select("i", "fold", "role").collect()))
        assert rows(b) == rows(want)


def test_rows_of_model_queries_are_derived_once(tables):
    """Fits read a stored table: their plans have no window over races, and no copy of a row for each fold."""
    from ticktote.catalog import models

    d, n = models.blocks(tables)
    for x in (d, *models.split(tables)):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Generate" not in plan and "Join" not in plan
    assert n == 6 and d.count() == models.rows(tables).count()


def test_odd_inputs(spark):
    p = sample(300)
    p.loc[p.fold == 1, "label"] = 1  # one class only
    d = frame(spark, p)
    fits = nt.fit(d, FEATURES, "label", [nt.Cell(l2=0.1)], max_steps=15)
    assert set(fits.beta) == {0, 1, 2} and all(np.isfinite(b).all() for b in fits.beta.values())
    ev = nt.evaluate(d, fits).toPandas().set_index("fold")
    assert np.isnan(ev.loc[1, "auc"]) and ev.loc[0, "auc"] > 0.5
    assert nt.predict(d.withColumn("fold", F.lit(9)), fits).where("proba is not null").count() == 0
    empty = nt.fit(d.limit(0), FEATURES, "label", [nt.Cell()])
    assert empty.beta == {} and nt.evaluate(d, empty).count() == 0


def test_random_search_ranks_settings(spark):
    p = sample()
    d = spark.createDataFrame(p).withColumn("role", F.when(F.col("a") % 1.0 < 0.7, "train").otherwise("test"))
    cells = sc.search_cells(FEATURES, 6)
    got = sc.random_search(d, FEATURES, "label", cells).orderBy("rank").toPandas()
    assert len(got) == 6 and got.mean_auc.is_monotonic_decreasing and (got.folds == 3).all()
    assert cells == sc.search_cells(FEATURES, 6) and cells[0] == nt.Cell()


def test_duplicate_features(spark):
    d = spark.createDataFrame(sample()).withColumn("twice", F.col("a") * -2)
    got = sc.duplicate_features(d, ["a", "b", "c", "twice"], 0.9).collect()
    assert [(r["a"], r["b"]) for r in got] == [("a", "twice"), ("b", "c")]
