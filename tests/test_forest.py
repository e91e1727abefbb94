"""Trees of many folds grown side by side against pyspark.ml's, one fit for each fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from ticktote.operators import forest as fo
from ticktote.plans import scoring as sc

FEATURES = ["a", "b", "c", "d", "e", "k"]


def rows(spark, n=3000, blocks=3):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({f: rng.normal(size=n).round(2) for f in FEATURES}).assign(k=rng.integers(0, 4, n).astype(float), flat=1.5)
    p["label"] = (p.a + p.b * p.k - p.c + 0.3 * p.d + rng.normal(size=n) > 1).astype(int)
    p["block"], p["ret"] = rng.integers(-1, blocks, n), np.where(p.label == 1, 1.0, -0.3)
    p.loc[:1, "block"] = [-1, blocks - 1]
    d = spark.createDataFrame(p)
    odd = d.limit(4).withColumn("b", F.lit(None).cast("double")).unionByName(d.limit(4).withColumn("c", F.lit(float("nan"))))
    return d.unionByName(odd).repartition(3).localCheckpoint()


def test_features_are_drawn_as_pyspark_ml_draws_them(spark):
    jvm = spark._jvm
    r, draws = jvm.java.util.Random(), fo._Draws(fo.Forest(5, 3, 11), 6)
    r.setSeed(11)
    for _ in range(20):
        x, want = jvm.org.apache.spark.util.random.XORShiftRandom(r.nextLong()), [0, 1, 2]
        for j in range(3, 6):
            k = int(x.nextDouble() * (j + 1))
            if k < 3:
                want[k] = j
        assert draws.next() == want


def test_single_trees_and_boosting_are_those_of_pyspark_ml(spark):
    d, features, kw = rows(spark), [*FEATURES, "flat"], {"labelCol": "label", "featuresCol": "features", "seed": 42}
    fits = fo.fit(d, features, "label", [fo.Boosting(3, 2), fo.Forest(1, 4, 42)], range(3), 42)
    assert fits.jobs == 6
    got = fo.score(d, fits, {"g": (0,), "t": (1,), "cut": (1, 2)})
    assert got.count() == sc.assemble(d.where("block >= 0"), features).count() < d.where("block >= 0").count()
    for f in range(3):
        x = sc.assemble(d.where(F.col("block") < f), features)
        ml = [m.fit(x) for m in (GBTClassifier(maxIter=3, maxDepth=2, **kw), DecisionTreeClassifier(maxDepth=4, **kw), DecisionTreeClassifier(maxDepth=2, **kw))]
        p = sc.score_voters(ml, got.where(F.col("block") == f), features, "q").toPandas()
        assert len(p) > 500
        for i, c in enumerate(("g", "t", "cut"), 1):
            np.testing.assert_allclose(p[c], p[f"q{i}"], atol=1e-12)


def test_forests_are_as_good_as_those_of_pyspark_ml(spark):
    d = rows(spark, 8000, 2)
    fits = fo.fit(d, FEATURES, "label", [fo.Forest(10, 5, 11), fo.Forest(10, 3, 11)], range(2), 11)
    s = fo.score(d, fits, {"deep": (0,), "cut": (0, 3), "low": (1,)}).withColumn("right", ((F.col("deep") > 0.5).cast("int") == F.col("label")).cast("int"))
    # the upper levels of a forest are the forest of less depth
    assert s.where(F.abs(F.col("cut") - F.col("low")) > 1e-12).count() == 0
    for f in range(2):
        m = RandomForestClassifier(numTrees=10, maxDepth=5, seed=11, labelCol="label", featuresCol="features").fit(sc.assemble(d.where(F.col("block") < f), FEATURES))
        test = sc.assemble(d.where(F.col("block") == f), FEATURES)
        want = m.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
        assert abs(s.where(F.col("block") == f).agg(F.avg("right")).first()[0] - want) < 0.02
    weights = fo.POISSON.astype(float)
    assert abs(weights.mean() - 1) < 1e-3 and abs(weights.var() - 1) < 5e-3


@pytest.mark.parametrize("search", [
    lambda d, n: sc.grid_search(d, FEATURES, "label", "ret", [{"numTrees": t, "maxDepth": m} for t in (2, 3) for m in (1, 2)], range(n)).collect(),
    lambda d, n: sc.walk_forward_scores(d, FEATURES, "label", range(n), trees=2, depth=1).collect(),
])
def test_jobs_do_not_grow_with_folds(spark, search):
    """Before, each fold and parameter set was a fit of its own, with some ten passes over all rows."""
    d, used = rows(spark, 800, 4), []
    for n in (2, 4):
        spark.sparkContext.setJobGroup(f"folds{n}", "")
        assert len(search(d, n)) > 0
        used.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds{n}")))
    spark.sparkContext.setJobGroup("", "")
    assert 0 < used[0] and used[1] <= used[0] + 8  # a logistic fit may take some steps more


def test_odd_folds(spark):
    d = rows(spark, 300, 2)
    grid = [{"numTrees": 3, "maxDepth": 2}]
    assert sc.grid_search(d, FEATURES, "label", "ret", grid, range(0)).count() == 0
    got = sc.grid_search(d.where("block < 1"), FEATURES, "label", "ret", grid, range(2)).collect()
    assert [(r["fold"], r["n"] > 0, r["pf"] is None) for r in got] == [(0, True, False), (1, False, True)]
    with pytest.raises(ValueError):
        sc.grid_search(d.where("block > 0"), FEATURES, "label", "ret", grid, range(2))
    one = sc.walk_forward_scores(d.withColumn("label", F.lit(0)), FEATURES, "label", range(2), trees=2, depth=1)
    assert one.where("vote = 0").count() == one.count() > 0
