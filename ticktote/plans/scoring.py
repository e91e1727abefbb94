"""Model training and scoring with pyspark.ml.

Voters, stacking, calibration and searches are pipelines over DataFrames; the
only driver loops run over a handful of folds or grid points.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktote.functions.core import Seq, sdiv
from ticktote.operators import forest as fo
from ticktote.operators import newton as nt
from ticktote.operators.metrics import correlation_pairs
from ticktote.operators.sequence import runs
from ticktote.sources.storage import stored_table

C = F.col


def voters(label: str, trees: int = 10, depth: int = 4, seed: int = 42) -> list:
    """Five classifiers that differ in family, depth or seed."""
    kw = {"labelCol": label, "featuresCol": "features"}
    return [
        GBTClassifier(maxIter=5, maxDepth=3, seed=seed, **kw),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **kw),
        RandomForestClassifier(numTrees=trees, maxDepth=depth + 2, seed=seed + 1, **kw),
        LogisticRegression(maxIter=20, **kw),
        DecisionTreeClassifier(maxDepth=depth, seed=seed, **kw),
    ]


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip").transform(df)


def fit_voters(train: DataFrame, features: list[str], label: str, **kw) -> list:
    """The voters on rows that every pass of every voter reads again: write train first, see `stored_table`.

    The vectors are made anew in each pass. Held in memory they would take several times the room of the stored
    columns, and drive out the binned rows that the tree models hold.
    """
    d = assemble(train, features).select("features", label)
    return [v.fit(d) for v in voters(label, **kw)]


def score_voters(models: list, df: DataFrame, features: list[str], prefix: str = "p") -> DataFrame:
    """Adds one probability column per voter."""
    d = assemble(df, features)
    for i, m in enumerate(models, 1):
        m = m.copy()
        m.setPredictionCol(f"_y{i}").setProbabilityCol(f"_v{i}").setRawPredictionCol(f"_w{i}")
        d = m.transform(d).withColumn(f"{prefix}{i}", vector_to_array(f"_v{i}")[1]).drop(f"_y{i}", f"_v{i}", f"_w{i}")
    return d.drop("features")


def vote(df: DataFrame, cols: list[str], cut: float = 0.5) -> DataFrame:
    """Majority vote, mean probability and how many voters agree with the majority."""
    ups = sum(((C(c) > cut).cast("int") for c in cols), F.lit(0))
    n = len(cols)
    d = df.withColumn("_up", ups)
    return d.withColumns({
        "vote": (C("_up") * 2 > n).cast("int"), "mean_proba": sum((C(c) for c in cols), F.lit(0.0)) / n, "agreement": F.greatest(C("_up"), n - C("_up"))}).drop("_up")


def model_weights(stats: DataFrame) -> DataFrame:
    """Weights per model from accuracy, sharpe and mae: equal, accuracy cubed, clipped sharpe, inverse error."""
    w = Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(w)
    a3, sh, inv = F.pow("accuracy", F.lit(3)), F.greatest(C("sharpe"), F.lit(0.0)), 1 / F.greatest(C("mae"), F.lit(1e-10))
    tot = F.sum(sh).over(w)
    return stats.select(
        "model", (1.0 / n).alias("w_equal"), (a3 / F.sum(a3).over(w)).alias("w_accuracy"), F.when(tot > 0, sh / tot).otherwise(1.0 / n).alias("w_sharpe"), (inv / F.sum(inv).over(w)).alias("w_error"))


def long_scores(df: DataFrame, keys: list[str], cols: dict[str, Column]) -> DataFrame:
    """One row per (key, model)."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), v.alias("proba")) for k, v in cols.items()]))
    return df.select(*keys, rows.alias("e")).select(*keys, "e.*")


def weighted_combine(scores: DataFrame, weights: DataFrame, keys: list[str], weight: str) -> DataFrame:
    d = scores.join(F.broadcast(weights.select("model", C(weight).alias("_w"))), "model")
    return d.groupBy(*keys).agg(F.sum(C("_w") * C("proba")).alias("proba"))


def stack(train: DataFrame, test: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Logistic regression on the voters' probabilities."""
    m = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=50, probabilityCol="_p").fit(assemble(train, cols, "_x").select("_x", label))
    out = m.transform(assemble(test, cols, "_x"))
    return out.withColumn("stacked", vector_to_array("_p")[1]).drop("_x", "_p", "rawPrediction", "prediction")


def walk_forward_scores(d: DataFrame, features: list[str], label: str, folds: Iterable[int], trees: int = 10, depth: int = 4, seed: int = 42) -> DataFrame:
    """Per fold: fit the five families of `voters` on the rows of earlier blocks, score those of its own. d is stored and has block.

    All trees of all folds grow side by side, as do all logistic fits, so the jobs do not depend on the number of folds.
    """
    folds = list(folds)
    models = [fo.Boosting(5, 3), fo.Forest(trees, depth, seed), fo.Forest(trees, depth + 2, seed + 1), fo.Forest(1, depth, seed)]
    grown = fo.fit(d, features, label, models, folds, seed)
    n = max(folds, default=-1) + 1
    lines = nt.fit(d.where(C("block") < n - 1).withColumn("fold", C("block") + 1), features, label, [nt.Cell()], nested=n)
    s = fo.score(d, grown, {"p1": (0,), "p2": (1,), "p3": (2,), "p5": (3,)}).withColumn("fold", C("block"))
    return vote(nt.predict(s, lines, out="p4"), [f"p{i}" for i in range(1, 6)])


def meta_model(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
    """A primary model, then a second one on features and primary probability that tells if the primary is right.

    Write train first: each pass of both fits reads it again.
    """
    base = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip"), RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=10, maxDepth=4, seed=7, probabilityCol="_p")]).fit(train)

    def primary(d: DataFrame) -> DataFrame:
        d = base.transform(d).withColumn("primary", vector_to_array("_p")[1])
        return d.withColumn("right", ((C("primary") > 0.5).cast("int") == C(label)).cast("int")).drop("_x", "_p", "rawPrediction", "prediction")

    meta = LogisticRegression(featuresCol="_x", labelCol="right", maxIter=30, probabilityCol="_p").fit(assemble(primary(train), [*features, "primary"], "_x").select("_x", "right"))
    out = meta.transform(assemble(primary(test), [*features, "primary"], "_x"))
    return out.withColumn("meta", vector_to_array("_p")[1]).drop("_x", "_p", "rawPrediction", "prediction")


def calibrate(train: DataFrame, test: DataFrame, score: str, label: str) -> DataFrame:
    """Platt and isotonic calibration of one score."""
    platt = LogisticRegression(featuresCol="_x", labelCol=label, maxIter=50, probabilityCol="_p").fit(assemble(train, [score], "_x").select("_x", label))
    iso = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="isotonic").fit(train.select(C(score), C(label).cast("double").alias(label)))
    out = platt.transform(assemble(test, [score], "_x")).withColumn("platt", vector_to_array("_p")[1]).drop("_x", "_p", "rawPrediction", "prediction")
    return iso.transform(out)


def importances(train: DataFrame, features: list[str], label: str, weak_share: float = 0.1) -> DataFrame:
    """Feature importance, running share and the weakest share flagged (one row per feature)."""
    m = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=10, maxDepth=5, seed=3).fit(assemble(train, features).select("features", label))
    rows = [(f, float(v)) for f, v in zip(features, m.featureImportances.toArray())]
    d = train.sparkSession.createDataFrame(rows, "feature string, importance double")
    w = Window.partitionBy(F.lit(0))
    run = w.orderBy(C("importance").desc(), "feature").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"share": sdiv(C("importance"), F.sum("importance").over(w)), "rank": F.row_number().over(w.orderBy(C("importance").desc(), "feature"))})
    d = d.withColumn("cum_share", F.sum("share").over(run))
    return d.withColumn("weak", (C("rank") > F.ceil(F.count(F.lit(1)).over(w) * (1 - weak_share))).cast("int"))


def duplicate_features(df: DataFrame, features: list[str], threshold: float = 0.95) -> DataFrame:
    """Pairs of features whose absolute correlation reaches the threshold, the strongest first."""
    d = correlation_pairs(df, features).select("a", "b", F.abs("corr").alias("corr"))
    return d.where(C("corr") >= threshold).orderBy(F.desc("corr"), "a", "b")


def grid_search(d: DataFrame, features: list[str], label: str, ret: str, grid: list[dict], folds: Iterable[int]) -> DataFrame:
    """Fold profit factor of each parameter set (numTrees, maxDepth); the grid is a short list.

    d is stored and has block: fold f is trained on the rows of earlier blocks and tested on its own. Trees of all folds
    grow side by side, one job for each level. Sets that differ in depth alone share a forest: cut at a depth, it is the one
    that this depth grows by itself. The test rows of all fits are scored in one job.
    """
    folds, sizes = list(folds), sorted({p["numTrees"] for p in grid})
    models = [fo.Forest(n, max(p["maxDepth"] for p in grid if p["numTrees"] == n), seed=11) for n in sizes]
    fits = fo.fit(d, features, label, models, folds, seed=11)
    test = fo.score(d, fits, {f"_p{i}": (sizes.index(p["numTrees"]), p["maxDepth"]) for i, p in enumerate(grid)})
    sums = [F.count(F.lit(1)).alias("n")]
    for i in range(len(grid)):
        r = F.when(C(f"_p{i}") > 0.5, C(ret)).otherwise(-C(ret))
        sums += [F.sum(F.when(r > 0, r)).alias(f"g{i}"), F.sum(F.when(r < 0, -r)).alias(f"l{i}")]
    of = {v["block"]: v for v in test.groupBy("block").agg(*sums).collect()}
    none = dict.fromkeys(["n", *[f"{x}{i}" for i in range(len(grid)) for x in "gl"]], 0)
    rows = [(i, str(sorted(p.items())), f, int(v["n"]), float(v[f"g{i}"] or 0) / float(v[f"l{i}"]) if v[f"l{i}"] else None) for f in folds for v in [of.get(f, none)] for i, p in enumerate(grid)]
    return d.sparkSession.createDataFrame(sorted(rows, key=lambda r: (r[0], r[2])), "grid int, params string, fold int, n bigint, pf double")


def search_cells(features: list[str], draws: int, seed: int = 42) -> list[nt.Cell]:
    """Random settings: penalty and class weight drawn on a logarithmic scale, and a random part of the features; the first is the plain model."""
    rng = np.random.default_rng(seed)
    cells = [nt.Cell()]
    for _ in range(draws - 1):
        kept = [f for f in features if rng.random() < rng.uniform(0.5, 1.0)] or features
        cells.append(nt.Cell(float(10 ** rng.uniform(-5, 0)), float(10 ** rng.uniform(0, 1)), tuple(kept)))
    return cells


def random_search(d: DataFrame, features: list[str], label: str, cells: list[nt.Cell], folds: int | None = None) -> DataFrame:
    """Mean area, loss and accuracy of each setting over the test rows of all folds, best first; d has fold and role.

    With the number of expanding folds, d is stored and has block instead: a fold is trained on the rows of earlier blocks
    and tested on its own. All settings and folds are fitted together: one job for each Newton step, and one for all test rows.
    """
    if folds is None:
        x = stored_table(d.select("fold", "role", label, *features), "search")
        train, test = x.where("role = 'train'"), x.where("role = 'test'")
    else:
        train, test = d.where(C("block") < folds - 1).withColumn("fold", C("block") + 1), d.where(C("block") >= 0).withColumn("fold", C("block"))
    fits = nt.fit(train, features, label, cells, nested=folds)
    s = nt.evaluate(test, fits).groupBy("cell").agg(
        F.count("auc").alias("folds"), F.sum("n").alias("n"), F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("std_auc"), F.avg("log_loss").alias("mean_loss"), F.avg("accuracy").alias("mean_accuracy"))
    names = d.sparkSession.createDataFrame([(i, c.l2, c.positive_weight, ",".join(c.features or features)) for i, c in enumerate(cells)], "cell int, l2 double, positive_weight double, features string")
    return names.join(s, "cell").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_auc"), "cell")))


def auc_by_fold(scored: DataFrame, label: str, proba: str) -> DataFrame:
    """Area under the ROC curve and accuracy per fold, exact for ties, over all folds at once.

    Scores are counted by value first, so the ordered pass over a fold has one row per distinct score. A fold without
    both classes has a null area.
    """
    p, y = C(proba).cast("double"), C(label).cast("long")
    right = ((p > 0.5).cast("long") == y).cast("long")
    g = scored.groupBy("fold", p.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_pos"), F.sum(right).alias("_ok"))
    below = F.coalesce(F.sum(C("_n") - C("_pos")).over(Window.partitionBy("fold").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = C("_pos") * (below + (C("_n") - C("_pos")) / 2)
    t = g.withColumn("_won", won).groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("_n", "_pos", "_ok", "_won")])
    return t.select("fold", C("_n").alias("n"), F.try_divide("_won", C("_pos") * (C("_n") - C("_pos"))).alias("auc"), (C("_ok") / C("_n")).alias("accuracy"))


def standardise(df: DataFrame, train: Column, cols: list[str]) -> DataFrame:
    """Zero mean and unit deviation by the training rows only (a one-row aggregate)."""
    t = df.where(train).agg(*[F.avg(c).alias("_m_" + c) for c in cols], *[F.stddev_pop(c).alias("_s_" + c) for c in cols])
    d = df.join(F.broadcast(t))
    return d.withColumns({c: sdiv(C(c) - C("_m_" + c), F.when(C("_s_" + c) != 0, C("_s_" + c))) for c in cols}).select(*df.columns)


def regime_clusters(bars: DataFrame, train: Column, k: int = 3, smooth: int = 5) -> DataFrame:
    """Clusters of 24-bar return and its volatility fitted on training rows; labels ordered by mean return.

    A bar takes the majority of its last `smooth` raw labels; missing labels repeat the last one.
    """
    q = Seq("symbol", "ts")
    d = bars.withColumn("_r", q.pct("close", 24)).withColumn("_v", q.sd("_r", 24))
    ok = d.dropna(subset=["_r", "_v"])
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["_r", "_v"], outputCol="_x0"), StandardScaler(inputCol="_x0", outputCol="_x", withMean=True), GaussianMixture(featuresCol="_x", predictionCol="_raw", probabilityCol="_pp", k=k, seed=42, maxIter=30)])
    m = pipe.fit(ok.where(train))
    lab = m.transform(ok).select("symbol", "ts", "_raw", "_r")
    names = lab.where(train).groupBy("_raw").agg(F.avg("_r").alias("_mr"))
    names = names.withColumn("_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_mr")) - 1).select("_raw", "_id")
    lab = lab.join(F.broadcast(names), "_raw", "left").select("symbol", "ts", "_id")
    d = bars.select("symbol", "ts").join(lab, ["symbol", "ts"], "left")
    near = F.collect_list("_id").over(q.last(smooth))
    best = F.array_max(F.transform(F.array(*[F.lit(i) for i in range(k)]), lambda i: F.struct(F.size(F.filter(near, lambda e: e == i)).alias("n"), i.alias("i"))))
    d = d.withColumn("regime", F.when(F.size(near) > 0, best["i"]))
    d = d.withColumn("regime", F.coalesce(F.last("regime", ignorenulls=True).over(q.upto()), F.lit(0)))
    d = runs(d, q, "regime")
    w = Window.partitionBy("symbol", "run_id").orderBy("ts")
    return d.withColumns({"regime_changed": (F.row_number().over(w) == 1).cast("int"), "regime_duration": F.row_number().over(w)}).drop("_id", "run_id")
