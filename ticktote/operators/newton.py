"""Logistic models of many (fold, cell) pairs fitted at the same time.

A cell is one setting: penalty, weight of the positive class, features in use. Each Newton step is one job: tasks add
up loss, gradient and Hessian of all cells over their rows, fold by fold, and emit sums only, whose number depends on
folds, cells and features but not on rows. The small systems are solved on the driver. A step that raises the loss of
a pair is halved for that pair alone, and pairs that have converged rest: no task computes them again.

Expanding folds need not be spread out: with `nested` folds, a row whose fold is k is a row of the folds k to nested - 1,
and is stored, read and sent to Python once. All pairs are evaluated on one standardisation, that of the rows as they
are stored, and each fold's own is an affine map of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 4096


@dataclass(frozen=True)
class Cell:
    """One setting. features: names in use, or None for all. The penalty is l2 / 2 times the squared standardised coefficients, beside the mean loss."""

    l2: float = 0.0
    positive_weight: float = 1.0
    features: tuple[str, ...] | None = None


@dataclass
class Fits:
    """Coefficients of all (fold, cell) pairs on standardised features, the intercept first."""

    features: list[str]
    label: str
    cells: list[Cell]
    center: dict[int, np.ndarray]
    scale: dict[int, np.ndarray]
    beta: dict[int, np.ndarray]
    residual: dict[int, np.ndarray] = field(default_factory=dict)
    steps: int = 0
    #: center and scale that tasks use, whatever the fold
    common: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.ones(0))

    def to_fold(self, k: int) -> np.ndarray:
        """The matrix that turns a row (1, x) on the common standardisation into one on that of fold k."""
        center, scale = self.common
        out = np.diag([1.0, *(scale / self.scale[k])])
        out[1:, 0] = (center - self.center[k]) / self.scale[k]
        return out

    def on_common(self, k: int) -> np.ndarray:
        """Coefficients of fold k for rows on the common standardisation."""
        return self.beta[k] @ self.to_fold(k)


#: rows whose arrays over all pairs stay in the processor's cache
BLOCK_ROWS = 2048


def _reduce(rows: DataFrame, fits: Fits, pairs: dict[int, np.ndarray], one: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], nested: int | None = None) -> dict[int, np.ndarray]:
    """Sums of one(x, y, beta, cells), an array over (cell, ...), per fold; one row of sums per task, fold and place.

    x is standardised by `fits.common`, an intercept first; pairs has the cells that each fold asks for, and beta their
    coefficients, one row for each.
    """
    label, features = fits.label, fits.features
    center, scale = fits.common
    beta = {k: fits.on_common(k)[c] for k, c in pairs.items() if len(c)}
    asked = {k: c for k, c in pairs.items() if len(c)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, tuple | None] = {}
        total: dict[int, np.ndarray] = {}

        def group(k: int) -> tuple | None:
            """The folds that rows of number k belong to, and their cells and coefficients side by side."""
            if k not in groups:
                own = [f for f in (range(max(k, 0), nested) if nested is not None else [k]) if f in beta]
                groups[k] = (own, np.concatenate([beta[f] for f in own]), np.concatenate([asked[f] for f in own])) if own else None
            return groups[k]

        for b in batches:
            fold, y = b.column("fold").to_numpy(), b.column(label).to_numpy(zero_copy_only=False).astype(float)
            raw = np.column_stack([b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
            for k in np.unique(fold).tolist():
                if group(k) is None:
                    continue
                _, coefficients, cells = group(k)
                at = np.flatnonzero(fold == k)
                for i in range(0, len(at), BLOCK_ROWS):
                    some = at[i : i + BLOCK_ROWS]
                    x = np.column_stack([np.ones(len(some)), (raw[some] - center) / scale])
                    total[k] = total.get(k, 0) + one(x, y[some], coefficients, cells)
        for k, v in total.items():
            v, at = v.reshape(len(group(k)[2]), -1), 0
            for f in group(k)[0]:
                part = v[at : at + len(asked[f])].ravel()
                at += len(asked[f])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.size, f)), pa.array(np.arange(part.size)), pa.array(part)], ["fold", "i", "v"])

    out = rows.select("fold", label, *features).mapInArrow(run, "fold long, i long, v double").groupBy("fold", "i").agg(F.sum("v").alias("v")).toPandas()
    return {int(k): p.sort_values("i")["v"].to_numpy() for k, p in out.groupby("fold")}


def _probability(eta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))


def _moments(train: DataFrame, features: list[str], nested: int | None) -> tuple[dict[int, tuple], tuple[np.ndarray, np.ndarray]]:
    """Rows, means and deviations of each fold, and mean and scale of all stored rows; one row of sums per fold number leaves Spark."""
    stats = train.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features], *[F.max(f).alias(f"b_{f}") for f in features], *[F.min(f).alias(f"a_{f}") for f in features]).collect()
    part = {r["fold"]: [np.array([r[p + f] for f in features], dtype=float) for p in ("m_", "s_", "a_", "b_")] + [r["n"]] for r in stats}

    def pooled(ks: list[int]) -> tuple:
        """(n, mean, deviation) of several parts; a feature of one value has the deviation 0, whatever rounding says."""
        mean, sd, low, high = (np.array([part[k][i] for k in ks]) for i in range(4))
        w = np.array([part[k][4] for k in ks], dtype=float)[:, None]
        m = (w * mean).sum(axis=0) / w.sum()
        s = np.sqrt((w * (sd**2 + (mean - m) ** 2)).sum(axis=0) / w.sum()) if len(ks) > 1 else sd[0]
        return int(w.sum()), m, np.where(high.max(axis=0) > low.min(axis=0), s, 0.0) if len(ks) > 1 else s

    if nested is None:
        folds = {k: pooled([k]) for k in part}
    else:
        known = {k: [j for j in part if j <= k] for k in range(nested)}
        folds = {k: pooled(js) for k, js in known.items() if js}
    if not part:
        return folds, (np.zeros(len(features)), np.ones(len(features)))
    _, m, s = pooled(list(part))
    return folds, (m, np.where(s > 0, s, 1.0))


def fit(train: DataFrame, features: list[str], label: str, cells: list[Cell], *, max_steps: int = 40, tol: float = 1e-10, nested: int | None = None) -> Fits:
    """Fits every cell on every fold of train (columns fold, label and features; rows with a NULL among them are left out).

    Write or persist train first: it is read once for each step. Folds without rows have no fit; a constant feature
    has the coefficient 0. Fits that do not converge, as for classes that a plane separates, show in `residual`.
    With nested folds, a row of fold k is one of the folds k, ..., nested - 1.
    """
    train = train.dropna(subset=["fold", label, *features])
    stats, common = _moments(train, features, nested)
    center, spread = {k: v[1] for k, v in stats.items()}, {k: v[2] for k, v in stats.items()}
    scale = {k: np.where(s > 0, s, 1.0) for k, s in spread.items()}
    d, m = len(features) + 1, len(cells)
    used = np.array([[True, *[c.features is None or f in c.features for f in features]] for c in cells])
    active = {k: used & np.array([True, *(spread[k] > 0)]) for k in stats}
    weight, l2 = np.array([c.positive_weight for c in cells]), np.array([c.l2 for c in cells])
    fits = Fits(features, label, cells, center, scale, {k: np.zeros((m, d)) for k in stats}, common=common)
    upper = np.triu_indices(d)

    def sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Loss, gradient, upper half of the Hessian and total weight, a line for each pair."""
        eta, up = x @ beta.T, y[:, None] > 0.5
        e = np.exp(-np.abs(eta))
        p = np.where(eta >= 0, 1.0, e) / (1.0 + e)
        w = np.where(up, weight[cell], 1.0)
        loss = (w * (np.maximum(eta, 0) + np.log1p(e) - y[:, None] * eta)).sum(axis=0)
        gradient = (w * (p - y[:, None])).T @ x
        hessian = (w * p * (1 - p)).T @ (x[:, upper[0]] * x[:, upper[1]])
        return np.column_stack([loss, gradient, hessian, w.sum(axis=0)])

    done = {k: np.zeros(m, bool) for k in stats}
    best = {k: (np.full(m, np.inf), np.zeros((m, d))) for k in stats}
    fits.residual = {k: np.full(m, np.inf) for k in stats}
    while fits.steps < max_steps and not all(v.all() for v in done.values()):
        fits.steps += 1
        pairs = {k: np.flatnonzero(~v) for k, v in done.items()}
        for k, flat in _reduce(train, fits, pairs, sums, nested).items():
            s, to = flat.reshape(len(pairs[k]), -1), fits.to_fold(k)
            for c, v in zip(pairs[k].tolist(), s, strict=True):
                half = np.zeros((d, d))
                half[upper] = v[d + 1 : -1]
                square = half + np.triu(half, 1).T
                penalty = l2[c] * np.where(np.arange(d) > 0, fits.beta[k][c], 0.0)
                loss = v[0] / v[-1] + (penalty * fits.beta[k][c]).sum() / 2
                gradient = to @ v[1 : d + 1] / v[-1] + penalty
                hessian = to @ square @ to.T / v[-1] + l2[c] * np.diag([0.0, *[1.0] * (d - 1)])
                on = active[k][c]
                if loss > best[k][0][c] + 1e-13 * abs(loss):
                    fits.beta[k][c] = (fits.beta[k][c] + best[k][1][c]) / 2
                    continue
                best[k][0][c], best[k][1][c] = loss, fits.beta[k][c]
                fits.residual[k][c] = np.abs(gradient[on]).max()
                if fits.residual[k][c] < tol:
                    done[k][c] = True
                    continue
                move = np.zeros(d)
                move[on] = np.linalg.lstsq(hessian[np.ix_(on, on)], gradient[on], rcond=None)[0]
                fits.beta[k][c] = fits.beta[k][c] - move
    for k in stats:
        fits.beta[k] = best[k][1].copy()
    return fits


def _all_pairs(fits: Fits) -> dict[int, np.ndarray]:
    return {k: np.arange(len(fits.cells)) for k in fits.beta}


def moments(rows: DataFrame, fits: Fits, nested: int | None = None) -> DataFrame:
    """(fold, cell, term, moment): mean over rows of probability times feature; at an unpenalised optimum it equals that of the label."""
    spark, features = rows.sparkSession, fits.features
    rows = rows.dropna(subset=["fold", fits.label, *features])
    m, d = len(fits.cells), len(features) + 1
    center, scale = fits.common

    def sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return np.column_stack([_probability(x @ beta.T).T @ x, np.full(len(cell), len(x))])

    out = []
    for k, flat in _reduce(rows, fits, _all_pairs(fits), sums, nested).items():
        s = flat.reshape(m, d + 1)
        for c in range(m):
            mean = s[c, 0] / s[c, -1]
            raw = s[c, 1:-1] / s[c, -1] * scale + mean * center
            out += [(k, c, t, float(v)) for t, v in zip(["intercept", *features], [mean, *raw], strict=True)]
    return spark.createDataFrame(out, "fold int, cell int, term string, moment double")


def evaluate(rows: DataFrame, fits: Fits, bins: int = BINS) -> DataFrame:
    """(fold, cell, n, log_loss, accuracy, auc) of rows by the fits of their fold.

    The area is that of probabilities rounded down to 1 / bins, with ties counted half; counts by bin are all that
    leaves a task.
    """
    spark = rows.sparkSession
    rows = rows.dropna(subset=["fold", fits.label, *fits.features])
    m = len(fits.cells)

    def sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray, cell: np.ndarray) -> np.ndarray:
        eta, up = x @ beta.T, y > 0.5
        p = _probability(eta)
        loss = (np.logaddexp(0, eta) - y[:, None] * eta).sum(axis=0)
        right = ((p > 0.5) == up[:, None]).sum(axis=0)
        at = np.minimum((p * bins).astype(int), bins - 1) + np.where(up, 0, bins)[:, None]
        counts = np.bincount((at + np.arange(len(cell)) * 2 * bins).ravel(), minlength=len(cell) * 2 * bins).reshape(len(cell), 2 * bins)
        return np.column_stack([loss, right, np.full(len(cell), len(x)), counts])

    out = []
    for k, flat in _reduce(rows, fits, _all_pairs(fits), sums).items():
        for c, s in enumerate(flat.reshape(m, -1)):
            pos, neg = s[3 : 3 + bins], s[3 + bins :]
            won = (pos * (np.cumsum(neg) - neg / 2)).sum()
            area = float(won / (pos.sum() * neg.sum())) if pos.sum() and neg.sum() else None
            out.append((k, c, int(s[2]), float(s[0] / s[2]), float(s[1] / s[2]), area))
    return spark.createDataFrame(out, "fold int, cell int, n long, log_loss double, accuracy double, auc double")


def predict(rows: DataFrame, fits: Fits, cell: int = 0, out: str = "proba") -> DataFrame:
    """rows with the probability of their fold's fit; NULL for a fold without fit or a NULL feature. An expression, without Python."""
    schema = T.StructType([T.StructField("fold", rows.schema["fold"].dataType), T.StructField("_b", T.ArrayType(T.DoubleType())), T.StructField("_a", T.DoubleType())])
    table = []
    for k, beta in fits.beta.items():
        raw = beta[cell][1:] / fits.scale[k]
        table.append((k, raw.tolist(), float(beta[cell][0] - (raw * fits.center[k]).sum())))
    d = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, schema)), "fold", "left")
    eta = F.col("_a")
    for i, f in enumerate(fits.features):
        eta = eta + F.col("_b")[i] * F.col(f)
    return d.withColumn(out, 1 / (1 + F.exp(-eta))).drop("_a", "_b")
