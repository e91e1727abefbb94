"""Whitening of embeddings on leading principal components, found by spectrum slicing.

Sums and the centred covariance of the distinct vectors are gathered by Spark, a matrix of d x d numbers whatever the
number of rows. Its leading eigenpairs are found one by one: an LDL' factorisation of the shifted matrix has as many
positive pivots as there are eigenvalues above the shift, so such counts isolate the k-th eigenvalue, Rayleigh quotient
iteration then converges on it, and two more counts around the result certify that it is the k-th.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktote.llm.common import shared_table

SCALE, COMPONENTS = 256, 4
_EPS = np.finfo(np.float64).eps
_PIVOT = (1 + 17**0.5) / 8
_LONG = 2**63 - 1


def count_above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric matrix a above shift: the positive inertia of LDL' of a - shift, with complete pivoting."""
    m = a - shift * np.eye(len(a))
    n = 0
    while len(m):
        diagonal = np.abs(np.diagonal(m))
        r = int(np.argmax(diagonal))
        off = np.abs(m)
        np.fill_diagonal(off, 0)
        p, q = np.unravel_index(int(np.argmax(off)), off.shape)
        if diagonal[r] >= _PIVOT * off[p, q]:
            if diagonal[r] == 0:
                break
            n += int(m[r, r] > 0)
            gone, block = [r], m[r : r + 1, r : r + 1]
        else:
            # a pivot of two rows with a negative determinant: one eigenvalue on each side
            n += 1
            gone, block = [p, q], m[np.ix_([p, q], [p, q])]
        rest = np.delete(np.arange(len(m)), gone)
        c = m[np.ix_(rest, gone)]
        m = m[np.ix_(rest, rest)] - c @ np.linalg.solve(block, c.T)
        m = (m + m.T) / 2
    return n


def _solve(a: np.ndarray, shift: float, v: np.ndarray, norm: float) -> np.ndarray:
    for nudge in (0.0, 1.0, 64.0):
        try:
            w = np.linalg.solve(a - (shift + nudge * _EPS * norm) * np.eye(len(a)), v)
            if np.isfinite(w).all():
                return w
        except np.linalg.LinAlgError:
            continue
    return v


def leading_pairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows.

    Equal eigenvalues get any orthonormal vectors of their space. The sign makes the largest entry positive.
    """
    d = len(a)
    k = min(k, d)
    norm = float(np.abs(a).sum(axis=1).max()) if d else 0.0
    values, vectors = np.zeros(k), np.eye(d)[:k]
    if norm == 0:
        return values, vectors
    fine = 4 * d * _EPS * norm
    counts = {-norm - fine: d, norm + fine: 0}

    def above(x: float) -> int:
        if x not in counts:
            counts[x] = count_above(a, x)
        return counts[x]

    rng = np.random.default_rng(0)
    found = np.zeros((0, d))
    for i in range(k):
        lo = max(x for x, n in counts.items() if n > i)
        hi = min(x for x, n in counts.items() if n <= i)
        while True:
            # exactly one eigenvalue in (lo, hi], or an interval too narrow to part equal ones
            while hi - lo > fine and not (above(lo) == i + 1 and above(hi) == i):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if above(mid) > i else (lo, mid)
            v = rng.standard_normal(d)
            rho, best = (lo + hi) / 2, np.inf
            for step in range(60):
                w = _solve(a, rho, v, norm)
                w -= found.T @ (found @ w)
                w /= np.linalg.norm(w)
                av = a @ w
                got = float(w @ av)
                residual = float(np.linalg.norm(av - got * w - found.T @ (found @ (av - got * w))))
                v = w
                if residual >= best / 2 and step > 3:
                    break
                best = residual
                # the first steps are inverse iterations from inside the interval, then the quotient is the shift
                rho = got if step >= 2 or lo < got <= hi else rho
            margin = residual + fine
            if above(got + margin) <= i < above(got - margin) and margin < 1e-6 * norm:
                break
            if hi - lo <= fine:
                raise ArithmeticError("an eigenvalue could not be certified")
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if above(mid) > i else (lo, mid)
        values[i], vectors[i] = got, v * np.sign(v[np.argmax(np.abs(v))])
        found = np.vstack([found, v])
    return values, vectors


def whole_vector(vec: Column) -> Column:
    """True where the vector has entries and all of them are finite numbers."""
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def quantised(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of each entry as long; beyond the range of long it stops at its ends."""
    return F.transform(vec, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def _matrix(batch: pa.RecordBatch, i: int, d: int) -> np.ndarray:
    return batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, 0, d)
            # two halves of each number, so that no sum passes the range of long
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array((x >> 32).sum(axis=0)), pa.array((x & 0xFFFFFFFF).sum(axis=0))], ["j", "hi", "lo"])

    return run


def _products(d: int, mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            c = _matrix(b, 0, d) - mean
            total += c.T @ c
        i, j = np.indices((d, d))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    return run


class Whitening:
    """A fitted whitening: n, exact sums, covariance, eigenvalues and eigenvectors; all of a size that depends on the dimension only."""

    def __init__(self, fit: DataFrame, dimension: int, components: int = COMPONENTS) -> None:
        """fit: stored distinct vectors x of one length."""
        d = self.dimension = dimension
        self.n = fit.count()
        rows = fit.mapInArrow(_sums(d), "j long, hi long, lo long").groupBy("j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("hi", "lo")]).collect()
        self.sums = [0] * d
        for r in rows:
            self.sums[r["j"]] = (int(r["hi"]) << 32) + int(r["lo"])
        self.mean = np.array([s / self.n for s in self.sums])
        cells = fit.mapInArrow(_products(d, self.mean), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        v = np.zeros((d, d))
        v[cells["i"], cells["j"]] = cells["v"]
        self.covariance = (v + v.T) / (2 * self.n)
        self.values, self.vectors = leading_pairs(self.covariance, components)
        trace = float(np.trace(self.covariance))
        self.explained = [float(e) / trace if trace > 0 else None for e in self.values]
        flat = 4 * d * _EPS * float(np.abs(self.covariance).sum(axis=1).max())
        #: matrix d x k of the directions; a component without spread has none
        self.spread = [bool(e > flat) for e in self.values]
        self.directions = np.array([u / e**0.5 if ok else np.full(d, np.nan) for u, e, ok in zip(self.vectors, self.values, self.spread, strict=True)]).T

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.directions

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S)^2, exact; None where that passes the range of long."""
        bound = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(abs(s) for s in self.sums)
        if self.dimension * bound * bound <= _LONG:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x]
        return [e if e <= _LONG else None for e in exact]

    def identity_error(self, fit: DataFrame) -> float | None:
        """Largest absolute entry of the covariance of the whitened fit list minus the identity, over components with spread."""
        ks = [k for k, ok in enumerate(self.spread) if ok]
        if not ks:
            return None
        model, d = self, self.dimension

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w = model.whiten(_matrix(b, 0, d))
                yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in ks], [f"w{k}" for k in ks])

        out = fit.mapInArrow(run, ", ".join(f"w{k} double" for k in ks))
        pairs = [(a, b) for a in ks for b in ks if a <= b]
        got = out.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
        return max(abs(got[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whitened_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Dropped are vectors that are null or empty, that hold a null or non-finite entry, and those of another length than
    most (ties: the longer). Repeated vectors count once in the fit and get rows each; a null id stays. A component
    without spread has a null whitened value (and all are null, as is explained, where all vectors are equal);
    deviation is null where it passes the range of long. An empty table gives no rows. Other columns are not looked at.
    """
    good = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x")).where(whole_vector(F.col("x"))).select("id", quantised(F.col("x"), scale).alias("x"))
    good = shared_table(good, "quantised")
    size = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = T.StructType([good.schema["id"], *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    if size is None:
        return vectors.sparkSession.createDataFrame([], schema)
    good = good.where(F.size("x") == size["d"])
    fit = shared_table(good.select("x").distinct(), "fit-list")
    model = Whitening(fit, size["d"], components)
    error, k = model.identity_error(fit), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = _matrix(b, 1, model.dimension), b.num_rows
            w = model.whiten(x).ravel()
            ids = b.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation, pa.array(w, mask=np.isnan(w)),
                 pa.array(model.explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())],
                schema.names)

    return good.mapInArrow(run, schema)
