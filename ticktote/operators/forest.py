"""Decision trees of many expanding folds, grown side by side.

A row has the block that tests it; fold f is trained on the rows of blocks below f. Each level of all trees of all folds is one
job: tasks find the node of each row in each tree and emit histograms of the levels' open nodes, whose number
depends on folds, trees, nodes, features and bins but not on rows. Nothing is held in memory between the jobs: rows are
read again, and a row's weights are drawn again from the seed, its partition and its place.

Trees are those of pyspark.ml: 32 bins between quantiles of a sample of each fold's own rows (all rows where they are few),
Poisson weights and sqrt(features) drawn per node where there is more than one tree, Gini or variance, no split
without gain, children of one class merged. Nodes draw their features from the generators of pyspark.ml; only the weights
of rows come from another one. The upper levels of a forest are the forest of less depth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: bins of a feature, and rows of a fold that their edges are taken from
BINS = 32
EDGE_ROWS = 10_000
#: rows whose arrays stay in the processor's cache
BLOCK_ROWS = 8192
EPSILON = 2.0**-52
#: Poisson draws with mean 1 by a number of 16 bits
_LEVELS = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)]))
POISSON = np.searchsorted(_LEVELS, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass(frozen=True)
class Forest:
    """Trees on Gini, each on a bag of its own; a single tree takes all rows and features."""

    trees: int
    depth: int
    seed: int = 0


@dataclass(frozen=True)
class Boosting:
    """Trees on variance, each fitted to the logistic loss that those before it leave."""

    trees: int
    depth: int
    rate: float = 0.1


@dataclass
class Tree:
    """Nodes by their place in the heap, the root at 1; a leaf has the feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    stats: np.ndarray

    @classmethod
    def blank(cls, depth: int, channels: int) -> Tree:
        n = 2 << depth
        return cls(np.full(n, -1), np.full(n, BINS, np.uint8), np.zeros((n, channels)))


#: a tree whose leaves are carried down to one depth: feature, cut and value by place
Flat = tuple[int, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Trees:
    """Trees of each (model, fold); fine edges of each feature, and which bin of a fold a fine one lies in."""

    features: list[str]
    models: list[Forest | Boosting]
    folds: list[int]
    edges: list[np.ndarray]
    bins: dict[int, list[np.ndarray]]
    trees: dict[tuple[int, int], list[Tree]] = field(default_factory=dict)
    jobs: int = 0

    def flat(self, model: int, fold: int, depth: int | None = None) -> list[Flat]:
        """The grown trees down to a depth, ready to find the value of a row."""
        m = self.models[model]
        depth = m.depth if depth is None else depth
        value = _mean if isinstance(m, Boosting) else _share
        return [_flat(t, depth, value, isinstance(m, Forest)) for t in self.trees[model, fold]]


def _share(s: np.ndarray) -> float:
    return s[1] / (s[0] + s[1])


def _mean(s: np.ndarray) -> float:
    return s[1] / s[0]


def _all(s: np.ndarray) -> np.ndarray:
    return s.sum(axis=-1)


def _first(s: np.ndarray) -> np.ndarray:
    return s[..., 0]


def _gini(s: np.ndarray) -> np.ndarray:
    n = s.sum(axis=-1)
    p = s / np.where(n > 0, n, 1.0)[..., None]
    return 1.0 - p[..., 0] * p[..., 0] - p[..., 1] * p[..., 1]


def _variance(s: np.ndarray) -> np.ndarray:
    n = np.where(s[..., 0] > 0, s[..., 0], 1.0)
    return (s[..., 2] - s[..., 1] * s[..., 1] / n) / n


def _flat(t: Tree, depth: int, value: Callable[[np.ndarray], float], merge: bool) -> Flat:
    feature, cut, out = np.zeros(2 << depth, np.intp), np.full(2 << depth, BINS, np.uint8), np.zeros(2 << depth)

    def leaf(at: int, level: int, v: float) -> None:
        for k in range(depth - level + 1):
            span = slice(at << k, (at + 1) << k)
            feature[span], cut[span], out[span] = 0, BINS, v

    def walk(at: int, level: int) -> int | None:
        """The class of a leaf, or None of a node with children."""
        up = int(t.stats[at][1] > t.stats[at][0])
        if level < depth and t.feature[at] >= 0:
            low, high = walk(2 * at, level + 1), walk(2 * at + 1, level + 1)
            if not merge or low is None or low != high:
                feature[at], cut[at] = t.feature[at], t.cut[at]
                return None
        leaf(at, level, value(t.stats[at]))
        return up

    walk(1, 0)
    return depth, feature, cut, out


def _descend(codes: np.ndarray, at: np.ndarray | None, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row after some levels; at has the rows' numbers, None is all of them. A leaf's rows go to its left."""
    n = codes.shape[1]
    at, flat = np.arange(n) if at is None else at, codes.ravel()
    node = np.ones(len(at), np.intp)
    for level in range(depth):
        if level:
            node += node + (flat.take(feature.take(node) * n + at) > cut.take(node))
        else:
            node += node + (flat.take(feature[1] * n + at) > cut[1])
    return node


def _value(codes: np.ndarray, t: Flat) -> np.ndarray:
    depth, feature, cut, out = t
    return out.take(_descend(codes, None, feature, cut, depth))


def _codes(b: pa.RecordBatch, features: list[str], edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, b.column(f).to_numpy(zero_copy_only=False).astype(float)).astype(np.uint16) for f, e in zip(features, edges, strict=True)])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, BLOCK_ROWS):
            yield b.slice(i, BLOCK_ROWS)


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between values such that about equally many rows lie in each bin; between all values where these are few."""
    v, n = np.unique(values, return_counts=True)
    middle = (v[:-1] + v[1:]) / 2
    if len(middle) <= bins - 1:
        return middle
    total, out = np.cumsum(n).astype(float), []
    stride = goal = total[-1] / bins
    for i in range(len(middle)):
        if abs(total[i] - goal) < abs(total[i + 1] - goal):
            out.append(middle[i])
            goal += stride
    return np.array(out)


def _edges(d: DataFrame, features: list[str], folds: list[int], seed: int) -> dict[int, list[np.ndarray]]:
    """Bin edges of each fold from a sample of its own training rows."""
    size = {r["block"]: r["count"] for r in d.groupBy("block").count().collect()}
    rows = {f: sum(n for b, n in size.items() if b < f) for f in folds}
    if any(n == 0 for n in rows.values()):
        raise ValueError("a fold has no training rows")
    share = {f: min(1.0, max(BINS * BINS, EDGE_ROWS) / n) for f, n in rows.items()}
    most = F.lit(0.0)
    for f in sorted(folds, reverse=True):  # of the folds that hold a row the first takes the largest share
        most = F.when(F.col("block") < f, F.lit(share[f])).otherwise(most)
    some = d.withColumn("_u", F.rand(seed)).where(F.col("_u") < most).select("block", "_u", *features).toPandas()
    out = {}
    for f in folds:
        own = some[(some["block"] < f) & (some["_u"] < share[f])]
        out[f] = [quantile_edges(own[x].to_numpy(float), min(BINS, rows[f])) for x in features]
    return out


def _best(h: np.ndarray, drawn: Iterable[int], cuts: list[int], impurity: Callable[[np.ndarray], np.ndarray], count: Callable[[np.ndarray], np.ndarray]) -> tuple | None:
    """(feature, cut, left, right) with the most gain from histograms (feature, channel, bin); None without gain."""
    best, out = 0.0, None
    for j in drawn:
        if cuts[j]:
            total = h[j].sum(axis=1)
            left = np.cumsum(h[j], axis=1)[:, : cuts[j]].T
            right = total - left
            nl, nr = count(left), count(right)
            gain = impurity(total) - nl / (nl + nr) * impurity(left) - nr / (nl + nr) * impurity(right)
            gain = np.where((nl >= 1) & (nr >= 1), gain, -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, out = float(gain[k]), (j, k, left[k], right[k])
    return out


@dataclass
class _Open:
    """Nodes of one level of a tree that may still be split, and the features that each looks at."""

    tree: int
    level: int
    nodes: list[int]
    drawn: list[list[int]]


class _Draws:
    """The features that the nodes of a forest look at, drawn one after the other as pyspark.ml draws them."""

    def __init__(self, model: Forest | Boosting, features: int):
        self.all = isinstance(model, Boosting) or model.trees == 1
        self.features = features
        self.state = 0 if self.all else (model.seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _int(self) -> int:
        """java.util.Random: the next 32 bits, with their sign."""
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        v = self.state >> 16
        return v - (1 << 32) if v >> 31 else v

    def next(self) -> list[int]:
        if self.all:
            return list(range(self.features))
        some, x = int(np.ceil(np.sqrt(self.features))), _scramble(((self._int() << 32) + self._int()) & _LONG)
        out = list(range(some))
        for j in range(some, self.features):
            high, x = _shifted(x, 26)
            low, x = _shifted(x, 27)
            k = int(((high << 27) + low) * 2.0**-53 * (j + 1))
            if k < some:
                out[k] = j
        return out


_LONG = (1 << 64) - 1


def _shifted(x: int, bits: int) -> tuple[int, int]:
    """XORShiftRandom: some bits, and the state after them."""
    x ^= (x << 21) & _LONG
    x ^= x >> 35
    x ^= (x << 4) & _LONG
    return x & ((1 << bits) - 1), x


def _scramble(seed: int) -> int:
    """The state that XORShiftRandom starts from: murmur hashes of its seed."""
    data, mask = seed.to_bytes(8, "big"), 0xFFFFFFFF

    def murmur(h: int) -> int:
        for i in (0, 4):
            k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask
            h ^= ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask
            h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & mask
        h = (h ^ h >> 13) * 0xC2B2AE35 & mask
        return h ^ h >> 16

    low = murmur(0x3C074A61)
    return murmur(low) << 32 | low


def _histograms(d: DataFrame, label: str, fits: Trees, ask: dict[tuple[int, int], list[_Open]]) -> dict[tuple[int, int, int], np.ndarray]:
    """Sums by (node, feature, channel, bin) of the open nodes of each (model, fold, tree): one job."""
    features, models, edges, bins = fits.features, fits.models, fits.edges, fits.bins
    by_fold = {f: [(m, ask[m, f]) for m in range(len(models)) if ask[m, f]] for f in fits.folds}
    bagged = [m for m, x in enumerate(models) if isinstance(x, Forest) and x.trees > 1]
    grown: dict[tuple[int, int, int], tuple] = {}
    before: dict[tuple[int, int], list[Flat]] = {}
    for f, some in by_fold.items():
        for m, opens in some:
            for o in opens:
                t = fits.trees[m, f][o.tree]
                slot = np.full(len(t.feature), -1)
                slot[o.nodes] = range(len(o.nodes))
                grown[m, f, o.tree] = (np.maximum(t.feature, 0), t.cut, slot, sorted(set().union(*o.drawn)))
            if isinstance(models[m], Boosting):
                before[m, f] = [_flat(t, models[m].depth, _mean, False) for t in fits.trees[m, f][:-1]]

    def residual(codes: np.ndarray, y: np.ndarray, model: Boosting, trees: list[Flat]) -> np.ndarray:
        sign = np.where(y > 0, 1.0, -1.0)
        return 4.0 * sign / (1.0 + np.exp(2.0 * sign * _margin(codes, model, trees))) if trees else sign

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        draws = {m: np.random.default_rng([models[m].seed, TaskContext.get().partitionId()]) for m in bagged}
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for b in _slices(batches):
            block = b.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            fine, y = _codes(b, features, edges)[:, order], (b.column(label).to_numpy().astype(float) > 0.5).astype(np.intp)[order]
            bag = {m: POISSON[g.integers(0, 1 << 16, (models[m].trees, len(block)), np.uint16)][:, order] for m, g in draws.items()}
            for f, end in zip(fits.folds, np.searchsorted(block[order], fits.folds), strict=True):
                if not end or not by_fold[f]:
                    continue
                codes = np.stack([bins[f][j].take(fine[j, :end]) for j in range(len(features))])
                for m, opens in by_fold[f]:
                    forest = isinstance(models[m], Forest)
                    r = None if forest else residual(codes, y[:end], models[m], before[m, f])
                    for o in opens:
                        feature, cut, slot, used = grown[m, f, o.tree]
                        at = np.flatnonzero(bag[m][o.tree, :end]) if m in bag else np.arange(end)
                        place = slot.take(_descend(codes, at, feature, cut, o.level))
                        if (place < 0).any():
                            live = place >= 0
                            at, place = at[live], place[live]
                        kinds, size = (2, len(o.nodes) * 2 * BINS) if forest else (3, len(o.nodes) * BINS)
                        key = (m, f, o.tree)
                        if key not in total:
                            total[key] = np.zeros((len(o.nodes), len(features), kinds, BINS))
                        base = (place * 2 + y.take(at)) * BINS if forest else place * BINS
                        weights = [bag[m][o.tree].take(at).astype(float) if m in bag else None] if forest else [None, v := r.take(at), v * v]
                        for j in used:
                            bin_of = base + codes[j].take(at)
                            for c, w in enumerate(weights):
                                h = np.bincount(bin_of, w, size)
                                if forest:
                                    total[key][:, j] += h.reshape(len(o.nodes), 2, BINS)
                                else:
                                    total[key][:, j, c] += h.reshape(len(o.nodes), BINS)
        for (m, f, k), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([f]), pa.array([k]), pa.array([v.tobytes()])], ["model", "fold", "tree", "sums"])

    def add(p: pd.DataFrame) -> pd.DataFrame:
        return p.head(1).assign(sums=[np.sum([np.frombuffer(s) for s in p["sums"]], axis=0).tobytes()])

    schema = "model long, fold long, tree long, sums binary"
    out = d.mapInArrow(run, schema).groupBy("model", "fold", "tree").applyInPandas(add, schema).collect()
    return {(r["model"], r["fold"], r["tree"]): np.frombuffer(r["sums"]) for r in out}


def _margin(codes: np.ndarray, model: Boosting, trees: list[Flat]) -> np.ndarray:
    return sum((model.rate if i else 1.0) * _value(codes, t) for i, t in enumerate(trees))


def fit(d: DataFrame, features: list[str], label: str, models: list[Forest | Boosting], folds: Iterable[int], seed: int = 0) -> Trees:
    """Grows all trees of all models and folds; d has block and is stored, as each level reads it again.

    Rows with a NULL or NaN feature, or without label, are left out.
    """
    folds = sorted(folds)
    d = d.select("block", label, *features).dropna()
    own = _edges(d, features, folds, seed) if folds else {}
    edges = [np.unique(np.concatenate([own[f][j] for f in folds])) if folds else np.zeros(0) for j in range(len(features))]
    # fold bins by fine bin: all values of a fine bin lie above the same edges of a fold
    bins = {f: [np.searchsorted(own[f][j], [*edges[j], np.inf]).astype(np.uint8) for j in range(len(features))] for f in folds}
    fits = Trees(features, models, folds, edges, bins, {(m, f): [] for m in range(len(models)) for f in folds})
    d = d.where(F.col("block") < max(folds, default=0))

    draws = {(m, f): _Draws(models[m], len(features)) for m, f in fits.trees}

    def opened(m: int, f: int, level: int, nodes: dict[int, list[int]]) -> list[_Open]:
        return [_Open(k, level, at, [draws[m, f].next() for _ in at]) for k, at in sorted(nodes.items(), reverse=True)]

    def begin(m: int, f: int) -> list[_Open]:
        """All trees of a forest, or the next one of a boosting."""
        model, trees = models[m], fits.trees[m, f]
        new = range(len(trees), model.trees if isinstance(model, Forest) else min(len(trees) + 1, model.trees))
        trees += [Tree.blank(model.depth, 2 if isinstance(model, Forest) else 3) for _ in new]
        return opened(m, f, 0, {k: [1] for k in new})

    ask = {(m, f): begin(m, f) for m, f in fits.trees}
    while any(ask.values()):
        fits.jobs += 1
        sums = _histograms(d, label, fits, ask)
        for (m, f), opens in ask.items():
            model, going = models[m], {}
            impurity, count = (_gini, _all) if isinstance(model, Forest) else (_variance, _first)
            for o in opens:
                t, more = fits.trees[m, f][o.tree], []
                h = sums[m, f, o.tree].reshape(len(o.nodes), len(features), -1, BINS)
                for i, at in enumerate(o.nodes):
                    if at == 1:
                        t.stats[1] = h[0, o.drawn[0][0]].sum(axis=1)
                    found = _best(h[i], o.drawn[i], [len(e) for e in own[f]], impurity, count) if model.depth else None
                    if found:
                        t.feature[at], t.cut[at], t.stats[2 * at], t.stats[2 * at + 1] = found
                        more += [c for c in (2 * at, 2 * at + 1) if o.level + 1 < model.depth and abs(impurity(t.stats[c])) >= EPSILON]
                if more:
                    going[o.tree] = more[::-1]
            ask[m, f] = opened(m, f, opens[0].level + 1, going) if going else begin(m, f) if opens else []
    return fits


def score(rows: DataFrame, fits: Trees, out: dict[str, tuple]) -> DataFrame:
    """rows with probabilities by the fits of their block's fold: out has (model,) or (model, depth) by name.

    Rows of other blocks, or with a NULL or NaN feature, are left out.
    """
    rows = rows.where(F.col("block").isin(fits.folds)).dropna(subset=fits.features)
    features, edges, bins, models = fits.features, fits.edges, fits.bins, fits.models
    flat = {(c, f): fits.flat(spec[0], f, *spec[1:]) for c, spec in out.items() for f in fits.folds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            block, fine = b.column("block").to_numpy(), _codes(b, features, edges)
            p = {c: np.zeros(len(block)) for c in out}
            for f in np.unique(block).tolist():
                at = np.flatnonzero(block == f)
                codes = np.stack([bins[f][j].take(fine[j, at]) for j in range(len(features))])
                for c, spec in out.items():
                    model, trees = models[spec[0]], flat[c, f]
                    p[c][at] = sum(_value(codes, t) for t in trees) / len(trees) if isinstance(model, Forest) else 1.0 / (1.0 + np.exp(-2.0 * _margin(codes, model, trees)))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, p.values())], [*b.schema.names, *p])

    return rows.mapInArrow(run, T.StructType([*rows.schema, *[T.StructField(c, T.DoubleType()) for c in out]]))
