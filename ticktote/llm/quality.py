"""A quality classifier trained by co-training of two views.

The text view has hashed words, their first four and five bytes, and the shape of a text (shares of kinds of
characters, repetition of words and lines); of the hashed ones, those count that tell good from bad labelled rows. The
metadata view has the other columns. Each view is a logistic model fitted on a bounded sample of labelled rows. In
each round both score all documents, and what one view is confident about is a pseudo-label for the other. At the end
each view is calibrated on labelled rows that it was not fitted on, and a small model over both calibrated views scores
all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktote.llm.common import shared_table
from ticktote.llm.textops import columns, mix, pieces, word_hashes

WORD_FEATURES = 1 << 20
PREFIXES = (4, 5)
LEAST_ROWS = 5
Z_SCORE = 3.5
MOST_FEATURES = 60_000
SHAPE_BINS = 16
META_FEATURES = 1 << 12
MAX_LABELLED = 8_000
MAX_PSEUDO = 2_000
ROUNDS = 2
CONFIDENT = 0.97
META = ("lang", "source", "n_chars")
#: rows, and bytes of text, that a task works on at a time
SLICE_ROWS, TEXT_BYTES = 1_000, 1 << 18


_KINDS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", "#$%&*+<=>@^~", "|", ".,;:", "\n", " \t", "()[]{}/\\\"'_-")
_KIND_OF = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate(_KINDS, 1):
    _KIND_OF[list(_chars.encode())] = _k
_KIND_OF[128:] = len(_KINDS) + 1
N_KINDS = len(_KINDS) + 2
N_SHAPES = N_KINDS + 6
TEXT_FEATURES = WORD_FEATURES + N_SHAPES * SHAPE_BINS + 1


def _bins(x: np.ndarray) -> np.ndarray:
    """Shares from 0 to 1 to bins that are finer near 0."""
    return np.minimum((np.sqrt(np.clip(x, 0, 1)) * SHAPE_BINS).astype(np.int64), SHAPE_BINS - 1)


def _logs(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(x, 0) + 1).astype(np.int64), SHAPE_BINS - 1)


def text_features(batch: pa.RecordBatch, i: int, chosen: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The sorted feature numbers of each text of a column; with `chosen`, renumbered by it, without those it has as 0."""
    data, off = columns(batch, i)
    for a, z in pieces(data, off, TEXT_BYTES):
        part, at = data[off[a] : off[z]], off[a : z + 1] - off[a]
        size = np.diff(at)
        h, w = word_hashes(part, at)
        n = np.diff(w)
        of = np.repeat(np.arange(z - a) * N_KINDS, size)
        shares = np.bincount(of + _KIND_OF[part], minlength=(z - a) * N_KINDS).reshape(-1, N_KINDS) / np.maximum(size, 1)[:, None]
        breaks = np.flatnonzero(part == 10)
        hashed = np.stack([(mix(x, 11 + k) % np.uint64(WORD_FEATURES)).astype(np.int64) for k, x in enumerate([h, *[word_hashes(part, at, b)[0] for b in PREFIXES]])])
        if chosen is not None:
            hashed = chosen[hashed]
        for k in range(z - a):
            words = h[w[k] : w[k + 1]]
            distinct = len(np.unique(words)) / max(len(words), 1)
            line = breaks[np.searchsorted(breaks, at[k]) : np.searchsorted(breaks, at[k + 1])]
            lines = part[at[k] : at[k + 1]].tobytes().split(b"\n") if len(line) else [b""]
            extra = [distinct, len(set(lines)) / len(lines)]
            numbers = [size[k] / max(n[k], 1), n[k], len(lines), size[k] / len(lines)]
            shape = np.concatenate([_bins(np.append(shares[k], extra)), _logs(np.array(numbers, dtype=np.float64))])
            own = WORD_FEATURES + np.arange(N_SHAPES) * SHAPE_BINS + shape
            own = np.append(own, TEXT_FEATURES - 1)
            got = hashed[:, w[k] : w[k + 1]].ravel()
            if chosen is not None:
                own, got = chosen[own], got[got > 0]
            yield np.concatenate([np.unique(got), own])


def choose_features(rows: list[np.ndarray], y: np.ndarray, least: int = LEAST_ROWS, most: int = MOST_FEATURES, z_score: float = Z_SCORE) -> np.ndarray:
    """New numbers, from 1 on, for chosen hashed features, and for all shapes; 0 for others.

    Chosen are those that at least `least` rows have and whose shares among good and bad rows differ by z_score standard
    errors (the `most` commonest of them).
    """
    df = [np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == k] or [np.zeros(0, np.int64)]), minlength=TEXT_FEATURES)[:WORD_FEATURES] for k in (0, 1)]
    n = [max(int((y == k).sum()), 1) for k in (0, 1)]
    both = (df[0] + df[1]) / sum(n)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n[0] + 1 / n[1]))
    keep = np.flatnonzero((df[0] + df[1] >= least) & (np.abs(df[1] / n[1] - df[0] / n[0]) >= z_score * error))
    keep = np.sort(keep[np.argsort(-both[keep], kind="stable")[:most]])
    out = np.zeros(TEXT_FEATURES, np.int32)
    out[keep] = 1 + np.arange(len(keep))
    out[WORD_FEATURES:] = 1 + len(keep) + np.arange(TEXT_FEATURES - WORD_FEATURES)
    return out


def meta_features(row: tuple, names: tuple[str, ...]) -> np.ndarray:
    """Feature numbers of the metadata of a row: each value, numbers by their magnitude, and each pair of values."""
    got = [f"{c}={int(np.log2(abs(v) + 1) * 2) if isinstance(v, (int, float)) and v == v and abs(v) < 1e300 else v}" for c, v in zip(names, row, strict=True)]
    got += [f"{x}&{y}" for i, x in enumerate(got) for y in got[i + 1 :]]
    return np.unique(np.array([zlib.crc32(g.encode("utf-8", "replace")) % (META_FEATURES - 1) for g in got] + [META_FEATURES - 1], dtype=np.uint16))


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, size: int, *, l2: float = 1e-3, steps: int = 150, rate: float = 0.1) -> np.ndarray:
    """Weights of a logistic model over binary features, by full-batch Adam."""
    lens = np.array([len(r) for r in rows])
    idx = np.concatenate(rows).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[idx], starts), -30, 30)))
        g = np.bincount(idx, weights=np.repeat((p - y) / len(y), lens), minlength=size) + l2 * w / np.sqrt(len(y))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def logits(rows: list[np.ndarray], w: np.ndarray) -> np.ndarray:
    return np.array([w[r].sum() for r in rows])


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic model over few columns and a constant, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w)
    return w


@dataclass
class CoTrained:
    """Weights of both views, their calibrations and the model that combines them."""

    chosen: np.ndarray
    text: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16))
    meta: np.ndarray = field(default_factory=lambda: np.zeros(META_FEATURES))
    text_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    meta_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    combine: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))
    constant: float | None = None

    def views(self, text: list[np.ndarray], meta: list[np.ndarray]) -> np.ndarray:
        """Calibrated log-odds of both views."""
        return np.column_stack([logits(text, self.text) * self.text_scale[0] + self.text_scale[1], logits(meta, self.meta) * self.meta_scale[0] + self.meta_scale[1]])

    def scores(self, text: list[np.ndarray], meta: list[np.ndarray]) -> np.ndarray:
        """Columns: text view, metadata view and combined probability of a good document."""
        x = self.views(text, meta)
        z = np.column_stack([x, x @ self.combine[:2] + self.combine[2]])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if self.constant is not None:
            p[:] = self.constant
        return p


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches by SLICE_ROWS, so that the arrays made for them stay small, however large batches are."""
    return (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS))


def _sets(b: pa.RecordBatch, i: int) -> list[np.ndarray]:
    return [np.frombuffer(v, dtype=np.uint16) for v in b.column(i).to_pylist()]


def featurise(docs: DataFrame, id_col: str, text_col: str, meta_cols: tuple[str, ...], chosen: np.ndarray | None = None) -> DataFrame:
    """id and both feature sets of each row, as packed numbers: of 16 bits, or 32 for texts if no features are chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            text = [f.astype(np.uint32 if chosen is None else np.uint16).tobytes() for f in text_features(b, 1, chosen)]
            meta = [m.tobytes() for m in _metas(b, range(2, 2 + len(meta_cols)), meta_cols)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], ["id", "tf", "mf"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("tf", T.BinaryType()), T.StructField("mf", T.BinaryType())])
    return docs.select(id_col, text_col, *meta_cols).mapInArrow(run, schema)


def _metas(b: pa.RecordBatch, at, names: tuple[str, ...]) -> list[np.ndarray]:
    return [meta_features(r, names) for r in zip(*[b.column(k).to_pylist() for k in at], strict=True)] if names else [meta_features((), ())] * b.num_rows


def _taught(features: DataFrame, model: CoTrained, view: str, sure: float, most: int) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Of all documents, those that a view is sure about: at most `most` of either class, chosen by a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            p = model.scores(_sets(b, 1), _sets(b, 2))[:, 0 if view == "text" else 1]
            at = pa.array(np.flatnonzero((p >= sure) | (p <= 1 - sure)))
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns], pa.array((p >= 0.5).astype(np.int32)).take(at)], ["id", "tf", "mf", "y"])

    schema = T.StructType([*features.schema.fields, T.StructField("y", T.IntegerType())])
    sure_rows = features.mapInArrow(run, schema).withColumn("h", F.xxhash64("id", "tf"))
    got = [r for k in (0, 1) for r in sure_rows.where(F.col("y") == k).orderBy("h").limit(most).select("tf", "mf", "y").toArrow().to_pylist()]
    return [r["tf"] for r in got], [r["mf"] for r in got], np.array([r["y"] for r in got], dtype=np.float64)


def sample_labels(labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled ids, chosen by a hash, with the fold that calibrates as 0; of several labels the lowest holds."""
    known = labels.where("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"))
    return known.orderBy(F.xxhash64("id"), "id").limit(most).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(5)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = META, *, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED, max_pseudo: int = MAX_PSEUDO, sure: float = CONFIDENT) -> tuple[CoTrained, DataFrame]:
    """The model, from labels (id, good: 0 or 1, null is none), and the features of all documents that it scores.

    max_labelled rows at most are used of the labels; a fifth of them calibrates. Each round adds at most max_pseudo
    pseudo-labels of either class to either view, of all documents without a label in the sample. Without labels of
    both classes the model answers the share of good ones, or 1 if there are none.
    """
    sample = shared_table(sample_labels(labels, max_labelled), "labels")
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"m{k}") for k, c in enumerate(meta_cols)])
    names = tuple(f"m{k}" for k in range(len(meta_cols)))
    mine = named.join(F.broadcast(sample.select("id")), "id", "left_semi")
    rows = featurise(mine, "id", "text", names).join(F.broadcast(sample), "id").dropDuplicates(["id"]).toArrow().to_pylist()
    rows.sort(key=lambda r: str(r["id"]))
    wide = [np.frombuffer(r["tf"], dtype=np.uint32) for r in rows]
    meta = [np.frombuffer(r["mf"], dtype=np.uint16) for r in rows]
    y, held = np.array([r["good"] for r in rows], dtype=np.float64), np.array([r["fold"] == 0 for r in rows], dtype=bool)
    model = CoTrained(choose_features([w for w, h in zip(wide, held, strict=True) if not h], y[~held]))
    features = shared_table(featurise(named, "id", "text", names, model.chosen), "features")
    if len(set(y.tolist())) < 2:
        model.constant = float(y.mean()) if len(y) else 1.0
        return model, features
    text = [model.chosen[w][model.chosen[w] > 0] for w in wide]
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(rows), bool)
    fit, check = np.flatnonzero(~held), np.flatnonzero(held if held.any() else ~held)
    pick = lambda xs, at: [xs[i] for i in at]
    unlabelled = features.join(F.broadcast(sample.select("id")), "id", "left_anti")
    extra_text, extra_meta = ([], np.zeros(0)), ([], np.zeros(0))
    for k in range(rounds + 1):
        model.text = fit_logistic(pick(text, fit) + extra_text[0], np.concatenate([y[fit], extra_text[1]]), 1 << 16)
        model.meta = fit_logistic(pick(meta, fit) + extra_meta[0], np.concatenate([y[fit], extra_meta[1]]), META_FEATURES)
        model.text_scale = fit_dense(logits(pick(text, check), model.text)[:, None], y[check])
        model.meta_scale = fit_dense(logits(pick(meta, check), model.meta)[:, None], y[check])
        if k == rounds:
            break
        tf, _, ty = _taught(unlabelled, model, "meta", sure, max_pseudo)
        extra_text = ([np.frombuffer(x, dtype=np.uint16) for x in tf], ty)
        _, mf, my = _taught(unlabelled, model, "text", sure, max_pseudo)
        extra_meta = ([np.frombuffer(x, dtype=np.uint16) for x in mf], my)
    model.combine = fit_dense(model.views(pick(text, check), pick(meta, check)), y[check])
    return model, features


def good_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A document is good when it is labelled as of good quality and not as toxic; null labels say nothing."""
    return labels.select(F.col(id_col).alias("id"), F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when((F.col("quality") == 0) | (F.col("toxic") == 1), 0).alias("good"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = META, **kw) -> DataFrame:
    """One row per input row: id, text_score, meta_score and score, the probability of a good document.

    labels has id and good. Null and empty texts have the features of a text of no length; null metadata is a value of
    its own; repeated rows get equal scores; an empty table gives none.
    """
    model, features = train(docs, labels, id_col, text_col, meta_cols, **kw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            p = model.scores(_sets(b, 1), _sets(b, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, k]) for k in range(3)]], ["id", "text_score", "meta_score", "score"])

    schema = T.StructType([features.schema["id"], *[T.StructField(c, T.DoubleType()) for c in ("text_score", "meta_score", "score")]])
    return features.mapInArrow(run, schema)


def accept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = META, *, least: float = 0.5, **kw) -> DataFrame:
    """The rows of docs that score at least `least`, in one pass over docs without a shuffle of texts."""
    model, _ = train(docs, labels, id_col, text_col, meta_cols, **kw)
    text_at, meta_at = docs.columns.index(text_col), [docs.columns.index(c) for c in meta_cols]
    names = tuple(f"m{k}" for k in range(len(meta_cols)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            p = model.scores(list(text_features(b, text_at, model.chosen)), _metas(b, meta_at, names))[:, 2]
            yield b.filter(pa.array(p >= least))

    return docs.mapInArrow(run, docs.schema)
