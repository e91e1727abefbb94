"""Language-model scores by prediction by partial matching (PPM) over bytes, with escape method C and symbol exclusion.

Training counts every byte after its three bytes of context, over all training documents. A context of k bytes
predicts the symbols seen after it; the escape, as likely as the number of distinct symbols, leads to the context one
byte shorter, where symbols that were on offer before are excluded; at last all symbols left are equally likely. The
trie of contexts is turned into one row of 256 log-probabilities for each context, so scoring a text is a lookup per
byte. A text is preceded by, and ends with, the byte 0xFF, which UTF-8 never has; its end counts as a symbol.

The trie has all contexts of up to three bytes. Those of up to two bytes (65,793 at most) and the max_contexts most
frequent ones of three are broadcast as rows, so the broadcast model has a fixed bound; with them goes one bit for each
of the 2^24 contexts of three bytes that tells which others training has seen. The symbols of a document after such
contexts are counted, and meet the rows of their contexts in a join. Words are treated alike: the counts of the
broadcast_words most frequent ones are broadcast; all other words meet their count in the same join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktote.llm.common import shared_table
from ticktote.llm.textops import columns, pieces, word_hashes

END = 0xFF
MAX_CONTEXTS = 65_536
BROADCAST_WORDS = 200_000
FOLDS = 10


def is_held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether the CRC-32 of the id as text is divisible by folds. A null id counts as the text "null"."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds == 0


def _framed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with three END bytes before each row and one after the last row; places where rows begin."""
    n = len(off) - 1
    out = np.full(len(data) + 3 * n + 1, END, dtype=np.uint8)
    begin = off[:-1] + 3 * np.arange(n)
    out[np.arange(len(data)) + np.repeat(3 * np.arange(1, n + 1), np.diff(off))] = data
    return out, begin


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three bytes of context and a symbol, as 32-bit codes, for each byte and end of rows; where rows begin among them."""
    x, begin = _framed(data, off)
    x = x.astype(np.uint32)
    g = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
    keep = np.ones(len(g), bool)  # the paddings of a row after its first one predict nothing
    for k in (1, 2):
        at = begin[1:] - 3 + k + 0
        keep[at[at >= 0]] = False
    starts = off[:-1] + np.arange(len(off) - 1)
    return g[keep], starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (kind, key, n): kind 0 for grams, 1 for words, 2 for ends of documents."""
    for b in batches:
        data, off = columns(b, 0)
        grams, words, held = [], [], 0

        def rows(grams=grams, words=words) -> Iterator[pa.RecordBatch]:
            for kind, got in ((0, grams), (1, words)):
                if got:
                    key, n = (np.concatenate([g[i] for g in got]) for i in (0, 1))
                    key, at = np.unique(key, return_inverse=True)
                    n = np.bincount(at, weights=n).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.uint64).view(np.int64)), pa.array(n)], ["kind", "key", "n"])
                got.clear()

        for a, z in pieces(data, off):
            part, at = data[off[a] : off[z]], off[a : z + 1] - off[a]
            grams.append(np.unique(_grams(part, at)[0], return_counts=True))
            words.append(np.unique(word_hashes(part, at)[0], return_counts=True))
            held += len(words[-1][0])
            if held > 1_500_000:
                yield from rows()
                held = 0
        yield from rows()
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([b.num_rows], pa.int64())], ["kind", "key", "n"])


def _predict(levels: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of the 256 symbols for rows of contexts; levels has each row's counts, longest context first."""
    m = len(levels[0])
    p, escape, excluded = np.zeros((m, 256)), np.ones(m), np.zeros((m, 256), bool)
    for counts in levels:
        c = np.where(excluded, 0, counts)
        n, kinds = c.sum(1), (c > 0).sum(1)
        total = np.maximum(n + kinds, 1)
        p += np.where(c > 0, escape[:, None] * c / total[:, None], 0)
        full = (kinds + excluded.sum(1)) == 256  # nothing is left to escape to
        p *= np.where(full & (kinds > 0), ((n + kinds) / np.maximum(n, 1)), 1)[:, None] ** (c > 0)
        escape *= np.where(kinds > 0, np.where(full, 0, kinds / total), 1)
        excluded |= c > 0
    left = 256 - excluded.sum(1)
    p += np.where(excluded, 0, (escape / np.maximum(left, 1))[:, None])
    return np.log10(p)


class Shorter:
    """Counts of the symbols after contexts of up to two bytes, from (codes of two bytes and a symbol, counts)."""

    def __init__(self, pairs: tuple[np.ndarray, np.ndarray]):
        order = np.argsort(pairs[0])
        self.code, self.n = pairs[0][order].astype(np.int64), pairs[1][order]
        self.one = np.zeros((256, 256), np.int64)
        np.add.at(self.one.reshape(-1), self.code & 0xFFFF, self.n)
        self.zero = self.one.sum(0)

    def levels(self, ctx: np.ndarray) -> list[np.ndarray]:
        """Counts after the last two, one and no bytes of ctx."""
        begin = (ctx & 0xFFFF) << 8
        a, z = np.searchsorted(self.code, begin), np.searchsorted(self.code, begin + 256)
        n, row = z - a, np.repeat(np.arange(len(ctx)), z - a)
        at = np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)
        two = np.zeros((len(ctx), 256), np.int64)
        two[row, self.code[at] & 255] = self.n[at]
        return [two, self.one[ctx & 255], np.broadcast_to(self.zero, (len(ctx), 256))]


class Model:
    """Rows of log10 probabilities by context: all contexts of up to two bytes, and the most frequent ones of three."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], others: np.ndarray | None = None):
        """grams: codes of the kept three-byte contexts with their symbols and counts; pairs: those of two-byte contexts; others: three-byte contexts that were seen but have no row here."""
        shorter = Shorter(pairs)
        seen2, seen1 = np.unique(shorter.code >> 8), np.flatnonzero(shorter.one.any(1))
        ctx3 = np.unique(grams >> np.uint64(8)).astype(np.int64)
        row3 = np.searchsorted(ctx3, (grams >> np.uint64(8)).astype(np.int64))
        tables = [_predict([shorter.zero[None]]), _predict(shorter.levels(seen1)[1:])]
        for part in np.array_split(seen2, max(1, len(seen2) // 4096)):
            tables.append(_predict(shorter.levels(part)))
        for lo in range(0, len(ctx3), 4096):
            part = ctx3[lo : lo + 4096]
            own = np.zeros((len(part), 256), np.int64)
            mine = (row3 >= lo) & (row3 < lo + len(part))
            own[row3[mine] - lo, (grams[mine] & np.uint64(255)).astype(np.int64)] = counts[mine]
            tables.append(_predict([own, *shorter.levels(part)]))
        self.table = np.concatenate(tables).astype(np.float32)
        self.ctx1, self.ctx2, self.ctx3 = seen1, seen2, ctx3
        seen = np.zeros(1 << 24, bool)
        if others is not None:
            seen[others] = True
        self.others = np.packbits(seen)
        self.index = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "index": None}

    def rows(self) -> np.ndarray:
        """The row of each of the 2^24 contexts of three bytes; -1 for those that were seen but have no row here."""
        if self.index is None:
            one = np.zeros(256, np.int32)
            one[self.ctx1] = 1 + np.arange(len(self.ctx1))
            two = np.tile(one, 256)
            two[self.ctx2] = 1 + len(self.ctx1) + np.arange(len(self.ctx2))
            index = np.tile(two, 256)
            index[np.unpackbits(self.others).view(bool)] = -1
            index[self.ctx3] = 1 + len(self.ctx1) + len(self.ctx2) + np.arange(len(self.ctx3))
            self.index = index
        return self.index

    def log10(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probabilities of grams, 0 where the context has no row here; whether it has none."""
        row = self.rows()[grams >> 8]
        return np.where(row < 0, np.float32(0), self.table[row, grams & 255]), row < 0


def train_model(counts: DataFrame, max_contexts: int = MAX_CONTEXTS) -> tuple[Model, DataFrame]:
    """The model of a table of gram counts (key, n), and rows (key, row) of the three-byte contexts that it has no row of.

    Only counts of the bounded part of the trie, and the codes of the other contexts, reach the driver.
    """
    sc, counts = counts.sparkSession.sparkContext, counts.withColumn("ctx", F.shiftright("key", 8))
    top = counts.groupBy("ctx").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "ctx").limit(max_contexts).select("ctx")
    kept = counts.join(F.broadcast(top), "ctx").select("key", "n").toPandas()
    pairs = counts.groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("n").alias("n")).toPandas()
    pairs = pairs["key"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64)
    shorter = sc.broadcast(pairs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = Shorter(shorter.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                ctx, seen = part.column(0).to_numpy(), part.column(1).flatten()
                own = np.zeros((len(ctx), 256), np.int64)
                own[np.repeat(np.arange(len(ctx)), part.column(1).value_lengths().to_numpy()), seen.field("key").to_numpy() & 255] = seen.field("n").to_numpy()
                row = _predict([own, *lower.levels(ctx)]).astype(np.float32)
                ends = np.arange(0, row.size + 1, 256, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(row.reshape(-1)))], ["key", "row"])

    rest = counts.join(F.broadcast(top), "ctx", "left_anti").groupBy("ctx").agg(F.collect_list(F.struct("key", "n")).alias("seen"))
    rest = shared_table(rest.mapInArrow(predict, "key long, row array<float>"), "contexts")
    others = rest.select(F.col("key").cast("int").alias("key")).toPandas()["key"].to_numpy(np.int64)
    return Model(kept["key"].to_numpy(np.int64).astype(np.uint64), kept["n"].to_numpy(np.int64), pairs, others), rest


def _uses(of: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of document and value, and how often each occurs."""
    order = np.lexsort((what, of))
    what, of = what[order], of[order]
    new = np.flatnonzero(np.append(True, (what[1:] != what[:-1]) | (of[1:] != of[:-1])))
    return of[new], what[new], np.diff(np.append(new, len(what)))


def _score(model, words, end_count: int):
    """Rows of documents (kind 0), with the sums over frequent words and contexts, and rows (row_key, key, uses) of the other words (1) and, with a symbol, contexts (2)."""
    names = ["row_key", "id", "score", "n_tokens", "base", "known", "kind", "key", "symbol", "uses"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, value = words.value
        for b in batches:
            data, off = columns(b, 2)
            keys = b.column(0).to_numpy()

            def rest(kind, keys, key, symbol, uses, id_type=b.column(1).type) -> pa.RecordBatch:
                m = len(keys)
                gone = [pa.nulls(m, t) for t in (id_type, pa.float64(), pa.int64(), pa.float64(), pa.int64())]
                return pa.RecordBatch.from_arrays([pa.array(keys), *gone, pa.array(np.full(m, kind, np.int32)), pa.array(key), symbol, pa.array(uses)], names)

            for a, z in pieces(data, off):
                part, at = data[off[a] : off[z]], off[a : z + 1] - off[a]
                grams, starts = _grams(part, at)
                got, other = model.value.log10(grams)
                sums = np.add.reduceat(got.astype(np.float64), starts)
                h, w = word_hashes(part, at)
                n = np.diff(w)
                place = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
                found = hot[place] == h if len(hot) else np.zeros(len(h), bool)
                of = np.repeat(np.arange(z - a), n)
                base = np.bincount(of[found], weights=value[place[found]], minlength=z - a) + np.log10(end_count + 0.1)
                known = np.bincount(of[found], minlength=z - a) + (end_count > 0)
                m = z - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:z]), b.column(1).slice(a, m), pa.array(sums), pa.array(n + 1), pa.array(base), pa.array(known.astype(np.int64)), pa.array(np.zeros(m, np.int32)), *(pa.nulls(m, t) for t in (pa.int64(), pa.int32(), pa.int64()))], names)
                if not found.all():
                    row, what, uses = _uses(of[~found], h[~found])
                    yield rest(1, keys[a:z][row], what.view(np.int64), pa.nulls(len(row), pa.int32()), uses)
                if other.any():
                    row, what, uses = _uses(np.searchsorted(starts, np.flatnonzero(other), side="right") - 1, grams[other])
                    yield rest(2, keys[a:z][row], (what >> 8).astype(np.int64), pa.array((what & 255).astype(np.int32)), uses)

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, folds: int = FOLDS, max_contexts: int = MAX_CONTEXTS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the PPM probability).

    Null and empty texts are the end alone. Repeated rows are scored once each, and each is learnt from. Without any
    training document all symbols are equally likely, and the base knows nothing: its score is 0 for want of a
    vocabulary other than the unknown.
    """
    sc, kind = docs.sparkSession.sparkContext, docs.schema[id_col].dataType
    training = docs.where(~is_held_out(F.col(id_col), folds)).select(F.col(text_col))
    counted = shared_table(training.mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "ngram-counts")
    model, contexts = train_model(counted.where("kind = 0").select("key", "n"), max_contexts)
    model = sc.broadcast(model)
    vocabulary = counted.where("kind = 1")
    whole = counted.where("kind > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.lit(0)).alias("ends"), F.count("*").alias("v")).first()
    total, ends, distinct = whole["n"], whole["ends"], whole["v"]
    top = vocabulary.orderBy(F.desc("n"), "key").limit(broadcast_words).select("key", "n").toPandas()
    key = top["key"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(key)
    words = sc.broadcast((key[at], np.log10(top["n"].to_numpy(np.float64)[at] + 0.1)))
    fields = [
        ("row_key", T.LongType()), ("id", kind), ("score", T.DoubleType()), ("n_tokens", T.LongType()), ("base", T.DoubleType()), ("known", T.LongType()),
        ("kind", T.IntegerType()), ("key", T.LongType()), ("symbol", T.IntegerType()), ("uses", T.LongType())]
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col), F.col(text_col)).mapInArrow(
        _score(model, words, ends), T.StructType([T.StructField(n, t) for n, t in fields]))
    # rows of documents get keys of their own, so that they are dealt out evenly by the join for the other words and contexts
    rows = rows.withColumn("key", F.coalesce("key", F.xxhash64("row_key")))
    seen = vocabulary.select("kind", "key", F.col("n").alias("c"), F.lit(None).cast("array<float>").alias("row"))
    seen = seen.unionByName(contexts.select(F.lit(2).alias("kind"), "key", F.lit(None).cast("long").alias("c"), "row"))
    met = rows.join(seen, ["kind", "key"], "left")
    c = F.coalesce("c", F.lit(0))
    own, word = F.col("kind") == 0, F.col("kind") == 1
    got = met.groupBy("row_key").agg(
        F.max(F.when(own, F.struct("id", "score", "n_tokens"))).alias("d"),
        F.sum(F.when(F.col("kind") == 2, F.col("uses") * F.get("row", F.col("symbol")).cast("double"))).alias("other"),
        F.sum(F.when(word, F.col("uses") * F.log10(c + 0.1)).when(own, F.col("base"))).alias("base"),
        F.sum(F.when(word, F.when(c > 0, F.col("uses")).otherwise(0)).when(own, F.col("known"))).alias("n_known"))
    spread = float(np.log10(total + 0.1 * (distinct + 1)))
    return got.select(
        F.col("d.id").alias("id"), is_held_out(F.col("d.id"), folds).alias("held_out"), F.col("d.n_tokens").alias("n_tokens"), "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("d.n_tokens") * F.lit(spread)).alias("base_score"), (F.col("d.score") + F.coalesce("other", F.lit(0.0))).alias("score"))
