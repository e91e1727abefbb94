"""Jaccard join of documents on word shingles, by prefix filters under several token orders.

Under any order of all tokens, two sets of a Jaccard similarity of t or more share a token among the first
n - ceil(t n) + 1 of each. Several orders are used: all put tokens that very many documents have last (they differ in
how the rest is shuffled), and a pair is verified only if it passes under each of them.

Equal sets are one node. The first order's prefixes are dealt out by token. In each bucket every member is paired
with one leader, the member with the largest share of frequent tokens, so that a bucket of near copies costs one pair
each. Links form components; what is left to compare are members of a bucket in different components. Pairs in buckets
of a frequent token have all their other tokens in their prefixes as well, so a pair with none of those in common can
overlap in frequent tokens only; that bound drops many of them before a pair is made.

Texts move last. A pair must first pass the bitmap filter: each set has a bitmap in which a token flips one bit, and
two sets differ by at least as many tokens as their bitmaps have unequal bits. The bitmap folded to 512 bits is part of
the join's condition, so pairs that it rules out are never made; the whole one is compared after the join. Then the prefixes under all other orders
are intersected, and what is left is verified on the sets themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktote.llm.common import shared_table
from ticktote.llm.components import components
from ticktote.llm.textops import mix, shingle_sets

FREQUENT_TOKENS = 200_000
FREQUENT_SHARE = 0.0008
ORDERS = 3
PERCENT = 80
SALTS = 16
BROADCAST_IDS = 1_000_000
BITMAP_BYTES = 256
FOLDS = tuple(f"s{k}" for k in range(8))


def _node(tokens: np.ndarray, seed: int) -> tuple[int, bytes]:
    """A 64-bit key of a set and a 16-byte digest that tells whether keys stand for one set."""
    raw = tokens.tobytes()
    d = hashlib.blake2b(raw, digest_size=16, key=b"%d" % seed).digest()
    return int.from_bytes(d[:8], "little", signed=True), d[8:]


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens of each bit; the bitmap doubles until it has two bits for each token."""
    size = 8 * BITMAP_BYTES
    while size < 2 * len(tokens):
        size *= 2
    bits = np.bincount((mix(tokens, 7) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _unequal(x: bytes, y: bytes) -> int:
    """Unequal bits of two bitmaps, the longer one folded to the length of the other."""
    u, v = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    n = min(len(u), len(v))
    u, v = (np.bitwise_xor.reduce(w.reshape(-1, n), axis=0) for w in (u, v))
    return int(np.bitwise_count(u ^ v).sum())


def _folded(bitmap: bytes) -> np.ndarray:
    """The bitmap folded to as many 64-bit words as FOLDS; bits that meet cancel, so unequal bits still bound the difference."""
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, dtype=np.int64).reshape(-1, len(FOLDS)), axis=0)


def _similar_bitmaps(percent: int):
    """Of rows (a, b, n_a, n_b, bits_a, bits_b): the pairs whose bitmaps leave room for a similarity of percent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_numpy(), b.column(3).to_numpy()
            n = x + y
            unequal = np.fromiter(map(_unequal, b.column(4).to_pylist(), b.column(5).to_pylist()), dtype=np.int64, count=b.num_rows)
            overlap = np.minimum((n - unequal) // 2, np.minimum(x, y))
            keep = np.flatnonzero(100 * overlap >= percent * (n - overlap))
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    return run


def _profile(seed: int):
    """Rows of documents (n, node, digest, bits) and of tokens that many documents of a batch have."""
    names = ["id", "n", "node", "digest", "bits", *FOLDS, "token", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, digest, bits, sets, size = [], [], [], [], [], 0
            frequent: dict[int, int] = {}

            def count(sets=sets, frequent=frequent) -> None:
                if sets:
                    tokens, c = np.unique(np.concatenate(sets), return_counts=True)
                    keep = c >= max(4, FREQUENT_SHARE * len(sets))
                    for t, k in zip(tokens[keep].view(np.int64).tolist(), c[keep].tolist(), strict=True):
                        frequent[t] = frequent.get(t, 0) + k
                    sets.clear()

            for _, tokens in shingle_sets(b, 1):
                n.append(len(tokens))
                k, d = _node(tokens, seed)
                node.append(k if len(tokens) else None)
                digest.append(d if len(tokens) else None)
                bits.append(_bitmap(tokens) if len(tokens) else None)
                sets.append(tokens)
                size += len(tokens)
                if size > 4_000_000:
                    count()
                    size = 0
            count()
            rows, m = len(n), len(frequent)
            folds = np.array([_folded(x) if x else np.zeros(len(FOLDS), np.int64) for x in bits]).reshape(-1, len(FOLDS))
            none = pa.nulls(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.binary()), *[pa.array(folds[:, k]) for k in range(len(FOLDS))], none, none], names)
            if m:
                empty = [pa.nulls(m, t) for t in (b.column(0).type, pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * len(FOLDS))]
                yield pa.RecordBatch.from_arrays([*empty, pa.array(list(frequent), pa.int64()), pa.array(list(frequent.values()), pa.int64())], names)

    return run


class TokenOrders:
    """Global orders of tokens: frequent ones last, by their count; all others by a hash that differs from order to order."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        at = np.argsort(tokens)
        self.tokens, self.counts = tokens[at], counts[at]

    def frequent(self, tokens: np.ndarray) -> np.ndarray:
        """Counts of tokens among the frequent ones, else 0."""
        if not len(self.tokens):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.counts[at], 0)

    def prefix(self, tokens: np.ndarray, freq: np.ndarray, order: int, percent: int) -> np.ndarray:
        """Places of the tokens of the prefix."""
        p = len(tokens) - (percent * len(tokens) + 99) // 100 + 1
        rare = np.flatnonzero(freq == 0)
        h = mix(tokens, 100 + order)
        if len(rare) >= p:
            return rare[np.argpartition(h[rare], p - 1)[:p]]
        often = np.flatnonzero(freq)
        rest = often[np.lexsort((h[often], freq[often] if order % 2 == 0 else freq[often].max() - freq[often]))] if order else often[np.lexsort((h[often], freq[often]))]
        return np.concatenate([rare, rest[: p - len(rare)]])


def _postings(orders, percent: int):
    """Rows (token, salt, node, rare) of the prefixes under the first order, each node once for a task. rare: a set's tokens that are not frequent."""
    names = ["token", "salt", "node", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            nodes, out, size = b.column(0).to_pylist(), [], 0

            def batch(out=out) -> pa.RecordBatch:
                t, s, k, r = (np.concatenate([x[i] for x in out]) for i in range(4))
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(s), pa.array(k), pa.array(r)], names)

            for i, tokens in shingle_sets(b, 1):
                node = nodes[i]
                if node in seen or not len(tokens):
                    continue
                seen.add(node)
                freq = orders.value.frequent(tokens)
                at = orders.value.prefix(tokens, freq, 0, percent)
                m = len(at)
                salt = np.where(freq[at] > 0, node % SALTS, -1).astype(np.int32)
                out.append((tokens[at], salt, np.full(m, node, np.int64), np.full(m, np.count_nonzero(freq == 0), np.int32)))
                size += m
                if size > 200_000:
                    yield batch()
                    size = 0
            if out:
                yield batch()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by token, salt and rank: those of buckets with several members, or of a salted token, with the bucket's leader.

    Rows of one node in one bucket, which several tasks may have sent, are one. Further columns are passed on.
    """
    held, last = None, None
    for b in batches:
        token, salt, node, *more = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        new[0] = last != (token[0], node[0])
        last = (token[-1], node[-1])
        token, salt, node, *more = (x[new] for x in (token, salt, node, *more))
        if not len(token):
            continue
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        if held is not None and held["key"] == (token[0], salt[0]):
            first[0] = False
        run = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        lead = node[starts][np.maximum(run, 0)] if len(starts) else np.zeros(len(token), np.int64)
        keep = (salt >= 0) | ~first
        if held is not None and not first[0]:
            lead = np.where(run < 0, held["lead"], lead)
        lone = np.append(first[1:], False)  # the last row's bucket may go on in the next batch
        keep |= first & ~lone
        keep[-1] = (salt[-1] >= 0) or not first[-1]
        out = [x[keep] for x in (token, salt, node, *more, lead)]
        if held is not None and not first[0] and held["row"] is not None:
            out = [np.concatenate([[r], o]).astype(o.dtype) for r, o in zip(held["row"], out, strict=True)]
        row = None if keep[-1] else tuple(x[-1] for x in (token, salt, node, *more, lead))
        held = {"key": (token[-1], salt[-1]), "lead": lead[-1], "row": row}
        yield pa.RecordBatch.from_arrays([pa.array(o) for o in out], [*b.schema.names, "lead"])


def _verify(orders, percent: int, count_orders: int):
    """Of rows (a, text_a, b, text_b): the pairs that pass every order's prefix filter and then the similarity itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(0).to_pylist(), b.column(2).to_pylist()
            ok = []
            for (i, x), (_, y) in zip(shingle_sets(b, 1), shingle_sets(b, 3), strict=True):
                fx, fy = orders.value.frequent(x), orders.value.frequent(y)
                if all(len(np.intersect1d(x[orders.value.prefix(x, fx, k, percent)], y[orders.value.prefix(y, fy, k, percent)], assume_unique=True)) for k in range(1, count_orders)):
                    o = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * o >= percent * (len(x) + len(y) - o):
                        ok.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([left[i] for i in ok], pa.int64()), pa.array([right[i] for i in ok], pa.int64())], ["a", "b"])

    return run


def _marked(rest: DataFrame) -> DataFrame:
    """rest with least and most: of each node, the outermost of its tokens that are frequent, or that are not, as the row's token."""
    kind = Window.partitionBy("node", F.col("salt") < 0)
    return rest.withColumns({"least": F.min("token").over(kind), "most": F.max("token").over(kind)})


def _candidates(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a bucket in different components that sizes, frequent tokens and folded bitmaps leave room for.

    Nodes that share many tokens would meet in as many buckets. All conditions but the token's are those of the pair and
    of the kind of token (frequent or not), so two nodes with the same least token of a kind meet there only, and else
    those with the same largest one there.
    """
    x, y = (rest.select(*[F.col(c).alias(f"{c}_{k}") for c in rest.columns]) for k in "xy")
    both = F.least(F.col("often_x"), F.col("often_y"))
    fits = (F.col("salt_x") < 0) | (100 * both >= percent * (F.col("n_x") + F.col("n_y") - both))
    close = 100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")
    unequal = sum((F.bit_count(F.col(f"{c}_x").bitwiseXOR(F.col(f"{c}_y"))) for c in FOLDS), F.lit(0))
    alike = unequal * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent)
    once = F.when(F.col("least_x") == F.col("least_y"), F.col("token_x") == F.col("least_x")).when(F.col("most_x") == F.col("most_y"), F.col("token_x") == F.col("most_x")).otherwise(True)
    return x.join(y, (F.col("token_x") == F.col("token_y")) & (F.col("node_x") < F.col("node_y")) & (F.col("root_x") != F.col("root_y")) & close & once & fits & alike)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = PERCENT, orders: int = ORDERS, frequent_tokens: int = FREQUENT_TOKENS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Documents link when 100 * intersection >= percent * union of their sets of five-word shingles (words after
    lower-casing A-Z, broken at ASCII white space; fewer words are one shingle). A component is named after its
    smallest id. Null and empty texts have an empty set and link with nothing; repeated rows have equal sets and
    link. Rows with a null id keep a row; a set that only they have links with nothing and its component is null.

    What is broadcast: the most frequent tokens, frequent_tokens at most, and the ids of documents whose texts are to
    be verified, if there are at most broadcast_ids of them (beyond that they are joined by shuffle).
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(c, t) for c, t in (("n", T.LongType()), ("node", T.LongType()), ("digest", T.BinaryType()), ("bits", T.BinaryType()), *[(c, T.LongType()) for c in FOLDS], ("token", T.LongType()), ("count", T.LongType()))]])
    seed = 0
    while True:
        profile = shared_table(text.mapInArrow(_profile(seed), schema), "profile")
        sets = profile.where("n is not null")
        clash = sets.where("node is not null").groupBy("node").agg(F.count_distinct("digest").alias("k")).where("k > 1")
        if clash.isEmpty():
            break
        seed += 1
    reps = sets.where("node is not null").groupBy("node").agg(F.min("id").alias("first_id"), F.max("n").alias("n"), F.first("bits").alias("bits"), *[F.first(c).alias(c) for c in FOLDS])
    top = profile.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(frequent_tokens).toPandas()
    order = sc.broadcast(TokenOrders(top["token"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)))

    def keyed(b: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in b:
            node = [_node(t, seed)[0] for _, t in shingle_sets(x, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), x.column(0)], ["node", "text"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (node, text) whose text has the set of the node."""
        for b in batches:
            node = b.column(0).to_pylist()
            yield b.take(pa.array([i for i, t in shingle_sets(b, 1) if _node(t, seed)[0] == node[i]], pa.int64()))

    post = text.select("text").mapInArrow(lambda b: _postings(order, percent)(keyed(b)), "token long, salt int, node long, rare int")
    dealt = post.repartition("token", "salt").sortWithinPartitions("token", "salt", "rare", "node")
    shared = shared_table(dealt.mapInArrow(_shared, "token long, salt int, node long, rare int, lead long"), "shared-prefixes")

    # salted buckets of one token: their leaders meet under the least of them
    heads = shared.where("salt >= 0").groupBy("token").agg(F.min("lead").alias("least"))
    across = shared.where("salt >= 0").select("token", "lead").distinct().join(heads, "token").select(F.col("least").alias("a"), F.col("lead").alias("b"))
    stars = shared.select(F.col("lead").alias("a"), F.col("node").alias("b")).unionByName(across).where("a <> b").groupBy("a", "b").count()
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a"))

    members = shared_table(shared.select("node").distinct().join(reps, "node"), "members")

    def verified(pairs: DataFrame) -> DataFrame:
        x = members.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
        y = members.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
        left = shared_table(both.mapInArrow(_similar_bitmaps(percent), "a long, b long"), "similar-bitmaps")
        wanted = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(members, "node").select("node", "first_id")
        if wanted.count() <= broadcast_ids:
            wanted = F.broadcast(wanted)
        # one text stands for equal sets; rows with other texts may have its id
        fetched = text.join(wanted, text["id"] == wanted["first_id"]).select("node", "text")
        one = fetched.mapInArrow(own, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))
        texts = shared_table(one, "candidate-texts")
        full = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        full = full.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return full.select("a", "text_a", "b", "text_b").mapInArrow(_verify(order, percent, orders), "a long, b long")

    links = shared_table(verified(best.select("a", "b")), "links")
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    comp = components(links)
    here = shared.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = here.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    rest = here.join(mixed, "token").select("token", "salt", "node", "rare", "root").join(members.select("node", "n", *FOLDS), "node")
    rest = shared_table(_marked(rest.withColumn("often", F.col("n") - F.col("rare")).drop("rare")), "mixed-buckets")
    pairs = _candidates(rest, percent)
    pairs = pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = shared_table(verified(pairs), "more-links")
    final = components(links.union(more))

    named = sets.join(final, "node", "left").withColumn("key", F.coalesce("root", "node"))
    least = named.where("key is not null").groupBy("key").agg(F.min("id").alias("component_id"))
    with_set = named.where("key is not null").join(least, "key").select("id", F.col("n").alias("n_shingles"), "component_id")
    return with_set.unionByName(named.where("key is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs with the row of the smallest id of each component; rows that share that id stay together."""
    drop = near_components(docs, id_col, text_col, **kw).where("id <> component_id").select(F.col("id").alias("__id")).distinct()
    return docs.join(drop, docs[id_col] == drop["__id"], "left_anti")
