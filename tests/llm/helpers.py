"""Fixtures shared by the tests of the folder: awkward documents and plain-Python twins."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

#: names that the operators use inside must not clash with columns of the input
CLASHING = ["row_key", "id", "w", "n", "h", "recipe", "__id", "entity_kinds", "sha256", "token", "node", "score"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])


def frame(spark, rows):
    """A documents table with clashing extra columns from (doc_id, text) pairs, over several partitions."""
    full = [(i, t, None if k % 5 == 0 else "en", f"s{k % 3}", None if t is None else len(t), *[f"x{k}"] * len(CLASHING)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3) if full else spark.createDataFrame([], SCHEMA)


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 6))) if r.random() < 0.7 else f"w{r.randrange(words)}" for _ in range(n))


def awkward():
    """Nulls, empties, a very long text, exact and near copies, repeated rows, ties."""
    base = prose(1, 120)
    near = base.split()
    near[50] = "changed"
    far = base.split()
    far[10:100:9] = ["other"] * 10
    rows = [
        (1, None), (2, ""), (3, "   \n\t"), (4, base), (5, base), (6, " ".join(near)), (7, base.upper()), (8, " ".join(far)), (9, base.replace(" ", "  ")),
        (10, "one"), (11, "one"), (12, "two words"), (13, "é ü ñ ß 漢字 и"), (14, prose(2, 60_000)), (15, "x" * 5000), (16, "x" * 5000), (16, "x" * 5000), (17, base + " " + prose(3, 200)),
        (None, "no id here at all, friend"), (18, "a b c d e f g h i j k"), (19, "A B C D E F G H I J K"), (20, prose(4, 300)), (21, prose(4, 300)[:-3])]
    return rows


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def unite(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
