"""Lexicon counts in one pass against a count of each word by itself."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ticktote.functions.lexicon import counts_by_value, lexicon_hits, overlaps_itself


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def counts(spark, texts, values):
    d = frame(spark, texts).withColumn("h", lexicon_hits(F.col("text"), values))
    per = counts_by_value(F.col("text"), F.col("h"), values)
    rows = d.select("i", *[n.alias(f"v{k}") for k, n in enumerate(per.values())]).collect()
    return {r["i"]: {v: r[f"v{k}"] for k, v in enumerate(per)} for r in rows}


def want(texts, values):
    return {i: {v: sum((t or "").count(w) for w, x in values.items() if x == v) for v in values.values()} for i, t in enumerate(texts)}


def test_counts_of_overlapping_words(spark):
    values = {"a": 1.0, "aa": 2.0, "aba": 2.0, "調子": 1.0, "絶好調": 3.0, "好調": -1.0, "good": 3.0, "oo": 4.0, "😀b": 4.0}
    texts = [None, "", "a", "aaaaa", "ababababa", "絶好調です。調子は絶好調", "so good, goood", "b", "Good", "a\na", "x😀b😀"]
    assert counts(spark, texts, values) == want(texts, values)


def test_a_thousand_words(spark):
    r = random.Random(5)
    values = {"".join(r.choices("abcdef", k=r.randint(3, 5))): float(r.randint(-1, 1)) for _ in range(2_000)}
    assert len(values) > 1_000
    # what can overlap itself is counted one by one
    values = {w: v for w, v in values.items() if not overlaps_itself(w)} | {"aa": 1.0}
    texts = [" ".join("".join(r.choices("abcdef", k=r.randint(1, 9))) for _ in range(40)) for _ in range(12)]
    got = counts(spark, texts, values)
    assert got == want(texts, values) and sum(map(sum, (g.values() for g in got.values()))) > 300


def test_hits_and_edges(spark):
    got = frame(spark, ["xabx", None]).select(lexicon_hits(F.col("text"), ["ab", "x", "b"]).alias("h")).collect()
    assert got[0]["h"] == ["x", "b", "x", "ab"] and got[1]["h"] == []
    assert frame(spark, ["a"]).select(lexicon_hits(F.col("text"), []).alias("h")).first()["h"] == []
    assert frame(spark, []).select(lexicon_hits(F.col("text"), ["a"])).count() == 0
    with pytest.raises(ValueError):
        lexicon_hits(F.col("text"), ["a", ""])
