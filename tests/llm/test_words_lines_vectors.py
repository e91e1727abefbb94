"""Spelling variants, whitening and line deduplication against plain-Python twins, over awkward rows."""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, frame, prose  # noqa: E402

from ticktote.llm import line_dedup, spelling, whitening  # noqa: E402


def fold(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


# ---- lines


def lines_twin(rows, min_chars, min_docs):
    key = lambda line: fold(line.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    rank = lambda i: (i is not None, i or 0)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and i != max(holders[key(x)], key=rank) for x in lines]
        out[i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)] += 1
    return out


def line_rows():
    common = "This Line Occurs In very many documents, at any place."
    rows = awkward() + [(100 + i, f"{'  ' * (i % 3)}{common.upper() if i % 2 else common}\n{prose(i, 12)}\nshort\nshort\n{common}\t") for i in range(60)]
    rows += [(200 + i, "\n".join([f"only four documents hold this long line number {i % 3}, x", "äöü " * 12, ""])) for i in range(12)]
    return rows + [(300, "\n\n\n"), (301, common), (301, common + "\n" + common), (302, "\x0b" + common + "\f"), (None, common), (None, prose(3, 200) + "\n" + common)]


@pytest.mark.parametrize("hot,chars,docs", [(1 / 4096, 40, 5), (0.02, 40, 5), (0.0, 10, 2), (1.0, 1, 1)])
def test_drop_lines(spark, hot, chars, docs):
    rows = line_rows()
    got = line_dedup.drop_lines(frame(spark, rows), hot_share=hot, min_chars=chars, min_docs=docs).collect()
    assert Counter((r["id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == lines_twin(rows, chars, docs)
    assert all(sum(x["length"] for x in r["drop_runs"]) == r["n_dropped"] for r in got)


def test_drop_lines_empty_table(spark):
    assert line_dedup.drop_lines(frame(spark, [])).count() == 0


def test_sorted_runs_need_one_exchange(spark):
    rows = spark.range(2000).selectExpr("cast(cast(id % 50 as string) as binary) h", "id", "cast(cast(id as string) as binary) doc_key", "1 pos")
    plan = line_dedup._dropped(rows, 5, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(h" not in plan.split("rangepartitioning")[0]


# ---- words


def words_twin(rows, step, least=7, often=2, factor=10):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if step and h % step == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= often}
    by_cut = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by_cut[w[:k] + w[k + 1:]].add(w)
        by_cut[w].add(w)

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    out, form = {}, {}
    for w in n:
        close = {v for k in range(len(w)) for v in by_cut[w[:k] + w[k + 1:]]} | by_cut[w]
        close = [v for v in close if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
        out[w] = len(close)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, n[w], out[w], form[w], n[form[w]] if form[w] else None, root(w)) for w in n}


def spelled_rows():
    base = ["translation", "government", "élémentaire", "naturalisation", "Straßenbahn", "aaaaaaaaaa", "abababababab", "tionquement", "mentationes"]
    rows = []
    for k in range(400):
        w = base[k % len(base)]
        at, kind = (k * 7) % len(w), k % 11
        typo = {0: w[:at] + w[at + 1:], 1: w[:at] + "x" + w[at:], 2: w[:at] + "é" + w[at + 1:], 3: w + "s", 4: "q" + w}.get(kind, w)
        rows.append((k, f"{typo} {w}, {w.upper()}; {typo}! {w[:7]} {w}-{w}×{w}"))
    return rows + [(None, "translation translations"), (None, "translation"), (7, "x" * 3000 + " " + "x" * 3001), (8, "x" * 3000 + " " + "x" * 3001), (9, None), (10, ""), (10, "transXation transXation")]


@pytest.mark.parametrize("options", [{}, {"min_frequent": 2}, {"min_frequent": 1, "max_grams": 10, "longest": 5}, {"min_frequent": 0}])
def test_spelling_variants(spark, options):
    rows = spelled_rows() + awkward()
    got = spelling.spelling_variants(frame(spark, rows), typo_step=31, **options).collect()
    assert len(got) == len({r["word"] for r in got})
    assert {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got} == words_twin(rows, 31)


def test_near_words_are_whole(spark):
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(5, 9))) for _ in range(1500)})
    vocabulary = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    twin = words_twin([(1, " ".join(words))], 0, least=5, often=1)
    for frequent in (3, 30, 10**6):
        got = Counter(r["word"] for r in spelling.near_words(vocabulary, min_frequent=frequent).collect())
        assert {w: got[w] for w in words} == {w: c for w, _, c, *_ in twin}


def test_roots_follow_chains(spark):
    words = ["abcdefg" + "hijk"[:k] for k in range(5)]
    vocabulary = spark.createDataFrame([(w, 20**k) for k, w in enumerate(words)], "word string, n long")
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variant_forms(vocabulary).collect()}
    assert got == {w: (words[k + 1] if k < 4 else None, words[4]) for k, w in enumerate(words)}


def test_spelling_edges(spark):
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame(spark, []), min_letters=4)
    with pytest.raises(ValueError):
        spelling.variant_forms(spark.createDataFrame([], "word string, n long"), factor=1)


# ---- vectors


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, id string, x double, component int").repartition(3) if rows else spark.createDataFrame(
        [], "vec_id long, embedding array<float>, id string, x double, component int")


def vector_rows(d=6, n=300):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((n, d)) * np.linspace(2, 0.2, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    bad = [(900, None), (901, []), (902, [1.0] * (d - 1) + [None]), (903, [nan] * d), (904, [inf] + [0.0] * (d - 1)), (905, [1.0, 2.0])]
    return rows + bad + [(None, rows[0][1]), (5, rows[5][1]), (906, rows[5][1]), (907, [-0.0] * d), (908, [0.0] * d)]


def test_whitening(spark):
    rows = vector_rows()
    got = whitening.whitened_rows(vector_frame(spark, rows)).toPandas()
    good = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(int)) for i, v in rows if v is not None and len(v) == 6 and None not in v and np.isfinite(v).all()]
    fit = np.array(sorted({tuple(x) for _, x in good}))
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors.T[::-1]
    want = Counter((i, k + 1, n, int(((n * x - s) ** 2).sum())) for i, x in good for k in range(4))
    ids = [None if np.isnan(v) else int(v) for v in got.id]
    assert Counter(zip(ids, got.component, got.n, got.deviation)) == want
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    for k in range(4):
        part = got[got.component == k + 1].copy()
        assert np.allclose(part.explained, values[k] / np.trace(cov), rtol=1e-9)
        by_dev = {int(((n * x - s) ** 2).sum()): x for _, x in good}
        x = np.array([by_dev[v] for v in part.deviation])
        w = (x - s / n) @ vectors[k] / np.sqrt(values[k])
        assert min(np.abs(part.whitened - w).max(), np.abs(part.whitened + w).max()) < 1e-8


def test_whitening_edges(spark):
    assert whitening.whitened_rows(vector_frame(spark, [])).count() == 0
    assert whitening.whitened_rows(vector_frame(spark, [(1, None), (2, [])])).count() == 0
    flat = whitening.whitened_rows(vector_frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(flat) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] is None and r["identity_error"] is None for r in flat)
    line = whitening.whitened_rows(vector_frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 6.0]), (3, [1.0])])).collect()
    assert sorted((r["id"], r["component"], r["whitened"] is None) for r in line) == [(1, 1, False), (1, 2, True), (2, 1, False), (2, 2, True)]
    big = whitening.whitened_rows(vector_frame(spark, [(1, [3e38]), (2, [-3e38]), (3, [1e7]), (4, [2.0])])).collect()
    assert {r["id"] for r in big} == {1, 2, 3, 4} and all(r["n"] == 4 for r in big)


def test_leading_pairs():
    rng = np.random.default_rng(1)
    for a in [np.diag([3.0, 3, 3, 2, 1, 0, 0]), np.eye(5), np.ones((6, 6)), np.diag([1e-9, 1, 1e9]), *[m @ m.T for m in rng.standard_normal((4, 20, 30))]]:
        values, vectors = whitening.leading_pairs(a, 4)
        want = np.linalg.eigvalsh(a)[::-1][: len(values)]
        scale = np.abs(a).max()
        assert np.allclose(values, want, atol=1e-12 * scale)
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-9)
        assert np.allclose(vectors @ a, values[:, None] * vectors, atol=1e-10 * scale)
    a = rng.standard_normal((15, 15))
    a += a.T
    assert all(whitening.count_above(a, s) == (np.linalg.eigvalsh(a) > s).sum() for s in np.linspace(-8, 8, 21))
