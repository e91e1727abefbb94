"""Operators on documents against plain-Python twins, over awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import awkward, frame, prose, shingle_set, unite  # noqa: E402

from ticktote.llm import components, decontaminate, exact_dedup, ngram_join, packing, ppm, suffix_dedup, textops  # noqa: E402


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("bits,chunking", [(64, {}), (64, {"shortest": 8, "longest": 40}), (2, {"shortest": 8, "longest": 40})])
def test_exact_groups(spark, bits, chunking):
    rows = awkward()
    got = exact_dedup.exact_groups(frame(spark, rows), hash_bits=bits, **chunking).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[strip(t)].append((-len(t or ""), i is not None, i))
    want = Counter()
    for t, members in groups.items():
        keep = min(members)[2]
        for _, _, i in members:
            want[i, keep, len(members), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)


def test_keep_distinct_keeps_columns_and_one_row_each(spark):
    docs = frame(spark, awkward())
    out = exact_dedup.keep_distinct(docs)
    assert out.columns == docs.columns
    texts = [strip(r["text"]) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({strip(t) for _, t in awkward()})
    assert exact_dedup.keep_distinct(frame(spark, [])).count() == 0


def test_chunks_move_little_after_an_edit(spark):
    text = prose(9, 4000).replace(" ", "")
    both = [(1, text), (2, text[:9000] + "edit" + text[9000:])]
    a, b = (set(map(tuple, r["recipe"])) for r in exact_dedup.chunk_recipes(frame(spark, both)).orderBy("id").collect())
    assert len(a & b) >= 0.8 * len(a)


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_contamination(spark, limit):
    bench = [(1, prose(1, 120)[40:220]), (2, "two words"), (3, None), (4, ""), (5, "a b c d e f g h i j k"), (6, "A, b; c d e f g h i j k"), (None, "one")]
    rows = awkward() + [(30, "so a b c d e f g h i j k a b c d e f g h i j"), (31, "Two  words, two. WORDS")]
    got = decontaminate.contamination(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string"), broadcast_rows=limit).collect()
    want = Counter()
    for i, t in rows:
        w, hit, items = words(t), set(), set()
        for item, b in bench:
            bw = words(b)
            for k in range(max(1, len(bw) - 9)) if bw else ():
                win = bw[k:k + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p:p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        items.add(str(item) if item is not None else "null")
        want[i, len(w), len(hit), tuple(sorted(items))] += 1
    assert Counter((r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)


def test_decontaminate_documents_and_spans(spark):
    docs = frame(spark, [(1, "clean text"), (2, "so, two words; and more."), (3, None), (4, "")])
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()} == {1, 3, 4}
    cut = decontaminate.decontaminate(docs, bench, remove="spans")
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "clean text", 2: "so; and more.", 3: None, 4: ""}
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 4
    assert decontaminate.contamination(frame(spark, []), bench).count() == 0


def test_decontaminate_keeps_clean_rows_of_a_shared_id(spark):
    docs = frame(spark, [(None, "clean text"), (None, "so, two words; and more."), (5, "two words"), (5, "all clean"), (5, None), (6, "clean")])
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(None, "clean text"), (5, "all clean"), (5, None), (6, "clean")])
    cut = decontaminate.decontaminate(docs, bench, remove="spans").collect()
    assert Counter((r["doc_id"], r["text"]) for r in cut) == Counter([(None, "clean text"), (None, "so; and more."), (5, ""), (5, "all clean"), (5, None), (6, "clean")])


def components_twin(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, unite(links, sets)


def near_rows(n=60):
    base = prose(50, 90).split()
    rows = []
    for i in range(n):
        w = list(base)
        for k in range(i % 7):
            w[(i * 13 + k * 17) % 90] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    line = "a very common line that all of these documents have in one place or another "
    return rows + [(100 + i, line + prose(100 + i, 30 + i)) for i in range(40)] + [(200 + i, line * (1 + i % 3) + f"t{i % 4}") for i in range(12)]


@pytest.mark.parametrize("frequent,small", [(200_000, 1_000_000), (0, 0), (40, 1_000_000)])
def test_near_components(spark, frequent, small):
    rows = [r for r in awkward() if r[0] is not None] + near_rows() if frequent else near_rows()
    rows = [(1000 + i if k > 22 else i, t) for k, (i, t) in enumerate(rows)] if frequent else rows
    n, root = components_twin(rows)
    got = ngram_join.near_components(frame(spark, rows), frequent_tokens=frequent, broadcast_ids=small).collect()
    assert len(got) == len(rows)
    assert {r["id"]: r["component_id"] for r in got} == root
    assert {r["id"]: r["n_shingles"] for r in got} == n


def test_words_of_one_polynomial_are_told_apart(spark):
    """The Thue-Morse word and its complement share every polynomial hash modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[b ^ f] for b in bits) for f in (0, 1))
    hashes, _ = textops.word_hashes(np.frombuffer(f"{one} {two} {one.upper()}".encode(), dtype=np.uint8), np.array([0, 3 * 1024 + 2]))
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
    got = {r["id"]: r["component_id"] for r in ngram_join.near_components(frame(spark, [(1, one), (2, two), (3, one.upper())])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_near_components_edges(spark):
    assert ngram_join.near_components(frame(spark, [])).count() == 0
    got = {r["id"]: r["component_id"] for r in ngram_join.near_components(frame(spark, [(None, "some words without an id"), (5, None), (6, "b c"), (6, "b c")])).collect()}
    assert got == {None: None, 5: 5, 6: 6}
    assert {r["doc_id"] for r in ngram_join.keep_one(frame(spark, awkward())).collect()} >= {1, 2, 3, 4, None}


def test_nodes_that_share_many_tokens_meet_once(spark):
    """Each pair is made once for a kind of token where the outermost tokens agree, and never less than once."""
    sets = {1: range(0, 40), 2: range(0, 40), 3: range(1, 40), 4: range(2, 39), 5: range(100, 110)}
    frequent = {k: range(200, 230) for k in (2, 4, 6)}
    rows = [(t, -1, k) for k, own in sets.items() for t in own] + [(t, k % 16, k) for k, own in frequent.items() for t in own]
    full = [(t, salt, k, 100 + k, 95, 95, *[0] * len(ngram_join.FOLDS)) for t, salt, k in rows]
    names = ["token", "salt", "node", "root", "n", "often", *ngram_join.FOLDS]
    rest = spark.createDataFrame(full, ", ".join(f"{c} long" for c in names))
    got = Counter((r["node_x"], r["node_y"]) for r in ngram_join._candidates(ngram_join._marked(rest), 80).collect())
    want = {(a, b) for a in range(1, 7) for b in range(a + 1, 7) if set(sets.get(a, ())) & set(sets.get(b, ())) or a in frequent and b in frequent}
    assert set(got) == want
    assert got[1, 2] == got[1, 3] == got[2, 3] == 1 and got[2, 6] == got[4, 6] == 1 and got[1, 4] == 37 and got[2, 4] == 38


def test_near_components_of_texts_that_share_an_id(spark):
    one, two = prose(70, 90).split(), prose(71, 90).split()
    rows = [(1, " ".join(one)), (1, " ".join(two)), (10, " ".join([*one[:-1], "end"])), (11, " ".join([*two[:-1], "end"])), (12, prose(72, 90))]
    got = Counter((r["id"], r["component_id"]) for r in ngram_join.near_components(frame(spark, rows)).collect())
    assert got == Counter([(1, 1), (1, 1), (10, 1), (11, 1), (12, 12)])


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 90, 90: 90, 95: 90}


def test_shared_prefix_buckets_over_batches():
    import pyarrow as pa

    rows = [(1, -1, 10), (1, -1, 10), (2, -1, 11), (2, -1, 12), (2, -1, 12), (2, -1, 13), (3, 0, 14), (4, -1, 15), (4, -1, 16), (5, -1, 17), (6, 2, 18), (6, 2, 19)]
    whole = None
    for step in (1, 2, 3, 10):
        got = []
        chunks = [rows[i:i + step] for i in range(0, len(rows), step)]
        batches = (pa.RecordBatch.from_arrays([pa.array([r[k] for r in c]) for k in range(3)] + [pa.array([5] * len(c)), pa.array([0] * len(c))], ["token", "salt", "node", "n", "often"]) for c in chunks)
        for b in ngram_join._shared(batches):
            got += list(zip(*[b.column(i).to_pylist() for i in (0, 2, 5)], strict=True))
        whole = whole or sorted(got)
        assert sorted(got) == whole
    assert whole == [(2, 11, 11), (2, 12, 11), (2, 13, 11), (3, 14, 14), (4, 15, 15), (4, 16, 15), (6, 18, 18), (6, 19, 18)]


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(2)
    for n, m in ((10, 12), (150, 140), (3000, 2800), (9000, 900)):
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: min(m, n) * 9 // 10], r.integers(0, 2**63, m // 10, dtype=np.uint64)]))
        apart = len(np.setxor1d(x, y))
        a, b = ngram_join._bitmap(x), ngram_join._bitmap(y)
        assert 0.4 * min(apart, len(y)) <= ngram_join._unequal(a, b) <= apart
        fold = np.bitwise_count(ngram_join._folded(a).view(np.uint64) ^ ngram_join._folded(b).view(np.uint64)).sum()
        assert fold <= apart
        assert ngram_join._unequal(a, a) == 0


def cut_twin(rows, n=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            s = b[k:k + n]
            if i is not None:
                first[s] = min(i, first.get(s, i))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if i is not None and first[b[k:k + n]] < i:
                gone[k:k + n] = True
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[i, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()] += 1
    return out


def test_cut_repeats(spark):
    passage = prose(77, 15)
    rows = [(i, t[:4000] if t else t) for i, t in awkward()] + [(40 + k, prose(300 + k, 10 + k) + "é" * k + passage[:40 + k * 4] + prose(400 + k, 9)) for k in range(12)]
    got = suffix_dedup.cut_repeats(frame(spark, rows)).collect()
    assert Counter((r["id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got) == cut_twin(rows)
    assert suffix_dedup.cut_repeats(frame(spark, [])).count() == 0


def test_cut_repeats_of_texts_that_share_a_key_or_repeat_themselves(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "KEY_DIGITS", 1)
    line, other = prose(500, 12), prose(501, 12)
    rows = [(k, " ".join([prose(510 + k, 5), line, other[: 3 * k], line])) for k in range(40)] + [(60, "ab" * 400), (61, "ab" * 90 + line), (62, None), (63, "ab" * 400), (64, "a" * 49), (65, "a" * 50), (66, "a" * 51)]
    got = suffix_dedup.cut_repeats(frame(spark, rows)).collect()
    assert Counter((r["id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got) == cut_twin(rows)


def test_repeats_are_looked_for_at_few_places(spark):
    """A row for about each 18th byte, and bytes only of strings that several texts have."""
    texts = [np.random.default_rng(k).integers(97, 123, 20_000, dtype=np.uint8).tobytes() for k in range(4)]
    texts[2] = texts[2][:9000] + texts[1][5000:5400] + texts[2][9400:]
    x, off = np.frombuffer(b"".join(texts), np.uint8), np.arange(5) * 20_000
    row, first, count, anchor = suffix_dedup._stretches(x, off, 50)
    assert len(row) < len(x) / 15 and count.sum() == 4 * (20_000 - 49)
    at = dict(zip(((r, f + k) for r, f, c in zip(row, first, count, strict=True) for k in range(c)), np.repeat(anchor, count), strict=True))
    assert all(at[2, 49_000 + k] == at[1, 25_000 + k] for k in range(351))
    docs = spark.createDataFrame([(k, k, t.decode()) for k, t in enumerate(texts)], "key long, id long, text string")
    plan = suffix_dedup.cut_repeats(docs.select(F.col("id").alias("doc_id"), "text"))
    assert [(r["id"], r["n_removed"]) for r in plan.orderBy("id").collect()] == [(0, 0), (1, 0), (2, 400), (3, 0)]
    assert [tuple(r) for r in suffix_dedup.repeated_spans(docs).groupBy("key", "id").agg(F.min("start"), F.max("stop")).collect()] == [(2, 2, 9000, 9400)]


def ppm_twin(train, texts, order=3):
    """Probabilities by the definition: one trie of dictionaries, symbol by symbol."""
    trie = defaultdict(Counter)
    for t in train:
        b = b"\xff" * order + t + b"\xff"
        for i in range(order, len(b)):
            for k in range(order + 1):
                trie[b[i - k:i]][b[i]] += 1

    def log10(ctx, s):
        p, out = 1.0, set()
        for k in range(order, -1, -1):
            c = {x: n for x, n in trie.get(ctx[len(ctx) - k:], {}).items() if x not in out}
            n, d = sum(c.values()), len(c)
            if not d:
                continue
            full = d + len(out) == 256
            if s in c:
                return math.log10(p * c[s] / (n if full else n + d))
            p *= d / (n + d)
            out |= set(c)
        return math.log10(p / (256 - len(out)))

    return [sum(log10(b[i - order:i], b[i]) for b in [b"\xff" * order + t + b"\xff"] for i in range(order, len(b))) for t in texts]


@pytest.mark.parametrize("hot", [200_000, 3])
def test_ppm_and_base(spark, hot):
    rows = [(i, t[:3000] if t else t) for i, t in awkward()] + [(100 + k, prose(500 + k, 40)) for k in range(30)]
    got = ppm.score_documents(frame(spark, rows), broadcast_words=hot).collect()
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0
    train = [(t or "").encode() for i, t in rows if not held(i)]
    tokens = lambda b: [*b.lower().split(), None]
    counts = Counter(w for b in train for w in tokens(b))
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, t), score in zip(rows, ppm_twin(train, [(t or "").encode() for _, t in rows]), strict=True):
        ws = tokens((t or "").encode())
        want.append((i is not None, i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), score))
    have = [(r["id"] is not None, r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got]
    assert any(w[2] for w in want) and len(have) == len(want)
    for a, b in zip(sorted(have, key=str), sorted(want, key=str), strict=True):
        assert a[:6] == b[:6] and a[6:] == pytest.approx(b[6:], rel=1e-5)


@pytest.mark.parametrize("most", [0, 3])
def test_ppm_keeps_every_context(spark, most):
    rows = [(i, t[:3000] if t else t) for i, t in awkward()] + [(100 + k, prose(500 + k, 40) + "漢字 и") for k in range(30)]
    got = ppm.score_documents(frame(spark, rows), max_contexts=most, broadcast_words=3).collect()
    train = [(t or "").encode() for i, t in rows if zlib.crc32(("null" if i is None else str(i)).encode()) % 10]
    want = list(zip((str(i) for i, _ in rows), ppm_twin(train, [(t or "").encode() for _, t in rows]), strict=True))
    assert len(got) == len(want)
    for a, b in zip(sorted((str(r["id"]), r["score"]) for r in got), sorted(want), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-5)


def test_ppm_rows_sum_to_one():
    g, c = np.unique(textops.mix(np.arange(3000, dtype=np.uint64)) & np.uint64(0xFFFFFFFF), return_counts=True)
    pairs, at = np.unique(g & np.uint64(0xFFFFFF), return_inverse=True)
    m = ppm.Model(g, c, (pairs.astype(np.int64), np.bincount(at, weights=c).astype(np.int64)))
    assert np.allclose((10.0 ** m.table.astype(np.float64)).sum(1), 1, atol=1e-4)
    full = np.full((1, 256), 3)
    assert np.allclose((10.0 ** ppm._predict([full])).sum(), 1)


def test_ppm_without_training(spark):
    rows = [(i, "abc") for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = ppm.score_documents(frame(spark, rows)).collect()
    assert all(r["score"] == pytest.approx(4 * math.log10(1 / 256), rel=1e-5) and r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert ppm.score_documents(frame(spark, [])).count() == 0


def test_words_are_let_go_after_a_task():
    import pyarrow as pa
    import public_tokenizers

    run = packing._tokenise(public_tokenizers.path("word_bpe_49k.json"), 2048, 1)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([prose(5, 3000), None])], ["doc_id", "text"])
    first, again = list(run(iter([batch]))), list(run(iter([batch])))
    assert first[0].equals(again[0]) and first[0].column(1).to_pylist()[1] == 1
    assert all(not t.cores and len(t.code) == 2 for t in packing._TOKENIZERS.values())


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*awkward(), (50, "It's <|endoftext|> don't, ΣΑΣ. İstanbul éa 123abc²\x0bx\x85y  z")]
    tok, capacity = Tokenizer.from_file(path), 64
    got = packing.pack(frame(spark, rows), path, capacity=capacity).collect()
    ids = Counter()
    for i, t in rows:
        x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for s in range(0, len(x), capacity):
            ids[i, s, len(x[s:s + capacity]), zlib.crc32(x[s:s + capacity].tobytes()), len(x)] += 1
    assert Counter((r["id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == ids
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for w in windows.values():
        ends = list(itertools.accumulate(n for _, n in sorted(w)))
        assert [o for o, _ in sorted(w)] == [0, *ends[:-1]] and ends[-1] <= capacity
    total = sum(r["length"] for r in got)
    assert sorted(windows) == list(range(len(windows))) and len(windows) <= -(-total // capacity) + 1
    assert packing.pack(frame(spark, []), path).count() == 0


def test_minimum_slack_fills_windows():
    r = np.random.default_rng(3)
    hist = {int(n): int(r.integers(1, 400)) for n in r.integers(1, 2048, 500)}
    plan = packing.minimum_slack_plan(hist, 2048)
    placed = Counter()
    for n, a, z, *_ in plan:
        placed[n] += z - a + 1
    assert placed == hist
    windows = max(w + (z - a + 1) // k for _, a, z, k, w, _ in plan)
    needed = max(sum(n * c for n, c in hist.items()) / 2048, sum(c for n, c in hist.items() if n > 1024))
    assert windows <= 1.02 * needed + 1
    short = {n: c for n, c in hist.items() if n < 900}
    windows = max(w + (z - a + 1) // k for _, a, z, k, w, _ in packing.minimum_slack_plan(short, 2048))
    assert windows <= 1.001 * sum(n * c for n, c in short.items()) / 2048 + 1
    assert packing.minimum_slack_plan({}, 2048) == []
    assert packing.minimum_slack_plan({2048: 3}, 2048) == [(2048, 0, 2, 1, 0, 0)]
