"""Spelling variants of words by a variable-length gram index.

The vocabulary is counted on Spark. A gram dictionary is grown level by level: a gram stays in it while more than a
threshold of words positions have it, and only such grams get longer, so infrequent branches are pruned at their first
gram. Every place of a word then gives one gram: the shortest one that the dictionary does not have. A gram depends on
the letters that it covers and on nothing else, so one edit can change at most as many grams of a word as cover its
most covered letter: the word's affected-gram bound. Of two near words, the grams that the edit leaves alone are equal
and lie at equal places from the front, or from the end. In one order of all grams, the first such gram is among the
first bound + 1 of both words, so only those enter the index. Lists are merged under both bounds on the sets of grams
(as 64-bit maps), and what is left is verified by its edit distance.

Words whose bound reaches the number of their grams guarantee nothing; they are also indexed by grams of the shortest
length, which always guarantee one, so pairs of two such words are found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktote.llm.common import ascii_lower, shared_table

RUN = "A-Za-z\\u00C0-\\u00FF"
MIN_LETTERS, MIN_COUNT, FORM_FACTOR = 7, 2, 10
SHORTEST, LONGEST = 3, 8
#: a gram that more places of the vocabulary have gets longer; raised where the dictionary would pass MAX_GRAMS a level
MIN_FREQUENT, MAX_GRAMS = 500, 200_000
TYPO_STEP = 31

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_END = 36

ENTRY = T.StructType([
    T.StructField("gram", T.LongType()), T.StructField("place", T.LongType()), T.StructField("longer", T.BooleanType()), T.StructField("word", T.StringType()),
    T.StructField("n", T.LongType()), T.StructField("letters", T.LongType()), T.StructField("grams", T.LongType()), T.StructField("bound", T.IntegerType())])


def word_runs(docs: DataFrame, id_col: str, text_col: str, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(id, run): maximal runs of at least min_letters letters, A-Z lower-cased; null texts have none."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[{RUN}]{{{min_letters},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run")).withColumn("run", ascii_lower(F.col("run")))


def planted_typo(doc_id: Column, run: Column, step: int = TYPO_STEP) -> Column:
    """run, without one letter where step divides the checksum of id and run. A null id counts as no characters."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    return F.when(h % step == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n), stored, for words of at least min_letters code points and min_count occurrences."""
    counts = words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n"))
    return shared_table(counts.where(F.col("n") >= min_count), "vocabulary")


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words as Latin-1 bytes, each with an end mark; the word of each byte; the stop of each word."""
    data = np.frombuffer(("$".join(words) + "$").encode("latin-1"), np.uint8)
    stops = np.flatnonzero(data == _END) + 1
    return data, np.repeat(np.arange(len(words)), np.diff(stops, prepend=0)), stops


def _grams(data: np.ndarray, owner: np.ndarray, stops: np.ndarray, known: dict[int, np.ndarray], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, bytes as a number, length and rarity of the gram at each place. known: sorted frequent grams by length."""
    places = np.arange(len(data))
    start = places[places + SHORTEST <= stops[owner]]
    code = np.zeros(len(start), _U)
    for k in range(SHORTEST):
        code = (code << _U(8)) | data[start + k]
    length = np.full(len(start), SHORTEST)
    rare = np.zeros(len(start), bool)
    live = np.arange(len(start))
    for q in range(SHORTEST, longest):
        table = known.get(q, np.zeros(0, _U))
        at = np.searchsorted(table, code[live])
        hit = at < len(table)
        hit[hit] = table[at[hit]] == code[live][hit]
        rare[live[~hit]] = True
        live = live[hit]
        live = live[start[live] + q < stops[owner[start[live]]]]
        code[live] = (code[live] << _U(8)) | data[start[live] + q]
        length[live] = q + 1
    return start, code, length, rare


def _batches(rows: Iterator[pa.RecordBatch], letters: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one has about so many letters, or one word."""
    for batch in rows:
        size = np.cumsum([len(w) for w in batch.column(0).to_pylist()])
        a = 0
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + letters, side="right")))
            yield batch.slice(a, z - a)
            a = z


def _level(known: dict[int, np.ndarray], q: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(rows):
            _, code, length, _ = _grams(*_letters(batch.column(0).to_pylist()), known, q)
            gram, n = np.unique(code[length == q], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])

    return run


def gram_dictionary(vocabulary: DataFrame, longest: int = LONGEST, min_frequent: int = MIN_FREQUENT, max_grams: int = MAX_GRAMS) -> dict[int, np.ndarray]:
    """Frequent grams by length, grown level by level over the whole vocabulary; at most max_grams a level.

    The threshold is min_frequent, or more where so many places could hold more than max_grams frequent grams. Any
    dictionary gives the same near words; it only decides how even the lists of the index are.
    """
    places = vocabulary.agg(F.coalesce(F.sum(F.length("word") + 2 - SHORTEST), F.lit(0))).first()[0]
    limit = max(min_frequent, -(-places // max_grams))
    known: dict[int, np.ndarray] = {}
    for q in range(SHORTEST, longest):
        counts = vocabulary.select("word").mapInArrow(_level(known, q), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        grams = counts.where(F.col("n") > limit).select("gram").toPandas()["gram"].to_numpy(dtype=np.int64)
        if not len(grams):
            break
        known[q] = np.sort(grams.view(_U))
    return known


def _entries(words: list[str], counts: np.ndarray, known: dict[int, np.ndarray], longest: int, mode: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """Index entries of words, and which of them guarantee nothing."""
    data, owner, stops = _letters(words)
    start, code, length, rare = _grams(data, owner, stops, known, longest)
    of = owner[start]
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    cover = np.cumsum(edge[:-1])
    cover[stops - 1] = 0
    first = np.concatenate([[0], stops[:-1]])
    bound = np.maximum.reduceat(cover, first)
    loose = bound >= np.bincount(of, minlength=len(words))
    letters = np.bitwise_or.reduceat(np.where(data == _END, _U(0), _U(1) << (data & 63).astype(_U)), first)
    heads = np.searchsorted(of, np.arange(len(words)))
    grams = np.bitwise_or.reduceat(_U(1) << ((code * _ODD) >> _U(58)), heads)
    order = np.lexsort((start, code * _ODD, ~rare, of))
    rank = np.arange(len(order)) - heads[of[order]]
    take = order[rank <= bound[of[order]]]
    w = of[take]
    at, size = (start[take] - first[w]), (stops[w] - first[w] - 1)
    # a word meets words of its own length at the same place, and words of one letter less there or one place before
    sets = [(at, size, False), (at, size - 1, True), (at - 1, size - 1, True)]
    ok = [p >= 0 for p, _, _ in sets]
    place = np.concatenate([((p.astype(np.int64) << 32 | s) << 1 | mode)[k] for (p, s, _), k in zip(sets, ok, strict=True)])
    idx = np.concatenate([w[k] for k in ok])
    longer = np.concatenate([np.full(int(k.sum()), b) for (_, _, b), k in zip(sets, ok, strict=True)])
    gram = np.concatenate([code[take][k] for k in ok])
    cols = [gram.view(np.int64), place, longer, pa.array(words).take(pa.array(idx)), counts[idx], letters[idx].view(np.int64), grams[idx].view(np.int64), bound[idx].astype(np.int32)]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=pa.schema([
        ("gram", pa.int64()), ("place", pa.int64()), ("longer", pa.bool_()), ("word", pa.string()), ("n", pa.int64()), ("letters", pa.int64()), ("grams", pa.int64()), ("bound", pa.int32())])), loose


def _index(known: Broadcast, longest: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(rows, 1 << 18):
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            out, loose = _entries(words, counts, known.value, longest, 0)
            yield out
            if loose.any():
                yield _entries([w for w, k in zip(words, loose, strict=True) if k], counts[loose], {}, longest, 1)[0]

    return run


def near_words(vocabulary: DataFrame, *, longest: int = LONGEST, min_frequent: int = MIN_FREQUENT, max_grams: int = MAX_GRAMS) -> DataFrame:
    """(word, near, n_near_word): all ordered pairs of words one inserted, deleted or replaced code point apart, partitioned by word.

    vocabulary: distinct (word, n) of at least 2 * SHORTEST - 1 letters of Latin-1. A word has at most some hundred near
    words for each of its letters, so they may meet in one task.
    """
    known = vocabulary.sparkSession.sparkContext.broadcast(gram_dictionary(vocabulary, longest, min_frequent, max_grams))
    entries = vocabulary.select("word", "n").mapInArrow(_index(known, longest), ENTRY)
    a, b = entries.where("not longer").alias("a"), entries.alias("b")

    def only(x: str, y: str) -> Column:
        return F.bit_count(F.col(f"{x}.grams").bitwiseAND(F.bitwise_not(f"{y}.grams"))) <= F.col(f"{x}.bound")

    pairs = a.join(
        b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.place") == F.col("b.place")) & (F.col("b.longer") | (F.col("a.word") < F.col("b.word")))
        & (F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2) & only("a", "b") & only("b", "a")
        & (F.levenshtein("a.word", "b.word", 1) == 1))
    both = F.explode(F.array(F.struct(F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("b.n").alias("n")), F.struct(F.col("b.word").alias("word"), F.col("a.word").alias("near"), F.col("a.n").alias("n"))))
    return pairs.select(both.alias("p")).select("p.word", "p.near", F.col("p.n").alias("near_n")).repartition("word").distinct()


def variant_forms(vocabulary: DataFrame, *, factor: int = FORM_FACTOR, **index: int) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n and root.

    The form is the near word of largest n (ties: smallest in code-point order), if that n is at least factor times
    the word's own. Forms grow with each step, so the chains from word to root are short and have no circles; they are
    followed by pointer doubling over stored tables.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    near = near_words(vocabulary, **index).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("top"))
    out = vocabulary.join(near, "word", "left")
    formed = -F.col("top.m") >= F.col("n") * factor
    out = shared_table(out.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("top.near")).alias("form"), F.when(formed, -F.col("top.m")).alias("form_n")), "forms")
    roots = shared_table(out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = shared_table(roots.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return out.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, typo_step: int | None = None, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, **options: int) -> DataFrame:
    """Words of docs with their near words, forms and roots; see variant_forms. Rows: word, n, n_near, form, form_n, root.

    Words are maximal runs of letters of Latin-1 with A-Z lower-cased. With typo_step, letters are left out of some
    occurrences first (planted_typo), which gives known misspellings. Null and empty texts have no words; repeated
    rows count each; a null id has no characters; an empty table gives no rows. Other columns are not looked at.
    """
    if min_letters < 2 * SHORTEST - 1:
        raise ValueError(f"words need at least {2 * SHORTEST - 1} letters")
    runs = word_runs(docs, id_col, text_col, min_letters)
    word = planted_typo(F.col("id"), F.col("run"), typo_step) if typo_step else F.col("run")
    return variant_forms(count_words(runs.select(word.alias("word")), min_letters, min_count), **options)
