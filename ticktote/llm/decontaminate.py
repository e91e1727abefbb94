"""Benchmark decontamination, in DataFrame functions only.

Windows of n benchmark words are known by their grams of (n + 1) / 2 words. The grams' hashes are a table of known
size that is broadcast while it is small (and shuffled beyond that). Of a document only every (n / 2 + 1)th gram is
looked up: each window that occurs covers one of those. A hit counts only when all words of the window are the
same. A document's row travels with its grams as one more element, so hits and documents meet in one aggregation
without a second read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktote.llm.common import ascii_lower, free_name, shared_table

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TAIL = r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)$"
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Words after lower-casing A-Z: runs of digits, letters and characters beyond ASCII. Null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_BREAK), "")


def gram_of(n: Column | int) -> Column | int:
    """Words in the grams that are looked up for windows of n words."""
    return (n + 1) // 2 if isinstance(n, int) else F.floor((n + 1) / 2).cast("int")


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 10) -> DataFrame:
    """Distinct windows: w_len, w_text, win (its words) and items (the ids, as sorted strings). A shorter item is one window."""
    ws = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    win = ws.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, size))).alias("win"))
    return win.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items")).select(
        F.size("win").alias("w_len"), F.array_join("win", " ").alias("w_text"), "win", "items")


def window_grams(windows: DataFrame) -> DataFrame:
    """A row for each gram of each window: g_hash, g_at (its offset), w_len, w_text, items."""
    g = gram_of(F.col("w_len"))
    at = F.explode(F.sequence(F.lit(0), F.col("w_len") - g)).alias("g_at")
    return windows.select("w_len", "w_text", "win", "items", at).select(
        F.xxhash64(F.slice("win", F.col("g_at") + 1, g)).alias("g_hash"), "g_at", "w_len", "w_text", "items")


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_col: str = "item_id", bench_text: str = "text", size: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input row: id, n_words, n_hit, items (sorted), spans (maximal runs of hit words, start and end) and row_key.

    A document word inside any occurrence of a benchmark window is hit. Null and empty texts have no words and no
    hits; an empty benchmark hits nothing; repeated rows are judged one by one. The gram table is broadcast up to
    broadcast_rows rows, else joined by shuffle.
    """
    grams = window_grams(benchmark_windows(bench, item_col, bench_text, size))
    counts = {r["w_len"]: r["n"] for r in grams.groupBy("w_len").agg(F.count("*").alias("n")).collect()}  # one row per length, size at most
    hint = "broadcast" if sum(counts.values()) <= broadcast_rows else "merge"
    base = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))

    kind = "array<struct<pos: int, len: int, h: bigint, first: int, near: array<string>>>"

    def lookups(n: int) -> Column:
        """Every (n - g + 1)th gram of g words, with the words of all windows of n that have it."""
        g = gram_of(n)
        at = F.sequence(F.lit(1), F.size("w") - g + 1, F.lit(n - g + 1))
        first = lambda i: F.greatest(i - (n - g), F.lit(1))
        one = F.transform(at, lambda i: F.struct(
            i.alias("pos"), F.lit(n).alias("len"), F.xxhash64(F.slice("w", i, g)).alias("h"), first(i).alias("first"), F.slice("w", first(i), i + n - first(i)).alias("near")))
        return F.when(F.size("w") >= n, one).otherwise(F.array().cast(kind))

    none = F.array().cast("array<string>")
    head = F.array(F.struct(F.lit(0).alias("pos"), F.size("w").alias("len"), F.lit(0).cast("bigint").alias("h"), F.lit(0).alias("first"), none.alias("near")))
    # the lookups are a column of their own, so that exploding them runs as generated code; a row has its own few words only
    listed = base.select("row_key", "id", F.concat(head, *[lookups(n) for n in sorted(counts)]).alias("xs"))
    looked = listed.select("row_key", "id", F.explode("xs").alias("x")).select("row_key", "id", F.col("x.pos").alias("g_pos"), "x.len", "x.h", "x.first", "x.near")
    found = looked.join(grams.hint(hint), F.col("h") == F.col("g_hash"), "left").withColumn("pos", F.col("g_pos") - F.col("g_at"))
    same = (F.col("g_pos") > 0) & (F.col("len") == F.col("w_len")) & (F.col("pos") >= F.col("first"))
    same = same & (F.col("w_text") == F.array_join(F.slice("near", F.greatest(F.col("pos") - F.col("first") + 1, F.lit(1)), F.col("len")), " "))
    hits = found.where((F.col("g_pos") == 0) | same).select(
        "row_key", "id", F.when(F.col("g_pos") == 0, F.col("len")).alias("n"), F.when(F.col("g_pos") > 0, F.struct("pos", (F.col("pos") + F.col("len")).alias("end"))).alias("at"),
        F.when(F.col("g_pos") > 0, F.col("items")).alias("items"))
    got = hits.groupBy("row_key").agg(
        F.first("id", ignorenulls=True).alias("id"), F.max("n").cast("long").alias("n_words"), F.sort_array(F.collect_set("at")).alias("at"),
        F.collect_set("items").alias("item_lists"))
    runs = F.aggregate("at", F.expr("cast(array() as array<struct<pos: int, end: int>>)"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["pos"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["pos"].alias("pos"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(s))))
    spans = F.transform(runs, lambda s: F.struct((s["pos"] - 1).alias("start"), (s["end"] - 1).alias("end")))
    return got.select("row_key", "id", "n_words", F.array_sort(F.array_distinct(F.flatten("item_lists"))).alias("items"), spans.alias("spans")).withColumn(
        "n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))


def remove_spans(text: Column, spans: Column) -> Column:
    """text without the words of spans and what separates them from the word before."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])))
    return F.concat(F.array_join(kept, ""), F.regexp_extract(text, TAIL, 1))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, remove: str = "documents", **kw) -> DataFrame:
    """docs without contaminated documents (remove="documents") or with the hit words cut out (remove="spans").

    Rows are judged one by one, whatever their ids: docs are written once with a key of each row to the shared folder.
    """
    key = free_name(docs, "row_key")
    kept = shared_table(docs.withColumn(key, F.monotonically_increasing_id()), "keyed-documents")
    hit = contamination(kept, bench, key, text_col, **kw).where("n_hit > 0").select(F.col("id").alias("__id"), F.col("spans").alias("__spans"))
    on = kept[key] == hit["__id"]
    if remove == "documents":
        return kept.join(hit, on, "left_anti").drop(key)
    cut = F.when(hit["__spans"].isNull(), kept[text_col]).otherwise(remove_spans(kept[text_col], hit["__spans"]))
    return kept.join(hit, on, "left").select(*[cut.alias(c) if c == text_col else kept[c] for c in docs.columns])
