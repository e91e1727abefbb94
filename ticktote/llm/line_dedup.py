"""Line deduplication by sorted hashes and keep bitmaps, in DataFrame functions only.

Every document gives one light row (hash, document, position) for each long line. The rows are range-partitioned by
hash and sorted by hash, document (largest first) and position, so that one pass over a sorted run meets the document
that keeps a line before all others. A hash with a large share of all rows is dealt over several runs by its documents
first, and the small summaries of its runs are merged before a row is decided. What comes back is a run-length
bitmap for each document; texts never move through these steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktote.llm.common import ascii_lower, shared_table

BLANKS = " \t\n\x0b\f\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: a hash with more than this share of all rows, or this many rows, is dealt over several runs
HOT_SHARE, RUN_ROWS = 1 / 4096, 1 << 20
RUNS = "array<struct<start: int, length: int>>"


def line_array(text: Column) -> Column:
    """Lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def digest(c: Column) -> Column:
    """The first 16 bytes of SHA-256."""
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


def with_doc_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_key, id, text). Rows with one id and one text share a key, and all that is decided about them."""
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.when(F.col(id_col).isNull(), F.lit("\x01")).otherwise(F.lit("\x02")), F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(digest(named).alias("doc_key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h, id, doc_key, pos) of the lines whose key has at least min_chars code points; h is the digest of the key."""
    lines = docs.select("doc_key", "id", F.posexplode(line_array(F.col("text"))).alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = lines.withColumn("key", ascii_lower(F.btrim("line", F.lit(BLANKS)))).where(F.length("key") >= min_chars)
    return keyed.select(digest(F.col("key")).alias("h"), "id", "doc_key", "pos")


def _dropped(rows: DataFrame, min_docs: int, hot_share: float) -> DataFrame:
    """(doc_key, pos) of the lines that go. rows: h, id, doc_key, pos, stored."""
    total = rows.count()
    spread = max(1, min(int(total * hot_share), RUN_ROWS))
    # at most max(1 / hot_share, total / RUN_ROWS) hashes are hot
    counts = rows.groupBy("h").agg(F.count("*").alias("c"))
    hot = shared_table(counts.where(F.col("c") > spread).select("h", F.ceil(F.col("c") / spread).cast("int").alias("k")), "hot-lines")
    dealt = rows.join(hot, "h", "left").withColumn("salt", F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), "k").cast("int")))
    # one hash, or one deal of a hot hash, is one run inside one range; the keeping document comes first
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = Window.partitionBy("h", "salt").orderBy(F.desc_nulls_last("id"), "pos")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = dealt.repartitionByRange(parts, "h", "salt").withColumns({"top": F.first("id").over(run), "nth": F.dense_rank().over(run.orderBy(F.desc_nulls_last("id")))})
    marked = marked.withColumn("docs", F.last("nth").over(whole))
    if hot.isEmpty():
        return marked.where((F.col("nth") > 1) & (F.col("docs") >= min_docs)).select("doc_key", "pos")
    marked = shared_table(marked.select("h", "k", "id", "doc_key", "pos", "top", "docs", "nth"), "line-runs")
    plain = marked.where(F.col("k").isNull() & (F.col("nth") > 1) & (F.col("docs") >= min_docs))
    # a run of a hot hash is summed up in one row; the runs of a hash have different documents
    runs = marked.where("k is not null and nth = 1").groupBy("h", "top").agg(F.max("docs").alias("docs"))
    merged = runs.groupBy("h").agg(F.max("top").alias("best"), F.sum("docs").alias("all"))
    split = marked.where("k is not null").join(F.broadcast(merged), "h").where((F.col("all") >= min_docs) & ~F.col("id").eqNullSafe(F.col("best")))
    return plain.select("doc_key", "pos").union(split.select("doc_key", "pos"))


def _runs(sorted_positions: Column) -> Column:
    """Runs of consecutive numbers in a sorted array of distinct numbers, in one pass for starts and one for ends."""
    p = sorted_positions
    starts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
    ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("z")), lambda r: F.struct(r["a"].alias("start"), (r["z"] - r["a"] + 1).cast("int").alias("length")))


def keep_bitmaps(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, hot_share: float = HOT_SHARE) -> DataFrame:
    """(doc_key, drop_runs) of the documents that lose lines: the zeros of their keep bitmap, run-length coded. docs: doc_key, id, text.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least min_chars code points that
    at least min_docs documents hold lose all their lines, except in the largest id that holds them.
    """
    rows = shared_table(_line_rows(docs, min_chars), "line-rows")
    gone = _dropped(rows, min_docs, hot_share)
    # a set, as repeated rows of one document give each position again
    bits = gone.groupBy("doc_key").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    return shared_table(bits.select("doc_key", _runs(F.col("p")).cast(RUNS).alias("drop_runs")), "keep-bitmaps")


def kept_lines(lines: Column, drop_runs: Column) -> Column:
    """Lines outside drop_runs, as one slice for each run that stays."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drop_runs, lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform(drop_runs, lambda r: r["start"]), F.array(F.size(lines)))
    return F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("z")), lambda r: F.slice(lines, r["a"] + 1, r["z"] - r["a"])))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, drop_runs (run-length keep bitmap) and kept (lines that stay, joined by newline).

    A document is an id: rows that share an id (null too, which is less than any other) count as one document, and all
    of them keep a line of which theirs is the largest id. Null and empty texts are one empty line. Repeats of a line
    within the document that keeps it stay. A text all of whose lines go has an empty kept text. An empty table gives
    no rows; other columns of the input are not looked at.
    """
    rows = with_doc_key(docs, id_col, text_col)
    bits = keep_bitmaps(rows, **options)
    runs = F.coalesce("drop_runs", F.expr(f"cast(array() as {RUNS})"))
    out = rows.join(bits, "doc_key", "left").select("id", line_array(F.col("text")).alias("lines"), runs.alias("drop_runs"))
    gone = F.aggregate("drop_runs", F.lit(0).cast("long"), lambda a, r: a + r["length"])
    kept = F.array_join(kept_lines(F.col("lines"), F.col("drop_runs")), "\n")
    return out.select("id", F.size("lines").cast("long").alias("n_lines"), gone.alias("n_dropped"), "drop_runs", kept.alias("kept"))
