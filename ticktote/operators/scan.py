"""Prefix scans over range partitions of the order.

Rows are cut into chunks of about equal size along (keys, order), whatever the keys and the calendar look like, so one
key with most of the rows is many chunks and a thousand small keys share one. All running totals, peaks, maxima and
positions are windows inside (keys, chunk), after one exchange. One summary row per key and chunk is carried over the
chunks of a key and joined back. The number of chunks grows with the rows; the cut points are a table of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktote.sources.storage import stored_table

#: rows of a chunk beyond the parallelism of the session, and sampled rows for each cut
CHUNK_ROWS, PER_CUT = 1 << 20, 16
#: comparisons that are compiled into one expression
TREE = 64


def _sort_key(keys: list[str], order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in (*keys, *order)])


def cut_points(df: DataFrame, keys: list[str], order: list[str], chunks: int) -> DataFrame:
    """One stored row with the sorted array of at most chunks - 1 cut points of (keys, order).

    A fixed number of hash buckets keeps one row each, with map-side aggregation, which is a sample of the distinct
    sort keys whose size does not depend on the data.
    """
    names = [*keys, *order]
    sample = df.select(*names).groupBy(F.pmod(F.xxhash64(*names), F.lit(PER_CUT * chunks)).alias("_bucket"))
    sample = sample.agg(F.min_by(_sort_key(keys, order), F.xxhash64(F.lit(1), *names)).alias("_s"))
    ranked = sample.select("_s", F.row_number().over(Window.orderBy("_s")).alias("_r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    # chunks - 1 rows at even distances in the sample, or fewer if it is smaller
    part = lambda r: F.floor(r * chunks / F.col("_n"))
    cuts = ranked.where((part(F.col("_r")) != part(F.col("_r") - 1)) & (F.col("_r") < F.col("_n"))).agg(F.sort_array(F.collect_list("_s")).alias("_cuts"))
    return stored_table(cuts, "cuts")


def _chunk_of(cuts: Column, value: Column, size: int) -> Column:
    """Number of cut points, of at most size, that are at most value.

    A tree of comparisons, which compiles, for as many as TREE of them; with more, the tree finds the stretch between
    two of them, and a binary search goes on inside it.
    """
    stride = -(-size // TREE)
    below = lambda i: F.coalesce(value < F.get(cuts, i), F.lit(True))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(below(F.lit(mid * stride + stride - 1)), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    found = tree(0, size // stride)
    if stride == 1:
        return found

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        left = (s["lo"] < s["hi"]) & below(mid)
        return F.struct(F.when((s["lo"] >= s["hi"]) | left, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(left, mid).otherwise(s["hi"]).alias("hi"))

    start = F.struct((found * stride).alias("lo"), F.least(found * stride + stride - 1, F.size(cuts)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(stride.bit_length() + 1)), start, halve)["lo"]


def chunked(df: DataFrame, keys: list[str], order: list[str], *, chunks: int | None = None, store: bool = True) -> DataFrame:
    """df with _chunk, the number of its range along (keys, order). Rows of equal sort key share a chunk.

    df is written to the shared folder first, as it is read for the cut points, the scan and the summaries; store=False
    leaves that out for inputs that are stored tables already.
    """
    src = stored_table(df, "scan") if store else df
    if chunks is None:
        chunks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-src.count() // CHUNK_ROWS))
    cuts = cut_points(src, keys, order, chunks)
    found = _chunk_of(F.col("_cuts"), _sort_key(keys, order), chunks)
    return src.join(F.broadcast(cuts)).select(*df.columns, found.alias("_chunk"))


def prefix_scan(
    df: DataFrame, keys: list[str], order: list[str], *, sums: dict[str, str | Column] | None = None, peaks: dict[str, str | tuple[str, Column]] | None = None,
    maxima: dict[str, str | Column] | None = None, position: str | None = None, size: str | None = None, chunks: int | None = None, store: bool = True,
) -> DataFrame:
    """Adds running values of each key in its order, all in one scan.

    sums: name -> value, a running total; peaks: name -> running total, its running maximum, or (total, condition), over
    the rows that meet it; maxima: name -> value, the running maximum without NULLs; position: 0-based row number;
    size: rows of the key. NULL values add nothing. Rows with a NULL key belong to no sequence: each chunk of them starts anew.
    Rows of equal sort key are in any order.
    """
    col = lambda v: F.col(v) if isinstance(v, str) else v
    sums = {k: col(v) for k, v in (sums or {}).items()}
    maxima = {k: col(v) for k, v in (maxima or {}).items()}
    peaks = {k: (v, F.lit(True)) if isinstance(v, str) else v for k, v in (peaks or {}).items()}
    d = chunked(df, keys, order, chunks=chunks, store=store)
    home = [*keys, "_chunk"]
    w = Window.partitionBy(*home).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = {"_l": F.row_number().over(Window.partitionBy(*home).orderBy(*order)).cast("long") - 1} if position else {}
    d = d.withColumns({**{"_s_" + k: F.coalesce(F.sum(c).over(w), F.lit(0.0)) for k, c in sums.items()}, **{"_m_" + k: F.max(c).over(w) for k, c in maxima.items()}, **rank})
    if peaks:
        d = d.withColumns({"_m_" + k: F.max(F.when(cond, F.col("_s_" + s))).over(w) for k, (s, cond) in peaks.items()})
    # one row per key and chunk
    tops = [F.max("_m_" + k).alias("_x_" + k) for k in (*peaks, *maxima)]
    total = d.groupBy(*home).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias("_t_" + k) for k, c in sums.items()], *tops)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = total.withColumns({**{"_c_" + k: F.coalesce(F.sum("_t_" + k).over(before), F.lit(0.0)) for k in sums}, "_c": F.coalesce(F.sum("_n").over(before), F.lit(0))})
    carry = carry.withColumns({"_a_" + k: F.col("_x_" + k) + F.col("_c_" + s) for k, (s, _) in peaks.items()}) if peaks else carry
    carry = carry.withColumns({**{"_b_" + k: F.max("_a_" + k).over(before) for k in peaks}, **{"_b_" + k: F.max("_x_" + k).over(before) for k in maxima}, "_size": F.sum("_n").over(Window.partitionBy(*keys))})
    d = d.join(carry.select(*home, "_c", "_size", *["_c_" + k for k in sums], *["_b_" + k for k in (*peaks, *maxima)]), home, "left")
    out = {k: F.coalesce(F.col("_c_" + k), F.lit(0.0)) + F.col("_s_" + k) for k in sums}
    out |= {k: F.greatest(F.col("_b_" + k), F.col("_m_" + k) + F.coalesce(F.col("_c_" + s), F.lit(0.0))) for k, (s, _) in peaks.items()}
    out |= {k: F.greatest(F.col("_b_" + k), F.col("_m_" + k)) for k in maxima}
    out |= {position: F.coalesce("_c", F.lit(0)) + F.col("_l")} if position else {}
    out |= {size: F.col("_size")} if size else {}
    return d.select(*[c for c in df.columns if c not in out], *[v.alias(k) for k, v in out.items()])
