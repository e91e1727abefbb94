"""Pair statistics of all instruments by a blocked Gram matrix.

Instruments are numbered and cut into tiles, timestamps are dealt into slabs. A tile of a slab is packed into one row
of arrays; tiles of a slab meet pairwise (an equi-join on the slab), and each meeting is six small matrix products,
which give count, sums, squares and products of every pair of the two tiles over their common timestamps. Slabs are
then added up tile pair by tile pair, and only pairs that pass the thresholds leave it. The plan has the same size for
5 and for 5,000 instruments, and no timestamp is ever expanded into its pairs of instruments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticktote.sources.storage import stored_table

TILE, SLAB_ROWS = 64, 4096
_STATS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _dense(idx: np.ndarray, at: np.ndarray, x: np.ndarray, rows: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    v, m = np.zeros((rows, tile)), np.zeros((rows, tile))
    v[at, idx], m[at, idx] = x, 1.0
    return v, m


def _products(tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                cell = {c: b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("ia", "ta", "xa", "ib", "tb", "xb")}
                times, at = np.unique(np.concatenate([cell["ta"], cell["tb"]]), return_inverse=True)
                k = len(cell["ta"])
                va, ma = _dense(cell["ia"], at[:k], cell["xa"], len(times), tile)
                vb, mb = _dense(cell["ib"], at[k:], cell["xb"], len(times), tile)
                out = (ma.T @ mb, va.T @ mb, ma.T @ vb, (va * va).T @ mb, ma.T @ (vb * vb), va.T @ vb)
                yield pa.RecordBatch.from_arrays(
                    [b.column("a").slice(r, 1), b.column("b").slice(r, 1), *[pa.array([m.ravel()], pa.list_(pa.float64())) for m in out]], ["a", "b", *_STATS])

    return run


def _pairs_of(a: int, b: int, total: dict[str, np.ndarray], tile: int, min_common: int, min_corr: float) -> pa.RecordBatch:
    """The pairs i < j of two tiles that pass the thresholds."""
    i, j = (v.ravel() for v in np.indices((tile, tile)))
    i, j, n = i + a * tile, j + b * tile, total["n"]
    with np.errstate(divide="ignore", invalid="ignore"):
        mx, my = total["sx"] / n, total["sy"] / n
        cxx, cyy, cxy = total["sxx"] - n * mx * mx, total["syy"] - n * my * my, total["sxy"] - n * mx * my
        flat = (cxx <= 1e-12 * total["sxx"]) | (cyy <= 1e-12 * total["syy"])
        corr = np.where(flat, np.nan, cxy / np.sqrt(cxx * cyy))
        ok = (i < j) & (n >= max(min_common, 1)) & ((np.abs(corr) >= min_corr) | (min_corr <= 0))
    cols = [i, j, n.astype(np.int64), mx, my, cxx, cyy, cxy]
    return pa.RecordBatch.from_arrays([*[pa.array(c[ok]) for c in cols], pa.array(corr[ok], mask=np.isnan(corr[ok]))], ["i", "j", "n_common", "mean_x", "mean_y", "sxx", "syy", "sxy", "corr"])


def _add(tile: int, min_common: int, min_corr: float):
    """Adds up the slabs of each tile pair; rows come sorted by tile pair, so one sum is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                here = batch.column("a")[r].as_py(), batch.column("b")[r].as_py()
                if here != key:
                    if key:
                        yield _pairs_of(*key, total, tile, min_common, min_corr)
                    key, total = here, {c: np.zeros(tile * tile) for c in _STATS}
                for c in _STATS:
                    total[c] += batch.column(c)[r].values.to_numpy()
        if key:
            yield _pairs_of(*key, total, tile, min_common, min_corr)

    return run


def pair_statistics(series: DataFrame, key: str = "symbol", ts: str = "ts", x: str = "x", *, min_common: int = 1, min_corr: float = 0.0, tile: int = TILE, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """One row per unordered pair of instruments: left_symbol < right_symbol, n_common, mean_x, mean_y, sxx, syy, sxy, corr.

    x belongs to left_symbol, y to right_symbol; sxx, syy and sxy are centred sums over the timestamps that both have,
    corr is NULL where one of them is constant there. Pairs with fewer than min_common common timestamps or an absolute
    correlation under min_corr never leave their tile. NULL and NaN values and NULL keys or timestamps count as missing;
    an instrument has one value per timestamp.
    """
    d = series.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(x).cast("double").alias("x"))
    d = stored_table(d.where("k is not null and t is not null and x is not null and not isnan(x)"), "series")
    # values are taken from the instrument's mean, so that sums of squares keep their digits
    names = d.groupBy("k").agg(F.avg("x").alias("m")).withColumn("i", F.row_number().over(Window.orderBy("k")) - 1)
    names = stored_table(names, "instruments")
    slabs = max(1, -(-d.select(F.approx_count_distinct("t")).first()[0] // slab_rows))
    packed = d.join(names, "k").select(
        F.expr(f"i div {tile}").cast("int").alias("tile"), F.pmod(F.xxhash64("t"), F.lit(slabs)).alias("slab"), F.struct((F.col("i") % tile).alias("i"), "t", (F.col("x") - F.col("m")).alias("x")).alias("c"))
    packed = packed.groupBy("slab", "tile").agg(F.collect_list("c").alias("c"))
    number = F.transform("c", lambda e: F.unix_micros(e["t"].cast("timestamp")))
    packed = packed.select("slab", "tile", F.col("c.i").alias("i"), number.alias("t"), F.col("c.x").alias("x"))
    packed = stored_table(packed, "tiles")
    a = packed.select("slab", *[F.col(c).alias(n) for c, n in (("tile", "a"), ("i", "ia"), ("t", "ta"), ("x", "xa"))])
    b = packed.select("slab", *[F.col(c).alias(n) for c, n in (("tile", "b"), ("i", "ib"), ("t", "tb"), ("x", "xb"))])
    met = a.join(b, "slab").where("a <= b")
    parts = met.mapInArrow(_products(tile), "a int, b int, " + ", ".join(f"{c} array<double>" for c in _STATS))
    schema = "i long, j long, n_common long, mean_x double, mean_y double, sxx double, syy double, sxy double, corr double"
    pairs = parts.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_add(tile, min_common, min_corr), schema)
    left, right = names.select("i", F.col("k").alias("left_symbol"), F.col("m").alias("_ml")), names.select(F.col("i").alias("j"), F.col("k").alias("right_symbol"), F.col("m").alias("_mr"))
    out = pairs.join(left, "i").join(right, "j")
    return out.select(
        "left_symbol", "right_symbol", "n_common", (F.col("mean_x") + F.col("_ml")).alias("mean_x"), (F.col("mean_y") + F.col("_mr")).alias("mean_y"), "sxx", "syy", "sxy", "corr")
