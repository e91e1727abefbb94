"""Finite-state scans: positions that open, hold and close by rules.

A transition is a map on a handful of states and maps compose associatively, so
a key is cut into chunks of rows: each chunk is reduced to the map from its
incoming to its outgoing state, chunks of chunks are reduced in the same way, and
each chunk then replays its rows from the now known incoming state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold_chunks(df: DataFrame, keys: list[str], pos: str, cols: list[str], chunk: int) -> DataFrame:
    """(keys, _c, _rows): the rows of each chunk in order."""
    d = df.withColumn("_c", F.expr(f"{pos} div {chunk}"))
    return d.groupBy(*keys, "_c").agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("_o"), *cols))).alias("_rows"))


def _entry_states(maps: DataFrame, keys: list[str], states: int, chunk: int, levels: int) -> DataFrame:
    """(keys, _c, _in): the state before each chunk. maps: keys, _c, _map.

    Maps of chunks are rows of the same problem, so chunks of chunks are mapped in turn; the last level folds what is
    left of a key, one map for chunk ** levels rows.
    """
    look = lambda s, e: F.get(e["_map"], s)
    if levels == 0:
        per = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_c", "_map"))).alias("_rows")).withColumn("_in", F.lit(0))
    else:
        upper = _fold_chunks(maps.withColumnRenamed("_c", "_p"), keys, "_p", ["_map"], chunk)
        folded = upper.select(*keys, "_c", F.array(*[F.aggregate("_rows", F.lit(s), lambda a, e: look(a, e).cast("int")) for s in range(states)]).alias("_map"))
        per = upper.join(_entry_states(folded, keys, states, chunk, levels - 1), [*keys, "_c"])
        per = per.select(*keys, F.transform("_rows", lambda e: F.struct(e["_o"].alias("_c"), e["_map"].alias("_map"))).alias("_rows"), "_in")
    start = F.struct(F.array().cast("array<int>").alias("o"), F.col("_in").cast("int").alias("s"))
    ins = F.aggregate("_rows", start, lambda a, e: F.struct(F.array_append(a["o"], a["s"]).alias("o"), look(a["s"], e).cast("int").alias("s")), lambda a: a["o"])
    per = per.select(*keys, F.explode(F.arrays_zip(F.transform("_rows", lambda e: e["_c"]).alias("_c"), ins.alias("_in"))).alias("z"))
    return per.select(*keys, "z._c", "z._in")


def state_scan(
    df: DataFrame, keys: list[str], pos: str, cols: list[str], step: Callable[[Column, Column], Column], states: int, out: str = "state", chunk: int = 128, levels: int = 2
) -> DataFrame:
    """Adds the state after each row; the start state is 0. `step(state, row)` gives the next state.

    No array is longer than chunk, but for the last level's, which has one entry for chunk ** (levels + 1) rows of a key.
    """
    ch = _fold_chunks(df, keys, pos, cols, chunk)
    maps = ch.select(*keys, "_c", F.array(*[F.aggregate("_rows", F.lit(s), lambda a, e: step(a, e).cast("int")) for s in range(states)]).alias("_map"))
    ch = ch.join(_entry_states(maps, keys, states, chunk, levels), [*keys, "_c"], "inner")
    start = F.struct(F.array().cast("array<int>").alias("o"), F.col("_in").alias("s"))

    def emit(a, e):
        nxt = step(a["s"], e).cast("int")
        return F.struct(F.array_append(a["o"], nxt).alias("o"), nxt.alias("s"))

    path = F.aggregate("_rows", start, emit, lambda a: a["o"])
    res = ch.select(*keys, F.explode(F.arrays_zip(F.transform("_rows", lambda e: e["_o"]).alias(pos), path.alias(out))).alias("z"))
    res = res.select(*keys, F.col(f"z.{pos}").alias(pos), F.col(f"z.{out}").alias(out))
    return df.join(res, [*keys, pos], "inner")


def pair_position(state: Column, z: Column, entry: float = 2.0, exit_: float = 0.5, stop: float = 4.0) -> Column:
    """0 flat, 1 long the spread, 2 short the spread."""
    a = F.abs(z)
    flat = F.when(z >= entry, 2).when(z <= -entry, 1).otherwise(0)
    return F.when(z.isNull(), state).when(a >= stop, 0).when((state != 0) & (a <= exit_), 0).when(state == 0, flat).otherwise(state)
