"""Ordered folds for state that no window can express.

Rows of a key are streamed in order through one small state object: Spark
shuffles by key and sorts inside partitions, batches pass through mapInPandas,
and only the state (not the group) is held in memory. A key is one sequence by
nature here, so the key is the unit of parallelism; filter rows that cannot
change the state before folding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def keyed_fold(df: DataFrame, keys: list[str], order: list[str], schema: str, init: Callable[[], Any], step: Callable[[Any, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """step(state, rows) gets consecutive rows of one key, mutates the state and returns output rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf[keys].astype(str).agg("\x1f".join, axis=1)
            block = (k != k.shift()).cumsum()
            for _, part in pdf.groupby(block, sort=False):
                name = k.loc[part.index[0]]
                if name != cur:
                    cur, state = name, init()
                out = step(state, part)
                if len(out):
                    yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def drawdown_stop(df: DataFrame, keys: list[str], order: list[str], ret: str, limit: float = 0.10, resume: float = 0.5) -> DataFrame:
    """Stop after a drawdown beyond `limit`, resume once pnl is back to `resume` of its peak.

    Adds traded (0/1) and cum; a stopped row is not traded.
    """

    class S:
        cum = peak = 0.0
        stopped = False

    def step(s: S, p: pd.DataFrame) -> pd.DataFrame:
        traded, cum = [], []
        for x in p[ret].to_numpy():
            go = True
            if s.stopped:
                if s.cum >= s.peak * resume:
                    s.stopped = False
                else:
                    go = False
            elif s.peak - s.cum > limit:
                s.stopped, go = True, False
            if go:
                s.cum += x
                s.peak = max(s.peak, s.cum)
            traded.append(int(go))
            cum.append(s.cum)
        return p.assign(traded=traded, cum=cum)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", traded int, cum double"
    return keyed_fold(df, keys, order, schema, S, step)


def dynamic_threshold(df: DataFrame, keys: list[str], order: list[str], conf: str, ret: str, base: float, slope: float = 2.0, cap: float = 0.15) -> DataFrame:
    """Accept a row when its confidence reaches base + min(slope x own drawdown, cap)."""

    class S:
        cum = peak = dd = 0.0

    def step(s: S, p: pd.DataFrame) -> pd.DataFrame:
        taken = []
        for c, x in zip(p[conf].to_numpy(), p[ret].to_numpy()):
            ok = c >= base + min(abs(s.dd) * slope, cap)
            if ok:
                s.cum += x
                s.peak = max(s.peak, s.cum)
                s.dd = s.cum - s.peak
            taken.append(int(ok))
        return p.assign(taken=taken)

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", taken int"
    return keyed_fold(df, keys, order, schema, S, step)


def elo(df: DataFrame, pool: str, order: list[str], race: str, who: str, rank: str, k: float = 32.0, start: float = 1500.0) -> DataFrame:
    """Rating of every participant before each race; all pairs of a race update together.

    Pools are independent leagues and run in parallel; inside a pool ratings
    depend on every earlier race. Rows of one race must be consecutive in `order`.
    """
    cols = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rating: dict = {}
        cur_pool, held = None, None
        for pdf in _with_end(batches):
            if pdf is None:
                if held is None:
                    return
                pdf, closing = held, True
            else:
                pdf, closing = (pdf if held is None else pd.concat([held, pdf], ignore_index=True)), False
            pools, races = pdf[pool].to_numpy(), pdf[race].to_numpy()
            names, ranks = pdf[who].tolist(), pdf[rank].to_numpy(dtype=float)
            cut = np.flatnonzero((pools[1:] != pools[:-1]) | (races[1:] != races[:-1])) + 1
            edges = [0, *cut.tolist(), len(pdf)]
            stop = len(edges) - 1 if closing else len(edges) - 2
            pre = np.empty(len(pdf))
            for i in range(stop):
                lo, hi = edges[i], edges[i + 1]
                if pools[lo] != cur_pool:
                    cur_pool, rating = pools[lo], {}
                r = np.array([rating.get(n, start) for n in names[lo:hi]])
                pre[lo:hi] = r
                n = hi - lo
                if n > 1:
                    expect = 1.0 / (1.0 + 10.0 ** ((r[None, :] - r[:, None]) / 400.0))
                    rk = ranks[lo:hi]
                    actual = (rk[:, None] < rk[None, :]) + 0.5 * (rk[:, None] == rk[None, :])
                    # an entry against itself contributes 0.5 - 0.5
                    delta = (actual - expect).sum(axis=1) * (k / (n - 1))
                    for name, x in zip(names[lo:hi], delta.tolist()):
                        rating[name] = rating.get(name, start) + x
            done = edges[stop]
            held = None if closing else pdf.iloc[done:]
            if done:
                yield pdf.iloc[:done][cols].assign(elo=pre[:done])
            if closing:
                return

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", elo double"
    return df.repartition(pool).sortWithinPartitions(pool, *order).mapInPandas(run, schema)


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    for b in batches:
        if not b.empty:
            yield b
    yield None
