"""Sequences, smoothing, as-of joins and barriers against pandas twins, with edge rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticktote.functions.core import Seq, clip
from ticktote.operators.gram import pair_statistics
from ticktote.operators.scan import _chunk_of, chunked, prefix_scan
from ticktote.operators import indicators as ind
from ticktote.operators import sequence as sq
from ticktote.operators.asof import asof, asof_nearest
from ticktote.operators.automaton import pair_position, state_scan
from ticktote.operators.pyramid import long_exits
from ticktote.operators.quantiles import exact_quantiles
from ticktote.operators.recurrence import ewm
from ticktote.operators.touch import first_touch, triple_barrier

Q = Seq("symbol", "ts")
T0 = pd.Timestamp("2024-01-01")


def frame(n=120, nulls=False, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for s, m in (("A", n), ("B", 7), ("C", 1)):
        c = 100 + rng.normal(0, 1, m).cumsum()
        p = pd.DataFrame({"symbol": s, "ts": T0 + pd.to_timedelta(np.arange(m), "h"), "close": c})
        p["open"] = p["close"].shift(1).fillna(p["close"])
        p["high"], p["low"], p["volume"] = p[["open", "close"]].max(axis=1) + 0.5, p[["open", "close"]].min(axis=1) - 0.5, 10.0
        if nulls:
            p.loc[p.index % 5 == 2, "close"] = np.nan
            p.loc[p.index == 0, "close"] = np.nan
        out.append(p)
    return pd.concat(out, ignore_index=True)


def sdf(spark, p):
    d = spark.createDataFrame(p)
    return d.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


def col(d, c, keys=("symbol", "ts")):
    return d.toPandas().sort_values(list(keys))[c].to_numpy(dtype=float)


@pytest.mark.parametrize("mp", [None, 3])
def test_rolling_guard_counts_non_null(spark, mp):
    p = frame(nulls=True)
    got = col(sdf(spark, p).withColumn("m", Q.mean("close", 6, mp)).withColumn("s", Q.sd("close", 6, mp)), "m")
    want = p.groupby("symbol")["close"].transform(lambda x: x.rolling(6, min_periods=mp).mean()).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("nulls", [False, True])
@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("span", [2, 12, 40])
def test_ewm_matches_pandas(spark, nulls, adjust, span):
    p = frame(600, nulls=nulls)
    got = col(ewm(sdf(spark, p), Q, {"e": {"x": "close", "span": span, "adjust": adjust, "min_periods": 4}}), "e")
    want = p.groupby("symbol")["close"].transform(lambda x: x.ewm(span=span, adjust=adjust, min_periods=4).mean()).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9, equal_nan=True)


def test_rsi_edges(spark):
    up = pd.DataFrame({"symbol": "U", "ts": T0 + pd.to_timedelta(np.arange(20), "h"), "close": np.arange(20.0) + 1})
    flat = up.assign(symbol="F", close=5.0)
    d = ind.rsi_simple(spark.createDataFrame(pd.concat([up, flat]))).toPandas()
    assert (d[d.rsi.notna()].rsi == 100).all() and d.groupby("symbol").rsi.count().eq(7).all()
    w = ind.rsi_smoothed(spark.createDataFrame(pd.concat([up, flat]))).toPandas()
    assert w.rsi_w.isna().all()


def test_numbering_running_and_halo(spark):
    p = frame(300)
    d = sdf(spark, p)
    num = sq.number_rows(d, ["symbol"], ["ts"])
    assert (col(num, "pos") == p.groupby("symbol").cumcount().to_numpy()).all()
    run = sq.running(d.withColumn("x", F.col("close") - 100), ["symbol"], ["ts"], {"cum": "x"}, {"peak": "cum"})
    cum = p.assign(x=p.close - 100).groupby("symbol")["x"].cumsum()
    np.testing.assert_allclose(col(run, "cum"), cum, rtol=1e-9)
    np.testing.assert_allclose(col(run, "peak"), cum.groupby(p.symbol).cummax(), rtol=1e-9)
    h = sq.with_halo(num, ["symbol"], "pos", 32, back=19, ahead=3)
    qc = Seq(["symbol", "chunk_id"], "pos")
    h = h.withColumns({"m": qc.mean("close", 20), "nx": qc.lead("close", 3)}).where("is_core")
    np.testing.assert_allclose(col(h, "m"), p.groupby("symbol")["close"].transform(lambda x: x.rolling(20).mean()), equal_nan=True)
    np.testing.assert_allclose(col(h, "nx"), p.groupby("symbol")["close"].shift(-3), equal_nan=True)
    with pytest.raises(ValueError):
        sq.with_halo(num, ["symbol"], "pos", 8, back=9)


@pytest.mark.parametrize("horizon,block", [(10_000, None), (37, 4), (1, None)])
def test_long_exits_over_the_pyramid(spark, horizon, block):
    rng = np.random.default_rng(12)
    cells, parts = [(3.0, 5.0), (20.0, 20.0), (500.0, 900.0)], []
    for k, n in (("a", 700), ("b", 45), ("c", 1)):
        close = 100 + rng.standard_normal(n).cumsum()
        parts.append(pd.DataFrame({"symbol": k, "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "close": close, "high": close + rng.random(n), "low": close - rng.random(n), "side": rng.choice([1, -1], n), "unit": 1.0}))
    p = pd.concat(parts, ignore_index=True)
    d = spark.createDataFrame(p).withColumn("unit", F.when(F.hour("ts") != 5, F.col("unit")))
    got = long_exits(d, ["symbol"], ["ts"], cells, "side", "unit", horizon, block).toPandas()
    want = {}
    for k, g in p.groupby("symbol"):
        c, hi, lo, sd, ts = (g[x].to_numpy() for x in ("close", "high", "low", "side", "ts"))
        for i in range(len(g)):
            for sl, tp in cells:
                stop, take = c[i] - sd[i] * sl, c[i] + sd[i] * tp
                out = (None, None, None)
                if pd.Timestamp(ts[i]).hour != 5 and i + 1 < len(g):
                    end = min(i + horizon, len(g) - 1)
                    out = ("time_exit", c[end], end - i)
                    a, z = slice(i + 1, end + 1), sd[i] > 0
                    s, t = (lo[a] <= stop, hi[a] >= take) if z else (hi[a] >= stop, lo[a] <= take)
                    if (s | t).any():
                        j = int(np.argmax(s | t))
                        out = ("stop_loss", stop, j + 1) if s[j] else ("take_profit", take, j + 1)
                want[k, pd.Timestamp(ts[i]), sl, tp] = out
    assert len(got) == len(want)
    for r in got.itertuples():
        why, price, held = want[r.symbol, r.ts, r.sl_mult, r.tp_mult]
        assert (r.exit_reason if isinstance(r.exit_reason, str) else None) == why
        assert why is None or (abs(r.exit_price - price) < 1e-9 and r.bars_held == held)


@pytest.mark.parametrize("tile,slab", [(64, 4096), (3, 20)])
def test_pair_statistics(spark, tile, slab):
    """All pairs against pandas: missing rows, NULLs, NaN, a constant, a NULL key, an instrument without company."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal(90).cumsum()
    wide = pd.DataFrame({f"s{i}": 1e4 * i + base * (i % 3 - 1) + rng.standard_normal(90) for i in range(8)}, index=pd.date_range("2024-01-01", periods=90, freq="h"))
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide["flat"] = 7.25
    wide.loc[wide.index[10:], "s7"] = np.nan
    long = wide.rename_axis("ts").reset_index().melt("ts", var_name="symbol", value_name="x")
    d = spark.createDataFrame(long).unionByName(spark.createDataFrame([(pd.Timestamp("2024-01-01").to_pydatetime(), None, 1.0), (pd.Timestamp("2031-01-01").to_pydatetime(), "alone", 1.0)], "ts timestamp, symbol string, x double"))
    got = pair_statistics(d, tile=tile, slab_rows=slab).toPandas().set_index(["left_symbol", "right_symbol"]).sort_index()
    want = {}
    for i, a in enumerate(sorted(wide)):
        for b in sorted(wide)[i + 1 :]:
            both = wide[[a, b]].dropna()
            if len(both):
                c = both.cov(ddof=0).to_numpy() * len(both)
                want[a, b] = (len(both), both[a].mean(), both[b].mean(), c[0, 0], c[1, 1], c[0, 1], both[a].corr(both[b]) if "flat" not in (a, b) and len(both) > 1 else np.nan)
    assert list(got.index) == sorted(want)
    np.testing.assert_allclose(got.to_numpy(dtype=float), np.array([want[k] for k in got.index]), rtol=1e-7, atol=1e-7, equal_nan=True)
    few = pair_statistics(d, tile=tile, slab_rows=slab, min_common=30, min_corr=0.5).toPandas()
    assert {(a, b) for a, b in zip(few.left_symbol, few.right_symbol)} == {k for k, v in want.items() if v[0] >= 30 and abs(v[-1]) >= 0.5}
    assert pair_statistics(d.limit(0)).count() == 0


def test_plan_of_many_instruments_stays_small(spark):
    d = spark.range(4000).select((F.col("id") % 2000).cast("string").alias("symbol"), F.timestamp_seconds(F.col("id") % 7).alias("ts"), F.rand(1).alias("x"))
    plan = lambda f: len(f._jdf.queryExecution().optimizedPlan().toString())
    assert plan(pair_statistics(d)) < 2 * plan(pair_statistics(d.where("symbol < '11'")))


@pytest.mark.parametrize("chunk,levels", [(4, 2), (3, 0), (128, 2)])
def test_state_scan_over_levels(spark, chunk, levels):
    rng = np.random.default_rng(4)
    p = pd.DataFrame({"k": ["a"] * 500 + ["b"] * 7, "pos": [*range(500), *range(7)], "z": rng.standard_normal(507) * 2})
    got = state_scan(spark.createDataFrame(p), ["k"], "pos", ["z"], lambda s, e: pair_position(s, e["z"]), 3, chunk=chunk, levels=levels).toPandas().sort_values(["k", "pos"])
    want = []
    for _, part in p.groupby("k"):
        s = 0
        for z in part.z:
            s = 0 if abs(z) >= 4 or (s and abs(z) <= 0.5) else s or (2 if z >= 2 else 1 if z <= -2 else 0)
            want.append(s)
    assert got.state.tolist() == want


@pytest.mark.parametrize("chunks", [1, 3, 64, 200])
def test_prefix_scan_of_one_hot_key(spark, chunks):
    """One key holds most rows, all in one month and many on one day; small keys, a NULL key and NULL values beside it."""
    rng = np.random.default_rng(8)
    n = 3000
    p = pd.DataFrame({"k": np.where(rng.random(n) < 0.9, "hot", rng.choice(list("abc"), n)), "d": pd.Timestamp("2024-05-03") + pd.to_timedelta(rng.integers(0, 4, n), "D"), "i": rng.permutation(n), "x": rng.integers(-5, 6, n).astype(float)})
    d = spark.createDataFrame(p).withColumn("x", F.when(F.col("i") % 50 != 0, F.col("x"))).withColumn("k", F.when(F.col("i") % 97 != 0, F.col("k")))
    got = prefix_scan(d, ["k"], ["d", "i"], sums={"s": "x"}, peaks={"top": "s", "at_gain": ("s", F.col("x") > 0)}, maxima={"m": "x"}, position="pos", size="n", chunks=chunks)
    got = got.where("k is not null").toPandas().sort_values(["k", "d", "i"]).reset_index(drop=True)
    g = got.groupby("k")
    s = got.x.fillna(0).groupby(got.k).cumsum()
    np.testing.assert_allclose(got.s, s, atol=1e-9)
    np.testing.assert_allclose(got.top, s.groupby(got.k).cummax(), atol=1e-9)
    gains = s.where(got.x > 0).groupby(got.k).cummax().groupby(got.k).ffill()
    np.testing.assert_allclose(got.at_gain, gains, atol=1e-9)
    np.testing.assert_allclose(got.m, got.x.groupby(got.k).cummax().groupby(got.k).ffill(), atol=1e-9)
    assert (got.pos == g.cumcount()).all() and (got.n == g.k.transform("size")).all()
    empty = prefix_scan(d.limit(0), ["k"], ["d", "i"], sums={"s": "x"}, position="pos", chunks=chunks)
    assert empty.count() == 0


def test_chunks_split_a_hot_key_evenly(spark):
    d = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("k"), F.lit("2024-01-01").cast("date").alias("day"), "id")
    sizes = chunked(d, ["k"], ["day", "id"], chunks=16).where("k = 99").groupBy("_chunk").count().toPandas()["count"]
    assert len(sizes) >= 12 and sizes.max() < 3 * 20_000 / 16


@pytest.mark.parametrize("cuts,size", [(0, 1), (5, 8), (64, 64), (65, 65), (300, 300), (250, 300)])
def test_chunk_of_counts_cut_points(spark, cuts, size):
    points = [3 * i for i in range(cuts)]
    d = spark.range(-5, 3 * cuts + 5).withColumn("cuts", F.array(*[F.lit(float(p)) for p in points]) if cuts else F.array().cast("array<double>"))
    got = d.select("id", _chunk_of(F.col("cuts"), F.col("id").cast("double"), size).alias("c")).collect()
    assert all(r["c"] == sum(p <= r["id"] for p in points) for r in got)


def test_losing_streak_ignores_zero(spark):
    pnl = [-1, -1, 0, -1, 2, -1, 0, 0, -1, -1, 1, 0, -1]
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(pnl)], "k string, t int, pnl double")
    got = sq.losing_streak(d, ["k"], ["t"], "pnl", chunks=5).orderBy("t").toPandas().streak.tolist()
    want, s = [], 0
    for v in pnl:
        s = s + 1 if v < 0 else 0 if v > 0 else s
        want.append(s)
    assert got == want


@pytest.mark.parametrize("period", [None, "day"])
def test_asof_backward_null_row_and_tolerance(spark, period):
    left = pd.DataFrame({"symbol": ["A"] * 5 + ["B"], "ts": [T0 + pd.Timedelta(h, "h") for h in (-1, 0, 5, 30, 80, 3)], "i": range(6)})
    right = pd.DataFrame({"symbol": ["A"] * 3, "ts": [T0, T0 + pd.Timedelta("4h"), T0 + pd.Timedelta("28h")], "v": [1.0, np.nan, 3.0], "w": [10, 20, 30]})
    r = sdf(spark, right)
    d = asof(spark.createDataFrame(left), r, by=["symbol"], period=period).toPandas().sort_values("i")
    np.testing.assert_array_equal(d.w.to_numpy(dtype=float), [np.nan, 10, 20, 30, 30, np.nan])
    assert np.isnan(d.v.iloc[2])  # the last row wins even if its value is NULL
    t = asof(spark.createDataFrame(left), r, by=["symbol"], period=period, tolerance_s=3600).toPandas().sort_values("i")
    np.testing.assert_array_equal(t.w.to_numpy(dtype=float), [np.nan, 10, 20, np.nan, np.nan, np.nan])
    f = asof(spark.createDataFrame(left), r, by=["symbol"], period=period, forward=True).toPandas().sort_values("i")
    np.testing.assert_array_equal(f.w.to_numpy(dtype=float), [10, 10, 30, np.nan, np.nan, np.nan])


def test_asof_nearest_tie_is_earlier(spark):
    left = spark.createDataFrame(pd.DataFrame({"ts": [T0 + pd.Timedelta("1h")], "i": [0]}))
    right = spark.createDataFrame(pd.DataFrame({"ts": [T0, T0 + pd.Timedelta("2h")], "v": [1.0, 2.0]}))
    assert asof_nearest(left, right).toPandas().v.tolist() == [1.0]


def test_first_touch_stop_wins_and_time_exit(spark):
    hi, lo, c = [10, 12, 10.1, 10.2], [10, 8, 9.9, 9.8], [10, 10, 10, 10.1]
    p = pd.DataFrame({"symbol": "A", "ts": T0 + pd.to_timedelta(range(4), "h"), "high": hi, "low": lo, "close": c}).astype({"close": float, "high": float, "low": float})
    d = first_touch(spark.createDataFrame(p), Q, F.lit(11.0), F.lit(9.0), F.lit(1), 3).orderBy("ts").toPandas()
    assert d.exit_reason.tolist()[:3] == ["stop_loss", "time_exit", "time_exit"] and d.exit_reason.iloc[3] is None
    assert d.exit_price.iloc[0] == 9.0 and d.bars_held.iloc[1] == 2


def test_triple_barrier_brute_force(spark):
    p = frame(80)
    got = col(triple_barrier(sdf(spark, p), Q, 0.01, -0.008, 10), "label")
    want = []
    for _, g in p.groupby("symbol"):
        c = g.close.to_numpy()
        for i in range(len(c)):
            if len(c) - i <= 10:
                want.append(np.nan)
                continue
            lab = 2
            for k in range(1, 11):
                x = c[i + k] / c[i] - 1
                if x >= 0.01:
                    lab = 1
                    break
                if x <= -0.008:
                    lab = 0
                    break
            want.append(lab)
    np.testing.assert_array_equal(got, want)


def test_state_scan_matches_loop(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(0, 2, 700)
    d = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(z)], "k string, pos int, z double")
    got = state_scan(d, ["k"], "pos", ["z"], lambda s, e: pair_position(s, e["z"]), 3, chunk=64).orderBy("pos").toPandas().state.tolist()
    want, s = [], 0
    for v in z:
        a = abs(v)
        s = 0 if a >= 4 or (s and a <= 0.5) else s if s else 2 if v >= 2 else 1 if v <= -2 else 0
        want.append(s)
    assert got == want


def test_exact_quantiles_with_ties_and_skew(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"k": ["a"] * 3000 + ["b"] * 3, "x": np.r_[np.where(rng.random(3000) < 0.6, 1.0, rng.exponential(5, 3000)), [1.0, 2.0, 4.0]]})
    d = exact_quantiles(spark.createDataFrame(p), ["k"], "x", {"q10": 0.1, "q50": 0.5, "q98": 0.98, "q100": 1.0}).toPandas().set_index("k")
    for k, g in p.groupby("k"):
        np.testing.assert_allclose(d.loc[k, ["q10", "q50", "q98", "q100"]].astype(float), np.quantile(g.x, [0.1, 0.5, 0.98, 1.0]), rtol=1e-12)


def test_clip_keeps_null(spark):
    d = spark.range(1).select(clip(F.lit(None).cast("double"), -1, 1).alias("c"), clip(F.lit(3.0), -1, 1).alias("d")).first()
    assert d.c is None and d.d == 1.0


def test_features_do_not_look_ahead(spark):
    from ticktote.plans.features import base_features, multi_timeframe

    p = frame(400)
    cut = T0 + pd.Timedelta(300, "h")
    q = p.copy()
    q.loc[q.ts >= cut, ["open", "high", "low", "close"]] *= 3
    for f in (base_features, lambda b: multi_timeframe(b, [("4 hours", "4h"), ("day", "1d")], with_macd=False)):
        a, b = (f(sdf(spark, x)).where(F.col("ts") < F.lit(cut)).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for x in (p, q))
        pd.testing.assert_frame_equal(a, b)


def test_partition_invariance(spark):
    p = frame(200)
    outs = []
    for n in ("1", "3", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        d = sdf(spark, p.sample(frac=1, random_state=int(n)))
        d = ewm(d, Q, {"e": {"x": "close", "span": 9}}).withColumn("r", ind.rolling_pct_rank("close", 20))
        outs.append(d.select("symbol", "ts", "e", "r").toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    pd.testing.assert_frame_equal(outs[0], outs[1])
    pd.testing.assert_frame_equal(outs[0], outs[2])
