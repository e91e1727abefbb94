"""Composite feature sets over bars and auxiliary series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticktote.functions import calendar as cal
from ticktote.functions.core import Seq, flag, sdiv
from ticktote.operators import indicators as ind
from ticktote.operators.asof import asof
from ticktote.operators.resample import resample
from ticktote.operators.sequence import key_join


def multi_timeframe(bars: DataFrame, frames: list[tuple[str, str]], shift: int = 1, with_macd: bool = True) -> DataFrame:
    """Indicators of coarser bars on every base bar, from completed bars only.

    `shift` bars are held back: 1 uses the last completed coarse bar, 0 the still
    open one (for comparison).
    """
    q = Seq("symbol", "ts")
    out = bars.select("symbol", "ts")
    for unit, name in frames:
        c = ind.rsi_simple(resample(bars, unit))
        c = c.withColumn("_w", sdiv(4 * q.sd("close", 20), q.mean("close", 20)))
        cols = {f"rsi_{name}": "rsi", f"bb_width_{name}": "_w"}
        if with_macd:
            c = ind.macd(c)
            cols[f"macd_hist_{name}"] = "macd_hist"
        c = c.select("symbol", "ts", *[(q.lag(v, shift) if shift else F.col(v)).alias(k) for k, v in cols.items()])
        out = asof(out, c, by=["symbol"])
    return out


def daily_trend(bars: DataFrame, daily: DataFrame, long: int = 200, short: int = 20) -> DataFrame:
    """Daily close against its long mean and the short mean's direction, carried to the bars."""
    q = Seq("symbol", "ts")
    d = daily.withColumns({"_m": q.mean("close", long), "_s": q.mean("close", short)})
    d = d.select(
        "symbol",
        "ts",
        flag(F.col("close") > F.col("_m")).alias("trend_flag"),
        sdiv(F.col("close") - F.col("_m"), F.col("_m")).alias("trend_strength"),
        flag(F.col("_s") > q.lag("_s")).alias("ma_dir"),
    )
    return asof(bars, d, by=["symbol"]).fillna({"trend_flag": 0, "trend_strength": 0.0, "ma_dir": 0})


def macro_surprise(times: DataFrame, series: DataFrame, signs: dict[str, tuple[str, int]], window: int = 6, min_periods: int = 3, release_lag_days: int = 0) -> DataFrame:
    """Signed z-score of each series against its own recent values, carried forward, and their mean."""
    q = Seq("series_id", "ts")
    z = series.withColumn("_z", F.coalesce(q.zscore("value", window, min_periods), F.lit(0.0)))
    if release_lag_days:
        z = z.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(release_lag_days)))
    out = times
    for name, (sid, sign) in signs.items():
        s = z.where(F.col("series_id") == sid).select("ts", (F.col("_z") * sign).alias(name))
        out = asof(out, s, period="year").fillna({name: 0.0})
    n = len(signs)
    return out.withColumn("surprise_composite", sum((F.col(c) for c in signs), F.lit(0.0)) / n)


def position_features(cot: DataFrame, q: Seq) -> DataFrame:
    """Net positions over open interest, normalised change, 26-period z-score, change of open interest."""
    d = cot.withColumn("_ch", q.diff("spec_net")).withColumn("_ac", F.abs("_ch"))
    zero = F.lit(0.0)
    return d.select(
        *q.keys,
        "ts",
        F.coalesce(sdiv("spec_net", "oi"), zero).alias("spec_net_norm"),
        F.coalesce(sdiv("comm_net", "oi"), zero).alias("comm_net_norm"),
        F.coalesce(sdiv(F.col("_ch"), q.mean("_ac", 26, 4)), zero).alias("spec_net_change"),
        F.coalesce(q.zscore("spec_net", 26, 8), zero).alias("spec_zscore"),
        F.coalesce(q.pct("oi"), zero).alias("oi_change"),
    )


def cross_pair_features(times: DataFrame, bars: DataFrame, symbols: list[str], strength: tuple[str, str]) -> DataFrame:
    """Return and RSI columns of other instruments carried to the given times; missing values are 0."""
    q = Seq("symbol", "ts")
    f = ind.rsi_simple(ind.returns(bars.where(F.col("symbol").isin(symbols)), [1, 6]))
    f = f.withColumn("rsi", F.when(F.col("rsi") != 100, F.col("rsi")))
    wide = f.groupBy("ts").agg(
        *[
            F.max(F.when(F.col("symbol") == s, F.col(c))).alias(f"{s}_{n}")
            for s in symbols
            for c, n in (("ret_1", "ret1"), ("ret_6", "ret6"), ("rsi", "rsi"))
        ]
    )
    d = asof(times, wide, period="week").fillna(0.0)
    a, b = strength
    return d.withColumn("base_strength", -(F.col(f"{a}_ret1") + F.col(f"{b}_ret1")) / 2)


def leave_one_out(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """Group mean without the own value; groups are pre-aggregated, then joined back."""
    g = df.groupBy(*keys).agg(F.sum(x).alias("_s"), F.count(x).alias("_n"))
    d = key_join(df, g, keys)
    return d.withColumn(out, sdiv(F.col("_s") - F.col(x), F.col("_n") - 1)).drop("_s", "_n")


def rule_regime(df: DataFrame, atr_share: float, adx_min: float) -> DataFrame:
    """Three labels from volatility (ATR over price) and trend strength (ADX)."""
    trend, vol = F.col("adx") >= adx_min, sdiv("atr", "close") >= atr_share
    lab = F.when(trend & vol, "HIGH_VOL_TREND").when(trend & ~vol, "LOW_VOL_TREND").otherwise("RANGE")
    return df.withColumn("regime", F.when(F.col("atr").isNull() | F.col("adx").isNull(), "RANGE").otherwise(lab))


BASE_COLUMNS = [
    "rsi", "macd", "macd_hist", "bb_width", "ma_25", "ret_1", "ret_3", "ret_6", "ret_24", "vol_24", "hour", "dow",
    "hour_sin", "hour_cos", "ma_5", "ma_75", "bb_pos", "abs_ret_1", "hl_ratio", "ma_cross",
]


def base_features(bars: DataFrame) -> DataFrame:
    """The 20-column technical set of one bar."""
    q = Seq("symbol", "ts")
    d = ind.bollinger(ind.macd(ind.rsi_simple(bars)))
    d = cal.time_parts(ind.returns(ind.moving_averages(d, [5, 25, 75]), [1, 3, 6, 24]))
    d = d.withColumns(
        {
            "vol_24": q.sd("ret_1", 24),
            "abs_ret_1": F.abs("ret_1"),
            "hl_ratio": sdiv(F.col("high") - F.col("low"), F.col("close")),
            "ma_cross": sdiv(F.col("ma_5") - F.col("ma_75"), F.col("close")),
        }
    )
    return d.select("symbol", "ts", *BASE_COLUMNS)


def stock_baseline(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per (target, leader) of pairs: the target's returns, RSI, volume ratio and volatility, and the leader's previous return."""
    q = Seq("symbol", "ts")
    f = ind.returns(ind.rsi_simple(bars), [1, 5, 20])
    f = f.withColumns({"volume_ratio": sdiv(F.col("volume"), q.mean("volume", 20)), "vol_20": q.sd("ret_1", 20), "us_prev": q.lag("ret_1")})
    lead = f.select(F.col("symbol").alias("leader"), "ts", "us_prev")
    d = f.select(
        F.col("symbol").alias("target"), "ts", F.col("ret_1").alias("target_ret_1"), F.col("ret_5").alias("target_ret_5"), F.col("ret_20").alias("target_ret_20"), "rsi", "volume_ratio", "vol_20"
    )
    d = d.join(pairs, "target").join(lead, ["leader", "ts"], "left")
    return d.withColumn("rsi_x_us", F.col("rsi") * F.col("us_prev"))
