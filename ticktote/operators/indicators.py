"""Price-series indicators: column families over one canonical sequence.

Each function adds its columns to bars (symbol, ts, open, high, low, close,
volume). Bars are one row per symbol and calendar bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktote.functions.core import Seq, flag, sdiv
from ticktote.operators.recurrence import ewm

SEQ = Seq("symbol", "ts")


def gain_loss(q: Seq, x: str = "close") -> tuple[Column, Column]:
    """Up and down moves; the first row has no move and counts as zero."""
    d = q.diff(x)
    return F.when(d > 0, d).otherwise(0.0), F.when(d < 0, -d).otherwise(0.0)


def rsi_from(g: Column, l: Column, zero_loss_is_100: bool = True) -> Column:
    r = 100 - 100 / (1 + F.try_divide(g, l))
    return F.when(g.isNull() | l.isNull(), None).when(l == 0, 100.0 if zero_loss_is_100 else None).otherwise(r)


def rsi_simple(df: DataFrame, n: int = 14, q: Seq = SEQ, out: str = "rsi", x: str = "close") -> DataFrame:
    g, l = gain_loss(q, x)
    d = df.withColumns({"_g": g, "_l": l})
    return d.withColumn(out, rsi_from(q.mean("_g", n), q.mean("_l", n))).drop("_g", "_l")


def rsi_smoothed(df: DataFrame, n: int = 14, wilder: bool = True, q: Seq = SEQ, out: str = "rsi_w") -> DataFrame:
    """Exponential RSI; NULL where there is no average loss. The first row has no move."""
    d1 = q.diff("close")
    d = df.withColumns({"_g": F.greatest(d1, F.lit(0.0)), "_l": F.greatest(-d1, F.lit(0.0))})
    d = d.withColumns({"_g": F.when(d1.isNotNull(), F.col("_g")), "_l": F.when(d1.isNotNull(), F.col("_l"))})
    p = {"alpha": 1.0 / n} if wilder else {"span": n}
    d = ewm(d, q, {"_ag": {"x": "_g", **p}, "_al": {"x": "_l", **p}})
    return d.withColumn(out, rsi_from(F.col("_ag"), F.col("_al"), False)).drop("_g", "_l", "_ag", "_al")


def macd(df: DataFrame, q: Seq = SEQ, fast: int = 12, slow: int = 26, signal: int = 9, sfx: str = "") -> DataFrame:
    d = ewm(df, q, {"_f": {"x": "close", "span": fast}, "_s": {"x": "close", "span": slow}})
    d = d.withColumn("macd" + sfx, F.col("_f") - F.col("_s")).drop("_f", "_s")
    d = ewm(d, q, {"macd_signal" + sfx: {"x": "macd" + sfx, "span": signal}})
    return d.withColumn("macd_hist" + sfx, F.col("macd" + sfx) - F.col("macd_signal" + sfx))


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, q: Seq = SEQ) -> DataFrame:
    d = df.withColumns({"_m": q.mean("close", n), "_s": q.sd("close", n)})
    up, lo = F.col("_m") + k * F.col("_s"), F.col("_m") - k * F.col("_s")
    return d.withColumns(
        {"bb_upper": up, "bb_lower": lo, "bb_width": sdiv(up - lo, F.col("_m")), "bb_pos": sdiv(F.col("close") - lo, up - lo)}
    ).drop("_m", "_s")


def moving_averages(df: DataFrame, ns: list[int], q: Seq = SEQ) -> DataFrame:
    return df.withColumns({f"ma_{n}": q.mean("close", n) for n in ns})


def true_range(q: Seq = SEQ) -> Column:
    """Largest of the three ranges; the first row has only high - low."""
    pc = q.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def atr_simple(df: DataFrame, n: int = 14, q: Seq = SEQ, out: str = "atr") -> DataFrame:
    d = df.withColumn("_tr", true_range(q))
    return d.withColumn(out, q.mean("_tr", n)).drop("_tr")


def atr_smoothed(df: DataFrame, n: int = 14, q: Seq = SEQ, out: str = "atr_e", wilder: bool = False, adjust: bool = False, min_periods: int = 1) -> DataFrame:
    d = df.withColumn("_tr", true_range(q))
    p = {"alpha": 1.0 / n} if wilder else {"span": n}
    return ewm(d, q, {out: {"x": "_tr", "adjust": adjust, "min_periods": min_periods, **p}}).drop("_tr")


def directional_moves(q: Seq = SEQ) -> tuple[Column, Column]:
    up, dn = q.diff("high"), -q.diff("low")
    return F.when((up > dn) & (up > 0), up).otherwise(0.0), F.when((dn > up) & (dn > 0), dn).otherwise(0.0)


def adx_simple(df: DataFrame, n: int = 14, q: Seq = SEQ) -> DataFrame:
    p, m = directional_moves(q)
    d = df.withColumns({"_tr": true_range(q), "_p": p, "_m": m})
    d = d.withColumns({"_a": q.mean("_tr", n), "_pm": q.mean("_p", n), "_mm": q.mean("_m", n)})
    d = d.withColumns({"plus_di": 100 * sdiv("_pm", "_a"), "minus_di": 100 * sdiv("_mm", "_a")})
    d = d.withColumn("_dx", 100 * sdiv(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    d = d.withColumns({"adx": q.mean("_dx", n), "di_diff": F.col("plus_di") - F.col("minus_di")})
    return d.drop("_tr", "_p", "_m", "_a", "_pm", "_mm", "_dx")


def adx_smoothed(df: DataFrame, n: int = 14, wilder: bool = False, q: Seq = SEQ, out: str = "adx_e") -> DataFrame:
    p, m = directional_moves(q)
    s = {"alpha": 1.0 / n} if wilder else {"span": n}
    d = df.withColumns({"_tr": true_range(q), "_p": p, "_m": m})
    d = ewm(d, q, {"_a": {"x": "_tr", **s}, "_pm": {"x": "_p", **s}, "_mm": {"x": "_m", **s}})
    d = d.withColumns({"_pd": 100 * sdiv("_pm", "_a"), "_md": 100 * sdiv("_mm", "_a")})
    d = d.withColumn("_dx", 100 * sdiv(F.abs(F.col("_pd") - F.col("_md")), F.col("_pd") + F.col("_md")))
    d = ewm(d, q, {out: {"x": "_dx", **s}})
    return d.withColumn(out + "_di_diff", F.col("_pd") - F.col("_md")).drop("_tr", "_p", "_m", "_a", "_pm", "_mm", "_pd", "_md", "_dx")


def stochastic(df: DataFrame, k: int = 14, dn: int = 3, q: Seq = SEQ) -> DataFrame:
    d = df.withColumns({"_hi": q.roll(F.max, "high", k), "_lo": q.roll(F.min, "low", k)})
    d = d.withColumn("stoch_k", 100 * sdiv(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    return d.withColumn("stoch_d", q.mean("stoch_k", dn)).drop("_hi", "_lo")


def williams_r(df: DataFrame, n: int = 14, q: Seq = SEQ) -> DataFrame:
    hi, lo = q.roll(F.max, "high", n), q.roll(F.min, "low", n)
    return df.withColumn("williams_r", -100 * sdiv(hi - F.col("close"), hi - lo))


def rolling_mad(x: str, n: int, q: Seq = SEQ) -> Column:
    """Mean absolute deviation around the mean of the same frame."""
    v, m = F.collect_list(x).over(q.last(n)), F.avg(x).over(q.last(n))
    s = F.aggregate(F.transform(v, lambda e: F.abs(e - m)), F.lit(0.0), lambda a, e: a + e)
    return F.when(F.count(x).over(q.last(n)) >= n, s / n)


def cci(df: DataFrame, n: int = 20, q: Seq = SEQ) -> DataFrame:
    d = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    d = d.withColumns({"_m": q.mean("_tp", n), "_mad": rolling_mad("_tp", n, q)})
    return d.withColumn("cci", sdiv(F.col("_tp") - F.col("_m"), 0.015 * F.col("_mad"))).drop("_tp", "_m", "_mad")


def mfi(df: DataFrame, n: int = 14, q: Seq = SEQ) -> DataFrame:
    d = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    d = d.withColumns({"_mf": F.col("_tp") * F.col("volume"), "_d": q.diff("_tp")})
    d = d.withColumns({"_pf": F.when(F.col("_d") > 0, F.col("_mf")).otherwise(0.0), "_nf": F.when(F.col("_d") < 0, F.col("_mf")).otherwise(0.0)})
    r = sdiv(q.roll(F.sum, "_pf", n), q.roll(F.sum, "_nf", n))
    return d.withColumn("mfi", 100 - 100 / (1 + r)).drop("_tp", "_mf", "_d", "_pf", "_nf")


def obv(df: DataFrame, change: int = 12, q: Seq = SEQ) -> DataFrame:
    d = df.withColumn("_sv", F.coalesce(F.signum(q.diff("close")), F.lit(0.0)) * F.col("volume"))
    d = d.withColumn("obv", F.sum("_sv").over(q.upto()))
    return d.withColumn("obv_chg", q.pct("obv", change)).drop("_sv")


def range_volatility(df: DataFrame, n: int = 24, q: Seq = SEQ) -> DataFrame:
    """Realised, Parkinson and Garman-Klass volatility over n rows."""
    lhl, lco = F.log(sdiv("high", "low")), F.log(sdiv("close", "open"))
    d = df.withColumns(
        {"_lr": F.log(sdiv(F.col("close"), q.lag("close"))), "_pk": lhl * lhl, "_gk": 0.5 * lhl * lhl - (2 * F.log(F.lit(2.0)) - 1) * lco * lco}
    )
    gk = q.mean("_gk", n)
    return d.withColumns(
        {
            "rv": q.sd("_lr", n),
            "parkinson": F.sqrt(q.mean("_pk", n) / (4 * F.log(F.lit(2.0)))),
            "garman_klass": F.when(gk >= 0, F.sqrt(gk)),
        }
    ).drop("_lr", "_pk", "_gk")


def volume_features(df: DataFrame, n: int = 20, q: Seq = SEQ) -> DataFrame:
    sv = F.coalesce(F.signum(q.diff("close")), F.lit(0.0)) * F.col("volume")
    d = df.withColumns({"vol_ratio": sdiv(F.col("volume"), q.mean("volume", n)), "_sv": sv})
    return d.withColumns(
        {"vol_spike": flag(F.col("vol_ratio") > 2), "vol_balance": sdiv(q.roll(F.sum, "_sv", n), q.roll(F.sum, "volume", n))}
    ).drop("_sv")


def returns(df: DataFrame, ks: list[int], q: Seq = SEQ, prefix: str = "ret") -> DataFrame:
    return df.withColumns({f"{prefix}_{k}": q.pct("close", k) for k in ks})


def rolling_pct_rank(x: str, n: int, q: Seq = SEQ, mode: str = "le", min_periods: int | None = None) -> Column:
    """Position of the current value in the last n values.

    le: share of frame values <= current; lt_prev: share of the n previous values
    < current; mean: average rank of the current value over the frame size.
    """
    c = F.col(x)
    w = q.before(n) if mode == "lt_prev" else q.last(n)
    v, cnt = F.collect_list(c).over(w), F.count(c).over(w)
    below, ties = F.size(F.filter(v, lambda e: e < c)), F.size(F.filter(v, lambda e: e == c))
    num = {"le": below + ties, "lt_prev": below, "mean": below + (ties + 1) / 2.0}[mode]
    return F.when((cnt >= (n if min_periods is None else min_periods)) & c.isNotNull(), num / cnt)


def adj_skew(x: str, n: int, q: Seq = SEQ) -> Column:
    """Bias-adjusted sample skewness of the last n values."""
    return q.roll(F.skewness, x, n) * ((n * (n - 1)) ** 0.5 / (n - 2))
