"""Windows, calendar columns and indicators over bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticktote.catalog.common_sql import BARS, DAILY, lag, r, roll
from ticktote.catalog.registry import query
from ticktote.functions import calendar as cal
from ticktote.functions.core import Seq, flag, rnd, rounded, sdiv
from ticktote.operators import indicators as ind
from ticktote.operators import sequence as sq
from ticktote.operators.recurrence import ewm
from ticktote.operators.resample import resample

Q = Seq("symbol", "ts")
W = "OVER (PARTITION BY symbol ORDER BY ts)"


def ema_sql(name: str, src: str, x: str, alpha: str) -> str:
    """Recursive twin of the exponential mean, one row per step."""
    return f"""{name}_n AS (SELECT symbol, ts, CAST({x} AS DOUBLE) AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn
 FROM {src} WHERE ({x}) IS NOT NULL), {name} AS (SELECT symbol, ts, rn, x AS y FROM {name}_n WHERE rn = 1 UNION ALL
 SELECT n.symbol, n.ts, n.rn, (1 - {alpha}) * p.y + {alpha} * n.x FROM {name} p JOIN {name}_n n ON n.symbol = p.symbol AND n.rn = p.rn + 1)"""


@query("t1_ohlcv_resample", f"""WITH {BARS} SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts,
 {r('first(open ORDER BY ts)')} AS open, {r('max(high)')} AS high, {r('min(low)')} AS low, {r('last(close ORDER BY ts)')} AS close,
 {r('sum(volume)')} AS volume FROM bars GROUP BY 1, 2""")
def _(t):
    return rounded(resample(t.bars(), "4 hours"))


@query("t1_daily_resample", f"""WITH {BARS} SELECT symbol, date_trunc('day', ts) AS ts,
 {r('first(open ORDER BY ts)')} AS open, {r('max(high)')} AS high, {r('min(low)')} AS low, {r('last(close ORDER BY ts)')} AS close,
 {r('sum(volume)')} AS volume FROM bars GROUP BY 1, 2""")
def _(t):
    return rounded(resample(t.bars(), "day"))


@query("w1_returns", f"""WITH {BARS} SELECT symbol, ts, {r('close - ' + lag('close'))} AS diff_1,
 {', '.join(f"{r(f'close / {lag(chr(99)+chr(108)+chr(111)+chr(115)+chr(101), k)} - 1')} AS ret_{k}" for k in (1, 3, 6, 12, 24))} FROM bars""")
def _(t):
    b = t.bars().withColumn("diff_1", Q.diff("close"))
    return rounded(ind.returns(b, [1, 3, 6, 12, 24]).select("symbol", "ts", "diff_1", *[f"ret_{k}" for k in (1, 3, 6, 12, 24)]))


@query("w2_rolling_stats", f"""WITH {BARS} SELECT symbol, ts, {r(roll('avg', 'close', 20))} AS m20, {r(roll('stddev_samp', 'close', 20))} AS s20,
 {r(roll('min', 'low', 14))} AS lo14, {r(roll('max', 'high', 14))} AS hi14, {r(roll('sum', 'volume', 24))} AS v24 FROM bars""")
def _(t):
    b = t.bars().withColumns({
        "m20": Q.mean("close", 20), "s20": Q.sd("close", 20), "lo14": Q.roll(F.min, "low", 14),
        "hi14": Q.roll(F.max, "high", 14), "v24": Q.roll(F.sum, "volume", 24)})
    return rounded(b.select("symbol", "ts", "m20", "s20", "lo14", "hi14", "v24"))


@query("w2_rolling_stats_daily_halo", f"""WITH {DAILY} SELECT symbol, ts, {r(roll('avg', 'close', 20))} AS m20, {r(roll('max', 'high', 14))} AS hi14 FROM daily""")
def _(t):
    """The same frames on chunked keys: no key needs to fit in one task."""
    # only what the frames read is stored and numbered
    d = sq.number_rows(t.sized().daily().select("symbol", "ts", "high", "close"), ["symbol"], ["ts"])
    d = sq.with_halo(d, ["symbol"], "pos", 256, back=19)
    q = Seq(["symbol", "chunk_id"], "pos")
    d = d.withColumns({"m20": q.mean("close", 20), "hi14": q.roll(F.max, "high", 14)}).where("is_core")
    return rounded(d.select("symbol", "ts", "m20", "hi14"))


_PAIR = """px AS (SELECT a.ts, ln(a.close) AS la, ln(b.close) AS lb, a.symbol AS ls, b.symbol AS rs, a.symbol || '|' || b.symbol AS symbol FROM bars a JOIN bars b ON a.ts = b.ts
 AND a.symbol < b.symbol)"""


@query("w3_rolling_corr", f"""WITH {BARS}, {_PAIR}, p2 AS (SELECT *, la - {lag('la')} AS ra, lb - {lag('lb')} AS rb FROM px)
 SELECT ls AS left_symbol, rs AS right_symbol, ts, {r(roll('corr', 'la', 60).replace('corr(la)', 'corr(la, lb)'))} AS c60,
 {r(roll('corr', 'ra', 24).replace('corr(ra)', 'corr(ra, rb)'))} AS c24 FROM p2""")
def _(t):
    from ticktote.operators.pairs import all_pairs

    pair = ["left_symbol", "right_symbol"]
    q = Seq(pair, "ts")
    p = all_pairs(t.bars()).withColumns({"la": F.log("a"), "lb": F.log("b")})
    p = p.withColumns({"ra": q.diff("la"), "rb": q.diff("lb")})
    return rounded(p.select(*pair, "ts", q.corr("la", "lb", 60).alias("c60"), q.corr("ra", "rb", 24).alias("c24")))


def _z(x: str, n: int, mp: int | None = None) -> str:
    return f"(({x}) - {roll('avg', x, n, mp=mp)}) / nullif({roll('stddev_samp', x, n, mp=mp)}, 0)"


@query("w4_rolling_zscore", f"""WITH {BARS} SELECT symbol, ts, {', '.join(f"{r(_z('close', n))} AS z{n}" for n in (6, 20, 60))} FROM bars""")
def _(t):
    return rounded(t.bars().select("symbol", "ts", *[Q.zscore("close", n).alias(f"z{n}") for n in (6, 20, 60)]))


def _ranked(n: int, mp: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"


@query("w5_rolling_pct_rank", f"""WITH {BARS}, l AS (SELECT symbol, ts, close,
 list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 71 PRECEDING AND CURRENT ROW) AS v72,
 list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING) AS p120,
 list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS v120 FROM bars)
 SELECT symbol, ts, {r("CASE WHEN len(v72) >= 72 THEN len(list_filter(v72, lambda x: x <= close)) / 72.0 END")} AS pct_le72,
 {r("CASE WHEN len(p120) >= 120 THEN len(list_filter(p120, lambda x: x < close)) / 120.0 END")} AS pct_lt120,
 {r("CASE WHEN len(v120) >= 20 THEN (len(list_filter(v120, lambda x: x < close)) + (len(list_filter(v120, lambda x: x = close)) + 1) / 2.0) / len(v120) END")} AS pct_rank120
 FROM l""")
def _(t):
    return rounded(t.bars().select(
        "symbol", "ts", ind.rolling_pct_rank("close", 72).alias("pct_le72"),
        ind.rolling_pct_rank("close", 120, mode="lt_prev").alias("pct_lt120"),
        ind.rolling_pct_rank("close", 120, mode="mean", min_periods=20).alias("pct_rank120")))


@query("w6_rolling_skew_sign", f"""WITH {BARS}, x AS (SELECT symbol, ts, close / {lag('close')} - 1 AS ret FROM bars)
 SELECT symbol, ts, {r(roll('skewness', 'ret', 24))} AS skew24,
 {r(roll('avg', 'CASE WHEN ret IS NOT NULL THEN CAST(ret > 0 AS INT) END', 12) + ' - 0.5')} AS sign12 FROM x""")
def _(t):
    b = t.bars().withColumn("ret", Q.pct("close"))
    b = b.withColumn("pos", (F.col("ret") > 0).cast("int"))
    return rounded(b.select("symbol", "ts", ind.adj_skew("ret", 24).alias("skew24"), (Q.mean("pos", 12) - 0.5).alias("sign12")))


@query("w7_rolling_mad", f"""WITH {BARS}, l AS (SELECT symbol, ts, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v,
 avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM bars)
 SELECT symbol, ts, {r("CASE WHEN len(v) >= 20 THEN list_avg(list_transform(v, lambda x: abs(x - m))) END")} AS mad20 FROM l""")
def _(t):
    return rounded(t.bars().select("symbol", "ts", ind.rolling_mad("close", 20).alias("mad20")))


@query("w14_run_lengths", f"""WITH {BARS}, x AS (SELECT symbol, ts, CAST(sign(close - {lag('close')}) AS INT) AS dir FROM bars),
 c AS (SELECT *, CASE WHEN dir IS NOT DISTINCT FROM {lag('dir')} AND row_number() {W} > 1 THEN 0 ELSE 1 END AS chg FROM x),
 g AS (SELECT *, sum(chg) {W} AS run FROM c)
 SELECT symbol, ts, CAST(coalesce(dir, 0) AS INT) AS dir, CAST(row_number() OVER (PARTITION BY symbol, run ORDER BY ts) * coalesce(dir, 0) AS BIGINT) AS signed_run FROM g""")
def _(t):
    b = t.bars().withColumn("dir", F.signum(Q.diff("close")).cast("int"))
    b = sq.runs(b, Q, "dir")
    n = F.row_number().over(Seq(["symbol", "run_id"], "ts").w)
    d = F.coalesce(F.col("dir"), F.lit(0))
    return b.select("symbol", "ts", d.alias("dir"), (n * d).cast("bigint").alias("signed_run"))


@query("w15_change_flags", f"""WITH {BARS}, x AS (SELECT symbol, ts, CAST(floor(close / 50) AS INT) AS regime FROM bars),
 c AS (SELECT *, CASE WHEN regime IS DISTINCT FROM {lag('regime')} THEN 1 ELSE 0 END AS changed,
 CASE WHEN coalesce(regime - {lag('regime')}, 0) <> 0 THEN 1 ELSE 0 END AS moved FROM x)
 SELECT symbol, ts, regime, changed, CAST(coalesce({roll('sum', 'moved', 3)}, 0) AS BIGINT) AS changes_3 FROM c""")
def _(t):
    b = t.bars().withColumn("regime", F.floor(F.col("close") / 50).cast("int"))
    b = b.withColumns({
        "changed": (~F.col("regime").eqNullSafe(Q.lag("regime"))).cast("int"),
        "moved": flag(Q.diff("regime") != 0)})
    c3 = F.coalesce(Q.roll(F.sum, "moved", 3), F.lit(0)).cast("bigint")
    return b.select("symbol", "ts", "regime", "changed", c3.alias("changes_3"))


@query("w28_time_decay_weight", f"""WITH {BARS} SELECT symbol, ts, {r("pow(0.5, date_diff('second', ts, max(ts) OVER ()) / 86400.0 / 365.0)", 9)} AS weight FROM bars""")
def _(t):
    b = t.bars()
    top = b.agg(F.max("ts").alias("_m"))
    age = (F.unix_timestamp("_m") - F.unix_timestamp("ts")) / 86400.0
    return b.join(F.broadcast(top)).select("symbol", "ts", rnd(F.pow(F.lit(0.5), age / 365.0), 9).alias("weight"))


@query("t2_ema", f"""WITH RECURSIVE {BARS}, {ema_sql('a', 'bars', 'close', '2.0/13')}, {ema_sql('b', 'bars', 'close', '1.0/14')}
 SELECT a.symbol, a.ts, {r('a.y')} AS ema12, {r('b.y')} AS wilder14 FROM a JOIN b ON a.symbol = b.symbol AND a.ts = b.ts""")
def _(t):
    d = ewm(t.bars(), Q, {"ema12": {"x": "close", "span": 12}, "wilder14": {"x": "close", "alpha": 1 / 14}})
    return rounded(d.select("symbol", "ts", "ema12", "wilder14"))


@query("t2_ema_adjusted", f"""WITH RECURSIVE {BARS}, n AS (SELECT symbol, ts, close AS x, row_number() {W} AS rn FROM bars),
 a AS (SELECT symbol, ts, rn, x AS num, 1.0::DOUBLE AS den FROM n WHERE rn = 1 UNION ALL SELECT n.symbol, n.ts, n.rn, (1 - 2.0/15) * a.num + n.x, (1 - 2.0/15) * a.den + 1
 FROM a JOIN n ON n.symbol = a.symbol AND n.rn = a.rn + 1) SELECT symbol, ts, {r('CASE WHEN rn >= 14 THEN num / den END')} AS ema14 FROM a""")
def _(t):
    d = ewm(t.bars(), Q, {"ema14": {"x": "close", "span": 14, "adjust": True, "min_periods": 14}})
    return rounded(d.select("symbol", "ts", "ema14"))


_GL = f"""gl AS (SELECT symbol, ts, close, CASE WHEN close - {lag('close')} > 0 THEN close - {lag('close')} ELSE 0.0 END AS g,
 CASE WHEN close - {lag('close')} < 0 THEN {lag('close')} - close ELSE 0.0 END AS l FROM bars)"""
_RSI = f"""{_GL}, rs AS (SELECT symbol, ts, close, {roll('avg', 'g', 14)} AS ag, {roll('avg', 'l', 14)} AS al FROM gl),
 rsi AS (SELECT symbol, ts, close, CASE WHEN ag IS NULL THEN NULL WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi FROM rs)"""


@query("t3_rsi_simple", f"WITH {BARS}, {_RSI} SELECT symbol, ts, {r('rsi')} AS rsi FROM rsi")
def _(t):
    return rounded(ind.rsi_simple(t.bars()).select("symbol", "ts", "rsi"))


_G2 = f"""g2 AS (SELECT symbol, ts, close - {lag('close')} AS dd FROM bars)"""


@query("t4_rsi_wilder", f"""WITH RECURSIVE {BARS}, {_G2}, {ema_sql('ag', 'g2', 'CASE WHEN dd > 0 THEN dd WHEN dd <= 0 THEN 0.0 END', '1.0/14')},
 {ema_sql('al', 'g2', 'CASE WHEN dd < 0 THEN -dd WHEN dd >= 0 THEN 0.0 END', '1.0/14')}
 SELECT b.symbol, b.ts, {r('100 - 100 / (1 + ag.y / nullif(al.y, 0))', 5)} AS rsi_w FROM bars b LEFT JOIN ag ON b.symbol = ag.symbol AND b.ts = ag.ts
 LEFT JOIN al ON b.symbol = al.symbol AND b.ts = al.ts""")
def _(t):
    return rounded(ind.rsi_smoothed(t.bars()).select("symbol", "ts", "rsi_w"), 5)


@query("t5_macd", f"""WITH RECURSIVE {BARS}, {ema_sql('f', 'bars', 'close', '2.0/13')}, {ema_sql('s', 'bars', 'close', '2.0/27')},
 m AS (SELECT f.symbol, f.ts, f.y - s.y AS macd FROM f JOIN s ON f.symbol = s.symbol AND f.ts = s.ts), {ema_sql('g', 'm', 'macd', '2.0/10')}
 SELECT m.symbol, m.ts, {r('macd')} AS macd, {r('g.y')} AS macd_signal, {r('macd - g.y')} AS macd_hist FROM m JOIN g ON m.symbol = g.symbol AND m.ts = g.ts""")
def _(t):
    return rounded(ind.macd(t.bars()).select("symbol", "ts", "macd", "macd_signal", "macd_hist"))


_BB = f"bb AS (SELECT symbol, ts, close, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS s FROM bars)"


@query("t6_bollinger", f"""WITH {BARS}, {_BB} SELECT symbol, ts, {r('m + 2 * s')} AS bb_upper, {r('m - 2 * s')} AS bb_lower,
 {r('4 * s / nullif(m, 0)')} AS bb_width, {r('(close - (m - 2 * s)) / nullif(4 * s, 0)')} AS bb_pos FROM bb""")
def _(t):
    return rounded(ind.bollinger(t.bars()).select("symbol", "ts", "bb_upper", "bb_lower", "bb_width", "bb_pos"))


@query("t7_moving_averages", f"""WITH {BARS}, m AS (SELECT symbol, ts, close, {', '.join(f"{roll('avg', 'close', n)} AS ma_{n}" for n in (5, 10, 20, 25, 50, 75, 100, 200))} FROM bars)
 SELECT symbol, ts, {', '.join(f"{r(f'ma_{n}')} AS ma_{n}" for n in (5, 10, 20, 25, 50, 75, 100, 200))}, {r('(ma_5 - ma_75) / close')} AS ma_cross, {r('close / ma_25 - 1')} AS ma_ratio FROM m""")
def _(t):
    ns = [5, 10, 20, 25, 50, 75, 100, 200]
    b = ind.moving_averages(t.bars(), ns)
    b = b.withColumns({"ma_cross": sdiv(F.col("ma_5") - F.col("ma_75"), F.col("close")), "ma_ratio": sdiv("close", "ma_25") - 1})
    return rounded(b.select("symbol", "ts", *[f"ma_{n}" for n in ns], "ma_cross", "ma_ratio"))


_TR = f"""tr AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars)"""


@query("t8_atr_simple", f"""WITH {BARS}, {_TR} SELECT symbol, ts, {r('tr')} AS tr, {r(roll('avg', 'tr', 14))} AS atr, {r(roll('avg', 'tr', 14) + ' / close * 100')} AS atr_pct FROM tr""")
def _(t):
    b = ind.atr_simple(t.bars().withColumn("tr", ind.true_range()))
    return rounded(b.select("symbol", "ts", "tr", "atr", (sdiv("atr", "close") * 100).alias("atr_pct")))


@query("t8_atr_smoothed", f"""WITH RECURSIVE {BARS}, {_TR}, {ema_sql('a', 'tr', 'tr', '2.0/15')}, {ema_sql('b', 'tr', 'tr', '1.0/14')}
 SELECT a.symbol, a.ts, {r('a.y')} AS atr_span, {r('b.y')} AS atr_wilder FROM a JOIN b ON a.symbol = b.symbol AND a.ts = b.ts""")
def _(t):
    b = ind.atr_smoothed(t.bars(), out="atr_span")
    return rounded(ind.atr_smoothed(b, out="atr_wilder", wilder=True).select("symbol", "ts", "atr_span", "atr_wilder"))


_DM0 = f"""dm AS (SELECT symbol, ts, tr, CASE WHEN high - {lag('high')} > {lag('low')} - low AND high - {lag('high')} > 0 THEN high - {lag('high')} ELSE 0.0 END AS p,
 CASE WHEN {lag('low')} - low > high - {lag('high')} AND {lag('low')} - low > 0 THEN {lag('low')} - low ELSE 0.0 END AS m FROM tr)"""


@query("t9_adx_simple", f"""WITH {BARS}, {_TR}, {_DM0}, s AS (SELECT symbol, ts, 100 * {roll('avg', 'p', 14)} / nullif({roll('avg', 'tr', 14)}, 0) AS pd,
 100 * {roll('avg', 'm', 14)} / nullif({roll('avg', 'tr', 14)}, 0) AS md FROM dm), x AS (SELECT *, 100 * abs(pd - md) / nullif(pd + md, 0) AS dx FROM s)
 SELECT symbol, ts, {r('pd')} AS plus_di, {r('md')} AS minus_di, {r(roll('avg', 'dx', 14))} AS adx, {r('pd - md')} AS di_diff FROM x""")
def _(t):
    return rounded(ind.adx_simple(t.bars()).select("symbol", "ts", "plus_di", "minus_di", "adx", "di_diff"))


@query("t9_adx_smoothed", f"""WITH RECURSIVE {BARS}, {_TR}, {_DM0}, {ema_sql('ea', 'dm', 'tr', '2.0/15')}, {ema_sql('ep', 'dm', 'p', '2.0/15')}, {ema_sql('em', 'dm', 'm', '2.0/15')},
 x AS (SELECT ea.symbol, ea.ts, 100 * abs(100 * ep.y / ea.y - 100 * em.y / ea.y) / nullif(100 * ep.y / ea.y + 100 * em.y / ea.y, 0) AS dx
 FROM ea JOIN ep ON ea.symbol = ep.symbol AND ea.ts = ep.ts JOIN em ON ea.symbol = em.symbol AND ea.ts = em.ts), {ema_sql('ed', 'x', 'dx', '2.0/15')}
 SELECT x.symbol, x.ts, {r('ed.y', 5)} AS adx_e FROM x LEFT JOIN ed ON x.symbol = ed.symbol AND x.ts = ed.ts""")
def _(t):
    return rounded(ind.adx_smoothed(t.bars()).select("symbol", "ts", "adx_e"), 5)


@query("t10_stochastic", f"""WITH {BARS}, k AS (SELECT symbol, ts, 100 * (close - {roll('min', 'low', 14)}) / nullif({roll('max', 'high', 14)} - {roll('min', 'low', 14)}, 0) AS k FROM bars)
 SELECT symbol, ts, {r('k')} AS stoch_k, {r(roll('avg', 'k', 3))} AS stoch_d FROM k""")
def _(t):
    return rounded(ind.stochastic(t.bars()).select("symbol", "ts", "stoch_k", "stoch_d"))


@query("t11_williams_r", f"""WITH {BARS} SELECT symbol, ts, {r(f"-100 * ({roll('max', 'high', 14)} - close) / nullif({roll('max', 'high', 14)} - {roll('min', 'low', 14)}, 0)")} AS williams_r FROM bars""")
def _(t):
    return rounded(ind.williams_r(t.bars()).select("symbol", "ts", "williams_r"))


@query("t12_cci", f"""WITH {BARS}, p AS (SELECT symbol, ts, (high + low + close) / 3 AS tp FROM bars), l AS (SELECT *,
 list(tp) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v, {roll('avg', 'tp', 20)} AS m FROM p)
 SELECT symbol, ts, {r("CASE WHEN len(v) >= 20 THEN (tp - m) / nullif(0.015 * list_avg(list_transform(v, lambda x: abs(x - m))), 0) END")} AS cci FROM l""")
def _(t):
    return rounded(ind.cci(t.bars()).select("symbol", "ts", "cci"))


@query("t13_mfi", f"""WITH {BARS}, p AS (SELECT symbol, ts, (high + low + close) / 3 AS tp, volume FROM bars), d AS (SELECT *, tp - {lag('tp')} AS dd, tp * volume AS mf FROM p),
 f AS (SELECT *, CASE WHEN dd > 0 THEN mf ELSE 0.0 END AS pf, CASE WHEN dd < 0 THEN mf ELSE 0.0 END AS nf FROM d)
 SELECT symbol, ts, {r(f"100 - 100 / (1 + {roll('sum', 'pf', 14)} / nullif({roll('sum', 'nf', 14)}, 0))")} AS mfi FROM f""")
def _(t):
    return rounded(ind.mfi(t.bars()).select("symbol", "ts", "mfi"))


@query("t14_obv", f"""WITH {BARS}, s AS (SELECT symbol, ts, coalesce(sign(close - {lag('close')}), 0) * volume AS sv FROM bars),
 o AS (SELECT symbol, ts, sum(sv) {W} AS obv FROM s) SELECT symbol, ts, {r('obv', 4)} AS obv, {r(f"obv - {lag('obv', 12)}", 4)} AS obv_chg FROM o""")
def _(t):
    b = ind.obv(t.bars())
    return b.select("symbol", "ts", rnd("obv", 4).alias("obv"), rnd(Q.diff("obv", 12), 4).alias("obv_chg"))


@query("t15_range_volatility", f"""WITH {BARS}, x AS (SELECT symbol, ts, ln(close / {lag('close')}) AS lr, pow(ln(high / low), 2) AS pk,
 0.5 * pow(ln(high / low), 2) - (2 * ln(2.0) - 1) * pow(ln(close / open), 2) AS gk FROM bars), y AS (SELECT *, {roll('avg', 'gk', 24)} AS g24 FROM x)
 SELECT symbol, ts, {r(roll('stddev_samp', 'lr', 24))} AS rv, {r('sqrt(' + roll('avg', 'pk', 24) + ' / (4 * ln(2.0)))')} AS parkinson,
 {r('CASE WHEN g24 >= 0 THEN sqrt(g24) END')} AS garman_klass FROM y""")
def _(t):
    return rounded(ind.range_volatility(t.bars()).select("symbol", "ts", "rv", "parkinson", "garman_klass"))


@query("t16_volume_features", f"""WITH {BARS}, x AS (SELECT symbol, ts, volume, volume / nullif({roll('avg', 'volume', 20)}, 0) AS ratio, coalesce(sign(close - {lag('close')}), 0) * volume AS sv FROM bars)
 SELECT symbol, ts, {r('ratio')} AS vol_ratio, CASE WHEN ratio > 2 THEN 1 ELSE 0 END AS vol_spike, {r(roll('sum', 'sv', 20) + ' / ' + roll('sum', 'volume', 20))} AS vol_balance FROM x""")
def _(t):
    return rounded(ind.volume_features(t.bars()).select("symbol", "ts", "vol_ratio", "vol_spike", "vol_balance"))


@query("t17_momentum_family", f"""WITH {BARS}, x AS (SELECT symbol, ts, close / {lag('close')} - 1 AS ret, (close / {lag('close', 10)} - 1) * 100 AS roc FROM bars),
 y AS (SELECT *, {roll('stddev_samp', 'ret', 24)} AS vol, ret - {lag('ret')} AS accel FROM x)
 SELECT symbol, ts, {r('accel')} AS accel, {r('roc')} AS roc_10, {r(roll('stddev_samp', 'vol', 24))} AS vol_of_vol, {r(f"vol / nullif({lag('vol', 6)}, 0) - 1")} AS vol_chg_6 FROM y""")
def _(t):
    b = t.bars().withColumns({"ret": Q.pct("close"), "roc_10": Q.pct("close", 10) * 100})
    b = b.withColumns({"vol": Q.sd("ret", 24), "accel": Q.diff("ret")})
    return rounded(b.select("symbol", "ts", "accel", "roc_10", Q.sd("vol", 24).alias("vol_of_vol"), Q.pct("vol", 6).alias("vol_chg_6")))


@query("p1_time_parts", f"""WITH {BARS} SELECT symbol, ts, CAST(hour(ts) AS INT) AS hour, CAST((dayofweek(ts) + 6) % 7 AS INT) AS dow, CAST(month(ts) AS INT) AS month,
 {r('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {r('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos, {r('sin(2 * pi() * ((dayofweek(ts) + 6) % 7) / 5)')} AS dow_sin,
 {r('cos(2 * pi() * ((dayofweek(ts) + 6) % 7) / 5)')} AS dow_cos, {r('sin(2 * pi() * month(ts) / 12)')} AS month_sin, {r('cos(2 * pi() * month(ts) / 12)')} AS month_cos FROM bars""")
def _(t):
    b = cal.time_parts(t.bars())
    return rounded(b.select("symbol", "ts", "hour", "dow", "month", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"))


@query("p2_session_flags", f"""WITH {BARS} SELECT symbol, ts, CAST(hour(ts) < 9 AS INT) AS tokyo, CAST(hour(ts) BETWEEN 7 AND 15 AS INT) AS london, CAST(hour(ts) BETWEEN 13 AND 21 AS INT) AS ny,
 CAST(hour(ts) BETWEEN 13 AND 15 AS INT) AS overlap, CAST(dayofweek(ts) = 5 AS INT) AS is_friday, CAST(dayofweek(ts) = 1 AS INT) AS is_monday,
 CAST(CAST(ts AS DATE) = last_day(ts) OR CAST(ts + INTERVAL 24 HOURS AS DATE) = last_day(ts + INTERVAL 24 HOURS) AS INT) AS is_month_end FROM bars""")
def _(t):
    b = cal.session_flags(t.bars())
    return b.select("symbol", "ts", "tokyo", "london", "ny", "overlap", "is_friday", "is_monday", "is_month_end")


@query("p3_hour_dow_interaction", f"WITH {BARS} SELECT symbol, ts, CAST(hour(ts) * 10 + (dayofweek(ts) + 6) % 7 AS INT) AS hour_dow FROM bars")
def _(t):
    return t.bars().select("symbol", "ts", cal.hour_dow("ts").alias("hour_dow"))


@query("p14_candle_shape", f"""WITH {BARS} SELECT symbol, ts, {r('abs(close - open) / nullif(high - low, 0)')} AS body_ratio, {r('(high - greatest(open, close)) / nullif(high - low, 0)')} AS upper_shadow,
 {r('(least(open, close) - low) / nullif(high - low, 0)')} AS lower_shadow, {r('(high - low) / close')} AS hl_ratio, {r('(close - low) / nullif(high - low, 0)')} AS close_pos FROM bars""")
def _(t):
    rng = F.col("high") - F.col("low")
    return rounded(t.bars().select(
        "symbol", "ts", sdiv(F.abs(F.col("close") - F.col("open")), rng).alias("body_ratio"),
        sdiv(F.col("high") - F.greatest("open", "close"), rng).alias("upper_shadow"),
        sdiv(F.least("open", "close") - F.col("low"), rng).alias("lower_shadow"),
        sdiv(rng, F.col("close")).alias("hl_ratio"), sdiv(F.col("close") - F.col("low"), rng).alias("close_pos")))


@query("flagship_signal_study", f"""WITH {BARS}, {_RSI}, {_BB}, x AS (SELECT r.symbol, r.ts, r.close, r.rsi, (b.m + 2 * b.s - (b.m - 2 * b.s)) / nullif(b.m, 0) AS width,
 lead(r.close, 4) OVER (PARTITION BY r.symbol ORDER BY r.ts) / r.close - 1 AS fwd FROM rsi r JOIN bb b ON r.symbol = b.symbol AND r.ts = b.ts),
 s AS (SELECT *, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 END * fwd * 0.01 AS ret FROM x WHERE fwd IS NOT NULL AND width IS NOT NULL AND hour(ts) NOT IN (20, 23) AND (rsi < 30 OR rsi > 70)),
 e AS (SELECT *, 1 + sum(ret) {W} AS eq FROM s), p AS (SELECT *, max(eq) {W} AS peak FROM e)
 SELECT symbol, count(*) AS n_trades, {r('sum(CASE WHEN ret > 0 THEN ret END) / -sum(CASE WHEN ret < 0 THEN ret END)')} AS pf, {r('max((peak - eq) / peak * 100)')} AS mdd,
 {r('avg(CAST(ret > 0 AS INT)) * 100')} AS win_rate, {r('avg(ret) / stddev_samp(ret) * sqrt(8760)')} AS sharpe FROM p GROUP BY 1""")
def _(t):
    from ticktote.plans.signal_study import signal_study

    return rounded(signal_study(t.bars()))
