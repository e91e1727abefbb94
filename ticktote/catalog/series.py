"""As-of joins, event joins and features that combine several series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ticktote.catalog.bars import _BB, _RSI, _TR, _z, ema_sql
from ticktote.catalog.common_sql import AUX, BARS, CALENDAR, DAILY, MONTHLY, lag, r, roll
from ticktote.catalog.registry import query
from ticktote.functions.core import Seq, band, flag, rnd, rounded, sdiv
from ticktote.operators import indicators as ind
from ticktote.operators.asof import asof, asof_nearest
from ticktote.operators.automaton import pair_position, state_scan
from ticktote.operators.events import blackout, upcoming
from ticktote.operators.gram import pair_statistics
from ticktote.operators.pairs import all_pairs, side_by_side
from ticktote.operators.resample import resample
from ticktote.operators.touch import first_touch

Q = Seq("symbol", "ts")
QX = Seq("symbol", "ts")
PAIR = ["left_symbol", "right_symbol"]
P2 = Seq(PAIR, "ts")
W = "OVER (PARTITION BY symbol ORDER BY ts)"


@query("j6_asof_backward", f"""WITH {BARS}, {AUX} SELECT b.symbol, b.ts, {r('a.value')} AS value, a.n_obs, a.ts AS src_ts FROM bars b ASOF LEFT JOIN aux a ON b.symbol = a.series_id AND b.ts >= a.ts""")
def _(t):
    a = t.daily_series().withColumnRenamed("series_id", "symbol")
    d = asof(t.bars().select("symbol", "ts"), a, by=["symbol"], right_ts="src_ts")
    return rounded(d)


@query("j6_asof_unequal_axis", f"""WITH tk AS (SELECT event_id, event_type AS symbol, ts, value FROM events WHERE event_type <> 'error'),
 qt AS (SELECT ts, max(value) AS ref FROM events WHERE event_type = 'error' GROUP BY 1)
 SELECT tk.event_id, {r('tk.value - qt.ref')} AS edge FROM tk ASOF LEFT JOIN qt ON tk.ts >= qt.ts""")
def _(t):
    e = t.raw("events")
    tk = e.where("event_type <> 'error'").select("event_id", F.col("event_type").alias("symbol"), "ts", "value")
    qt = e.where("event_type = 'error'").select("ts", F.col("value").alias("ref"))
    return asof(tk, qt, period="day").select("event_id", rnd(F.col("value") - F.col("ref")).alias("edge"))


@query("j7_asof_tolerance", f"""WITH {BARS}, s AS (SELECT * FROM bars WHERE close > 60), q AS (SELECT symbol, ts FROM bars)
 SELECT q.symbol, q.ts, {r("CASE WHEN date_diff('second', s.ts, q.ts) <= 7200 THEN s.close END")} AS last_big FROM q ASOF LEFT JOIN s ON q.symbol = s.symbol AND q.ts >= s.ts""")
def _(t):
    b = t.bars()
    src = b.where("close > 60").select("symbol", "ts", F.col("close").alias("last_big"))
    return rounded(asof(b.select("symbol", "ts"), src, by=["symbol"], tolerance_s=7200))


@query("j8_asof_nearest", f"""WITH {BARS}, q AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), s AS (SELECT ts, close FROM bars WHERE symbol = 'click'),
 b AS (SELECT q.event_id, q.ts, s.ts AS bt, s.close AS bc FROM q ASOF LEFT JOIN s ON q.ts >= s.ts), f AS (SELECT q.event_id, s.ts AS ft, s.close AS fc FROM q ASOF LEFT JOIN s ON q.ts <= s.ts)
 SELECT b.event_id, CASE WHEN ft IS NULL OR (bt IS NOT NULL AND b.ts - bt <= ft - b.ts) THEN bt ELSE ft END AS src_ts,
 {r('CASE WHEN ft IS NULL OR (bt IS NOT NULL AND b.ts - bt <= ft - b.ts) THEN bc ELSE fc END')} AS close FROM b JOIN f USING (event_id)""")
def _(t):
    q = t.raw("events").where("event_type = 'purchase'").select("event_id", "ts")
    s = t.bars().where("symbol = 'click'").select("ts", "close")
    return rounded(asof_nearest(q, s, period="week").select("event_id", "src_ts", "close"))


@query("j10_event_blackout", f"""WITH {BARS}, {CALENDAR} SELECT symbol, ts, CAST(EXISTS (SELECT 1 FROM calendar c WHERE c.importance >= 2
 AND c.event_ts BETWEEN b.ts - INTERVAL 1 HOUR AND b.ts + INTERVAL 2 HOUR) AS INT) AS blocked FROM bars b""")
def _(t):
    return blackout(t.bars().select("symbol", "ts"), t.calendar(), 2, 1, 2)


@query("j11_upcoming_events", f"""WITH {CALENDAR}, q AS (SELECT DISTINCT date_trunc('day', ts) AS ts FROM events) SELECT q.ts, c.event_id, c.importance,
 {r("date_diff('microsecond', q.ts, c.event_ts) / 3.6e9")} AS hours_until FROM q JOIN calendar c ON c.event_ts >= q.ts AND c.event_ts <= q.ts + INTERVAL 7 DAY""")
def _(t):
    q = t.raw("events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    u = upcoming(q, t.calendar(), 7)
    return rounded(u.select("ts", "event_id", "importance", "hours_until"))


_PATH = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)"


@query("j12_first_touch", f"""WITH {BARS}, {_TR}, a AS (SELECT symbol, ts, high, low, close, {roll('avg', 'tr', 14)} AS atr, row_number() {W} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM tr),
 e AS (SELECT * FROM a WHERE atr IS NOT NULL), x AS (SELECT e.symbol, e.ts, e.rn, e.n, e.close - 0.5 * e.atr AS sl, e.close + 0.5 * e.atr AS tp, p.rn - e.rn AS k, p.low, p.high, p.close AS pc
 FROM e JOIN a p ON p.symbol = e.symbol AND p.rn BETWEEN e.rn + 1 AND e.rn + 12),
 h AS (SELECT symbol, ts, min(k) FILTER (low <= sl OR high >= tp) AS k, max(k) AS kmax FROM x GROUP BY 1, 2),
 o AS (SELECT e.symbol, e.ts, coalesce(h.k, h.kmax) AS held, x.low, x.high, x.pc, x.sl, x.tp, h.k FROM e LEFT JOIN h ON h.symbol = e.symbol AND h.ts = e.ts
 LEFT JOIN x ON x.symbol = e.symbol AND x.ts = e.ts AND x.k = coalesce(h.k, h.kmax))
 SELECT symbol, ts, CASE WHEN held IS NULL THEN NULL WHEN k IS NULL THEN 'time_exit' WHEN low <= sl THEN 'stop_loss' ELSE 'take_profit' END AS exit_reason,
 {r("CASE WHEN k IS NULL THEN pc WHEN low <= sl THEN sl ELSE tp END")} AS exit_price, CAST(held AS DOUBLE) AS bars_held FROM o""")
def _(t):
    b = ind.atr_simple(t.bars())
    half = 0.5 * F.col("atr")
    d = first_touch(b, Q, F.col("close") + half, F.col("close") - half, F.lit(1), 12).where(F.col("atr").isNotNull())
    return rounded(d.select("symbol", "ts", "exit_reason", "exit_price", F.col("bars_held").cast("double").alias("bars_held")))


_LONG = [(4.0, 4.0), (4.0, 8.0), (8.0, 12.0)]


@query("j12_first_touch_long", f"""WITH {BARS}, {_TR}, a AS (SELECT symbol, ts, high, low, close, {roll('avg', 'tr', 14)} AS atr, CASE WHEN close < open THEN 1 ELSE -1 END AS side, row_number() {W} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM tr),
 g AS (SELECT * FROM (VALUES {', '.join(f'({s}::DOUBLE, {t}::DOUBLE)' for s, t in _LONG)}) AS g(sl_mult, tp_mult)), e AS (SELECT a.*, sl_mult, tp_mult, close - side * atr * sl_mult AS sl, close + side * atr * tp_mult AS tp FROM a CROSS JOIN g WHERE atr IS NOT NULL),
 x AS (SELECT e.symbol, e.ts, e.sl_mult, e.tp_mult, p.rn - e.rn AS k, CASE WHEN e.side > 0 THEN p.low <= e.sl ELSE p.high >= e.sl END AS stop, CASE WHEN e.side > 0 THEN p.high >= e.tp ELSE p.low <= e.tp END AS take, p.close AS pc FROM e JOIN a p ON p.symbol = e.symbol AND p.rn BETWEEN e.rn + 1 AND e.rn + 240),
 h AS (SELECT symbol, ts, sl_mult, tp_mult, min(k) FILTER (stop OR take) AS k, max(k) AS kmax, arg_min(stop, k) FILTER (stop OR take) AS stop, arg_max(pc, k) AS pc FROM x GROUP BY 1, 2, 3, 4)
 SELECT e.symbol, e.ts, e.sl_mult, e.tp_mult, CASE WHEN kmax IS NULL THEN NULL WHEN k IS NULL THEN 'time_exit' WHEN stop THEN 'stop_loss' ELSE 'take_profit' END AS exit_reason, {r('CASE WHEN k IS NULL THEN pc WHEN stop THEN sl ELSE tp END')} AS exit_price, CAST(coalesce(k, kmax) AS DOUBLE) AS bars_held
 FROM e LEFT JOIN h ON h.symbol = e.symbol AND h.ts = e.ts AND h.sl_mult = e.sl_mult AND h.tp_mult = e.tp_mult""")
def _(t):
    """Ten days of bars ahead, three pairs of barriers over one pyramid."""
    from ticktote.operators.pyramid import long_exits

    b = ind.atr_simple(t.bars()).withColumn("side", F.when(F.col("close") < F.col("open"), 1).otherwise(-1))
    d = long_exits(b, ["symbol"], ["ts"], _LONG, "side", "atr", 240).where("atr is not null")
    return rounded(d.select("symbol", "ts", "sl_mult", "tp_mult", "exit_reason", "exit_price", F.col("bars_held").cast("double").alias("bars_held")))


@query("j14_pair_common_dates", f"""WITH {BARS} SELECT a.symbol AS left_symbol, b.symbol AS right_symbol, count(*) AS n_common, {r('corr(ln(a.close), ln(b.close))')} AS corr
 FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol WHERE NOT (a.symbol = 'click' AND b.symbol = 'error') GROUP BY 1, 2 HAVING count(*) >= 60""")
def _(t):
    g = pair_statistics(t.bars().withColumn("x", F.log("close")), min_common=60)
    g = g.where("not (left_symbol = 'click' and right_symbol = 'error')")
    return rounded(g.select("left_symbol", "right_symbol", "n_common", "corr"))


_LAGX = f"""us AS (SELECT ts, symbol, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS us_prev FROM (SELECT symbol, ts, close / {lag('close')} - 1 AS ret FROM bars))"""


@query("j18_cross_market_lag", f"""WITH {BARS}, {_LAGX} SELECT b.ts, {r('b.close')} AS close, {r('u.us_prev')} AS us_prev FROM bars b LEFT JOIN us u ON u.ts = b.ts AND u.symbol = 'view' WHERE b.symbol = 'click'""")
def _(t):
    b = t.bars()
    us = b.where("symbol = 'view'").withColumn("_r", Q.pct("close")).withColumn("us_prev", Q.lag("_r")).select("ts", "us_prev")
    return rounded(b.where("symbol = 'click'").select("ts", "close").join(us, "ts", "left"))


_B4 = f"""b4 AS (SELECT symbol, time_bucket(INTERVAL '4 hours', ts) AS ts, last(close ORDER BY ts) AS close FROM bars GROUP BY 1, 2)"""
_G4 = f"""g4 AS (SELECT *, CASE WHEN close - {lag('close')} > 0 THEN close - {lag('close')} ELSE 0.0 END AS g, CASE WHEN close - {lag('close')} < 0 THEN {lag('close')} - close ELSE 0.0 END AS l FROM b4),
 s4 AS (SELECT symbol, ts, {roll('avg', 'g', 14)} AS ag, {roll('avg', 'l', 14)} AS al, 4 * {roll('stddev_samp', 'close', 20)} / {roll('avg', 'close', 20)} AS w FROM g4),
 f4 AS (SELECT symbol, ts, CASE WHEN ag IS NULL THEN NULL WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / al) END AS rsi, w FROM s4),
 k4 AS (SELECT symbol, ts, {lag('rsi')} AS rsi_4h, {lag('w')} AS bb_width_4h FROM f4)"""


@query("t18_multi_timeframe", f"""WITH {BARS}, {_B4}, {_G4} SELECT b.symbol, b.ts, {r('rsi_4h')} AS rsi_4h, {r('bb_width_4h')} AS bb_width_4h FROM bars b ASOF LEFT JOIN k4 ON b.symbol = k4.symbol AND b.ts >= k4.ts""")
def _(t):
    from ticktote.plans.features import multi_timeframe

    d = multi_timeframe(t.bars(), [("4 hours", "4h")], with_macd=False)
    return rounded(d.select("symbol", "ts", "rsi_4h", "bb_width_4h"))


@query("t18_multi_timeframe_macd")
def _(t):
    from ticktote.plans.features import multi_timeframe

    return rounded(multi_timeframe(t.bars(), [("4 hours", "4h"), ("day", "1d")]))


@query("t19_daily_trend", f"""WITH {BARS}, d AS (SELECT symbol, date_trunc('day', ts) AS ts, last(close ORDER BY ts) AS close FROM bars GROUP BY 1, 2),
 m AS (SELECT symbol, ts, close, {roll('avg', 'close', 10)} AS ma, {roll('avg', 'close', 5)} AS ms FROM d),
 f AS (SELECT symbol, ts, CASE WHEN close > ma THEN 1 ELSE 0 END AS trend, (close - ma) / nullif(ma, 0) AS strength, CASE WHEN ms > {lag('ms')} THEN 1 ELSE 0 END AS dir FROM m)
 SELECT b.symbol, b.ts, CAST(coalesce(f.trend, 0) AS INT) AS trend_flag, {r('coalesce(f.strength, 0.0)')} AS trend_strength, CAST(coalesce(f.dir, 0) AS INT) AS ma_dir FROM bars b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.ts >= f.ts""")
def _(t):
    from ticktote.plans.features import daily_trend

    return rounded(daily_trend(t.bars(), resample(t.bars(), "day"), 10, 5).select("symbol", "ts", "trend_flag", "trend_strength", "ma_dir"))


@query("t20_rate_trend", f"""WITH {BARS}, {AUX}, x AS (SELECT ts, value, CASE WHEN value > avg(value) OVER w AND count(*) OVER w >= 10 THEN 1 ELSE 0 END AS trend FROM aux WHERE series_id = 'view' WINDOW w AS (ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
 SELECT b.symbol, b.ts, {r('coalesce(x.value, 0.0)')} AS rate, CAST(coalesce(x.trend, 0) AS INT) AS rate_trend FROM bars b ASOF LEFT JOIN x ON b.ts >= x.ts""")
def _(t):
    q = Seq("series_id", "ts")
    a = t.daily_series().where("series_id = 'view'")
    a = a.select("ts", F.col("value").alias("rate"), flag(F.col("value") > q.mean("value", 10)).alias("rate_trend"))
    d = asof(t.bars().select("symbol", "ts"), a, period="week")
    return rounded(d.fillna({"rate": 0.0, "rate_trend": 0}))


_SUR = f"""z AS (SELECT series_id, ts, coalesce((value - {roll('avg', 'value', 6, 'series_id', mp=3)}) / nullif({roll('stddev_samp', 'value', 6, 'series_id', mp=3)}, 0), 0.0) AS z FROM monthly),
 sg AS (SELECT ts, max(CASE WHEN series_id = '1-URGENT' THEN z END) AS s_urgent, max(CASE WHEN series_id = '2-HIGH' THEN -z END) AS s_high FROM z GROUP BY 1)"""


@query("t21_macro_surprise", f"""WITH {MONTHLY}, {_SUR}, d AS (SELECT DISTINCT o_orderdate AS ts FROM orders)
 SELECT d.ts, {r('coalesce(a.s_urgent, 0.0)')} AS surprise_urgent, {r('coalesce(b.s_high, 0.0)')} AS surprise_high, {r('(coalesce(a.s_urgent, 0.0) + coalesce(b.s_high, 0.0)) / 2')} AS surprise_composite
 FROM d ASOF LEFT JOIN (SELECT * FROM sg WHERE s_urgent IS NOT NULL) a ON d.ts >= a.ts ASOF LEFT JOIN (SELECT * FROM sg WHERE s_high IS NOT NULL) b ON d.ts >= b.ts""")
def _(t):
    from ticktote.plans.features import macro_surprise

    days = t.raw("orders").select(F.col("o_orderdate").alias("ts")).distinct()
    return rounded(macro_surprise(days, t.monthly_series(), {"surprise_urgent": ("1-URGENT", 1), "surprise_high": ("2-HIGH", -1)}))


_COT = """cot AS (SELECT l_returnflag AS contract, date_trunc('week', l_shipdate) AS ts, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END) AS spec_net,
 sum(CASE WHEN l_linestatus = 'F' THEN l_quantity * l_discount ELSE 0 END) AS comm_net, sum(l_quantity) AS oi FROM lineitem GROUP BY 1, 2)"""


def cot(t):
    li = t.raw("lineitem")
    o = F.col("l_linestatus") == "O"
    return li.groupBy(F.col("l_returnflag").alias("contract"), F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(
        F.sum(F.when(o, F.col("l_quantity")).otherwise(-F.col("l_quantity"))).alias("spec_net"),
        F.sum(F.when(~o, F.col("l_quantity") * F.col("l_discount")).otherwise(0.0)).alias("comm_net"),
        F.sum("l_quantity").alias("oi"))


def _lc(x, k=1):
    return lag(x, k, "contract")


@query("t22_position_features", f"""WITH {_COT}, c AS (SELECT *, spec_net - {_lc('spec_net')} AS ch FROM cot)
 SELECT contract, ts, {r('coalesce(spec_net / nullif(oi, 0), 0.0)')} AS spec_net_norm, {r('coalesce(comm_net / nullif(oi, 0), 0.0)')} AS comm_net_norm,
 {r(f"coalesce(ch / nullif({roll('avg', 'abs(ch)', 26, 'contract', mp=4)}, 0), 0.0)")} AS spec_net_change,
 {r(f"coalesce((spec_net - {roll('avg', 'spec_net', 26, 'contract', mp=8)}) / nullif({roll('stddev_samp', 'spec_net', 26, 'contract', mp=8)}, 0), 0.0)")} AS spec_zscore,
 {r(f"coalesce(oi / {_lc('oi')} - 1, 0.0)")} AS oi_change FROM c""")
def _(t):
    from ticktote.plans.features import position_features

    return rounded(position_features(cot(t), Seq("contract", "ts")))


@query("t23_cross_pair_features", f"""WITH {BARS}, {_RSI}, f AS (SELECT b.symbol, b.ts, b.close / {lag('b.close', 1, 'b.symbol', 'b.ts')} - 1 AS ret1, b.close / {lag('b.close', 6, 'b.symbol', 'b.ts')} - 1 AS ret6, CASE WHEN r.rsi = 100.0 THEN NULL ELSE r.rsi END AS rsi
 FROM bars b JOIN rsi r ON r.symbol = b.symbol AND r.ts = b.ts), w AS (SELECT ts, max(CASE WHEN symbol = 'view' THEN ret1 END) AS view_ret1, max(CASE WHEN symbol = 'view' THEN ret6 END) AS view_ret6, max(CASE WHEN symbol = 'view' THEN rsi END) AS view_rsi,
 max(CASE WHEN symbol = 'signup' THEN ret1 END) AS signup_ret1, max(CASE WHEN symbol = 'signup' THEN ret6 END) AS signup_ret6, max(CASE WHEN symbol = 'signup' THEN rsi END) AS signup_rsi FROM f GROUP BY 1), c AS (SELECT ts FROM bars WHERE symbol = 'click')
 SELECT c.ts, {', '.join(r(f'coalesce({x}, 0.0)') + ' AS ' + x for x in ('view_ret1', 'view_ret6', 'view_rsi', 'signup_ret1', 'signup_ret6', 'signup_rsi'))}, {r('-(coalesce(view_ret1, 0.0) + coalesce(signup_ret1, 0.0)) / 2')} AS base_strength FROM c ASOF LEFT JOIN w ON c.ts >= w.ts""")
def _(t):
    from ticktote.plans.features import cross_pair_features

    b = t.bars()
    return rounded(cross_pair_features(b.where("symbol = 'click'").select("ts"), b, ["view", "signup"], ("view", "signup")))


@query("t24_commodity_features", f"""WITH {BARS}, {AUX}, j AS (SELECT b.symbol, b.ts, a.value AS oil FROM bars b ASOF LEFT JOIN (SELECT * FROM aux WHERE series_id = 'purchase') a ON b.ts >= a.ts),
 y AS (SELECT *, oil / {lag('oil')} - 1 AS r1, oil / {lag('oil', 6)} - 1 AS r6, oil / {lag('oil', 24)} - 1 AS r24 FROM j)
 SELECT symbol, ts, {r('r1')} AS oil_ret_1, {r('r6')} AS oil_ret_6, {r('r24')} AS oil_ret_24, {r(roll('stddev_samp', 'r1', 24))} AS oil_vol_24, {r(f"oil / {roll('avg', 'oil', 20)} - 1")} AS oil_ma_ratio FROM y""")
def _(t):
    a = t.daily_series().where("series_id = 'purchase'").select("ts", F.col("value").alias("oil"))
    d = asof(t.bars().select("symbol", "ts"), a, period="week")
    d = d.withColumns({f"oil_ret_{k}": Q.pct("oil", k) for k in (1, 6, 24)})
    d = d.withColumns({"oil_vol_24": Q.sd("oil_ret_1", 24), "oil_ma_ratio": sdiv(F.col("oil"), Q.mean("oil", 20)) - 1})
    return rounded(d.drop("oil"))


@query("t25_yield_spread", f"""WITH {BARS}, {AUX}, s AS (SELECT a.ts, a.value - b.value AS spread FROM aux a JOIN aux b ON a.ts = b.ts AND a.series_id = 'view' AND b.series_id = 'click')
 SELECT b.symbol, b.ts, {r('s.spread')} AS spread FROM bars b ASOF LEFT JOIN s ON b.ts >= s.ts""")
def _(t):
    w = side_by_side(t.daily_series(), ["view", "click"], "value", "series_id").dropna()
    s = w.select("ts", (F.col("view") - F.col("click")).alias("spread"))
    return rounded(asof(t.bars().select("symbol", "ts"), s, period="week"))


@query("t26_currency_conversion", f"""WITH {BARS}, {AUX}, fx AS (SELECT ts, value FROM aux WHERE series_id = 'signup' AND value > 48)
 SELECT b.symbol, b.ts, {r("CASE WHEN date_diff('second', fx.ts, b.ts) <= 86400 THEN b.close * fx.value END")} AS close_conv FROM bars b ASOF LEFT JOIN fx ON b.ts >= fx.ts""")
def _(t):
    fx = t.daily_series().where("series_id = 'signup' AND value > 48").select("ts", F.col("value").alias("fx"))
    d = asof(t.bars(), fx, tolerance_s=86400, period="week")
    return rounded(d.select("symbol", "ts", (F.col("close") * F.col("fx")).alias("close_conv")))


_IDX = f"dr AS (SELECT symbol, ts, open, high, low, close, volume, close / {lag('close')} - 1 AS ret, open / {lag('close')} - 1 AS gap FROM daily), idx AS (SELECT ts, avg(ret) AS idx_ret FROM dr GROUP BY 1)"


@query("t27_overnight_gap", f"""WITH {DAILY}, {_IDX} SELECT d.symbol, d.ts, {r('gap')} AS gap, CAST(sign(gap) AS DOUBLE) AS gap_dir, {r('abs(gap)')} AS gap_abs, {r('gap - idx_ret')} AS gap_vs_index FROM dr d JOIN idx i ON i.ts = d.ts""")
def _(t):
    d = t.daily().withColumns({"ret": Q.pct("close"), "gap": sdiv(F.col("open"), Q.lag("close")) - 1})
    idx = d.groupBy("ts").agg(F.avg("ret").alias("idx_ret"))
    d = d.join(idx, "ts")
    return rounded(d.select("symbol", "ts", "gap", F.signum("gap").alias("gap_dir"), F.abs("gap").alias("gap_abs"), (F.col("gap") - F.col("idx_ret")).alias("gap_vs_index")))


@query("t28_futures_proxies", f"""WITH {BARS}, x AS (SELECT symbol, ts, close, volume, (high - low) / close AS rng FROM bars)
 SELECT symbol, ts, {r('rng')} AS intraday_range, {r(f"rng / nullif({roll('avg', 'rng', 20)}, 0)")} AS range_vs_ma20, {r(f"close / nullif({roll('avg', 'close', 20)}, 0)")} AS level_vs_ma20,
 {r(f"(close / {lag('close')} - 1) - ({lag('close')} / {lag('close', 2)} - 1)")} AS acceleration, {r(f"{_z('volume', 20)} - {_z('rng', 20)}")} AS vol_range_divergence FROM x""")
def _(t):
    b = t.bars().withColumn("rng", sdiv(F.col("high") - F.col("low"), F.col("close"))).withColumn("r1", Q.pct("close"))
    return rounded(b.select(
        "symbol", "ts", F.col("rng").alias("intraday_range"), sdiv(F.col("rng"), Q.mean("rng", 20)).alias("range_vs_ma20"),
        sdiv(F.col("close"), Q.mean("close", 20)).alias("level_vs_ma20"), Q.diff("r1").alias("acceleration"),
        (Q.zscore("volume", 20) - Q.zscore("rng", 20)).alias("vol_range_divergence")))


@query("t29_sector_leave_one_out", f"""WITH {DAILY}, x AS (SELECT symbol, ts, close / {lag('close')} - 1 AS ret, s_nationkey AS sector FROM daily JOIN supplier ON s_suppkey = symbol),
 y AS (SELECT *, (sum(ret) OVER s - ret) / nullif(count(ret) OVER s - 1, 0) AS sector_avg FROM x WINDOW s AS (PARTITION BY sector, ts))
 SELECT symbol, ts, {r('sector_avg')} AS sector_avg, {r(roll('sum', 'sector_avg', 5))} AS sector_avg_5 FROM y""")
def _(t):
    from ticktote.plans.features import leave_one_out

    s = t.raw("supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("sector"))
    d = t.daily().withColumn("ret", Q.pct("close")).join(s, "symbol")
    d = leave_one_out(d, ["sector", "ts"], "ret", "sector_avg")
    return rounded(d.select("symbol", "ts", "sector_avg", Q.roll(F.sum, "sector_avg", 5).alias("sector_avg_5")))


_RR = f"x AS (SELECT symbol, ts, close / {lag('close')} - 1 AS ret FROM bars), w AS (SELECT a.symbol || '|' || b.symbol AS symbol, a.symbol AS ls, b.symbol AS rs, a.ts, a.ret AS a, b.ret AS b FROM x a JOIN x b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL)"


@query("t30_spread_features", f"""WITH {BARS}, {_RR}, y AS (SELECT *, a - b AS ab, {roll('corr', 'a', 20).replace('corr(a)', 'corr(a, b)')} AS co FROM w)
 SELECT ls AS left_symbol, rs AS right_symbol, ts, {r('ab')} AS spread, {r(roll('sum', 'ab', 5))} AS spread_5, {r(f"co - {lag('co', 5)}")} AS corr_momentum FROM y""")
def _(t):
    """Return spread of every pair of instruments, its five-bar sum and the momentum of the correlation."""
    w = all_pairs(t.bars().withColumn("ret", Q.pct("close")), "ret").withColumn("ab", F.col("a") - F.col("b"))
    w = w.withColumn("co", P2.corr("a", "b", 20))
    return rounded(w.select("left_symbol", "right_symbol", "ts", F.col("ab").alias("spread"), P2.roll(F.sum, "ab", 5).alias("spread_5"), P2.diff("co", 5).alias("corr_momentum")))


_ADX = f"""dm AS (SELECT symbol, ts, close, tr, CASE WHEN high - {lag('high')} > {lag('low')} - low AND high - {lag('high')} > 0 THEN high - {lag('high')} ELSE 0.0 END AS p,
 CASE WHEN {lag('low')} - low > high - {lag('high')} AND {lag('low')} - low > 0 THEN {lag('low')} - low ELSE 0.0 END AS m FROM tr),
 s AS (SELECT symbol, ts, close, {roll('avg', 'tr', 14)} AS atr, 100 * {roll('avg', 'p', 14)} / nullif({roll('avg', 'tr', 14)}, 0) AS pd, 100 * {roll('avg', 'm', 14)} / nullif({roll('avg', 'tr', 14)}, 0) AS md FROM dm),
 xx AS (SELECT *, 100 * abs(pd - md) / nullif(pd + md, 0) AS dx FROM s), ax AS (SELECT symbol, ts, close, atr, {roll('avg', 'dx', 14)} AS adx FROM xx),
 rg AS (SELECT *, CASE WHEN atr IS NULL OR adx IS NULL THEN 'RANGE' WHEN adx < 25 THEN 'RANGE' WHEN atr / close >= 1.0 THEN 'HIGH_VOL_TREND' ELSE 'LOW_VOL_TREND' END AS regime FROM ax)"""


@query("t31_rule_regime", f"WITH {BARS}, {_TR}, {_ADX} SELECT symbol, ts, regime FROM rg")
def _(t):
    from ticktote.plans.features import rule_regime

    return rule_regime(ind.adx_simple(ind.atr_simple(t.bars())), 1.0, 25).select("symbol", "ts", "regime")


@query("t33_dynamic_spread", f"""WITH {BARS}, x AS (SELECT symbol, ts, (high - low) / 100 AS spread, {roll('quantile_cont', '(high - low) / 100', 50, mp=1).replace('quantile_cont((high - low) / 100)', 'quantile_cont((high - low) / 100, 0.5)')} AS base, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars),
 y AS (SELECT *, spread / nullif({roll('avg', 'tr', 14)}, 0) AS rel FROM x) SELECT symbol, ts, {r('spread')} AS spread, {r('base')} AS baseline, {r('rel')} AS relative_cost,
 CASE WHEN rel IS NULL OR rel >= 0.012 THEN 'very_high' WHEN rel >= 0.009 THEN 'high' WHEN rel >= 0.006 THEN 'medium' ELSE 'low' END AS cost_level FROM y""")
def _(t):
    b = t.bars().withColumns({"spread": (F.col("high") - F.col("low")) / 100, "tr": ind.true_range()})
    rel = sdiv(F.col("spread"), Q.mean("tr", 14))
    base = Q.roll(lambda c: F.percentile(c, F.lit(0.5)), "spread", 50, 1)
    lev = F.coalesce(band("rel", [0.006, 0.009, 0.012], ["low", "medium", "high", "very_high"]), F.lit("very_high"))
    b = b.withColumn("rel", rel)
    return rounded(b.select("symbol", "ts", "spread", base.alias("baseline"), F.col("rel").alias("relative_cost"), lev.alias("cost_level")))


_SPR = f"""px AS (SELECT a.symbol || '|' || b.symbol AS symbol, a.symbol AS ls, b.symbol AS rs, a.ts, ln(a.close) - ln(b.close) AS s FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol), zz AS (SELECT symbol, ls, rs, ts, s, {_z('s', 60)} AS z FROM px)"""


def spreads(t):
    from ticktote.plans.pair_trade import spread_zscore

    return spread_zscore(all_pairs(t.bars()))


@query("t34_log_spread_zscore", f"""WITH {BARS}, {_SPR} SELECT ls AS left_symbol, rs AS right_symbol, ts, {r('s')} AS spread, {r('z')} AS z, CASE WHEN z IS NULL THEN 'NONE' WHEN abs(z) >= 4 THEN 'FORCE_EXIT' WHEN z >= 2 THEN 'SHORT_A_LONG_B' WHEN z <= -2 THEN 'LONG_A_SHORT_B' WHEN abs(z) <= 0.5 THEN 'CONVERGED' ELSE 'NONE' END AS zone FROM zz""")
def _(t):
    from ticktote.plans.pair_trade import zone

    return rounded(spreads(t).select("left_symbol", "right_symbol", "ts", "spread", "z", zone(F.col("z")).alias("zone")))


@query("t34_pair_position_state", f"""WITH RECURSIVE {BARS}, {_SPR}, n AS (SELECT symbol, ls, rs, ts, z, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM zz), st AS (SELECT symbol, ls, rs, ts, rn, 0 AS state FROM n WHERE rn = 1 UNION ALL
 SELECT n.symbol, n.ls, n.rs, n.ts, n.rn, CASE WHEN n.z IS NULL THEN st.state WHEN abs(n.z) >= 4 THEN 0 WHEN st.state <> 0 AND abs(n.z) <= 0.5 THEN 0 WHEN st.state = 0 THEN CASE WHEN n.z >= 2 THEN 2 WHEN n.z <= -2 THEN 1 ELSE 0 END ELSE st.state END FROM st JOIN n ON n.symbol = st.symbol AND n.rn = st.rn + 1)
 SELECT ls AS left_symbol, rs AS right_symbol, ts, state FROM st""")
def _(t):
    from ticktote.operators.sequence import number_rows

    d = number_rows(spreads(t).select(*PAIR, "ts", "z"), PAIR, ["ts"])
    return state_scan(d, PAIR, "pos", ["z"], lambda s, e: pair_position(s, e["z"]), 3).select(*PAIR, "ts", "state")


@query("t35_correlation_stability", f"""WITH {BARS}, px AS (SELECT a.symbol || '|' || b.symbol AS symbol, a.symbol AS ls, b.symbol AS rs, a.ts, a.close AS a, b.close AS b FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol),
 c AS (SELECT ls, rs, ts, {roll('corr', 'a', 24).replace('corr(a)', 'corr(a, b)')} AS recent, {roll('corr', 'a', 120).replace('corr(a)', 'corr(a, b)')} AS hist FROM px)
 SELECT ls AS left_symbol, rs AS right_symbol, ts, {r('recent')} AS recent_corr, {r('hist')} AS hist_corr, CASE WHEN abs(recent - hist) >= 0.3 THEN 1 ELSE 0 END AS unstable FROM c""")
def _(t):
    p = all_pairs(t.bars()).withColumns({"recent_corr": P2.corr("a", "b", 24), "hist_corr": P2.corr("a", "b", 120)})
    return rounded(p.select(*PAIR, "ts", "recent_corr", "hist_corr", flag(F.abs(F.col("recent_corr") - F.col("hist_corr")) >= 0.3).alias("unstable")))


@query("t36_lagged_corr_screen", f"""WITH {BARS}, x AS (SELECT symbol, ts, close / {lag('close')} - 1 AS ret FROM bars), u AS (SELECT symbol, ts, {lag('ret')} AS prev FROM x),
 p AS (SELECT j.symbol AS jp, u.symbol AS us, j.ts, j.ret, u.prev FROM x j JOIN u ON u.ts = j.ts WHERE j.symbol IN ('click', 'view') AND u.symbol IN ('error', 'purchase', 'signup') AND j.ret IS NOT NULL AND u.prev IS NOT NULL),
 c AS (SELECT jp, us, CASE WHEN count(*) OVER w >= 60 THEN corr(ret, prev) OVER w END AS c FROM p WINDOW w AS (PARTITION BY jp, us ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
 SELECT jp, us, {r('avg(c)')} AS mean_corr, {r('stddev_samp(c)')} AS std_corr, {r('max(c)')} AS max_corr, {r('min(c)')} AS min_corr, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) >= 120""")
def _(t):
    from ticktote.plans.pair_trade import lagged_correlation_screen

    return rounded(lagged_correlation_screen(t.bars(), ["click", "view"], ["error", "purchase", "signup"]))


@query("t37_residual_stationarity_rank", f"""WITH {BARS}, p AS (SELECT a.symbol AS ls, b.symbol AS rs, a.ts, ln(a.close) AS x, ln(b.close) AS y FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol),
 f AS (SELECT ls, rs, regr_slope(y, x) AS sl, regr_intercept(y, x) AS ic FROM p GROUP BY 1, 2), e AS (SELECT p.ls, p.rs, p.ts, y - sl * x - ic AS e FROM p JOIN f ON p.ls = f.ls AND p.rs = f.rs),
 d AS (SELECT ls, rs, e - lag(e) OVER w AS de, lag(e) OVER w AS e1 FROM e WINDOW w AS (PARTITION BY ls, rs ORDER BY ts)),
 g AS (SELECT ls, rs, regr_slope(de, e1) AS b, regr_count(de, e1) AS n, regr_sxx(de, e1) AS sxx, regr_syy(de, e1) AS syy FROM d GROUP BY 1, 2)
 SELECT ls AS left_symbol, rs AS right_symbol, {r('b')} AS slope, {r('b / sqrt((syy - b * b * sxx) / (n - 2) / sxx)', 5)} AS t_stat, rank() OVER (ORDER BY b / sqrt((syy - b * b * sxx) / (n - 2) / sxx)) AS rnk FROM g""")
def _(t):
    from ticktote.plans.pair_trade import residual_stationarity

    d = residual_stationarity(t.bars())
    d = d.withColumn("rnk", F.rank().over(Window.orderBy("t_stat")).cast("bigint"))
    return d.select("left_symbol", "right_symbol", rnd("slope").alias("slope"), rnd("t_stat", 5).alias("t_stat"), "rnk")


@query("t38_pair_trade_features", f"""WITH RECURSIVE {BARS}, g2 AS (SELECT *, close - {lag('close')} AS dd, close / {lag('close')} - 1 AS r1, close / {lag('close', 5)} - 1 AS r5, close / {lag('close', 20)} - 1 AS r20 FROM bars),
 {ema_sql('ag', 'g2', 'CASE WHEN dd > 0 THEN dd WHEN dd <= 0 THEN 0.0 END', '2.0/15')}, {ema_sql('al', 'g2', 'CASE WHEN dd < 0 THEN -dd WHEN dd >= 0 THEN 0.0 END', '2.0/15')}
 SELECT b.symbol, b.ts, {r(roll('stddev_samp', 'r1', 5, 'b.symbol', 'b.ts'))} AS vol_5, {r(roll('stddev_samp', 'r1', 20, 'b.symbol', 'b.ts'))} AS vol_20, {r('volume / nullif(' + roll('avg', 'volume', 20, 'b.symbol', 'b.ts') + ', 0)')} AS volume_ratio, {r('r1')} AS ret_1, {r('r5')} AS ret_5, {r('r20')} AS ret_20, {r('100 - 100 / (1 + ag.y / nullif(al.y, 0))')} AS rsi_span
 FROM g2 b LEFT JOIN ag ON b.symbol = ag.symbol AND b.ts = ag.ts LEFT JOIN al ON b.symbol = al.symbol AND b.ts = al.ts""")
def _(t):
    from ticktote.plans.pair_trade import pair_features

    return rounded(pair_features(t.bars()))


_CY = "(dayofweek(b.ts) + 6) % 7"


@query("t39_base_feature_set", f"""WITH RECURSIVE {BARS}, {_RSI}, {_BB}, {ema_sql('f', 'bars', 'close', '2.0/13')}, {ema_sql('s', 'bars', 'close', '2.0/27')}, m AS (SELECT f.symbol, f.ts, f.y - s.y AS macd FROM f JOIN s ON f.symbol = s.symbol AND f.ts = s.ts), {ema_sql('g', 'm', 'macd', '2.0/10')},
 w AS (SELECT *, {', '.join(f"{roll('avg', 'close', n)} AS ma_{n}" for n in (5, 25, 75))}, {', '.join(f"close / {lag('close', k)} - 1 AS ret_{k}" for k in (1, 3, 6, 24))} FROM bars)
 SELECT b.symbol, b.ts, {r('rsi.rsi')} AS rsi, {r('m.macd')} AS macd, {r('m.macd - g.y')} AS macd_hist, {r('4 * bb.s / nullif(bb.m, 0)')} AS bb_width, {r('(b.close - (bb.m - 2 * bb.s)) / nullif(4 * bb.s, 0)')} AS bb_pos, {', '.join(r(c) + ' AS ' + c for c in ('ma_5', 'ma_25', 'ma_75', 'ret_1', 'ret_3', 'ret_6', 'ret_24'))},
 {r(roll('stddev_samp', 'ret_1', 24, 'b.symbol', 'b.ts'))} AS vol_24, CAST(hour(b.ts) AS INT) AS hour, CAST({_CY} AS INT) AS dow, {r('sin(2 * pi() * hour(b.ts) / 24)')} AS hour_sin, {r('cos(2 * pi() * hour(b.ts) / 24)')} AS hour_cos, {r('abs(ret_1)')} AS abs_ret_1, {r('(b.high - b.low) / b.close')} AS hl_ratio, {r('(ma_5 - ma_75) / b.close')} AS ma_cross
 FROM w b JOIN rsi ON rsi.symbol = b.symbol AND rsi.ts = b.ts JOIN bb ON bb.symbol = b.symbol AND bb.ts = b.ts JOIN m ON m.symbol = b.symbol AND m.ts = b.ts JOIN g ON g.symbol = b.symbol AND g.ts = b.ts""")
def _(t):
    from ticktote.plans.features import base_features

    return rounded(base_features(t.bars()))


@query("t40_stock_baseline", f"""WITH {BARS}, {_RSI}, x AS (SELECT b.*, r.rsi, b.close / {lag('b.close', 1, 'b.symbol', 'b.ts')} - 1 AS r1, b.close / {lag('b.close', 5, 'b.symbol', 'b.ts')} - 1 AS r5, b.close / {lag('b.close', 20, 'b.symbol', 'b.ts')} - 1 AS r20 FROM bars b JOIN rsi r ON r.symbol = b.symbol AND r.ts = b.ts),
 u AS (SELECT symbol AS leader, ts, {lag('r1')} AS us_prev FROM x), f AS (SELECT symbol AS target, ts, r1, r5, r20, rsi, x.volume / nullif({roll('avg', 'x.volume', 20, 'x.symbol', 'x.ts')}, 0) AS vr, {roll('stddev_samp', 'r1', 20, 'x.symbol', 'x.ts')} AS v20 FROM x),
 k AS (SELECT DISTINCT leader FROM u) SELECT target, k.leader, f.ts, {r('r1')} AS target_ret_1, {r('r5')} AS target_ret_5, {r('r20')} AS target_ret_20, {r('rsi')} AS rsi, {r('vr')} AS volume_ratio,
 {r('v20')} AS vol_20, {r('us_prev')} AS us_prev, {r('rsi * us_prev')} AS rsi_x_us FROM f JOIN k ON k.leader <> f.target LEFT JOIN u ON u.leader = k.leader AND u.ts = f.ts""")
def _(t):
    """Every target with every other instrument as its leader."""
    from ticktote.plans.features import stock_baseline

    one, other = F.struct(F.col("left_symbol").alias("target"), F.col("right_symbol").alias("leader")), F.struct(F.col("right_symbol").alias("target"), F.col("left_symbol").alias("leader"))
    pairs = pair_statistics(t.bars(), x="close").select(F.explode(F.array(one, other)).alias("p")).select("p.*")
    return rounded(stock_baseline(t.bars(), pairs))
