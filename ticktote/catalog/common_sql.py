"""Shared CTEs of the oracle SQL, written independently of the DataFrame code."""

from __future__ import annotations

BARS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
 first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
 last(value ORDER BY ts, event_id) AS close, sum(value) AS volume FROM events GROUP BY 1, 2)"""

DAILY = """daily AS (SELECT l_suppkey AS symbol, l_shipdate AS ts,
 first(l_extendedprice/l_quantity ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity) AS open,
 max(l_extendedprice/l_quantity) AS high, min(l_extendedprice/l_quantity) AS low,
 last(l_extendedprice/l_quantity ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_quantity) AS close,
 sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"""

AUX = """aux AS (SELECT event_type AS series_id, date_trunc('day', ts) AS ts, avg(value) AS value, count(*) AS n_obs
 FROM events GROUP BY 1, 2)"""

MONTHLY = """monthly AS (SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate) AS ts,
 avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"""

CALENDAR = """calendar AS (SELECT event_id, ts AS event_ts, CAST(json_extract_string(props, '$.k') AS INT) % 3 + 1 AS importance
 FROM events WHERE event_type = 'error' AND value > 150.0)"""

RACES = """races AS (SELECT o_orderkey AS race_id, o_orderdate AS race_date, o_orderpriority AS grade, o_orderstatus AS status,
 o_totalprice AS purse, c_nationkey AS venue_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""

ENTRIES = """e0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber,
  l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS car_no,
  l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS prob FROM lineitem),
 entries AS (SELECT l_orderkey AS race_id, CAST(car_no AS INT) AS car_no, l_suppkey AS racer_id, l_partkey AS motor_id,
  l_extendedprice AS score, l_quantity AS qty, l_discount AS disc, l_tax AS tax, l_returnflag AS style,
  l_linestatus AS status, l_shipdate AS ship_ts, l_linenumber AS post,
  count(*) OVER (PARTITION BY l_orderkey) AS field_size, prob, 0.75 / prob * (0.8 + 12 * l_discount) AS odds,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice * (1 - l_discount) DESC, car_no) AS INT) AS finish
  FROM e0)"""

RE = ENTRIES + ", " + RACES + """, re AS (SELECT e.*, r.race_date, r.grade, r.status AS race_status, r.purse, r.venue_id
 FROM entries e JOIN races r USING (race_id))"""

SNAPS = ENTRIES + """, snaps AS (SELECT race_id, car_no, prob, minutes,
 odds * (1 + 3 * tax * minutes / 120 * CASE WHEN car_no % 2 = 0 THEN 1 ELSE -1 END) AS odds
 FROM entries, (SELECT unnest([120, 60, 30, 15, 5, 1, 0]) AS minutes))"""

BETS = RE + """, bets AS (SELECT race_id, race_date, grade AS strategy, venue_id, car_no, style, prob, odds, field_size,
 prob * odds AS ev, CASE WHEN finish = 1 THEN 1 ELSE 0 END AS hit, CASE WHEN finish = 1 THEN odds * 100 ELSE 0.0 END AS payout,
 CASE WHEN finish = 1 THEN odds - 1 ELSE -1.0 END * 0.02 AS ret
 FROM re QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY prob DESC, car_no) = 1)"""


TRADES = BARS + """, t0 AS (SELECT *, close / lag(close) OVER w - 1 AS ret1, lead(close, 4) OVER w / close - 1 AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
 t1 AS (SELECT *, CASE WHEN count(ret1) OVER w >= 24 THEN stddev_samp(ret1) OVER w END AS vol FROM t0 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
 trades AS (SELECT symbol, ts, open, high, low, close, vol, fwd, CASE WHEN close < open THEN 1 ELSE -1 END AS side, 0.5 + 0.5 * abs(close - open) / (high - low) AS conf,
 3 + hour(ts) % 3 AS agreement, CASE WHEN close < open THEN 1 ELSE -1 END * fwd * 0.01 AS ret FROM t1 WHERE fwd IS NOT NULL AND high > low)"""


def roll(agg: str, x: str, n: int, part: str = "symbol", order: str = "ts", mp: int | None = None) -> str:
    """Rolling aggregate over n rows, NULL below mp non-null values."""
    w = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {n if mp is None else mp} THEN {agg}({x}) {w} END"


def lag(x: str, k: int = 1, part: str = "symbol", order: str = "ts") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {part} ORDER BY {order})"


def r(x: str, n: int = 6) -> str:
    """Rounded like functions.core.rnd, with negative zero folded."""
    v = f"round(CAST({x} AS DOUBLE) + 0.0123456e-{n}::DOUBLE, {n})"
    return f"(CASE WHEN {v} = 0 THEN 0.0::DOUBLE ELSE {v} END)"
