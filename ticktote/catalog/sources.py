"""Scans, sinks, upserts, audits and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ticktote.catalog.common_sql import BARS, BETS, ENTRIES, RACES, r
from ticktote.catalog.metrics import EQ
from ticktote.catalog.registry import query
from ticktote.functions import calendar as cal
from ticktote.functions import text as tx
from ticktote.functions.core import all_reasons, code_map, flag, rnd, rounded, sdiv
from ticktote.sources import files as fs

C = F.col


@query("s1_csv_bar_scan", f"""WITH {BARS} SELECT symbol, ts, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, CASE WHEN hour(ts) = 5 THEN NULL ELSE {r('volume')} END AS volume FROM bars WHERE hour(ts) <> 3""")
def _(t):
    """Bars written out as CSV lines with headers, bad numbers and rows without a close, then parsed back."""
    b = t.bars()
    num = lambda c: F.format_string("%.17g", C(c))
    vol = F.when(F.hour("ts") == 5, "n/a").otherwise(num("volume"))
    close = F.when(F.hour("ts") == 3, "").otherwise(num("close"))
    line = F.concat_ws(",", C("ts").cast("string"), close, num("high"), num("low"), num("open"), vol)
    first = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) == 1
    heads = [F.lit("Price,Close,High,Low,Open,Volume"), F.lit("Ticker,X,X,X,X,X"), F.lit("Datetime,,,,,")]
    lines = b.withColumn("_f", first).select("symbol", F.explode(F.when(C("_f"), F.array(*heads, line)).otherwise(F.array(line))).alias("line"))
    return rounded(fs.from_csv_lines(lines).select("symbol", "ts", "open", "high", "low", "close", "volume"))


@query("s2_daily_bar_scan", f"WITH {BARS} SELECT symbol, CAST(ts AS DATE) AS day, {r('arg_max(close, ts)')} AS close FROM bars GROUP BY 1, 2")
def _(t):
    line = F.concat_ws(",", "symbol", F.date_format("ts", "yyyyMMdd"), F.date_format("ts", "HH"), F.format_string("%.17g", C("close")))
    p = t.bars().select(F.from_csv(line, "symbol string, d string, h int, close double").alias("p")).select("p.*")
    return rounded(p.groupBy("symbol", F.to_date("d", "yyyyMMdd").alias("day")).agg(F.max_by("close", "h").alias("close")))


@query("s3_rate_series_outer_union", """WITH a AS (SELECT date_trunc('month', o_orderdate)::DATE AS day, avg(o_totalprice) AS v FROM orders WHERE month(o_orderdate) <> 5 GROUP BY 1), b AS (SELECT date_trunc('month', l_shipdate)::DATE AS day, avg(l_discount) AS v FROM lineitem WHERE month(l_shipdate) <> 6 GROUP BY 1)
 SELECT coalesce(a.day, b.day) AS day, """ + r("a.v", 4) + " AS rate_10y, " + r("b.v") + " AS rate_diff FROM a FULL JOIN b ON a.day = b.day")
def _(t):
    a = t.raw("orders").where(F.month("o_orderdate") != 5).groupBy(F.trunc("o_orderdate", "month").alias("day")).agg(rnd(F.avg("o_totalprice"), 4).alias("rate_10y"))
    b = t.raw("lineitem").where(F.month("l_shipdate") != 6).groupBy(F.trunc("l_shipdate", "month").alias("day")).agg(rnd(F.avg("l_discount")).alias("rate_diff"))
    return a.join(b, "day", "full_outer")


@query("s4_race_scan_with_predicates", f"WITH {RACES} SELECT race_id, race_date, grade, race_status FROM (SELECT race_id, race_date, grade, status AS race_status FROM races) WHERE race_date BETWEEN '1997-01-01' AND '1997-06-30' AND race_status = 'F'")
def _(t):
    lit = lambda s: F.lit(s).cast("timestamp_ntz")
    d = fs.date_filter(t.races(False), "race_date", lit("1997-01-01"), lit("1997-06-30")).where("race_status = 'F'")
    return d.select("race_id", "race_date", "grade", "race_status")


@query("s5_format_switching_reader", "SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH'")
def _(t):
    d = fs.load_table(t.spark, f"{t.path}/orders.parquet", "parquet", t.raw("orders").schema)
    return d.where("o_orderpriority = '2-HIGH'").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("s6_date_and_race_filter", "SELECT l_orderkey AS race_id, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= '1998-01-01' AND l_shipdate <= '1998-02-28' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    lit = lambda s: F.lit(s).cast("timestamp_ntz")
    d = fs.date_filter(t.raw("lineitem"), "l_shipdate", lit("1998-01-01"), lit("1998-02-28"))
    o = t.raw("orders").where("o_orderpriority = '1-URGENT'").select(C("o_orderkey").alias("l_orderkey"))
    return d.join(o, "l_orderkey", "left_semi").select(C("l_orderkey").alias("race_id"), "l_linenumber", "l_quantity")


@query("s7_cached_file_collection", "SELECT 'customer' AS symbol, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'orders', count(*) FROM orders")
def _(t):
    """One read over many files; the symbol comes from the file name."""
    d = t.spark.read.parquet(*[f"{t.path}/{n}.parquet" for n in ("customer", "supplier", "orders")])
    return d.groupBy(F.regexp_extract(C("_metadata.file_path"), r"([^/]+?)\.parquet", 1).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@query("s8_market_payload_flattening", f"WITH {BARS} SELECT symbol, ts, {r('open')} AS open, {r('close')} AS close, {r('volume')} AS volume FROM bars")
def _(t):
    """Day payloads in the exchange's array form (with a repeated row), flattened and de-duplicated."""
    b = t.bars().withColumn("ms", F.unix_millis(C("ts").cast("timestamp")))
    num = lambda c: F.format_string("%.17g", C(c))
    row = F.struct(C("ms").alias("t"), num("open").alias("o"), num("high").alias("h"), num("low").alias("l"), num("close").alias("c"), num("volume").alias("v"))
    days = b.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.collect_list(row).alias("a"))
    body = F.to_json(F.concat(C("a"), F.slice("a", 1, 1)))
    d = fs.flatten_klines(days.withColumn("body", body), "body", ["symbol"])
    return rounded(d.select("symbol", C("ts").cast("timestamp_ntz").alias("ts"), "open", "close", "volume"))


_PR = """pr AS (SELECT CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_returnflag END AS code, CASE l_returnflag WHEN 'A' THEN 'ALPHA YEN' ELSE 'OTHER' END AS name, date_trunc('week', l_shipdate) AS week, l_orderkey * 100 + l_linenumber AS ver, l_quantity, l_discount FROM lineitem)"""


def position_source(t):
    flagc = C("l_returnflag")
    return t.raw("lineitem").select(
        F.when(C("l_partkey") % 9 != 0, flagc).alias("code"), F.when(flagc == "A", "ALPHA YEN").otherwise("OTHER").alias("name"), F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("week"),
        F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_discount").alias("ver"), "l_quantity", "l_discount")


@query("s9_position_file_extraction", _PR.join(["WITH ", """ SELECT code, week, arg_max(l_quantity, (l_o, l_n, l_quantity, l_discount)) AS net FROM (SELECT *, ver // 100 AS l_o, ver % 100 AS l_n FROM pr) WHERE coalesce(code = 'A', contains(lower(name), 'yen')) GROUP BY 1, 2"""]))
def _(t):
    d = fs.position_rows(position_source(t), "code", "name", ["A"], "yen", "week", "ver")
    return d.select("code", "week", C("l_quantity").alias("net"))


@query("s21_multi_contract_extraction", _PR.join(["WITH ", """ SELECT CASE code WHEN 'A' THEN 'AUD' WHEN 'R' THEN 'RUB' END AS symbol, week, arg_max(l_quantity, (ver // 100, ver % 100, l_quantity, l_discount)) AS net FROM pr WHERE code IN ('A', 'R') GROUP BY 1, 2"""]))
def _(t):
    d = fs.position_rows(position_source(t), "code", "name", ["A", "R"], "\x00", "week", "ver").where("code IS NOT NULL")
    return d.select(code_map("code", {"A": "AUD", "R": "RUB"}, "").alias("symbol"), "week", C("l_quantity").alias("net"))


@query("s10_page_match_extraction", """WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)">([A-Za-z]+)<', 1)) AS k, unnest(regexp_extract_all(html, 'href="/([A-Za-z]+)">([A-Za-z]+)<', 2)) AS v, unnest(range(1, len(regexp_extract_all(html, 'href="/([A-Za-z]+)">([A-Za-z]+)<', 1)) + 1)) AS n FROM pages)
 SELECT page_id, CAST(n AS INT) AS match_no, k AS target, v AS caption FROM m""")
def _(t):
    return fs.extract_matches(t.raw("pages"), "html", r'href="/([A-Za-z]+)">([A-Za-z]+)<', ["target", "caption"], ["page_id"])


_DAY = """w AS (SELECT race_id, max(race_id) // 8 AS page, max(CASE WHEN finish = 1 THEN car_no END) AS a, max(CASE WHEN finish = 2 THEN car_no END) AS b, max(CASE WHEN finish = 3 THEN car_no END) AS c FROM entries WHERE field_size >= 3 GROUP BY 1),
 n AS (SELECT *, CAST(row_number() OVER (PARTITION BY page ORDER BY race_id) AS INT) AS race_no FROM w)"""


@query("s10_payout_page_parse", f"WITH {ENTRIES}, {_DAY} SELECT page, race_no, a || '-' || b || '-' || c AS combo, CAST(race_id * 37 % 90000 + 1000 AS INT) AS payout FROM n WHERE race_id % 5 <> 0")
def _(t):
    """Result pages of several races and tables, rendered from the finish order and parsed back; some races are void."""
    car = lambda k: F.max(F.when(C("finish") == k, C("car_no")))
    g = t.entries().where("field_size >= 3").groupBy("race_id").agg(car(1).alias("a"), car(2).alias("b"), car(3).alias("c"))
    pay = F.format_number((C("race_id") * 37 % 90000 + 1000).cast("int"), 0)

    def table(name, *rows):
        head = F.lit(f"<table class='r'><tr><th>{name}</th><th>払戻</th></tr>")
        return F.concat(head, *[F.concat(F.lit(f"<tr>\n<td>{k}</td><td>"), v, F.lit("</td></tr>")) for k, v in rows], F.lit("</table>"))

    won = F.concat(F.lit("<b>"), F.concat_ws(" - ", "a", "b", "c"), F.lit("</b>  "), pay, F.lit("円"))
    void = F.when(C("race_id") % 5 == 0, "不成立").otherwise(won)
    html = F.concat(
        table("2車連", ("複", F.concat_ws("-", "a", "b")), ("単", F.concat(F.concat_ws("-", "b", "a", "c"), F.lit(" 99円")))),
        table("3連勝", ("複", F.concat(F.concat_ws("-", "c", "b", "a"), F.lit(" 77円"))), ("単", void), ("単", F.lit("1-1-1 1円"))),
        table("ワイド", ("単", F.lit("1-2-3 55円"))))
    pages = g.select(F.expr("race_id div 8").alias("page"), "race_id", html.alias("h")).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("race_id", "h"))).alias("r"))
    return fs.extract_payouts(pages.select("page", F.array_join(C("r.h"), "<hr>").alias("html")), "html", ["page"])


@query("s11_partitioned_sink", f"WITH {BARS} SELECT symbol, count(*) AS n, {r('sum(close)', 4)} AS total FROM bars GROUP BY 1")
def _(t):
    path = fs.scratch_dir(t.spark, "bars")
    fs.write_table(t.bars(), path, ["symbol"], "overwrite")
    g = t.spark.read.parquet(path).groupBy(C("symbol").cast("string").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("close"), 4).alias("total"))
    return g


_UP = "old AS (SELECT l_suppkey AS k, max(l_extendedprice) AS v, 1 AS ver FROM lineitem WHERE l_shipdate < '1998-01-01' GROUP BY 1), nw AS (SELECT l_suppkey AS k, min(l_extendedprice) AS v, 2 AS ver FROM lineitem WHERE l_shipdate >= '2001-06-01' AND l_quantity > 45 GROUP BY 1)"


def up(t):
    li = t.raw("lineitem")
    lit = lambda s: F.lit(s).cast("timestamp_ntz")
    old = li.where(C("l_shipdate") < lit("1998-01-01")).groupBy(C("l_suppkey").alias("k")).agg(F.max("l_extendedprice").alias("v")).withColumn("ver", F.lit(1))
    new = li.where((C("l_shipdate") >= lit("2001-06-01")) & (C("l_quantity") > 45)).groupBy(C("l_suppkey").alias("k")).agg(F.min("l_extendedprice").alias("v")).withColumn("ver", F.lit(2))
    return old, new


@query("s12_idempotent_upsert", f"WITH {_UP} SELECT coalesce(nw.k, old.k) AS k, coalesce(nw.v, old.v) AS v, coalesce(nw.ver, old.ver) AS ver FROM old FULL JOIN nw ON old.k = nw.k")
def _(t):
    old, new = up(t)
    return fs.upsert(old, new, ["k"], "ver")


@query("s13_insert_or_ignore", f"WITH {_UP}, o2 AS (SELECT * FROM old WHERE v < 104500) SELECT * FROM o2 UNION ALL SELECT * FROM nw WHERE k NOT IN (SELECT k FROM o2)")
def _(t):
    old, new = up(t)
    return fs.insert_ignore(old.where("v < 104500"), new, ["k"], ["ver"])


@query("s14_coalescing_update", f"""WITH {_UP}, o2 AS (SELECT k, CASE WHEN k % 4 <> 0 THEN v END AS v, CASE WHEN k % 3 <> 0 THEN ver END AS ver FROM old) SELECT o2.k, CASE WHEN o2.v IS NULL OR o2.ver IS NULL THEN coalesce(nw.v, o2.v) ELSE o2.v END AS v, CAST(CASE WHEN o2.v IS NULL OR o2.ver IS NULL THEN coalesce(nw.ver, o2.ver) ELSE o2.ver END AS DOUBLE) AS ver FROM o2 LEFT JOIN nw ON nw.k = o2.k""")
def _(t):
    old, new = up(t)
    o2 = old.select("k", F.when(C("k") % 4 != 0, C("v")).alias("v"), F.when(C("k") % 3 != 0, C("ver")).alias("ver"))
    d = fs.coalesce_update(o2, new, ["k"], ["v", "ver"], ["v", "ver"])
    return d.withColumn("ver", C("ver").cast("double"))


@query("s15_fetch_log_dedup", "WITH w AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, c_nationkey AS venue_id FROM orders JOIN customer ON c_custkey = o_custkey), l AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, c_nationkey AS venue_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F') SELECT * FROM w EXCEPT SELECT * FROM l")
def _(t):
    rc = t.races().select(F.to_date("race_date").alias("day"), "venue_id", "race_status")
    done = rc.where("race_status = 'F'").select("day", "venue_id").distinct()
    return rc.select("day", "venue_id").distinct().join(done, ["day", "venue_id"], "left_anti")


@query("s16_table_statistics", "SELECT 'orders' AS name, count(*) AS n_rows, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days FROM orders UNION ALL SELECT 'lineitem', count(*), CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE), count(DISTINCT CAST(l_shipdate AS DATE)) FROM lineitem")
def _(t):
    def st(name, day):
        d = t.raw(name).groupBy(F.to_date(day).alias("d")).agg(F.count(F.lit(1)).alias("n"))
        return d.agg(F.lit(name).alias("name"), F.sum("n").alias("n_rows"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("d").alias("n_days"))

    return st("orders", "o_orderdate").unionByName(st("lineitem", "l_shipdate"))


@query("s17_data_quality_profile", "SELECT count(*) AS n, count(*) FILTER (l_discount = 0) AS zero_discount, count(*) FILTER (l_quantity IS NULL) AS null_quantity, min(l_quantity) AS min_quantity, max(l_quantity) AS max_quantity, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, count(*) FILTER (l_tax > 0.08) AS bad_tax FROM lineitem")
def _(t):
    cnt = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return t.raw("lineitem").agg(
        F.count(F.lit(1)).alias("n"), cnt(C("l_discount") == 0, "zero_discount"), cnt(C("l_quantity").isNull(), "null_quantity"), F.min("l_quantity").alias("min_quantity"), F.max("l_quantity").alias("max_quantity"),
        F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"), cnt(C("l_tax") > 0.08, "bad_tax"))


_EVF = "ev AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE event_type END AS name, CASE WHEN event_id % 11 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts, CASE event_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'medium' WHEN 2 THEN 'LOW' ELSE 'odd' END AS impact FROM events)"


def event_rows(t):
    return t.raw("events").select(
        "event_id", F.when(C("event_id") % 10 == 0, "").otherwise(C("event_type")).alias("name"), F.when(C("event_id") % 11 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"),
        code_map(C("event_id") % 4, {0: "High", 1: "medium", 2: "LOW"}, "odd").alias("impact"))


@query("s18_custom_event_file", f"WITH {_EVF} SELECT name, CAST(ts AS TIMESTAMP) AS event_ts, lower(impact) AS impact FROM ev WHERE name <> '' AND ts <> 'soon' AND impact <> 'odd'")
def _(t):
    return fs.split_valid_events(event_rows(t))[0]


@query("s18_rejected_events", f"WITH {_EVF} SELECT CASE WHEN name = '' THEN 'name missing' WHEN ts = 'soon' THEN 'time not readable' ELSE 'impact unknown' END AS reason, count(*) AS n FROM ev WHERE name = '' OR ts = 'soon' OR impact = 'odd' GROUP BY 1")
def _(t):
    return fs.split_valid_events(event_rows(t))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("s19_event_journal", f"WITH {EQ}, j AS (SELECT CAST(year(race_date) AS INT) AS year, strategy, (peak - equity) / peak AS dd, hit FROM eq) SELECT year, strategy, CASE WHEN dd >= 0.95 THEN 'BLOCKED' WHEN hit = 1 THEN 'WIN' ELSE 'LOSS' END AS event, count(*) AS n, {r('max(dd)')} AS max_drawdown FROM j GROUP BY 1, 2, 3")
def _(t):
    """Account journal appended to a partitioned sink and read back."""
    from ticktote.operators.metrics import equity_curve

    d = equity_curve(t.bets(), ["strategy"], "ret", ["race_date", "race_id"])
    j = d.select("race_id", "race_date", F.year("race_date").alias("year"), "strategy", F.when(C("drawdown") >= 0.95, "BLOCKED").when(C("hit") == 1, "WIN").otherwise("LOSS").alias("event"), "equity", "drawdown")
    path = fs.scratch_dir(t.spark, "journal")
    fs.write_table(j, path, ["year"], "append")
    return rounded(t.spark.read.parquet(path).groupBy("year", "strategy", "event").agg(F.count(F.lit(1)).alias("n"), F.max("drawdown").alias("max_drawdown")))


@query("s20_payout_scan", f"WITH {BETS} SELECT race_id, car_no, {r('payout', 4)} AS payout FROM bets WHERE hit = 1 AND payout > 0 AND race_date >= '1998-01-01' AND race_date < '1999-01-01'")
def _(t):
    lit = lambda s: F.lit(s).cast("timestamp_ntz")
    d = t.bets().where((C("hit") == 1) & (C("payout") > 0) & (C("race_date") >= lit("1998-01-01")) & (C("race_date") < lit("1999-01-01")))
    return d.select("race_id", "car_no", rnd("payout", 4).alias("payout"))


# ---- scalar families -----------------------------------------------------------
@query("f1_math_functions", f"WITH {ENTRIES} SELECT race_id, car_no, {r('ln(score)')} AS ln_score, {r('exp(-odds)')} AS exp_odds, {r('sqrt(qty)')} AS sqrt_qty, {r('(exp(2 * disc) - 1) / (exp(2 * disc) + 1)')} AS tanh_disc, {r('pow(prob, 1.5)')} AS pow_prob, CAST(sign(disc - 0.05) AS DOUBLE) AS sgn, {r('least(greatest(odds, 2), 20)')} AS clipped, {r('radians(qty)')} AS rad FROM entries")
def _(t):
    from ticktote.functions.core import clip

    return rounded(t.entries().select(
        "race_id", "car_no", F.log("score").alias("ln_score"), F.exp(-C("odds")).alias("exp_odds"), F.sqrt("qty").alias("sqrt_qty"), F.tanh("disc").alias("tanh_disc"), F.pow("prob", F.lit(1.5)).alias("pow_prob"),
        F.signum(C("disc") - 0.05).alias("sgn"), clip("odds", 2, 20).alias("clipped"), F.radians("qty").alias("rad")))


@query("f2_date_functions", "SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d')::DATE AS day, last_day(o_orderdate) AS month_end, CAST(date_trunc('month', o_orderdate) + to_months(3) AS DATE) AS plus3, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days, CAST(isodow(o_orderdate) - 1 AS INT) AS dow FROM orders")
def _(t):
    d = F.to_date(F.date_format("o_orderdate", "yyyyMMdd"), "yyyyMMdd")
    return t.raw("orders").select(
        "o_orderkey", d.alias("day"), F.last_day("o_orderdate").alias("month_end"), F.add_months(F.trunc("o_orderdate", "month"), 3).alias("plus3"),
        F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("bigint").alias("days"), F.weekday("o_orderdate").alias("dow"))


@query("f3_macro_event_generator", """WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders), d AS (SELECT m, CAST(unnest(generate_series(m, last_day(m), INTERVAL 1 DAY)) AS DATE) AS d FROM m), k AS (SELECT *, isodow(d) AS w, row_number() OVER (PARTITION BY m, isodow(d) ORDER BY d) AS n FROM d)
 SELECT CASE WHEN w = 5 AND n = 1 THEN 'payrolls' ELSE 'rate_decision' END AS name, CAST(d AS TIMESTAMP) + INTERVAL 14 HOUR AS event_ts, 3 AS importance FROM k WHERE (w = 5 AND n = 1) OR (w = 3 AND n = 3) UNION ALL SELECT 'inflation', CAST(m + 14 AS TIMESTAMP) + INTERVAL 14 HOUR, 2 FROM m""")
def _(t):
    m = t.raw("orders").select(F.trunc("o_orderdate", "month").alias("month")).distinct()
    d = cal.macro_events(m)
    return d.withColumn("event_ts", C("event_ts").cast("timestamp_ntz"))


@query("f4_string_functions", "SELECT p_partkey, upper(p_name) AS up, trim(substr(p_brand, 7)) AS num, CAST(len(string_split(p_name, ' ')) AS INT) AS words, CAST((length(p_name) - length(replace(p_name, 'e', ''))) AS INT) AS n_e, regexp_replace(p_type, '(MY|ARD)$', '') AS stem, contains(lower(p_name), 'red') AS has_red FROM part")
def _(t):
    return t.raw("part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.trim(F.substring("p_brand", 7, 100)).alias("num"), F.size(F.split("p_name", " ")).alias("words"), tx.occurrences("p_name", "e").alias("n_e"),
        F.regexp_replace("p_type", "(MY|ARD)$", "").alias("stem"), F.lower("p_name").contains("red").alias("has_red"))


# what riders say, by motor_id % 13, with role, target (car_no of the follower) and confidence
_SAID = [
    ("前から行きます", "lead", "NULL", 0.8), ("自力で逃げたい", "lead", "NULL", 0.8), ("先手で頑張る", "lead", "NULL", 0.8), ("一人でやります", "single", "NULL", 0.8), ("単騎です", "single", "NULL", 0.8),
    ("#選手の後ろです", "follow", "'R' || car_no", 0.7), ("#君に付けます", "follow", "'R' || car_no", 0.7), ("#番の後ろへ", "follow", "'R' || car_no", 0.7), ("番手で勝負", "follow", "NULL", 0.7), ("後ろにつきます", "follow", "NULL", 0.7),
    ("I follow the # today", "follow", "'R' || car_no", 0.7), ("second wheel please", "follow", "NULL", 0.7), ("特になし", "unknown", "NULL", 0.3)]
_PICK = lambda k: " ".join(f"WHEN {i} THEN {x[k] if k == 2 else repr(x[k])}" for i, x in enumerate(_SAID))
_CMT = f"cmt AS (SELECT race_id, car_no, CASE motor_id % 13 {_PICK(1)} END AS role, CASE motor_id % 13 {_PICK(2)} END AS target, CASE motor_id % 13 {_PICK(3)} END AS confidence FROM entries)"


def comments(t):
    """Comments of riders called R and their number."""
    said = F.element_at(F.array(*[F.lit(x[0]) for x in _SAID]), (C("motor_id") % 13 + 1).cast("int"))
    return t.entries().select("race_id", "car_no", F.replace(said, F.lit("#"), F.concat(F.lit("R"), C("car_no"))).alias("txt"))


@query("f5_intent_classification", f"WITH {ENTRIES}, {_CMT} SELECT race_id, car_no, role, coalesce(target, '') AS target FROM cmt")
def _(t):
    d = tx.comment_intent(comments(t), "txt")
    return d.select("race_id", "car_no", "role", F.coalesce("target", F.lit("")).alias("target"))


@query("x5_comment_intent_confidence", f"WITH {ENTRIES}, {_CMT} SELECT race_id, car_no, role, CAST(confidence AS DOUBLE) AS confidence FROM cmt")
def _(t):
    return tx.comment_intent(comments(t), "txt").select("race_id", "car_no", "role", "confidence")


@query("f6_array_functions", f"WITH {ENTRIES} SELECT race_id, string_agg(lpad(CAST(car_no AS VARCHAR), 2, '0'), '' ORDER BY finish) AS combo_key, string_agg(CAST(car_no AS VARCHAR), '-' ORDER BY car_no) AS sorted_combo, max(CASE WHEN car_no = 1 THEN 1 ELSE 0 END) AS has_one, CAST(bool_and(car_no <= 4) AS INT) AS all_low FROM entries WHERE finish <= 3 GROUP BY 1")
def _(t):
    e = t.entries().where("finish <= 3").groupBy("race_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("finish", "car_no"))), lambda x: x["car_no"]).alias("c"))
    key = F.array_join(F.transform("c", lambda x: F.lpad(x.cast("string"), 2, "0")), "")
    d = e.withColumn("combo_key", key).withColumn("p", tx_combo("combo_key"))
    return d.select("race_id", "combo_key", F.array_join(F.transform(F.array_sort("p"), lambda x: x.cast("string")), "-").alias("sorted_combo"), flag(F.array_contains("p", 1)).alias("has_one"), flag(F.forall("p", lambda x: x <= 4)).alias("all_low"))


def tx_combo(key: str):
    """'010203' to [1, 2, 3]."""
    return F.transform(F.regexp_extract_all(key, F.lit("([0-9]{2})"), F.lit(1)), lambda x: x.cast("int"))


@query("f7_prediction_line_parse", f"WITH {ENTRIES} SELECT race_id, max(CASE WHEN finish = 1 THEN car_no END) AS favourite, CAST(max(CASE WHEN finish = 2 THEN car_no END) AS DOUBLE) AS second, CAST(max(CASE WHEN finish = 3 THEN car_no END) AS DOUBLE) AS third FROM entries WHERE finish <= 3 GROUP BY 1")
def _(t):
    e = t.entries().where("finish <= 3").groupBy("race_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("finish", "car_no"))), lambda x: x["car_no"].cast("string")).alias("c"))
    line = F.concat_ws(",", F.array_join(F.slice("c", 1, 2), "-"), F.try_element_at("c", F.lit(3)))
    d = tx.parse_prediction_line(e.withColumn("line", line), "line")
    return d.select("race_id", "favourite", C("second").cast("double").alias("second"), C("third").cast("double").alias("third"))


@query("f8_json_payouts", "SELECT event_id, 'k' AS combo, CAST(json_extract_string(props, '$.k') AS INT) AS payout FROM events UNION ALL SELECT event_id, 'k2', CAST(json_extract_string(props, '$.k') AS INT) * 2 FROM events WHERE event_id % 2 = 0")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    row = lambda n, v: F.struct(F.lit(n).alias("combo"), v.alias("payout"))
    js = F.to_json(F.when(C("event_id") % 2 == 0, F.array(row("k", k), row("k2", k * 2))).otherwise(F.array(row("k", k))))
    d = t.raw("events").select("event_id", js.alias("wide_payouts"))
    return d.select("event_id", F.explode(F.from_json("wide_payouts", "array<struct<combo:string,payout:int>>")).alias("p")).select("event_id", "p.combo", "p.payout")


@query("f9_map_functions", f"WITH {BETS}, g AS (SELECT strategy, CASE WHEN ev < 0.8 THEN 'low value' WHEN odds > 10 THEN 'long odds' ELSE 'taken' END AS reason, count(*) AS n FROM bets GROUP BY 1, 2) SELECT strategy, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(max(n) FILTER (reason = 'low value'), 0) AS BIGINT) AS low_value, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM g GROUP BY 1")
def _(t):
    reason = F.when(C("ev") < 0.8, "low value").when(C("odds") > 10, "long odds").otherwise("taken")
    g = t.bets().groupBy("strategy", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    m = g.groupBy("strategy").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("m"))
    text = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return m.select("strategy", "total", F.coalesce(F.try_element_at("m", F.lit("low value")), F.lit(0)).alias("low_value"), text.alias("reasons"))


@query("f10_time_zone", "SELECT event_id, date_trunc('second', ts) + INTERVAL 9 HOUR AS jst, CAST(hour(ts + INTERVAL 9 HOUR) AS INT) AS jst_hour FROM events")
def _(t):
    j = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), C("ts"))
    return t.raw("events").select("event_id", F.date_trunc("second", j).cast("timestamp_ntz").alias("jst"), F.hour(j).alias("jst_hour"))


@query("f11_pair_name_normalisation", "SELECT s_suppkey, upper(regexp_replace(s_name, '[/_# -]', '', 'g')) AS pair FROM supplier")
def _(t):
    return t.raw("supplier").select("s_suppkey", F.upper(F.regexp_replace("s_name", "[/_# -]", "")).alias("pair"))


# ---- text ------------------------------------------------------------------------
_LEX = {"the": 0.3, "est": 0.6, "and": 0.2, "ver": -0.4, "ment": -0.5, "una": 0.4, "sch": -0.6}
_SUM = " + ".join(f"{v} * ((length(text) - length(replace(text, '{k}', ''))) / {len(k)})" for k, v in _LEX.items())


def _cnt(ws):
    return " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in ws)


@query("x1_keyword_sentiment", f"""WITH s AS (SELECT conv_id, turn, text, {_SUM} AS total, {_cnt(['on', 'is'])} AS hi, {_cnt(['or', 'le'])} AS lo FROM conversations)
 SELECT conv_id, turn, {r("(CASE WHEN regexp_matches(text, 'n[eo]t') AND total > 0 THEN 0.5 ELSE 1 END) * (1 - 2 / (exp(total) + 1))")} AS sentiment_score, {r("CASE WHEN hi + lo > 0 THEN (hi - lo) / (hi + lo + 1) * 0.5 + 0.5 ELSE 0.5 END")} AS confidence_score, {r("CASE WHEN contains(text, 'ouch') THEN 1.0 WHEN contains(text, 'aux') THEN 0.4 ELSE 0 END")} AS injury_flag,
 CAST({_cnt([k for k, v in _LEX.items() if v > 0])} AS INT) AS n_positive, CAST({_cnt([k for k, v in _LEX.items() if v < 0])} AS INT) AS n_negative, CAST(length(text) AS INT) AS length FROM s""")
def _(t):
    d = tx.keyword_sentiment(t.raw("conversations"), "text", _LEX, {"ouch": 1.0, "aux": 0.4}, ["on", "is"], ["or", "le"], "n[eo]t")
    return rounded(d.select("conv_id", "turn", "sentiment_score", "confidence_score", "injury_flag", "n_positive", "n_negative", "length"))


_ALL = {**tx.POSITIVE_KEYWORDS, **tx.NEGATIVE_KEYWORDS}
_WORDS = [*_ALL, *tx.INJURY_KEYWORDS, *tx.CONFIDENT, *tx.DOUBTFUL, "ません", "特に", "今日は"]


def _say(*parts: str) -> str:
    return " || '、' || ".join(f"list_extract({_WORDS!r}, CAST(({p}) % {len(_WORDS)} + 1 AS INT))" for p in parts)


_TOTAL = " + ".join(f"((length(text) - length(replace(text, '{k}', ''))) // {len(k)}) * {v}" for k, v in _ALL.items())
_INJURY = ", ".join(f"CASE WHEN contains(text, '{k}') THEN {v} ELSE 0 END" for k, v in tx.INJURY_KEYWORDS.items())


@query("x1_rider_comment_scores", f"""WITH {ENTRIES}, c AS (SELECT race_id, car_no, {_say('motor_id', 'motor_id // 7 + car_no', 'racer_id + 3 * car_no')} AS text FROM entries),
 s AS (SELECT race_id, car_no, text, {_TOTAL} AS total, {_cnt(tx.CONFIDENT)} AS hi, {_cnt(tx.DOUBTFUL)} AS lo FROM c)
 SELECT race_id, car_no, {r("(CASE WHEN contains(text, 'ません') AND round(total, 9) > 0 THEN 0.5 ELSE 1 END) * (1 - 2 / (exp(total) + 1))")} AS sentiment_score, {r("CASE WHEN hi + lo > 0 THEN (hi - lo) / (hi + lo + 1) * 0.5 + 0.5 ELSE 0.5 END")} AS confidence_score, CAST(greatest({_INJURY}) AS DOUBLE) AS injury_flag,
 CAST({_cnt(list(tx.POSITIVE_KEYWORDS))} AS INT) AS n_positive, CAST({_cnt(list(tx.NEGATIVE_KEYWORDS))} AS INT) AS n_negative, CAST(length(text) AS INT) AS length FROM s""")
def _(t):
    """Three phrases of the lexicon for each rider, scored by the lexicon's own weights."""
    pick = lambda i: F.element_at(F.array(*map(F.lit, _WORDS)), (i % len(_WORDS) + 1).cast("int"))
    e = t.entries()
    said = F.concat_ws("、", pick(C("motor_id")), pick(F.expr("motor_id div 7") + C("car_no")), pick(C("racer_id") + 3 * C("car_no")))
    d = tx.keyword_sentiment(e.select("race_id", "car_no", said.alias("said")), "said", negation="ません")
    return rounded(d.select("race_id", "car_no", "sentiment_score", "confidence_score", "injury_flag", "n_positive", "n_negative", "length"))


_N = " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in _LEX)
_V = " + ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {v} ELSE 0 END" for k, v in _LEX.items())


@query("x2_rule_sentiment", f"""WITH s AS (SELECT doc_id, {_N} AS n, CAST({_V} AS DOUBLE) AS v FROM documents), x AS (SELECT doc_id, n, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v / n)) END AS sc FROM s)
 SELECT doc_id, {r('sc')} AS score, CASE WHEN round(sc, 9) >= 0.3 THEN 'positive' WHEN round(sc, 9) <= -0.3 THEN 'negative' WHEN n = 0 THEN 'skip' ELSE 'neutral' END AS label, {r('least(0.9, 0.5 + abs(sc) * 0.4)')} AS confidence FROM x""")
def _(t):
    d = tx.rule_sentiment(t.raw("documents").select("doc_id", "text"), "text", _LEX)
    return rounded(d.select("doc_id", "score", "label", "confidence"))


@query("x3_needs_context_flag", "SELECT doc_id, CAST(regexp_matches(text, '@|https?:|[0-9]{3}-[0-9]{4}|[Ll]icen[cs]e') AS INT) AS needs_context FROM documents")
def _(t):
    marks = ("@", "https?:", "[0-9]{3}-[0-9]{4}", "[Ll]icen[cs]e")
    return tx.needs_context(t.raw("documents"), "text", marks).select("doc_id", "needs_context")


_NEWS = [
    "CEOが来月末で辞任", "CEOは続投し会長だけが年内に辞任する見込みと伝えた", "買収と業務提携を検討", "買収は見送り、提携の協議は続けると両社が繰り返し強調した", "規制の強化を来週発表", "後任は未定",
    "条件付きで承認", "増益を発表", "新製品の発売", "株価は続伸", "規制", "提携"]


@query("x3_news_context_flag", f"""WITH {ENTRIES}, c AS (SELECT race_id, car_no, list_extract({_NEWS!r}, CAST(motor_id % {len(_NEWS)} + 1 AS INT)) || '。' || list_extract({_NEWS!r}, CAST((racer_id + 5 * car_no) % {len(_NEWS)} + 1 AS INT)) AS text FROM entries)
 SELECT race_id, car_no, CAST(regexp_matches(text, 'CEO.{{0,10}}辞任|買収.{{0,15}}提携|規制.{{0,20}}発表|後任|条件付き') AS INT) AS needs_context FROM c""")
def _(t):
    """Two headlines for each entry, some of which depend on their context."""
    pick = lambda i: F.element_at(F.array(*map(F.lit, _NEWS)), (i % len(_NEWS) + 1).cast("int"))
    d = t.entries().select("race_id", "car_no", F.concat_ws("。", pick(C("motor_id")), pick(C("racer_id") + 5 * C("car_no"))).alias("text"))
    return tx.needs_context(d, "text").select("race_id", "car_no", "needs_context")


_SEC = {"that": ["1001", "1002"], "ment": ["1002", "1003"], "sch": ["1004"]}
_INV = {"was": ["1005"], "pour": ["1001", "1006"]}


def _mapped(m):
    return "coalesce(array_to_string(list_sort(list_distinct(flatten([" + ", ".join(f"CASE WHEN contains(lower(text), '{k}') THEN {v} ELSE [] END" for k, v in m.items()) + "]))), ','), '')"


@query("x4_news_to_tickers", f"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b(\\d{{4}}(?:\\.T)?)\\b', 1))), ','), '') AS direct, {_mapped(_SEC)} AS sector, {_mapped(_INV)} AS inverse FROM documents")
def _(t):
    d = tx.news_targets(t.raw("documents").select("doc_id", "text"), "text", _SEC, _INV)
    return d.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("direct", "sector", "inverse")])


_TP = {"question": r"\?", "number": r"[0-9]", "exclaim": r"!", "long": r"^.{400,}"}


@query("x6_title_patterns", """WITH x AS (SELECT CASE WHEN regexp_matches(text, '\\?') THEN 'question' WHEN regexp_matches(text, '[0-9]') THEN 'number' WHEN regexp_matches(text, '!') THEN 'exclaim' WHEN regexp_matches(text, '^.{400,}') THEN 'long' ELSE 'other' END AS pattern, length(text) AS n, CAST(starts_with(text, '[') AS INT) AS bracket FROM conversations)
 SELECT pattern, count(*) AS n, """ + r("count(*) / sum(count(*)) OVER ()") + " AS share, " + r("avg(n)") + " AS mean_length, CAST(max(n) AS INT) AS max_length, CAST(sum(bracket) AS BIGINT) AS n_bracket FROM x GROUP BY 1")
def _(t):
    x = t.raw("conversations").select(tx.first_pattern("text", _TP, "other").alias("pattern"), F.length("text").alias("len"), flag(C("text").startswith("[")).alias("b"))
    g = x.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_length"), F.max("len").alias("max_length"), F.sum("b").alias("n_bracket"))
    return rounded(g.withColumn("share", C("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


@query("x7_sentiment_time_features", f"""WITH {BARS}, n AS (SELECT date_trunc('hour', ts) AS ts, avg(value - 50) AS p FROM events WHERE event_type = 'signup' AND value > 60 GROUP BY 1), j AS (SELECT b.symbol, b.ts, coalesce(n.p, 0.0) AS s FROM bars b LEFT JOIN n ON n.ts = b.ts)
 SELECT symbol, ts, {r('s')} AS sentiment, {r('avg(s) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)')} AS sentiment_24, {r('s - lag(s) OVER (PARTITION BY symbol ORDER BY ts)')} AS sentiment_chg FROM j""")
def _(t):
    from ticktote.functions.core import Seq

    q = Seq("symbol", "ts")
    n = tx.hourly_mean(t.raw("events").where("event_type = 'signup' AND value > 60").select("ts", (C("value") - 50).alias("sentiment")), "ts", "sentiment")
    d = t.bars().select("symbol", "ts").join(n, "ts", "left").fillna({"sentiment": 0.0})
    return rounded(d.select("symbol", "ts", "sentiment", q.mean("sentiment", 24, 1).alias("sentiment_24"), q.diff("sentiment").alias("sentiment_chg")))
