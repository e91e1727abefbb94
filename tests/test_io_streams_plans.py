"""Files, streams over several batches, plans and the driver contract."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ticktote.functions.core import Seq
from ticktote.operators import indicators as ind
from ticktote.sources import files as fs

C = F.col


def plan(d) -> str:
    return d._jdf.queryExecution().executedPlan().toString()


def test_csv_bars_with_headers(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Price,Close\nTicker,X\nDatetime,\n2024-01-01 00:00:00,1.5,2,1,1.2,10\n2024-01-01 01:00:00,,2,1,1.2,10\n2024-01-01 02:00:00,1.7,x,1,1.2,\n")
    d = fs.read_bars_csv(spark, str(tmp_path / "AAA.csv")).orderBy("ts").toPandas()
    assert d.symbol.tolist() == ["AAA", "AAA"] and d.close.tolist() == [1.5, 1.7] and pd.isna(d.high[1]) and pd.isna(d.volume[1])


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_load_table_formats(spark, tmp_path, tables, fmt):
    r = tables.raw("region")
    r.write.format(fmt).save(str(tmp_path / fmt))
    assert sorted(fs.load_table(spark, str(tmp_path / fmt), fmt, r.schema).collect()) == sorted(r.collect())


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, ver int")
    once = fs.upsert(old, new, ["k"], "ver")
    twice = fs.upsert(once, new, ["k"], "ver")
    assert sorted(once.collect()) == sorted(twice.collect()) and len(once.collect()) == 3


def test_payout_page(spark):
    page = """<table><tr><th>2車連</th></tr><tr><td>単</td><td>9-9-9 1円</td></tr></table>
     <table><tr><th>3連勝</th></tr><tr><td>複</td><td>1-2-3 50円</td></tr><tr><td> 単 </td><td>3-1-4 <b>17,640円</b></td></tr></table><table><tr><td>ワイド</td></tr><tr><td>単</td><td>1-2-3 5円</td></tr></table>
     <table><tr><th>3連単</th></tr><tr><td>単</td><td>不成立</td></tr></table><TABLE><TR><TH>3連単</TH></TR><TR><TD>単</TD><TD>2 - 5 - 1  980円</TD></TR></TABLE>
     <table><tr><th>3連単</th></tr><tr><td>単</td><td>2-5-1 99999999999999円</td></tr></table>"""
    h = spark.createDataFrame([(1, page), (2, None), (3, "")], "p int, html string")
    assert [(r.p, r.race_no, r.combo, r.payout) for r in fs.extract_payouts(h, "html", ["p"]).orderBy("race_no").collect()] == [(1, 1, "3-1-4", 17640), (1, 3, "2-5-1", 980)]


def test_comment_intents(spark):
    from ticktote.functions.text import comment_intent

    said = {"田中選手の後ろ": ("follow", "田中", 0.7), "山田君に付けます": ("follow", "山田", 0.7), "3番の後ろ": ("follow", "3", 0.7), "番手で": ("follow", None, 0.7), "前から": ("lead", None, 0.8), "先頭で": ("lead", None, 0.8),
            "自分で": ("single", None, 0.8), "単独": ("single", None, 0.8), "": ("unknown", None, 0.3), None: ("unknown", None, 0.3), "ALONE": ("single", None, 0.8)}
    d = comment_intent(spark.createDataFrame([(k,) for k in said], "t string"), "t")
    assert {r.t: (r.role, r.target, r.confidence) for r in d.collect()} == said


def test_stacked_windows_share_one_exchange(tables):
    d = ind.volume_features(ind.bollinger(ind.rsi_simple(ind.returns(tables.bars(), [1, 6]))))
    p = plan(d)
    assert p.count("Exchange hashpartitioning(symbol") == 1
    assert "Python" not in p


def test_filters_and_columns_reach_the_scan(tables):
    p = plan(tables.raw("lineitem").where("l_discount > 0.05").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_discount), GreaterThan(l_discount,0.05)]" in p and "l_comment" not in p


def test_plans_have_no_cartesian_product_and_little_python(spark):
    from ticktote import catalog
    from ticktote.catalog.registry import QUERIES

    catalog.load()
    folds = {"r22_elo_ratings", "g13_drawdown_stop_resume", "g13_dynamic_threshold"}
    skip = ("q", "z", "s11", "s19", "t32")
    for n, f in QUERIES.items():
        if n.startswith(skip) or n.startswith("l12_pairwise_training"):
            continue
        p = plan(f(spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in p, n
        assert ("InPandas" in p or "PythonUDF" in p) == (n in folds), n


def test_driver_contract(spark):
    import __spark_entry__ as e

    d = e.entry(spark)
    assert d.count() > 0 and d.columns == ["symbol", "n_trades", "pf", "mdd", "win_rate", "sharpe"]
    assert set(e.oracle_sql()) <= set(e.queries())


def split_files(spark, tables, folder, n=4, seed=None):
    """Events in n files: in time order, or shuffled over all files."""
    ev = tables.raw("events").orderBy("ts", "event_id").toPandas()
    dealt = ev if seed is None else ev.sample(frac=1, random_state=seed)
    k = len(ev) // n + 1
    for i in range(n):
        part = spark.createDataFrame(dealt.iloc[i * k : (i + 1) * k]).withColumn("ts", C("ts").cast("timestamp_ntz")).coalesce(1)
        part.write.mode("append").parquet(str(folder))
    return ev


def ledger(ev):
    """Balance, streak and verdict of every trade, key by key in time order."""
    from ticktote.streaming.stateful import RiskLedger

    out = []
    for key, p in ev.sort_values(["ts", "event_id"]).groupby("event_type"):
        p = p.assign(value=p.value - 50)
        out.append(RiskLedger().step((key,), p, RiskLedger().initial()))
    return pd.concat(out).sort_values("event_id").reset_index(drop=True)


def run_ledger(spark, folder, **kw):
    from ticktote.streaming import sources as so
    from ticktote.streaming import stateful as st

    s = so.stream_session(spark, 4)
    s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # several chunks for a key
    ticks = so.tick_stream(s, str(folder), "*.parquet").withColumn("value", C("value") - 50)
    return so.run_closed(ticks, lambda d: st.process(d, "event_type", st.RiskLedger, **kw), "t").toPandas().sort_values("event_id").reset_index(drop=True)


def test_stream_state_equals_batch(spark, tables, tmp_path):
    ev = split_files(spark, tables, tmp_path / "in")
    pd.testing.assert_frame_equal(run_ledger(spark, tmp_path / "in"), ledger(ev), check_dtype=False)


def test_shuffled_rows_of_a_batch_leave_in_order(spark, tables, tmp_path):
    ev = split_files(spark, tables, tmp_path / "in", n=1, seed=3)
    pd.testing.assert_frame_equal(run_ledger(spark, tmp_path / "in"), ledger(ev), check_dtype=False)


def test_a_key_is_never_whole_in_memory(spark, tables, tmp_path, monkeypatch):
    """Pieces of few rows, some hours each, give the rows of one pass; a step gets no more than an hour beyond them."""
    from ticktote.streaming import stateful as st

    class Held:
        def __init__(self):
            self.d = {}

        def getValueState(self, name, schema):
            return Value()

        def getMapState(self, name, key, value):
            return Map()

        def registerTimer(self, ms):
            pass

    class Value:
        v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

        def clear(self):
            self.v = None

    class Map(dict):
        getValue, removeKey, updateValue = dict.get, dict.pop, dict.__setitem__

    class Mark:
        def getCurrentWatermarkInMs(self):
            return 1 << 50

    monkeypatch.setattr(st, "PIECE_ROWS", 64)
    ev = tables.raw("events").orderBy("ts", "event_id").toPandas()
    ev = ev[ev.event_type == "click"].assign(value=lambda p: p.value - 50)
    one = st.RiskLedger()
    one.init(Held())
    dealt = ev.sample(frac=1, random_state=5)
    one.handleInputRows(("click",), (dealt.iloc[i : i + 16] for i in range(0, len(dealt), 16)), Mark())
    parts = list(one.handleExpiredTimer(("click",), Mark(), None))
    per_hour = ev.groupby(ev.ts.dt.floor("h")).size().max()
    assert len(parts) > 1 and max(map(len, parts)) < 64 + per_hour and not one.buffer
    want = st.RiskLedger().step(("click",), ev, st.RiskLedger().initial())
    pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), want.reset_index(drop=True), check_dtype=False)


def test_shuffled_files_within_lateness(spark, tmp_path):
    """Files overlap in time by less than the lateness; each key has more rows than one chunk."""
    ev = pd.DataFrame({"event_id": range(1200), "event_type": [f"k{i % 2}" for i in range(1200)], "value": [float((i * 37) % 101) for i in range(1200)]})
    ev["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(ev.event_id * 60, unit="s")
    ev["user_id"], ev["props"] = 1, "{}"
    dealt = ev.iloc[(ev.event_id + (ev.event_id * 61) % 101).argsort(kind="stable")]  # up to 100 minutes out of order
    for i in range(4):
        part = dealt.iloc[i * 300 : (i + 1) * 300].sample(frac=1, random_state=i)
        d = spark.createDataFrame(part[["event_id", "ts", "user_id", "event_type", "value", "props"]])
        d.withColumn("ts", C("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_ledger(spark, tmp_path / "in", late="4 hours")
    pd.testing.assert_frame_equal(got, ledger(ev), check_dtype=False)


@pytest.mark.parametrize("layout", [[[0], [1], [2], [3], [4], [5], [6]], [[0, 1, 2, 3, 4, 5, 6]], [[0, 1], [2, 3, 4], [5, 6]], [[0, 1, 2, 3], [4, 5], [6]]])
def test_idle_state_goes(spark, tmp_path, layout):
    """A key starts anew after a long silence, however its rows are dealt to batches."""
    from ticktote.streaming.stateful import RiskLedger

    days = [0, 0, 40, 41, 80, 81, 120]
    keys = ["a", "b", "b", "b", "b", "a", "c"]
    for part in layout:
        rows = [(i, (pd.Timestamp("2024-01-01") + pd.Timedelta(days=days[i])).to_pydatetime(), 1, keys[i], 60.0, "{}") for i in part]
        d = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        d.withColumn("ts", C("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_ledger(spark, tmp_path / "in", idle_ms=45 * 24 * 3600 * 1000).set_index("event_id").balance.to_dict()
    start = RiskLedger.start
    assert got == {0: start + 10, 1: start + 10, 2: start + 20, 3: start + 30, 4: start + 40, 5: start + 10, 6: start + 10}


def test_preclose_surge(spark, tmp_path):
    """A late snapshot within the lateness counts, one after it does not, and a race without one side has no history."""
    from ticktote.streaming import sources as so
    from ticktote.streaming import windows as wi

    at = lambda h, m=0: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h, minutes=m)).to_pydatetime()
    batches = [
        [(1, 1, at(11, 30), at(12), 2.0), (1, 1, at(11, 45), at(12), 2.5), (1, 1, at(11, 59), at(12), 2.6), (1, 2, at(11, 59), at(12), 4.0), (1, 3, at(11, 50), at(12), 4.0), (2, 1, at(12, 30), at(13), 10.0), (3, 1, at(11), at(13), 0.0)],
        [(1, 1, at(12), at(12), 3.25), (2, 1, at(12, 59), at(13), 10.5), (3, 1, at(13), at(13), 5.0), (4, 1, at(14), at(15), 5.0), (4, 1, at(15), at(15), 5.6), (9, 9, at(15), at(20), 1.0)],
        [(9, 9, at(20), at(20), 1.0), (5, 1, at(18, 30), at(19), 1.0)],
        [(1, 1, at(12), at(12), 99.0), (5, 1, at(18, 55), at(19), 1.3)]]
    schema = "race_id long, car_no int, ts timestamp, close timestamp, odds double"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = so.stream_session(spark, 2)
    stream = s.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r["race_id"], r["car_no"]): (None if r["change"] is None else round(r["change"], 6), r["verdict"]) for r in so.run_closed(stream, wi.preclose_surge, "p", ts="close").collect()}
    assert got == {(1, 1): (0.3, "cancel"), (1, 2): (None, "no history"), (1, 3): (None, "no history"), (2, 1): (0.05, "minor"), (3, 1): (None, "no history"), (4, 1): (0.12, "half"), (5, 1): (0.3, "cancel"), (9, 9): (0.0, "normal")}


def test_tasks_and_state_stores_grow_with_the_rows(spark, tables, monkeypatch):
    from ticktote.catalog import streams
    from ticktote.sources import tables as tb

    assert streams.stores(1000) == streams.PARTITIONS and streams.stores(1000 * streams.STORE_ROWS) == 1000
    plan = lambda: tables.entries()._jdf.queryExecution().optimizedPlan().toString()
    want = sorted(tables.entries().collect(), key=str)
    assert "RepartitionByExpression" not in plan()
    monkeypatch.setattr(tb, "TASK_ROWS", 500)
    assert "RepartitionByExpression" in plan() and sorted(tables.entries().collect(), key=str) == want


def test_streams_leave_the_session_alone(spark):
    from ticktote.streaming.sources import stream_session

    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert stream_session(spark, 3).conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


class _Fake:
    def __init__(self, master, conf=None, context_dir=None):
        self.master, self.dir = master, context_dir
        self.conf, self.sparkContext = self, self
        self.values = conf or {}

    def get(self, key, default=None):
        return self.values.get(key, default)

    def getCheckpointDir(self):
        return self.dir


def test_scratch_folders():
    assert fs.scratch_dir(_Fake("yarn", {"spark.checkpoint.dir": "hdfs://x/c/"}), "n").startswith("hdfs://x/c/n-")
    assert fs.scratch_dir(_Fake("yarn", context_dir="hdfs://y"), "n").startswith("hdfs://y/n-")
    assert "n-" in fs.scratch_dir(_Fake("local[4]"), "n")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        fs.scratch_dir(_Fake("spark://host:7077"), "n")


def test_stream_bars_equal_batch_bars(spark, tables, tmp_path):
    from ticktote.streaming import windows as wi
    from ticktote.streaming.sources import run_to_end, tick_stream

    split_files(spark, tables, tmp_path / "in")
    s = run_to_end(wi.bars(tick_stream(spark, str(tmp_path / "in"), "*.parquet"), late="60 minutes"), "b")
    b = tables.bars().withColumn("ts", C("ts").cast("timestamp"))
    j = s.join(b.select("symbol", "ts", C("close").alias("c"), C("volume").alias("v")), ["symbol", "ts"])
    assert s.count() == j.count() > 0 and j.where("abs(close - c) > 1e-9 or abs(volume - v) > 1e-6").count() == 0
