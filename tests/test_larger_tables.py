"""Plans and results of queries that were to grow no faster than their tables."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from ticktote.catalog import load
from ticktote.catalog.registry import QUERIES
from ticktote.functions.lexicon import lexicon_hits
from ticktote.operators import combos as cb
from ticktote.operators import history as hi
from ticktote.session import sized_session

C = F.col
SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["w17_date_range_rates", "w21_previous_meet_best", "w22_same_region_companions", "w23_head_to_head", "r21_betrayal_rate"])
def test_history_has_tasks_for_its_rows(spark, monkeypatch, name):
    from ticktote.sources import tables as tb

    load()
    want = sorted(QUERIES[name](spark, SF).collect(), key=str)
    monkeypatch.setattr(tb, "TASK_ROWS", 500)
    d = QUERIES[name](spark, SF)
    assert int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")) >= 10
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert want and sorted(d.collect(), key=str) == want


def test_sized_session_keeps_settings(spark):
    assert sized_session(spark, 4) is spark
    s = sized_session(spark, 9)
    keys = ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.execution.arrow.pyspark.enabled")
    assert s is not spark and s.conf.get("spark.sql.shuffle.partitions") == "9" and [s.conf.get(k) for k in keys] == [spark.conf.get(k) for k in keys]


@pytest.mark.parametrize("name", ["w17_date_range_rates", "w22_same_region_companions", "r19_lines_from_comments", "r20_line_source_fusion"])
def test_entries_are_derived_once(spark, name):
    load()
    assert "l_orderkey" not in optimized(QUERIES[name](spark, SF))


def test_totals_of_earlier_days(spark):
    r = random.Random(3)
    day = lambda: r.choice([None, *[date(2024, 1, 1) + timedelta(days=k) for k in range(6)]])
    rows = [(i % 40, r.choice(["a", "b", None]), r.choice(["c", "d", None]), day(), r.randint(0, 1)) for i in range(300)]
    d = spark.createDataFrame(rows, "race_id int, x string, y string, day date, win int")
    want = hi.past_sums(d, ["x", "y"], "day", {"w": (C("win"), None), "n": (F.lit(1), None)})
    got = hi.past_totals(d, ["x", "y"], "day", {"w": C("win"), "n": F.lit(1)}, spread="race_id")
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and "Join" not in optimized(got)


def test_tickets_join_no_cars(spark):
    rows = [(race, car, 0.1 * car, 0.05, car) for race in (1, 2) for car in (1, 2, 3, 4)] + [(None, 1, 0.5, 0.0, 1), (None, 2, 0.5, 0.0, 2), (3, 1, 1.0, 0.0, 1)]
    d = cb.ticket_rows(spark.createDataFrame(rows, "race_id int, car_no int, prob double, disc double, finish int"), 1e-9)
    assert "Join" not in optimized(d)
    n = {(r["race_id"], r["ticket"]): r["count"] for r in d.groupBy("race_id", "ticket").count().collect()}
    assert n == {(race, t): k for race in (1, 2) for t, k in (("exacta", 12), ("quinella", 6), ("wide", 6), ("trifecta", 24), ("trio", 4))}


def test_words_are_found_by_one_pattern(spark):
    words = ["絶好", "絶好調", "好", "a.", "a.b", "(x", "[", "|", "\\Q", "z\n", "-^", "😀", "😀b"]
    texts = ["絶好調で絶好", "a.ba.a.b", "(x[|\\Qz\n-^", "😀b😀", "ab", "x" * 5000 + "好"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(lexicon_hits(C("t"), words).alias("h"))
    assert optimized(d).count("regexp_extract_all") == 1 and "slice" not in optimized(d)
    for t, r in zip(texts, d.collect()):
        want = [w for n in sorted(set(map(len, words))) for k in range(len(t)) for w in words if len(w) == n and t.startswith(w, k)]
        assert r["h"] == want


def test_daily_frames_store_what_they_read(spark, monkeypatch):
    from ticktote.operators import scan
    from ticktote.sources import tables as tb

    load()
    want = sorted(QUERIES["w2_rolling_stats_daily_halo"](spark, SF).collect(), key=str)
    stored, store = [], scan.stored_table
    monkeypatch.setattr(scan, "stored_table", lambda df, name: stored.append((name, df)) or store(df, name))
    monkeypatch.setattr(tb, "TASK_ROWS", 500)
    d = QUERIES["w2_rolling_stats_daily_halo"](spark, SF)
    bars = next(df for name, df in stored if name == "scan")
    assert bars.columns == ["symbol", "ts", "high", "close"] and "min_by" not in optimized(bars)
    assert int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")) >= 10
    assert want and sorted(d.collect(), key=str) == want


def test_preclose_stream_gets_races_in_parts(spark, monkeypatch):
    """Files have a row per car and not per snapshot, and the state holds the cars of one part."""
    from pyspark.sql.streaming.query import StreamingQuery

    from ticktote.catalog import streams
    from ticktote.streaming import sources as so

    load()
    want = sorted(QUERIES["q7_stream_preclose_surge"](spark, SF).collect(), key=str)
    held, steps, state, feed, wait = [], [], [], so.fed_stream, StreamingQuery.awaitTermination

    def fed_stream(s, df, part, name):
        held.append(df.count())
        out = feed(s, df, part, name)
        steps.extend(out[1])
        return out

    def wait_and_see(q, *timeout):
        done = wait(q, *timeout)
        state.extend(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators)
        return done

    monkeypatch.setattr(so, "fed_stream", fed_stream)
    monkeypatch.setattr(StreamingQuery, "awaitTermination", wait_and_see)
    monkeypatch.setattr(streams, "PART_CARS", 2000)
    got = sorted(QUERIES["q7_stream_preclose_surge"](spark, SF).collect(), key=str)
    assert got == want and held == [len(want)] and len(steps) == -(-len(want) // 2000) >= 3
    assert len(want) / len(steps) * 0.8 < max(state) < len(want) / len(steps) * 1.2


def test_preclose_stream_of_no_races(spark, tmp_path):
    load()
    for name in ("lineitem", "orders"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert QUERIES["q7_stream_preclose_surge"](spark, str(tmp_path)).count() == 0
