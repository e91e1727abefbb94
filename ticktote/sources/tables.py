"""Logical tables of the data model, derived from the star-schema input.

Bars, races, entries, odds snapshots, results and ledgers are projections of
`events`, `lineitem`, `orders` and their dimensions (see FIXTURES.md). Only the
columns a caller asks for survive to the scan; Catalyst prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticktote.functions.core import sdiv
from ticktote.session import sized_session

ENTRY_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
# Snapshot times before the start, in minutes; 0 is the final price. Fixed values.
SNAPSHOTS = [120, 60, 30, 15, 5, 1, 0]
#: rows that one task sorts for windows over races, whatever the submitter's number of shuffle partitions
TASK_ROWS = 1 << 20


class Tables:
    """Reader for one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def sized(self, name: str = "lineitem") -> Tables:
        """These tables in a session whose every exchange makes tasks of about TASK_ROWS rows of the named table."""
        return Tables(sized_session(self.spark, -(-self.raw(name).count() // TASK_ROWS)), self.path)

    def _spread(self, df: DataFrame, key: str) -> DataFrame:
        """df dealt by key into tasks of about TASK_ROWS, where the session's shuffle partitions would hold more; counts df."""
        tasks = -(-df.count() // TASK_ROWS)
        return df.repartition(tasks, key) if tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else df

    # ---- price series -------------------------------------------------------
    def bars(self, unit: str = "hour") -> DataFrame:
        from ticktote.operators.resample import ticks_to_bars

        return ticks_to_bars(self.raw("events"), "event_type", "ts", "value", unit, tie="event_id")

    def daily(self) -> DataFrame:
        """Daily bars per supplier from unit prices of its line items."""
        li = self.raw("lineitem").select(
            F.col("l_suppkey").alias("symbol"),
            F.col("l_shipdate").alias("ts"),
            sdiv("l_extendedprice", "l_quantity").alias("px"),
            F.col("l_quantity").alias("qty"),
            F.struct("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("o"),
        )
        return li.groupBy("symbol", "ts").agg(
            F.min_by("px", "o").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "o").alias("close"),
            F.sum("qty").alias("volume"),
        )

    def daily_series(self) -> DataFrame:
        """Daily mean of event values per type: the slow auxiliary series."""
        return self.raw("events").groupBy(
            F.col("event_type").alias("series_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")
        ).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_obs"))

    def monthly_series(self) -> DataFrame:
        return self.raw("orders").groupBy(
            F.col("o_orderpriority").alias("series_id"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts")
        ).agg(F.avg("o_totalprice").alias("value"))

    def calendar(self, cutoff: float = 150.0) -> DataFrame:
        """Scheduled events: large error events, importance 1..3 from props.k."""
        e = self.raw("events").where((F.col("event_type") == "error") & (F.col("value") > cutoff))
        k = F.get_json_object("props", "$.k").cast("int")
        return e.select(F.col("event_id"), F.col("ts").alias("event_ts"), (k % 3 + 1).alias("importance"))

    # ---- races --------------------------------------------------------------
    def races(self, with_venue: bool = True) -> DataFrame:
        o = self.raw("orders").select(
            F.col("o_orderkey").alias("race_id"),
            F.col("o_orderdate").alias("race_date"),
            F.col("o_orderpriority").alias("grade"),
            F.col("o_orderstatus").alias("race_status"),
            F.col("o_totalprice").alias("purse"),
            "o_custkey",
        )
        if with_venue:
            c = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("venue_id"))
            o = o.join(c, "o_custkey", "left")
        return o.drop("o_custkey")

    def entries(self) -> DataFrame:
        """One row per entry of a race: fields, model probability, odds, finish.

        race_id groups are fields of starters; `operators.race.require_field_size` checks
        for foreign data that they are as small as windows over a race expect.
        """
        w = Window.partitionBy("l_orderkey").orderBy(*ENTRY_ORDER)
        race = Window.partitionBy("l_orderkey")
        rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        d = self._spread(self.raw("lineitem"), "l_orderkey").withColumn("car_no", F.row_number().over(w))
        d = d.withColumns(
            {
                "field_size": F.count(F.lit(1)).over(race),
                "prob": F.col("l_quantity") / F.sum("l_quantity").over(race),
                "finish": F.row_number().over(race.orderBy(rev.desc(), F.col("car_no"))),
            }
        )
        return d.select(
            F.col("l_orderkey").alias("race_id"),
            "car_no",
            F.col("l_suppkey").alias("racer_id"),
            F.col("l_partkey").alias("motor_id"),
            F.col("l_extendedprice").alias("score"),
            F.col("l_quantity").alias("qty"),
            F.col("l_discount").alias("disc"),
            F.col("l_tax").alias("tax"),
            F.col("l_returnflag").alias("style"),
            F.col("l_linestatus").alias("status"),
            F.col("l_shipdate").alias("ship_ts"),
            F.col("l_linenumber").alias("post"),
            "field_size",
            "prob",
            (0.75 / F.col("prob") * (0.8 + 12 * F.col("l_discount"))).alias("odds"),
            "finish",
        )

    def race_entries(self, with_venue: bool = False) -> DataFrame:
        return self.entries().join(self.races(with_venue), "race_id", "inner")

    def snapshot_cars(self) -> DataFrame:
        """What the odds snapshots of a car are made of, one row per car."""
        sgn = F.when(F.col("car_no") % 2 == 0, 1).otherwise(-1)
        return self.entries().select("race_id", "car_no", "prob", "odds", "tax", sgn.alias("sgn"))

    @staticmethod
    def snapshots_of(cars: DataFrame, *keep: str) -> DataFrame:
        """(race_id, car_no, minutes, odds) at the seven snapshot times of each car, and the columns to keep."""
        m = F.explode(F.array(*[F.lit(x) for x in SNAPSHOTS])).alias("minutes")
        return cars.select("*", m).select(
            "race_id",
            "car_no",
            *keep,
            "minutes",
            (F.col("odds") * (1 + 3 * F.col("tax") * F.col("minutes") / 120 * F.col("sgn"))).alias("odds"),
        )

    def odds_snapshots(self) -> DataFrame:
        """(race_id, car_no, prob, minutes, odds) at the seven snapshot times."""
        return self.snapshots_of(self.snapshot_cars(), "prob")

    # ---- ledgers ------------------------------------------------------------
    def bets(self) -> DataFrame:
        """Favourite of every race as one bet: strategy = grade, unit return in `ret`."""
        e = self.entries()
        fav = F.row_number().over(Window.partitionBy("race_id").orderBy(F.col("prob").desc(), "car_no"))
        e = e.withColumn("_k", fav).where("_k = 1")
        e = e.join(self.races(True), "race_id", "inner")
        hit = F.col("finish") == 1
        return e.select(
            "race_id",
            "race_date",
            F.col("grade").alias("strategy"),
            "venue_id",
            "car_no",
            "style",
            "prob",
            "odds",
            "field_size",
            (F.col("prob") * F.col("odds")).alias("ev"),
            hit.cast("int").alias("hit"),
            F.when(hit, F.col("odds") * 100).otherwise(0.0).alias("payout"),
            (F.when(hit, F.col("odds") - 1).otherwise(-1.0) * 0.02).alias("ret"),
        )

    def trades(self) -> DataFrame:
        """One contrarian trade per bar held four bars: side, confidence, agreement, return."""
        from ticktote.functions.core import Seq

        q = Seq("symbol", "ts")
        b = self.bars().withColumns({"ret1": q.pct("close"), "fwd": sdiv(q.lead("close", 4), F.col("close")) - 1})
        b = b.withColumn("vol", q.sd("ret1", 24)).where(F.col("fwd").isNotNull() & (F.col("high") > F.col("low")))
        side = F.when(F.col("close") < F.col("open"), 1).otherwise(-1)
        return b.select(
            "symbol", "ts", "open", "high", "low", "close", "vol", "fwd", side.alias("side"),
            (0.5 + 0.5 * F.abs(F.col("close") - F.col("open")) / (F.col("high") - F.col("low"))).alias("conf"),
            (3 + F.hour("ts") % 3).alias("agreement"),
            (side * F.col("fwd") * 0.01).alias("ret"),
        )
