"""Ordered work on keys that may hold a large share of all rows: positions, running totals, streaks, chunks with margins, runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktote.operators.scan import prefix_scan


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    r = right.select(*[F.col(c).alias("_r_" + c) if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_r_" + k)) for k in keys])
    return left.join(r, cond, how).drop(*["_r_" + k for k in keys])


def key_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left equi-join that keeps the left side's partitioning by its keys.

    A NULL key belongs to no sequence: such rows stay, without a partner.
    """
    return left.join(right, keys, "left")


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "pos", size: str | None = None, **scan) -> DataFrame:
    """0-based position of each row in its key's order and, if named, the number of rows of the key."""
    return prefix_scan(df, keys, order, position=name, size=size, **scan)


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str | Column], peaks: dict[str, str] | None = None, **scan) -> DataFrame:
    """Running totals and, for totals named in `peaks`, their running maximum.

    sums: output name -> value; peaks: output name -> name of a running total.
    """
    return prefix_scan(df, keys, order, sums=sums, peaks=peaks, **scan)


def losing_streak(df: DataFrame, keys: list[str], order: list[str], pnl: str, out: str = "streak", **scan) -> DataFrame:
    """Losses since the last win; a zero result keeps the streak.

    The running loss count minus its value at the last win, which is the running
    maximum over winning rows because the count never falls.
    """
    lost = (F.col(pnl) < 0).cast("double")
    d = prefix_scan(df, keys, order, sums={"_losses": lost}, peaks={"_at_win": ("_losses", F.col(pnl) > 0)}, **scan)
    streak = F.col("_losses") - F.coalesce(F.col("_at_win"), F.lit(0.0))
    return d.withColumn(out, streak.cast("int")).drop("_losses", "_at_win")


def with_halo(df: DataFrame, keys: list[str], pos: str, chunk: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Split each key into chunks of rows and copy the neighbours a row frame needs.

    Rows carry `chunk_id` and `is_core`; row frames reaching at most `back` rows
    back and `ahead` rows ahead are exact on core rows when partitioned by
    (keys, chunk_id). Both margins must be at most `chunk`.
    """
    if max(back, ahead) > chunk:
        raise ValueError("the frame must not be longer than the chunk")
    c = F.expr(f"{pos} div {chunk}")
    off = F.expr(f"{pos} % {chunk}")
    after, ahead_of = (off >= chunk - back) if back else F.lit(False), ((off < ahead) & (c > 0)) if ahead else F.lit(False)
    # one array for each case, as these compile and a filter over an array does not
    targets = F.when(after & ahead_of, F.array(c, c + 1, c - 1)).when(after, F.array(c, c + 1)).when(ahead_of, F.array(c, c - 1)).otherwise(F.array(c))
    d = df.where(F.col(pos).isNotNull()).withColumn("_home", c).withColumn("chunk_id", F.explode(targets))
    return d.withColumn("is_core", F.col("chunk_id") == F.col("_home")).drop("_home")


def runs(df: DataFrame, seq, value: str | Column, name: str = "run_id") -> DataFrame:
    """Number the runs of equal consecutive values (gaps and islands)."""
    v = F.col(value) if isinstance(value, str) else value
    d = df.withColumn("_chg", F.when(F.lag(v).over(seq.w).eqNullSafe(v), 0).otherwise(1))
    return d.withColumn(name, F.sum("_chg").over(seq.upto())).drop("_chg")
