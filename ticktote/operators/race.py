"""Operators inside a race: relative values, probabilities, odds movements.

Input contract: a race is a field of starters, MAX_STARTERS at most, so windows over
race_id and combinations of a race's entries are small. require_field_size checks it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ticktote.functions.core import col, flag, min_rank, sdiv

C = F.col
MAX_STARTERS = 18


def race() -> WindowSpec:
    return Window.partitionBy("race_id")


def require_field_size(entries: DataFrame, most: int = MAX_STARTERS) -> DataFrame:
    """entries, or an error at run time as soon as a race has more than `most` of them; no row is dropped."""
    n = F.count(F.lit(1)).over(race())
    said = F.concat(F.lit("race "), C("race_id").cast("string"), F.lit(f" has more than {most} starters"))
    ok = F.when(C("_starters") <= most, F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))
    return entries.withColumn("_starters", n).where(ok).drop("_starters")


def vs_field(x: str) -> Column:
    return C(x) - F.avg(x).over(race())


def fill_from_race(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(C(c), F.avg(c).over(race())) for c in cols})


def fill_zero_from_race(df: DataFrame, cols: list[str]) -> DataFrame:
    """Zeros take the mean of the race's positive values."""
    return df.withColumns({c: F.when(C(c) == 0, F.coalesce(F.avg(F.when(C(c) > 0, C(c))).over(race()), C(c))).otherwise(C(c)) for c in cols})


def normalise(x: str | Column, total: float = 1.0) -> Column:
    """Scale to a race total; uniform when the race sums to zero."""
    c = col(x)
    s, n = F.sum(c).over(race()), F.count(F.lit(1)).over(race())
    return F.when(s == 0, total / n).otherwise(total * sdiv(c, s))


def softmax(df: DataFrame, x: str, out: str, temperature: float = 1.0) -> DataFrame:
    """Softmax of log probabilities, shifted by the race maximum."""
    d = df.withColumn("_l", F.log(F.greatest(C(x), F.lit(1e-12))) / temperature)
    d = d.withColumn("_e", F.exp(C("_l") - F.max("_l").over(race())))
    return d.withColumn(out, C("_e") / F.sum("_e").over(race())).drop("_l", "_e")


def odds_changes(wide: DataFrame, times: list[int], prefix: str = "odds_") -> DataFrame:
    """Relative change between neighbouring snapshots, total change and acceleration."""
    o = {m: C(f"{prefix}{m}") for m in times}
    d = wide.withColumns({f"chg_{a}_{b}": sdiv(o[b] - o[a], o[a]) for a, b in zip(times, times[1:])})
    return d.withColumns({
        "chg_total": sdiv(o[times[-1]] - o[times[0]], o[times[0]]),
        "acceleration": C("chg_5_1") - C("chg_15_5")})


def odds_flags(d: DataFrame) -> DataFrame:
    """Sharp drop, contrarian move and late surge."""
    m = F.avg("chg_5_1").over(race())
    return d.withColumns({
        "sharp_drop": flag(C("chg_5_1") <= -0.10), "contrarian": flag((C("chg_5_1") * m < 0) & (F.abs("chg_5_1") > 0.10)), "late_surge": flag(F.abs("chg_1_0") >= 0.05)})


def odds_ranks(wide: DataFrame, first: str, final: str) -> DataFrame:
    d = wide.withColumns({"implied_prob": sdiv(F.lit(1.0), C(final)), "odds_rank": min_rank(final, ["race_id"], desc=False), "_r0": min_rank(first, ["race_id"], desc=False)})
    return d.withColumn("odds_rank_change", C("odds_rank") - C("_r0")).drop("_r0")


def surge_by_race(snaps: DataFrame, before: int, after: int, below: float = 10.0, threshold: float = 0.3) -> DataFrame:
    """Whether any popular entry of the race moved by the threshold between two snapshots."""
    d = snaps.where(C("minutes").isin(before, after)).groupBy("race_id", "car_no").agg(
        F.max(F.when(C("minutes") == before, C("odds"))).alias("a"), F.max(F.when(C("minutes") == after, C("odds"))).alias("b"))
    move = (C("a") < below) & (F.abs(sdiv(C("b") - C("a"), C("a"))) >= threshold)
    return d.groupBy("race_id").agg(F.max(flag(move)).alias("surge"), F.sum(flag(move)).alias("n_moved"))


def predictability(df: DataFrame, penalties: list[tuple[Column, int]], out: str = "predictability") -> DataFrame:
    """100 minus the penalties that apply, not below 0."""
    total = sum((F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, p in penalties), F.lit(0))
    return df.withColumn(out, F.greatest(F.lit(100) - total, F.lit(0)))
