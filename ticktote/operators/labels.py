"""Labels, time-ordered splits and training sets.

Splits are columns on the rows (fold, role): row positions come from a prefix
scan, folds are exploded from a short literal sequence, nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktote.functions.core import Seq, sdiv
from ticktote.operators.combos import pairs
from ticktote.operators.sequence import number_rows

C = F.col


def forward_return(q: Seq, k: int, x: str = "close") -> Column:
    return sdiv(q.lead(x, k) - C(x), C(x))


def dead_zone(ret: Column, cost: float) -> Column:
    return F.when(ret > cost, 1).when(ret < -cost, 0)


def positions(df: DataFrame, keys: list[str], order: list, **scan) -> DataFrame:
    """Adds pos (from 0) and n_rows of the key, in one scan."""
    return number_rows(df, keys, order, size="n_rows", **scan)


def _folds(d: DataFrame, count: int | Column) -> DataFrame:
    last = F.lit(count - 1) if isinstance(count, int) else count - 1
    return d.withColumn("fold", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last.cast("int")))))


def _roles(d: DataFrame, roles: dict[str, Column]) -> DataFrame:
    role = None
    for name, cond in roles.items():
        role = F.when(cond, name) if role is None else role.when(cond, name)
    return d.withColumn("role", role).where(C("role").isNotNull())


def purged_kfold(d: DataFrame, k: int = 5, embargo: int = 24) -> DataFrame:
    """Contiguous folds; the remainder goes to the first folds; train keeps an embargo on both sides."""
    d = _folds(d, k)
    base, rem = F.expr(f"n_rows div {k}"), C("n_rows") % k
    start = C("fold") * base + F.least(C("fold"), rem)
    end = start + base + F.when(C("fold") < rem, 1).otherwise(0)
    return _roles(d, {"test": (C("pos") >= start) & (C("pos") < end), "train": (C("pos") < start - embargo) | (C("pos") >= end + embargo)})


def walk_forward(d: DataFrame, min_train: int, test: int, step: int | None = None, rolling: bool = False, val: int = 0) -> DataFrame:
    """Expanding (or fixed-length rolling) training window followed by validation and test rows."""
    step = step or test
    room = C("n_rows") - min_train - val - test
    d = _folds(d, F.when(room >= 0, F.expr(f"(n_rows - {min_train + val + test}) div {step}") + 1).otherwise(0))
    cut = min_train + C("fold") * step
    roles = {"train": (C("pos") < cut) & ((C("pos") >= cut - min_train) if rolling else F.lit(True))}
    if val:
        roles["val"] = (C("pos") >= cut) & (C("pos") < cut + val)
    roles["test"] = (C("pos") >= cut + val) & (C("pos") < cut + val + test)
    return _roles(d, roles)


def purged_walk_forward(d: DataFrame, splits: int = 5, val_ratio: float = 0.15, test_ratio: float = 0.15, gap: int = 20) -> DataFrame:
    """Growing train, then validation and test, each behind a purge gap."""
    d = _folds(d, splits)
    n = C("n_rows")
    first = F.floor(n * 0.3)
    size = F.floor((n - first) / splits)
    cut = first + C("fold") * size
    v0 = cut + gap
    vn = F.floor(size * val_ratio / (val_ratio + test_ratio))
    t0 = v0 + vn + gap
    t1 = F.least(t0 + size - vn, n)
    p = C("pos")
    d = d.where((t1 > t0) & (v0 + vn <= n))
    return _roles(d, {"train": p < cut, "val": (p >= v0) & (p < v0 + vn), "test": (p >= t0) & (p < t1)})


def date_gap_folds(d: DataFrame, date: str, k: int = 5, gap_days: int = 7, min_train: int = 100) -> DataFrame:
    """Contiguous validation folds; train is everything older than the fold's start minus the gap."""
    base = F.expr(f"n_rows div {k}")
    own = F.least(F.expr(f"pos div greatest(n_rows div {k}, 1)"), F.lit(k - 1)).cast("int")
    starts = d.where(C("pos") % base == 0).where(C("pos") < base * k).select(own.alias("fold"), C(date).alias("_start"))
    edge = C("_start") - F.make_dt_interval(days=F.lit(gap_days))
    # the fold table has k rows
    j = d.withColumn("_own", own).join(F.broadcast(starts))
    j = _roles(j, {"val": C("_own") == C("fold"), "train": C(date) < edge})
    sizes = j.where("role = 'train'").groupBy("fold").agg(F.count(F.lit(1)).alias("_tn"))
    return j.join(F.broadcast(sizes.where(C("_tn") >= min_train)), "fold").drop("_own", "_start", "_tn")


def race_folds(races: DataFrame, folds: int = 5) -> DataFrame:
    """Folds over races in order: block i + 1 is tested on all blocks before it."""
    d = _folds(races, folds)
    size = F.expr(f"n_rows div {folds + 1}")
    cut = size * (C("fold") + 1)
    return _roles(d, {"train": C("pos") < cut, "test": (C("pos") >= cut) & (C("pos") < F.least(cut + size, C("n_rows")))})


def month_fold_count(df: DataFrame, date: str, first: str, months: int) -> int:
    """Folds of `months` from `first` on that hold all later rows; reads the last date."""
    last = df.agg(F.floor(F.months_between(F.trunc(F.max(date), "month"), F.lit(first).cast("date")) / months) + 1).first()[0]
    return max(int(last or 0), 0)


def month_folds(df: DataFrame, date: str, first: str, months: int, count: int) -> DataFrame:
    """Expanding folds by calendar: train before the cut month, test the next `months`."""
    d = _folds(df, count)
    cut = F.add_months(F.lit(first).cast("date"), C("fold") * months)
    nxt = F.add_months(F.lit(first).cast("date"), (C("fold") + 1) * months)
    return _roles(d, {"train": F.to_date(date) < cut, "test": (F.to_date(date) >= cut) & (F.to_date(date) < nxt)})


def month_blocks(df: DataFrame, date: str, first: str, months: int) -> DataFrame:
    """The folds of month_folds without copies of rows: block is the fold that tests a row, or -1 before all of them.

    Fold k is trained on the rows of blocks below k. Rows without a date are left out.
    """
    start = F.lit(first).cast("date")
    near = F.floor(F.months_between(F.trunc(date, "month"), F.trunc(start, "month")) / months).cast("int")
    block = F.when(F.to_date(date) >= F.add_months(start, near * months), near).otherwise(near - 1)
    return df.where(C(date).isNotNull()).withColumn("block", F.greatest(block, F.lit(-1)))


def pairwise_training(e: DataFrame, features: list[str], max_pairs: int | None = 20) -> DataFrame:
    """Feature differences and who finished ahead; pairs of a race in a scattered order, first max_pairs.

    The limit is the feature: a fixed number of training pairs per race. None keeps all pairs.
    """
    p = pairs(e, ["car_no", "finish", *features], ordered=False)
    order = F.pmod(C("race_id") * 7919 + C("car_no1") * 5003 + C("car_no2") * 3571, F.lit(1009))
    if max_pairs is not None:
        p = p.withColumn("_r", F.row_number().over(Window.partitionBy("race_id").orderBy(order, "car_no1", "car_no2"))).where(C("_r") <= max_pairs)
    return p.select("race_id", "car_no1", "car_no2", *[(C(f + "1") - C(f + "2")).alias("d_" + f) for f in features], (C("finish1") < C("finish2")).cast("int").alias("ahead"))


def second_place_training(e: DataFrame, features: list[str]) -> DataFrame:
    """Winner against every other entry: feature deltas and whether it came second."""
    win = e.where("finish = 1").select("race_id", C("car_no").alias("winner"), *[C(f).alias("_w_" + f) for f in features])
    d = e.join(win, "race_id").where(C("car_no") != C("winner"))
    return d.select("race_id", "winner", "car_no", *[(C(f) - C("_w_" + f)).alias("d_" + f) for f in features], (C("finish") == 2).cast("int").alias("second"))
