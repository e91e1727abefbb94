"""Column helpers with the null rules of the data model.

Rolling statistics are NULL until the required number of non-null values is in
the frame, divisions by zero are NULL, comparisons with NULL count as false.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sdiv(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def flag(cond: Column) -> Column:
    """Boolean to 0/1 with NULL as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def tie_shift(n: int) -> float:
    """Offset that keeps exact half-way values off the rounding boundary.

    Ratios with a power of two below the line often end in an exact 5, where the
    last bit of a sum would decide; the shift is far below the kept digits.
    """
    return 0.0123456 * 10.0**-n


def rnd(x: str | Column, n: int = 6) -> Column:
    return F.round(col(x) + F.lit(tie_shift(n)), n)


def clip(x: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounded value; NULL stays NULL."""
    c = v = col(x)
    if lo is not None:
        v = F.greatest(v, F.lit(float(lo)))
    if hi is not None:
        v = F.least(v, F.lit(float(hi)))
    return F.when(c.isNotNull(), v)


def rounded(df: DataFrame, n: int = 6, skip: Iterable[str] = ()) -> DataFrame:
    """Round every double column: results then do not depend on summation order."""
    skip = set(skip)
    return df.select(
        *[
            rnd(c, n).alias(c) if t in ("double", "float") and c not in skip else F.col(c)
            for c, t in df.dtypes
        ]
    )


class Seq:
    """An ordered sequence per key: the one canonical window of a plan.

    All frames derive from the same partitioning and order, so Spark plans a
    single exchange and sort for any number of them.
    """

    def __init__(self, keys: str | list[str] = "symbol", order: str | list = "ts"):
        self.keys = [keys] if isinstance(keys, str) else list(keys)
        self.order = order if isinstance(order, list) else [order]

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        """Current row and the n-1 rows before it."""
        return self.w.rowsBetween(-(n - 1), 0)

    def before(self, n: int | None = None) -> WindowSpec:
        """The n rows (or all rows) strictly before the current one."""
        return self.w.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)

    def after(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(1, n)

    def upto(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def lag(self, x: str | Column, k: int = 1) -> Column:
        return F.lag(col(x), k).over(self.w)

    def lead(self, x: str | Column, k: int = 1) -> Column:
        return F.lead(col(x), k).over(self.w)

    def diff(self, x: str | Column, k: int = 1) -> Column:
        return col(x) - self.lag(x, k)

    def pct(self, x: str | Column, k: int = 1) -> Column:
        return sdiv(x, self.lag(x, k)) - 1

    def roll(self, agg, x: str | Column, n: int, min_periods: int | None = None) -> Column:
        """agg over the last n rows, NULL below min_periods non-null values."""
        c, w = col(x), self.last(n)
        return F.when(F.count(c).over(w) >= F.lit(n if min_periods is None else min_periods), agg(c).over(w))

    def mean(self, x, n: int, min_periods: int | None = None) -> Column:
        return self.roll(F.avg, x, n, min_periods)

    def sd(self, x, n: int, min_periods: int | None = None) -> Column:
        return self.roll(F.stddev_samp, x, n, min_periods)

    def zscore(self, x, n: int, min_periods: int | None = None) -> Column:
        s = self.sd(x, n, min_periods)
        return sdiv(col(x) - self.mean(x, n, min_periods), F.when(s != 0, s))

    def corr(self, a, b, n: int) -> Column:
        a, b, w = col(a), col(b), self.last(n)
        both = a.isNotNull() & b.isNotNull()
        return F.when(F.count(F.when(both, 1)).over(w) >= n, F.corr(a, b).over(w))


def avg_rank(x: str | Column, part: list[str], desc: bool = True) -> Column:
    """Rank with ties sharing their mean rank; NULL keeps NULL."""
    c = col(x)
    o = c.desc_nulls_last() if desc else c.asc_nulls_last()
    r = F.rank().over(Window.partitionBy(*part).orderBy(o))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*part, c))
    return F.when(c.isNotNull(), r + (ties - 1) / 2.0)


def min_rank(x: str | Column, part: list[str], desc: bool = True) -> Column:
    c = col(x)
    o = c.desc_nulls_last() if desc else c.asc_nulls_last()
    return F.when(c.isNotNull(), F.rank().over(Window.partitionBy(*part).orderBy(o)))


def dense_rank(x: str | Column, part: list[str], desc: bool = True) -> Column:
    c = col(x)
    o = c.desc_nulls_last() if desc else c.asc_nulls_last()
    return F.when(c.isNotNull(), F.dense_rank().over(Window.partitionBy(*part).orderBy(o)))


def band(x: str | Column, edges: list[float], labels: list, right_closed: bool = False) -> Column:
    """Label of the interval x falls in; labels has one entry more than edges."""
    c = col(x)
    out = None
    for e, lab in zip(edges, labels):
        cond = c <= e if right_closed else c < e
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return F.when(c.isNotNull(), out.otherwise(F.lit(labels[-1])))


def first_reason(rules: list[tuple[str, Column]], default: str = "OK") -> Column:
    """Name of the first rule that holds."""
    out = None
    for name, cond in rules:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(default))


def all_reasons(rules: list[tuple[str, Column]], sep: str = ";") -> Column:
    """Names of all rules that hold, in rule order."""
    return F.concat_ws(sep, F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules])))


def code_map(x: str | Column, mapping: dict, default) -> Column:
    """Fixed small code table as a literal map."""
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.try_element_at(m, col(x)), F.lit(default))
