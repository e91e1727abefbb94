"""Exponentially weighted means as stacked window aggregates.

y[t] = A[t] * y[t-1] + B[t] with A <= 1 - alpha. A key is cut into chunks of C
values with (1 - alpha)^C below double precision. Inside a chunk the recurrence
is one running product and one running sum; what a chunk hands to the next one
is its own last value, since anything older has a weight under the rounding
error. All windows share the key's partitioning: one exchange, no join, no
Python. A key too long for one task can be cut with `sequence.with_halo`, as the
result depends on the last 2 C rows only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticktote.functions.core import Seq, col


def alpha_of(span: float | None = None, alpha: float | None = None) -> float:
    return alpha if alpha is not None else 2.0 / (span + 1.0)


def memory_rows(alpha: float) -> int:
    """Rows after which a value's weight is below double precision."""
    return max(2, math.ceil(-41.5 / math.log(1 - alpha)))


def ewm(df: DataFrame, seq: Seq, specs: dict[str, dict]) -> DataFrame:
    """Exponentially weighted means.

    specs: output -> {x, span | alpha, adjust (False), min_periods (1)}. NULLs
    inside the series keep decaying the older weights, a NULL row repeats the
    last value, rows before the first value are NULL.
    """
    prep, sums, zs, ends, res = {"_pos": F.row_number().over(seq.w)}, {}, {}, {}, {}
    xs = {}
    for k, s in specs.items():
        xs.setdefault(str(s["x"]), []).append(k)
    group = {k: f"g{i}" for i, ks in enumerate(xs.values()) for k in ks}
    for k in specs:
        prep[f"_n_{group[k]}"] = F.count(col(specs[k]["x"])).over(seq.upto())
    d = df.withColumns(prep)
    gap = {
        f"_d_{group[k]}": F.col("_pos")
        - F.last(F.when(col(specs[k]["x"]).isNotNull(), F.col("_pos")), ignorenulls=True).over(seq.before())
        for k in specs
    }
    d = d.withColumns(gap)
    size = {g: max(memory_rows(alpha_of(specs[k].get("span"), specs[k].get("alpha"))) for k in ks) for g, ks in zip([f"g{i}" for i in range(len(xs))], xs.values())}
    # one chunk length for all outputs keeps a single sort where the NULL pattern is shared
    c = max(size.values())
    d = d.withColumns({f"_c_{g}": F.expr(f"(_n_{g} - 1) div {c}") for g in size})
    for k, s in specs.items():
        a, x, g = alpha_of(s.get("span"), s.get("alpha")), col(s["x"]), group[k]
        ln, has, step = math.log(1 - a), x.isNotNull(), F.col(f"_d_{g}")
        w = Window.partitionBy(*seq.keys, f"_c_{g}").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
        if s.get("adjust", False):
            ln_a = F.when(~has | step.isNull(), 0.0).otherwise(ln * step)
            parts = {"u": F.coalesce(x, F.lit(0.0)), "v": F.when(has, 1.0).otherwise(0.0)}
        else:
            old = F.pow(F.lit(1 - a), step)
            ln_a = F.when(~has | step.isNull(), 0.0).when(step == 1, ln).otherwise(F.log(old / (old + a)))
            parts = {"u": F.when(~has, 0.0).when(step.isNull(), x).when(step == 1, a * x).otherwise(a * x / (old + a))}
        sums[f"_p_{k}"] = F.sum(ln_a).over(w)
        for p, b in parts.items():
            zs[f"_z{p}_{k}"] = (b, f"_p_{k}", w)
            ends[f"_e{p}_{k}"] = (f"_z{p}_{k}", has & (F.col(f"_n_{g}") % c == 0))
        y = {p: F.col(f"_z{p}_{k}") + F.exp(f"_p_{k}") * F.coalesce(F.col(f"_e{p}_{k}"), F.lit(0.0)) for p in parts}
        val = F.try_divide(y["u"], y["v"]) if "v" in y else y["u"]
        res[k] = (F.when(has, val), F.col(f"_n_{g}") >= max(1, s.get("min_periods", 1)))
    d = d.withColumns(sums)
    d = d.withColumns({k: F.exp(F.col(p)) * F.sum(b * F.exp(-F.col(p))).over(w) for k, (b, p, w) in zs.items()})
    d = d.withColumns({k: F.last(F.when(cond, F.col(z)), ignorenulls=True).over(seq.before()) for k, (z, cond) in ends.items()})
    d = d.withColumns({f"_y_{k}": v for k, (v, _) in res.items()})
    return d.select(
        *df.columns, *[F.when(ok, F.last(f"_y_{k}", ignorenulls=True).over(seq.upto())).alias(k) for k, (_, ok) in res.items()]
    )
