"""First-passage operators: which barrier is reached first in the next H rows.

The next H rows are read through a fixed row frame, so the cost per row is
bounded by H and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktote.functions.core import Seq, col


def _path(q: Seq, h: int, *cols: str) -> Column:
    return F.collect_list(F.struct(*cols)).over(q.after(h))


def triple_barrier(df: DataFrame, q: Seq, up, down, horizon: int = 24, x: str = "close", out: str = "label") -> DataFrame:
    """1 when the return first reaches `up`, 0 when it first reaches `down`, else 2.

    The last `horizon` rows of a sequence have no full path and stay NULL. `up`
    is tested before `down` on the same row; both may be columns.
    """
    up, down = (F.lit(float(v)) if isinstance(v, (int, float)) else v for v in (up, down))
    d = df.withColumns({"_up": up, "_dn": down, "_p": _path(q, horizon, x)})
    rets = F.transform("_p", lambda e: e[x] / F.col(x) - 1)
    hit = F.filter(rets, lambda r: (r >= F.col("_up")) | (r <= F.col("_dn")))
    first = F.try_element_at(hit, F.lit(1))
    lab = F.when(F.size("_p") < horizon, None).when(first.isNull(), 2).when(first >= F.col("_up"), 1).otherwise(0)
    return d.withColumn(out, lab.cast("int")).drop("_up", "_dn", "_p")


def with_path(df: DataFrame, q: Seq, horizon: int) -> DataFrame:
    """Adds the next rows' high, low and close once; exits of many parameter sets can then share them."""
    return df.withColumn("_p", _path(q, horizon, "high", "low", "close"))


def exit_grid(df: DataFrame, q: Seq, side: Column, atr: str, sl_mults: list[float], tp_mults: list[float], horizon: int) -> DataFrame:
    """Exits for every stop and target multiple; the path is read once per row."""
    cells = F.array(*[F.struct(F.lit(float(s)).alias("sl_mult"), F.lit(float(t)).alias("tp_mult")) for s in sl_mults for t in tp_mults])
    d = with_path(df, q, horizon).withColumn("_g", F.explode(cells)).select("*", "_g.*").drop("_g")
    e = F.col("close")
    return first_touch(d, q, e + side * F.col(atr) * F.col("tp_mult"), e - side * F.col(atr) * F.col("sl_mult"), side, horizon)


def first_touch(df: DataFrame, q: Seq, tp: Column, sl: Column, side: Column, horizon: int, entry: str | Column = "close") -> DataFrame:
    """Exit of a trade opened on each row: adds exit_reason, exit_price, bars_held.

    tp/sl are price levels, side is +1 or -1. A bar touching both exits at the
    stop. Without a touch the trade leaves at the close of the last bar in reach;
    rows without any later bar get NULLs.
    """
    d = df if "_p" in df.columns else with_path(df, q, horizon)
    d = d.withColumns({"_tp": tp, "_sl": sl, "_sd": side, "_e": col(entry)})

    def judge(e, i):
        stop = F.when(F.col("_sd") > 0, e["low"] <= F.col("_sl")).otherwise(e["high"] >= F.col("_sl"))
        take = F.when(F.col("_sd") > 0, e["high"] >= F.col("_tp")).otherwise(e["low"] <= F.col("_tp"))
        return F.struct(
            F.when(stop, F.lit("stop_loss")).when(take, F.lit("take_profit")).alias("why"),
            F.when(stop, F.col("_sl")).otherwise(F.col("_tp")).alias("px"),
            (i + 1).alias("n"),
        )

    hit = F.try_element_at(F.filter(F.transform("_p", judge), lambda e: e["why"].isNotNull()), F.lit(1))
    d = d.withColumn("_h", hit)
    timed = F.try_element_at(F.col("_p"), F.lit(-1))["close"]
    d = d.withColumns(
        {
            "exit_reason": F.when(F.size("_p") == 0, None).otherwise(F.coalesce(F.col("_h.why"), F.lit("time_exit"))),
            "exit_price": F.coalesce(F.col("_h.px"), timed),
            "bars_held": F.when(F.size("_p") == 0, None).otherwise(F.coalesce(F.col("_h.n"), F.size("_p"))),
        }
    )
    return d.drop("_tp", "_sl", "_sd", "_e", "_p", "_h")
