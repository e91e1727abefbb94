"""First passage over long horizons by a two-level pyramid of extremes.

Rows of a key are cut into blocks of about the square root of the horizon. A block knows its rows and the highest and
lowest value of each block ahead within the horizon. A barrier is looked for in the rest of its own block, then among
the extremes ahead, and the first block that can hold it is opened by an equi-join. So a row looks at a few square
roots of the horizon instead of at the horizon, no row carries its path, and all barriers of a row share one pyramid.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktote.operators.sequence import number_rows
from ticktote.sources.storage import stored_table


def _first(rows: Column) -> Column:
    return F.try_element_at(rows, F.lit(1))


def first_beyond(df: DataFrame, keys: list[str], pos: str, levels: Column, horizon: int, *, high: str = "high", low: str = "low", block: int | None = None) -> DataFrame:
    """(keys, pos, cell, up, down, at, at_high, at_low) for each row and each of its levels.

    levels: array of (cell, up, down). at is the position of the first of the next `horizon` rows whose high is at
    least up or whose low is at most down, NULL if there is none; NULL values and NULL levels are never reached.
    Positions are 0-based and without gaps inside a key; a NULL key is no sequence and has no rows.
    """
    b = block or max(2, isqrt(horizon))
    d = df.where(" and ".join(f"`{k}` is not null" for k in keys)) if keys else df
    row = F.struct(F.col(pos).cast("long").alias("p"), F.col(high).alias("h"), F.col(low).alias("l"), levels.alias("v"))
    blocks = d.groupBy(*keys, F.expr(f"`{pos}` div {b}").alias("blk")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    blocks = stored_table(blocks, "blocks")
    # only the extremes of a key are ordered, one row for a block
    top = blocks.select(*keys, "blk", F.array_max(F.transform("rows", lambda r: r["h"])).alias("hi"), F.array_min(F.transform("rows", lambda r: r["l"])).alias("lo"))
    w = Window.partitionBy(*keys).orderBy("blk").rangeBetween(1, -(-horizon // b))
    ahead = top.select(*keys, "blk", F.collect_list(F.struct("blk", "hi", "lo")).over(w).alias("ahead"))

    def look(e: Column, c: Column) -> Column:
        beyond = lambda hi, lo: F.coalesce(hi >= c["up"], F.lit(False)) | F.coalesce(lo <= c["down"], F.lit(False))
        own = _first(F.filter("rows", lambda r: (r["p"] > e["p"]) & (r["p"] <= e["p"] + horizon) & beyond(r["h"], r["l"])))
        nxt = _first(F.filter("ahead", lambda s: beyond(s["hi"], s["lo"])))
        return F.struct(e["p"].alias("p"), c["cell"].alias("cell"), c["up"].alias("up"), c["down"].alias("down"), F.struct(own["p"].alias("p"), own["h"].alias("h"), own["l"].alias("l")).alias("own"), nxt["blk"].alias("nxt"))

    d = blocks.join(ahead, [*keys, "blk"]).select(*keys, F.explode(F.flatten(F.transform("rows", lambda e: F.transform(e["v"], lambda c: look(e, c))))).alias("q"))
    # rows that need no other block get a number of their own, which meets none and spreads them
    d = d.select(*keys, "q.*").withColumn("nxt", F.coalesce(F.when(F.col("own.p").isNull(), F.col("nxt")), -1 - F.col("p")))
    d = d.join(blocks.select(*keys, F.col("blk").alias("nxt"), "rows"), [*keys, "nxt"], "left")
    hit = _first(F.filter("rows", lambda r: (r["p"] <= F.col("p") + horizon) & (F.coalesce(r["h"] >= F.col("up"), F.lit(False)) | F.coalesce(r["l"] <= F.col("down"), F.lit(False)))))
    d = d.withColumn("hit", F.when(F.col("own.p").isNotNull(), F.col("own")).otherwise(F.struct(hit["p"].alias("p"), hit["h"].alias("h"), hit["l"].alias("l"))))
    return d.select(*keys, F.col("p").alias(pos), "cell", "up", "down", F.col("hit.p").alias("at"), F.col("hit.h").alias("at_high"), F.col("hit.l").alias("at_low"))


def long_exits(df: DataFrame, keys: list[str], order: list[str], cells: list[tuple[float, float]], side: str, unit: str, horizon: int, block: int | None = None) -> DataFrame:
    """Exits of a trade opened at the close of each row, for each (stop multiple, target multiple) of cells.

    Adds sl_mult, tp_mult, exit_reason, exit_price and bars_held, as first_touch does for short horizons: a bar that
    reaches both exits at the stop, and without either the trade leaves at the close of the last row in reach. Rows
    with a NULL side or unit, or without a later row, get NULLs.
    """
    d = stored_table(number_rows(df, keys, order, "_pos", size="_rows"), "numbered")
    e, s, u = F.col("close"), F.col(side), F.col(unit)

    def level(i: int, sl: float, tp: float) -> Column:
        target, stop = e + s * u * tp, e - s * u * sl
        return F.struct(F.lit(i).alias("cell"), F.when(s > 0, target).otherwise(stop).alias("up"), F.when(s > 0, stop).otherwise(target).alias("down"))

    levels = F.array(*[level(i, sl, tp) for i, (sl, tp) in enumerate(cells)])
    found = first_beyond(d, keys, "_pos", levels, horizon, block=block)
    table = F.array(*[F.struct(F.lit(float(sl)).alias("sl_mult"), F.lit(float(tp)).alias("tp_mult")) for sl, tp in cells])
    last = F.least(F.col("_pos") + horizon, F.col("_rows") - 1)
    d = d.withColumn("_last", last).join(d.select(*keys, F.col("_pos").alias("_last"), F.col("close").alias("_timed")), [*keys, "_last"], "left")
    d = d.join(found, [*keys, "_pos"], "left").withColumn("_m", table[F.col("cell")])
    stop, target = F.when(s > 0, F.col("down")).otherwise(F.col("up")), F.when(s > 0, F.col("up")).otherwise(F.col("down"))
    stopped = F.when(s > 0, F.col("at_low") <= stop).otherwise(F.col("at_high") >= stop)
    open_ = (F.col("_last") > F.col("_pos")) & s.isNotNull() & u.isNotNull()
    out = {
        "sl_mult": F.col("_m.sl_mult"), "tp_mult": F.col("_m.tp_mult"),
        "exit_reason": F.when(open_, F.when(F.col("at").isNull(), "time_exit").when(stopped, "stop_loss").otherwise("take_profit")),
        "exit_price": F.when(open_, F.when(F.col("at").isNull(), F.col("_timed")).when(stopped, stop).otherwise(target)),
        "bars_held": F.when(open_, F.coalesce("at", "_last") - F.col("_pos")).cast("int")}
    return d.select(*df.columns, *[v.alias(k) for k, v in out.items()])
