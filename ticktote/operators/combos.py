"""Ordered and unordered combinations of a race's entries.

Pairs and triples are self joins on race_id. Entries already are partitioned by race,
so the joins add no exchange, and the fan-out is bounded by the field size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktote.functions.core import sdiv


def _side(e: DataFrame, cols: list[str], i: int) -> DataFrame:
    return e.select("race_id", *[F.col(c).alias(f"{c}{i}") for c in cols])


def pairs(e: DataFrame, cols: list[str], ordered: bool = True) -> DataFrame:
    """All (1, 2) of a race with 1 <> 2, or 1 < 2 when unordered. cols must hold car_no."""
    j = _side(e, cols, 1).join(_side(e, cols, 2), "race_id")
    return j.where(F.col("car_no1") != F.col("car_no2") if ordered else F.col("car_no1") < F.col("car_no2"))


def triples(e: DataFrame, cols: list[str], ordered: bool = True) -> DataFrame:
    j = pairs(e, cols, ordered).join(_side(e, cols, 3), "race_id")
    if ordered:
        return j.where((F.col("car_no3") != F.col("car_no1")) & (F.col("car_no3") != F.col("car_no2")))
    return j.where(F.col("car_no2") < F.col("car_no3"))


def p_exacta(p1: Column, p2: Column) -> Column:
    return p1 * sdiv(p2, 1 - p1)


def p_trifecta(p1: Column, p2: Column, p3: Column) -> Column:
    """Ordered probability from win probabilities without replacement."""
    return p_exacta(p1, p2) * sdiv(p3, 1 - p1 - p2)


def p_quinella(p1: Column, p2: Column) -> Column:
    return p_exacta(p1, p2) + p_exacta(p2, p1)


def p_trio(a: Column, b: Column, c: Column) -> Column:
    """Unordered triple: the sum over its six orders, with common denominators shared."""
    ab, ac, bc = (sdiv(F.lit(1.0), 1 - x - y) for x, y in ((a, b), (a, c), (b, c)))
    return a * b * c * (sdiv(ab + ac, 1 - a) + sdiv(ab + bc, 1 - b) + sdiv(ac + bc, 1 - c))


def combo_key(*cars: Column) -> Column:
    return F.concat_ws("-", *cars)


def exotic_odds(prob: Column, disc: Column, take: float = 0.75) -> Column:
    """Stand-in market price of a combination for tables without one."""
    return take / prob * (0.8 + 12 * disc)


TICKETS = ("exacta", "quinella", "wide", "trifecta", "trio")


def ticket_rows(e: DataFrame, min_prob: float = 0.0, tickets: tuple[str, ...] = TICKETS) -> DataFrame:
    """Tickets of a probability above min_prob: (race_id, ticket, combo, prob, odds, hit).

    Branches are left before their third car is met: no order of finish is likelier than its first two cars in that
    order, and no three cars than six times their strongest two as a pair. So the rows built stay close to those kept.
    """
    cols = ["car_no", "prob", "disc", "finish"]
    f = {i: F.col(f"finish{i}") for i in (1, 2, 3)}
    p = {i: F.col(f"prob{i}") for i in (1, 2, 3)}
    k = {i: F.col(f"car_no{i}") for i in (1, 2, 3)}
    stronger = lambda a, b: (p[a] > p[b]) | ((p[a] == p[b]) & (k[a] > k[b]))
    # each entry has its whole race beside it, so that a race is derived once for each ticket family and not for each car
    field = F.collect_list(F.struct(*cols)).over(Window.partitionBy("race_id"))
    field = e.where(F.col("race_id").isNotNull()).select("race_id", *cols, field.alias("_field"))
    first = field.select("race_id", "_field", *[F.col(c).alias(f"{c}1") for c in cols])

    def meet(d, i):
        d = d.select("*", F.explode("_field").alias("_car"))
        return d.select(*[c for c in d.columns if c != "_car"], *[F.col("_car")[c].alias(f"{c}{i}") for c in cols])

    two = meet(first, 2).where(k[1] != k[2])

    def row(ticket, prob, hit, disc=F.col("disc1")):
        return F.struct(F.lit(ticket).alias("ticket"), prob.alias("prob"), hit.cast("int").alias("hit"), disc.alias("disc"))

    def rows(d, combo, made):
        # generated columns: filters on them are not pushed down and re-derived per use
        return d.select("race_id", combo.alias("combo"), F.explode(made).alias("t")).select("race_id", "combo", "t.*")

    parts = []
    if {"exacta", "quinella", "wide"} & set(tickets):
        q = p_quinella(p[1], p[2])
        two_top, in3 = (f[1] <= 2) & (f[2] <= 2), (f[1] <= 3) & (f[2] <= 3)
        one = [row("exacta", p_exacta(p[1], p[2]), (f[1] == 1) & (f[2] == 2))] if "exacta" in tickets else []
        both = {"quinella": row("quinella", q, two_top), "wide": row("wide", F.least(F.lit(1.0), 3 * q), in3)}
        made = F.when(k[1] < k[2], F.array(*one, *[v for t, v in both.items() if t in tickets]))
        parts.append(rows(two, combo_key(k[1], k[2]), made.otherwise(F.array(*one)) if one else made))
    if "trifecta" in tickets:
        d = meet(two.where(p_exacta(p[1], p[2]) > min_prob), 3).where((k[3] != k[1]) & (k[3] != k[2]))
        made = F.array(row("trifecta", p_trifecta(p[1], p[2], p[3]), (f[1] == 1) & (f[2] == 2) & (f[3] == 3)))
        parts.append(rows(d, combo_key(k[1], k[2], k[3]), made))
    if "trio" in tickets:
        d = meet(two.where(stronger(1, 2) & (6 * p_quinella(p[1], p[2]) > min_prob)), 3).where(stronger(2, 3))
        low = F.array_min(F.array(*[F.struct(k[i].alias("k"), F.col(f"disc{i}").alias("d")) for i in (1, 2, 3)]))["d"]
        made = F.array(row("trio", p_trio(p[1], p[2], p[3]), (f[1] <= 3) & (f[2] <= 3) & (f[3] <= 3), low))
        parts.append(rows(d, F.array_join(F.sort_array(F.array(k[1], k[2], k[3])), "-"), made))
    u = parts[0]
    for more in parts[1:]:
        u = u.unionByName(more)
    return u.where(F.col("prob") > min_prob).select("race_id", "ticket", "combo", "prob", exotic_odds(F.col("prob"), F.col("disc")).alias("odds"), "hit")
