"""Perspective rotation of dialogues with any number of speakers, in DataFrame functions only.

For each participant the whole dialogue is rendered with that speaker as the assistant and all others as named
users; the mask has the parts that a model is to learn from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 256
END = "<|end|>\n"


def _safe(c: Column) -> Column:
    """Text that cannot be taken for a marker of the template."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def speaker_name(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(_safe(c), r"[\r\n>]", " "), F.lit("unknown"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, system_roles: tuple[str, ...] = ("system",), part_turns: int = PART_TURNS) -> DataFrame:
    """One row per dialogue part and participant: conv, part, speaker, n_turns, text, masks (start and end, in characters).

    Turns are ordered by turn, role and text (nulls first), so ties and repeated rows have a fixed place. A dialogue
    is rendered in parts of part_turns turn numbers, which bounds what one task holds; a null turn belongs to part
    -1. System roles are rendered as system and have no perspective. A null role speaks as "unknown", a null text is
    empty, and markers inside texts are broken up. A dialogue of system turns alone, and an empty table, give no row.
    """
    name = F.coalesce(F.col(role_col), F.lit("unknown"))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), name.alias("name"), _safe(F.col(text_col)).alias("body"))
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")
    parts = rows.withColumn("part", part).groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "name", "body"))).alias("said"))
    people = rows.where(~F.col("name").isin(*system_roles)).select(F.col("conv").alias("c"), F.col("name").alias("speaker")).distinct()
    both = parts.join(people, F.col("conv").eqNullSafe(F.col("c")))

    def head(m: Column, speaker: Column) -> Column:
        user = F.concat(F.lit("<|user name="), speaker_name(m["name"]), F.lit("|>\n"))
        return F.when(m["name"] == speaker, F.lit("<|assistant|>\n")).when(m["name"].isin(*system_roles), F.lit("<|system|>\n")).otherwise(user)

    segments = F.transform("said", lambda m: F.struct(
        head(m, F.col("speaker")).alias("head"), F.concat(m["body"], F.lit(END)).alias("body"), (m["name"] == F.col("speaker")).alias("learn")))
    both = both.withColumn("segments", segments)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("masks"))

    def step(acc: Column, s: Column) -> Column:
        a = acc["at"] + F.length(s["head"])
        z = a + F.length(s["body"])
        span = F.array(F.struct(a.alias("start"), z.alias("end")))
        return F.struct(z.alias("at"), F.when(s["learn"], F.concat(acc["masks"], span)).otherwise(acc["masks"]).alias("masks"))

    return both.select(
        "conv", "part", "speaker", F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "").alias("text"), F.aggregate("segments", start, step)["masks"].alias("masks"))
