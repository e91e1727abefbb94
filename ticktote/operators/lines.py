"""Riding lines: formation, fusion of sources and line features.

A line is a hyphen string of car numbers with a confidence, one row per
(race_id, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktote.functions.core import dense_rank
from ticktote.operators.sequence import key_join

C = F.col
# Weights and confidences of the line sources.
W_COMMENT, W_REPORTER, W_SCORE = 0.6, 0.3, 0.1
W_REPORTER_ONLY, W_SCORE_ONLY = 0.5, 0.5
SCORE_ONLY_CAP = 0.30
BASE_CONF, SINGLE_CONF, SAME_TERM_BONUS, COMMENT_CONF = 0.70, 0.45, 0.10, 0.80
UNCOMMENTED_WEIGHT = 0.6


def line_strings(entries: DataFrame, line: str, confidence: float = 1.0) -> DataFrame:
    g = entries.groupBy("race_id", line).agg(F.array_sort(F.collect_list("car_no")).alias("_c"))
    return g.select("race_id", F.array_join(C("_c").cast("array<string>"), "-").alias("line"), F.lit(confidence).alias("confidence"))


def explode_lines(lines: DataFrame) -> DataFrame:
    """(race_id, line, confidence, car_no, line_pos) with positions from 1."""
    return lines.select("race_id", "line", "confidence", F.posexplode(F.split("line", "-")).alias("_p", "_c")).select(
        "race_id", "line", "confidence", C("_c").cast("int").alias("car_no"), (C("_p") + 1).alias("line_pos"))


def line_features(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Line means, sizes and strength rank on every entry; always per race."""
    w = Window.partitionBy("race_id", "line")
    d = entries.join(members, ["race_id", "car_no"], "left")
    d = d.withColumns({"line_score": F.avg("score").over(w), "line_qty": F.sum("qty").over(w), "line_size": F.count(F.lit(1)).over(w)})
    return d.withColumn("line_rank", dense_rank("line_score", ["race_id"]))


def from_districts(entries: DataFrame) -> DataFrame:
    """Lines of up to three cars of one district, strongest back count first."""
    w = Window.partitionBy("race_id", "district").orderBy(C("back_count").desc(), "car_no")
    d = entries.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("race_id", "district"))})
    d = d.withColumn("_chunk", F.expr("_i div 3"))
    g = d.groupBy("race_id", "district", "_chunk").agg(F.array_sort(F.collect_list(F.struct("_i", "car_no", "term"))).alias("m"), F.max("_n").alias("_n"))
    same = F.try_element_at("m", F.lit(2))["term"] == F.try_element_at("m", F.lit(1))["term"]
    conf = F.when(C("_n") < 2, SINGLE_CONF).otherwise(BASE_CONF + F.when(F.coalesce(same, F.lit(False)), SAME_TERM_BONUS).otherwise(0.0))
    line = F.array_join(F.transform("m", lambda e: e["car_no"].cast("string")), "-")
    return g.select("race_id", line.alias("line"), F.least(conf, F.lit(1.0)).alias("confidence"))


def from_intents(intents: DataFrame) -> DataFrame:
    """Lead takes the next two followers in car order: the k-th lead gets followers 2k-1 and 2k."""
    w = Window.partitionBy("race_id", "role").orderBy("car_no")
    d = intents.withColumn("_k", F.row_number().over(w))
    slot = F.when(C("role") == "lead", C("_k")).when(C("role") == "follow", F.expr("(_k + 1) div 2"))
    d = d.withColumns({"_slot": slot, "_o": F.when(C("role") == "lead", 0).otherwise(C("_k"))})
    g = d.where(C("_slot").isNotNull()).groupBy("race_id", "_slot").agg(
        F.array_sort(F.collect_list(F.struct("_o", "car_no"))).alias("m"), F.max((C("role") == "lead").cast("int")).alias("_lead"))
    line = F.array_join(F.transform("m", lambda e: e["car_no"].cast("string")), "-")
    led = g.where("_lead = 1").select("race_id", line.alias("line"), F.lit(COMMENT_CONF).alias("confidence"))
    single = d.where("role = 'single'").select("race_id", C("car_no").cast("string").alias("line"), F.lit(COMMENT_CONF).alias("confidence"))
    return led.unionByName(single)


def from_comments(intents: DataFrame, entries: DataFrame) -> DataFrame:
    """Lines of the riders that commented, and of the others by district, with less confidence.

    intents has a row for each rider with a comment; entries has all riders, with district, term and back_count. Races
    without any comment get no line. A line that comments give keeps their confidence.
    """
    said = from_intents(intents)
    races = intents.select("race_id").distinct()
    silent = entries.join(races, "race_id", "left_semi").join(intents.select("race_id", "car_no"), ["race_id", "car_no"], "left_anti")
    rest = from_districts(silent).withColumn("confidence", C("confidence") * UNCOMMENTED_WEIGHT)
    return said.unionByName(rest.join(said.select("race_id", "line"), ["race_id", "line"], "left_anti"))


def fuse(comment: DataFrame, reporter: DataFrame, score: DataFrame) -> DataFrame:
    """Weighted confidence of the three sources, by which sources the race has."""
    src = [(comment, "c"), (reporter, "r"), (score, "s")]
    u = None
    for d, k in src:
        x = d.select("race_id", "line", F.lit(k).alias("src"), "confidence")
        u = x if u is None else u.unionByName(x)
    g = u.groupBy("race_id", "line").agg(*[F.coalesce(F.max(F.when(C("src") == k, C("confidence"))), F.lit(0.0)).alias(k) for _, k in src],
                                         *[F.max((C("src") == k).cast("int")).alias("_h" + k) for _, k in src])
    race = Window.partitionBy("race_id")
    g = g.withColumns({"_c": F.max("_hc").over(race), "_r": F.max("_hr").over(race)})
    both = C("c") * W_COMMENT + C("r") * W_REPORTER + C("s") * W_SCORE
    com = C("c") * (W_COMMENT + W_REPORTER / 2) + C("s") * (W_SCORE + W_REPORTER / 2)
    rep = C("r") * W_REPORTER_ONLY + C("s") * W_SCORE_ONLY
    conf = F.when((C("_c") == 1) & (C("_r") == 1), both).when(C("_c") == 1, com).when(C("_r") == 1, rep).otherwise(F.least(C("s"), F.lit(SCORE_ONLY_CAP)))
    conf = F.bround(F.least(conf, F.lit(1.0)), 4)
    return g.select("race_id", "line", conf.alias("confidence")).where(C("confidence") > 0)


def combo_confidence(combos: DataFrame, members: DataFrame, cars: list[str], key: list[str]) -> DataFrame:
    """Best confidence of a line sharing two or more cars with the combination, else 0."""
    m = members.select("race_id", "line", C("confidence").alias("_cf"), C("car_no").alias("_car"))
    e = combos.select(*key, F.explode(F.array(*cars)).alias("_car"))
    hit = e.join(m, ["race_id", "_car"]).groupBy(*key, "line").agg(F.count(F.lit(1)).alias("_n"), F.max("_cf").alias("_cf"))
    best = hit.where("_n >= 2").groupBy(*key).agg(F.max("_cf").alias("line_confidence"))
    return key_join(combos, best, key).withColumn("line_confidence", F.coalesce(C("line_confidence"), F.lit(0.0)))


def betrayal_hit(stated: Column, actual: Column) -> Column:
    return (stated != actual).cast("int")
