"""Column families of horse entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ticktote.functions.core import band, code_map, flag, sdiv

C = F.col

# Band edges (right-closed) of distance in metres and rest in days.
DISTANCE_EDGES = [1400, 1800, 2200]
REST_EDGES = [21, 45, 90, 180]
# Style score when many or few front runners are expected.
FAST_PACE_SCORE = {0: -0.3, 1: -0.1, 2: 0.2, 3: 0.3}
SLOW_PACE_SCORE = {0: 0.3, 1: 0.15, 2: -0.1, 3: -0.25}


def race() -> WindowSpec:
    return Window.partitionBy("race_id")


def distance_band(x="distance"):
    return band(x, DISTANCE_EDGES, [0, 1, 2, 3], right_closed=True)


def rest_band(x="days_since_last"):
    return band(x, REST_EDGES, [0, 1, 2, 3, 4], right_closed=True)


def running_style(corners):
    """Style code from the last corner position of a hyphen list: 0 front .. 3 closer."""
    last = F.try_element_at(F.split(corners, "-"), F.lit(-1)).try_cast("int")
    return F.coalesce(band(last, [2, 5, 10], [0, 1, 2, 3]), F.lit(1))


def track_condition(df: DataFrame) -> DataFrame:
    cond, style, km = C("track_condition"), C("prev_running_style"), C("distance") / 2000.0
    return df.withColumns({
        "cond_x_style": cond * style, "cond_x_dist": cond * km, "cond_dist_style": cond * km * style,
        "good_track_closer": flag((cond == 0) & (style >= 2)), "heavy_track_front": flag((cond >= 2) & (style <= 1))})


def pace(df: DataFrame) -> DataFrame:
    s = C("running_style")
    d = df.withColumns({"n_front": F.sum(flag(s <= 0)).over(race()), "front_ratio": F.avg(flag(s <= 1)).over(race())})
    fr = C("front_ratio")
    score = F.when(fr > 0.45, code_map("prev_running_style", FAST_PACE_SCORE, 0.0)).when(fr < 0.30, code_map("prev_running_style", SLOW_PACE_SCORE, 0.0)).otherwise(0.0)
    return d.withColumns({
        "hi_pace_flag": flag((C("n_front") >= 2) | (fr > 0.45)), "slow_pace_flag": flag((C("n_front") <= 1) & (fr < 0.30)),
        "pace_style_score": score, "dist_x_pace": C("distance") / 2000.0 * fr})


def class_transition(df: DataFrame) -> DataFrame:
    cl, wr, lf = C("race_class"), C("win_rate"), C("last_finish")
    return df.withColumns({
        "class_vs_perf": cl * 0.2 - wr, "class_struggle": flag((cl >= 3) & (wr < 0.05)), "class_dropper": flag((cl <= 1) & (wr > 0.15)),
        "class_vs_lastfinish": cl - lf / 3.0, "momentum_upgrade": flag((lf <= 3) & (cl >= 3)) * wr})


def trainer_jockey(df: DataFrame) -> DataFrame:
    tr, jo = C("trainer_win_rate"), C("jockey_win_rate")
    return df.withColumns({
        "trainer_jockey_combo": tr * jo, "combo_sum": tr + jo, "combo_balance": F.abs(tr - jo),
        "elite_combo": flag((tr > 0.12) & (jo > 0.12)), "trainer_x_class": tr * (C("race_class") + 1)})


def distance_aptitude(df: DataFrame) -> DataFrame:
    b = distance_band()
    young = (2.0 - F.abs(b - 1.5)) * 0.1
    old = (2.0 - F.abs(b - 0.5)) * 0.05
    return df.withColumns({
        "weight_dist_apt": (C("horse_weight") - 470) / 50.0 * (2.0 - b), "dist_winrate_sq": F.pow(C("distance") / 2000.0, 2) * C("win_rate"),
        "age_dist_apt": F.when(C("horse_age") <= 3, young).otherwise(old), "sex_dist": flag((C("sex") == 0) & (b <= 1))})


def weight_change(df: DataFrame) -> DataFrame:
    w = C("weight_change")
    return df.withColumns({
        "weight_change_sq": w * w, "slight_weight_loss": flag((w >= -4) & (w < 0)), "big_weight_gain": flag(w > 8), "big_weight_loss": flag(w < -8),
        "carried_x_class": C("weight_carried") * C("race_class"), "carried_rank": F.rank().over(race().orderBy("weight_carried"))})


def rest_period(df: DataFrame) -> DataFrame:
    d, b = C("days_since_last"), rest_band()
    return df.withColumns({
        "rest_category": b, "quick_return": flag(d <= 14), "medium_rest": flag((d > 45) & (d <= 90)), "long_rest": flag(d > 90),
        "very_long_rest": flag(d > 180), "log_days_rest": F.log1p(d), "rest_x_class": b * C("race_class"), "rest_x_age": b * (C("horse_age") - 3)})


def interactions(df: DataFrame) -> DataFrame:
    ip = sdiv(F.lit(1.0), C("odds"))
    d = df.withColumns({
        "implied_prob": ip, "odds_vs_winrate": C("win_rate") - ip, "jockey_horse_combo": C("jockey_win_rate") * C("win_rate"),
        "weight_extreme": flag((C("horse_weight") < 430) | (C("horse_weight") > 520)), "inner_post": flag(C("post") <= 3), "small_field": flag(C("field_size") <= 10),
        "pace_predict": F.avg(flag(C("prev_running_style") <= 1)).over(race())})
    return d.withColumn("style_pace_interact", C("prev_running_style") * C("pace_predict"))
