"""Column families of cycle-race entries with riding lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticktote.functions.core import clip, code_map, flag, sdiv

C = F.col
# Placement score of (line position, leg type, score); any other pair scores 0.
POSITION_LEG_SCORE = [
    (1, 0, 2.0), (1, 1, 1.0), (2, 2, 2.0), (2, 3, 1.5), (3, 3, 1.5), (3, 2, 1.0), (0, 1, 1.0), (0, 0, 0.5), (1, 3, -1.0), (2, 0, -0.5),
]
# Fixed values: (escape, makuri, sashi) base scores by bank length class.
BANK_BASE = {"short": (0.75, 0.45, 0.35), "mid": (0.60, 0.55, 0.50), "long": (0.45, 0.65, 0.60)}
BANK_FACTOR = {"short": (1.2, 0.8), "mid": (1.0, 1.0), "long": (0.7, 1.3)}


def bank_class(length: Column) -> Column:
    return F.when(length <= 335, "short").when(length == 400, "mid").otherwise("long")


def _by_bank(length: Column, table: dict, i: int) -> Column:
    return code_map(bank_class(length), {k: v[i] for k, v in table.items()}, 0.0)


def bank_type(df: DataFrame) -> DataFrame:
    short, long_ = C("bank_type") == 0, C("bank_type") == 2
    front, rear = C("leg_type").isin(0, 1), C("leg_type").isin(2, 3)
    adv = F.when((short & front) | (long_ & rear), 1.0).when((short & rear) | (long_ & front), -0.5).otherwise(0.0)
    esc = F.when(short, C("escape_rate") * 1.5).when(long_, C("escape_rate") * 0.5).otherwise(0.0)
    return df.withColumns({
        "bank_333": flag(short), "bank_500": flag(long_), "bank_leg_advantage": adv, "bank_x_line_size": C("bank_type") * C("line_size"), "bank_x_escape_rate": esc})


def weather(df: DataFrame) -> DataFrame:
    rain, p = C("weather") == 2, C("line_position")
    return df.withColumns({
        "wind_front_penalty": F.when(rain & (p == 1), -1.0).when(rain & (p == 0), -0.5).otherwise(0.0),
        "rain_draft_bonus": F.when(rain & (p == 2), 1.0).when(rain & (p == 3), 0.5).otherwise(0.0),
        "weather_x_escape": C("weather") * C("escape_rate"), "weather_x_line_strength": C("weather") * C("line_strength") / 100,
        "bad_weather_line_bonus": F.when((C("weather") >= 1) & (C("line_size") >= 3), 1.0).otherwise(0.0)})


def fatigue(df: DataFrame) -> DataFrame:
    d = C("rest_days")
    score = F.when(d <= 2, 3.0 - d).when(d <= 14, 0.0).otherwise((d - 14) / 30)
    best = flag((d >= 3) & (d <= 14)).cast("double")
    return df.withColumns({
        "fatigue_score": score, "fatigue_x_age": score * F.greatest(C("racer_age") - 30, F.lit(0)) / 20, "optimal_rest": best,
        "rest_x_class": best * C("racer_class") / 6, "consecutive_risk": F.when(d > 2, 0.0).when(C("leg_type") == 0, 2.0).otherwise(1.0)})


def season_tactics(df: DataFrame) -> DataFrame:
    d = df.withColumn("season", F.floor(C("race_id") % 365 / 91).cast("int"))
    winter, summer = C("season") == 3, C("season") == 1
    return d.withColumns({
        "season_x_line_front": F.when(winter & (C("line_position") == 1), -0.5).when(summer & C("line_position").isin(2, 3), 0.5).otherwise(0.0),
        "weather_volatility": C("weather") * 0.5 + C("is_morning") * 0.3, "morning_weather": C("is_morning") * C("weather"),
        "class_weather": C("class_level") * (2 - C("weather")) / 6,
        "season_x_bank": F.when((winter & (C("bank_type") == 2)) | (summer & (C("bank_type") == 0)), 1.0).otherwise(0.0)})


def position_leg(df: DataFrame) -> DataFrame:
    p, leg = C("line_position"), C("leg_type")
    score = F.coalesce(*[F.when((p == a) & (leg == b), F.lit(v)) for a, b, v in POSITION_LEG_SCORE], F.lit(0.0))
    d = df.withColumn("position_leg_score", score)
    return d.withColumns({
        "position_fit_x_points": C("position_leg_score") * C("race_points") / 100,
        "front_escape_combo": flag((p == 1) & (leg == 0)) * C("escape_rate"),
        "second_closer_combo": flag((p == 2) & leg.isin(2, 3)) * C("block_strength"),
        "position_mismatch": flag(C("position_leg_score") < 0).cast("double")})


def technique_rates(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of each winning technique; a zero total counts as one."""
    tot = sum((F.coalesce(C(c), F.lit(0)) for c in cols), F.lit(0))
    tot = F.when(tot == 0, 1).otherwise(tot)
    return df.withColumns({c + "_rate": F.bround(F.coalesce(C(c), F.lit(0)) / tot, 4) for c in cols})


def style_advantage(df: DataFrame) -> DataFrame:
    """Escape, makuri and sashi scores of a bank under the current wind."""
    ln = C("length")
    wind = F.when(C("is_dome") == 1, 0.0).otherwise(C("wind_speed"))
    head = (wind >= 4.0) & (F.abs(C("wind_dir") - 180) <= 45)
    f = F.when(head, F.least(wind / 4.0, F.lit(2.0))).otherwise(0.0)
    steep = F.when(C("cant") >= 34, 0.10).otherwise(0.0)
    return df.withColumns({
        "escape": clip(_by_bank(ln, BANK_BASE, 0) - 0.15 * f, 0, 1), "makuri": clip(_by_bank(ln, BANK_BASE, 1) + steep + 0.10 * f, 0, 1), "sashi": _by_bank(ln, BANK_BASE, 2)})


def deployment(df: DataFrame) -> DataFrame:
    """Escape, makuri, sashi deployment and chaos per entry; single riders are counted per race."""
    ln, pos = C("length"), C("line_position")
    lead = F.when(C("leg_type") == 0, 0.8).otherwise(0.4)
    single = F.sum(flag(C("line_size") == 1)).over(Window.partitionBy("race_id"))
    windy = C("wind_speed") >= 4
    chaos = F.least(F.lit(1.0), single * 0.15)
    chaos = F.least(F.lit(1.0), chaos + F.when(C("is_rain") == 1, 0.10).otherwise(0.0))
    chaos = F.least(F.lit(1.0), chaos + F.when(windy, 0.10).otherwise(0.0))
    return df.withColumns({
        "escape_deploy": F.when(pos == 1, F.least(F.lit(1.0), lead * _by_bank(ln, BANK_FACTOR, 0))).otherwise(0.3),
        "makuri_deploy": F.least(F.lit(1.0), (0.5 + F.when(windy, 0.15).otherwise(0.0)) * _by_bank(ln, BANK_FACTOR, 1)),
        "sashi_deploy": F.when(pos.isin(2, 3), 0.6).otherwise(0.3), "chaos_risk": chaos})
