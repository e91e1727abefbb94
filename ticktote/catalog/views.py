"""Test views that give the entry columns of each sport from the input tables."""

from __future__ import annotations

from ticktote.catalog.common_sql import RE

_HORSE = {
    "track_condition": "motor_id % 4", "distance": "1000 + (motor_id % 13) * 200", "prev_running_style": "racer_id % 4",
    "running_style": "(motor_id + racer_id) % 4", "race_class": "length(grade) % 6", "win_rate": "prob", "last_finish": "motor_id % 12 + 1",
    "jockey_win_rate": "disc * 2", "trainer_win_rate": "tax * 2", "horse_weight": "420 + qty * 2.5", "horse_age": "2 + post", "sex": "motor_id % 2",
    "weight_change": "qty - 25", "weight_carried": "50 + disc * 100", "days_since_last": "motor_id % 300",
}
_CYCLE = {
    "bank_type": "motor_id % 3", "leg_type": "racer_id % 4", "line_size": "1 + motor_id % 4", "line_position": "motor_id % 4", "escape_rate": "disc * 5",
    "weather": "race_id % 3", "line_strength": "score / 1000", "rest_days": "motor_id % 40", "racer_age": "20 + racer_id % 30", "racer_class": "post",
    "class_level": "length(grade) % 6", "is_morning": "race_id % 2", "race_points": "score / 500", "block_strength": "tax * 10",
    "length": "CASE WHEN race_id % 3 = 0 THEN 333 WHEN race_id % 3 = 1 THEN 400 ELSE 500 END", "cant": "30 + race_id % 6", "is_dome": "race_id % 2",
    "wind_speed": "race_id % 10", "wind_dir": "race_id % 360", "is_rain": "CASE WHEN race_id % 5 = 0 THEN 1 ELSE 0 END",
}


def _cols(m: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in m.items())


HX = RE + f", hx AS (SELECT race_id, car_no, post, odds, field_size, racer_id, race_date, finish, {_cols(_HORSE)} FROM re)"
CX = RE + f", cx AS (SELECT race_id, car_no, field_size, racer_id, race_date, finish, {_cols(_CYCLE)} FROM re)"


def horse(t):
    return t.race_entries().selectExpr("race_id", "car_no", "post", "odds", "field_size", "racer_id", "race_date", "finish", *[f"{v} AS {k}" for k, v in _HORSE.items()])


def cycle(t):
    return t.race_entries().selectExpr("race_id", "car_no", "field_size", "racer_id", "race_date", "finish", *[f"{v} AS {k}" for k, v in _CYCLE.items()])
