"""Signal generation and settlement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktote.functions import betting as bt
from ticktote.functions.core import first_reason, sdiv
from ticktote.operators import race as ra
from ticktote.operators.sequence import key_join

C = F.col


def generate_signals(
    entries: DataFrame,
    conditions: list[tuple[Column, int]],
    odds_move: Column,
    min_ev: float = 0.8,
    capital: float = 100000.0,
    min_score: int = 60,
    surge: float = 0.015,
    odds_cap: float = 100.0,
) -> DataFrame:
    """Value entries with predictability score, first failing filter and stake.

    conditions are (condition of a race, points it takes off the score); odds_move is the late move of the entry's odds.
    """
    d = ra.predictability(entries.withColumn("ev", bt.expected_value("prob", "odds")), conditions, "score")
    d = d.where((C("ev") >= min_ev) & (C("prob") < 1) & (C("odds") > 1))
    reason = first_reason([("predictability low", C("score") < min_score), ("odds surge", odds_move >= surge), ("odds cap", C("odds") > odds_cap)])
    return d.withColumns({"reason": reason, "stake": bt.kelly("prob", "odds", F.lit(capital), unit=100.0)})


def settle(bets: DataFrame, payouts: DataFrame) -> DataFrame:
    """Bets joined to the payout table of (race_id, ticket, combo); a missing payout is a loss."""
    d = key_join(bets, payouts, ["race_id", "ticket", "combo"])
    return d.withColumns({"win": C("payout").isNotNull().cast("int"), "payout": F.coalesce(C("payout"), F.lit(0.0))})
