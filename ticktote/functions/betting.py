"""Expected value and position sizing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticktote.functions.core import col, sdiv

# Takeout of the pool, and stake multipliers by drawdown (from, multiplier).
TAKEOUT = 0.25
DRAWDOWN_STEPS = [(0.40, 0.0), (0.30, 0.25), (0.20, 0.5), (0.10, 0.75)]
# Size multiplier from a losing streak on.
STREAK_STEPS = [(7, 0.0), (5, 0.25), (3, 0.5)]


def expected_value(prob, odds, takeout: float = TAKEOUT) -> Column:
    return col(prob) * col(odds) * (1 - takeout)


def steps(x: Column, table: list[tuple[float, float]], otherwise: float = 1.0) -> Column:
    """Value of the first entry x reaches; entries in descending order."""
    out = None
    for lim, v in table:
        out = F.when(x >= lim, v) if out is None else out.when(x >= lim, v)
    return out.otherwise(otherwise)


def kelly(prob, odds, capital, fraction: float = 0.25, max_ratio: float = 0.05, min_bet: float = 0.0, unit: float = 1.0) -> Column:
    """Fractional Kelly stake: zero below an edge, capped, raised to min_bet, rounded half-even to the unit."""
    p, o, cap = col(prob), col(odds), col(capital)
    full = F.greatest(F.lit(0.0), sdiv(p * o - 1, o - 1))
    bet = F.least(full * fraction * cap, cap * max_ratio)
    if min_bet > 0:
        bet = F.when(bet > 0, F.greatest(bet, F.lit(min_bet))).otherwise(0.0)
    if unit > 0:
        bet = F.rint(bet / unit) * unit
    bad = (p <= 0) | (p >= 1) | (o <= 1) | (cap <= 0)
    return F.when(bad, 0.0).otherwise(bet)


def kelly_after_drawdown(prob, odds, capital, peak, unit: float = 1.0, **kw) -> Column:
    base = kelly(prob, odds, capital, unit=unit, **kw)
    cap, pk = col(capital), col(peak)
    dd = sdiv(pk - cap, pk)
    adj = F.rint(base * steps(dd, DRAWDOWN_STEPS) / unit) * unit
    return F.when((pk <= 0) | (cap >= pk), base).otherwise(adj)


def risk_size(balance, entry, stop, streak, risk: float = 0.02) -> Column:
    """Size that loses `risk` of the balance at the stop, reduced by the losing streak."""
    gap = F.abs(col(entry) - col(stop))
    size = sdiv(col(balance) * risk, gap) * steps(col(streak), STREAK_STEPS)
    ok = (col(entry) > 0) & (col(stop) > 0) & (gap > 0)
    return F.when(ok, F.greatest(F.lit(0.0), F.bround(size, 2))).otherwise(0.0)


def sl_tp(side: Column, entry, atr, sl_mult: float = 1.5, tp_mult: float = 2.0) -> dict[str, Column]:
    e, a = col(entry), col(atr)
    return {
        "stop_loss": e - side * a * sl_mult,
        "take_profit": e + side * a * tp_mult,
        "reward_ratio": F.when(a * sl_mult > 0, F.bround(F.lit(tp_mult / sl_mult), 4)).otherwise(0.0),
    }


def exit_reason(side: Column, price: Column, sl: Column, tp: Column, held: Column, max_hold: float) -> Column:
    """stop_loss before take_profit before time_exit."""
    stop = F.when(side > 0, price <= sl).otherwise(price >= sl)
    take = F.when(side > 0, price >= tp).otherwise(price <= tp)
    return F.when(stop, "stop_loss").when(take, "take_profit").when(held >= max_hold, "time_exit")


def relative_cost(spread, atr) -> Column:
    return sdiv(spread, F.when(col(atr) > 0, col(atr)))


def verdict(cases: list[tuple[Column, bool, float, str]]) -> Column:
    """Struct (passed, mult, reason) of the first case that holds; otherwise pass at full confidence."""
    def s(p, m, r):
        return F.struct(F.lit(p).alias("passed"), F.lit(m).alias("mult"), F.lit(r).alias("reason"))

    out = None
    for cond, p, m, r in cases:
        out = F.when(cond, s(p, m, r)) if out is None else out.when(cond, s(p, m, r))
    return out.otherwise(s(True, 1.0, "normal"))


def odds_surge(before, after) -> Column:
    """Fixed limits: a rise of 20 % cancels, 10 % halves, 5 % takes a fifth."""
    b = col(before)
    x = sdiv(col(after) - b, b)
    return verdict([(b.isNull() | col(after).isNull() | (b <= 0), True, 1.0, "no history"), (x >= 0.20, False, 0.0, "surge 20%"), (x >= 0.10, True, 0.5, "surge 10%"), (x >= 0.05, True, 0.8, "surge 5%")])


def volume_surge(recent, baseline, threshold: float = 3.0) -> Column:
    x = sdiv(recent, baseline)
    return verdict([(col(baseline) <= 0, True, 1.0, "no baseline"), (x >= 2 * threshold, False, 0.0, "volume x2"), (x >= threshold, True, 0.5, "volume"), (x >= 0.7 * threshold, True, 0.8, "volume rising")])


def spread_widening(spread, baseline, limit: float = 3.0) -> Column:
    x = sdiv(spread, baseline)
    return verdict([(col(spread) >= limit, False, 0.0, "spread limit"), (col(baseline) <= 0, True, 1.0, "no baseline"), (x >= 3, True, 0.5, "spread x3"), (x >= 2, True, 0.8, "spread x2")])


def funding_extreme(rate, high: float = 0.01, low: float = -0.005) -> Column:
    r = col(rate)
    return verdict([(F.abs(r) >= abs(high) * 2, False, 0.0, "funding extreme"), (r >= high, True, 0.5, "funding high"), (r <= low, True, 0.5, "funding low")])


def zscore_size(z, capital, vol, max_ratio: float = 0.10) -> Column:
    p = F.greatest(F.lit(0.3), F.least(F.lit(0.8), 0.5 + (F.least(F.abs(col(z)), F.lit(4.0)) - 2) * 0.05))
    o = F.greatest(F.lit(1.5), F.least(F.lit(10.0), 1 / F.greatest(col(vol), F.lit(0.01))))
    return kelly(p, o, capital, max_ratio=max_ratio)


def scaled_position(conf, capital, vol_scalar, threshold: float, win_rate: float = 0.55, avg_win: float = 0.015, avg_loss: float = 0.01, cap: float = 0.1) -> Column:
    """Half-Kelly position scaled by confidence above the threshold and by volatility."""
    k = max(0.0, (win_rate - (1 - win_rate) / (avg_win / abs(avg_loss))) * 0.5)
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (col(conf) - threshold) / (1 - threshold)))
    v = F.greatest(F.lit(0.05), F.least(F.lit(1.0), col(vol_scalar)))
    return F.least(k * c * col(capital) * v, cap * col(capital))
