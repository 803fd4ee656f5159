"""Price, cost and risk arithmetic as column expressions (no UDFs).

Missing values are NULL throughout. A zero denominator gives NULL, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | str | float | int


def c(x: Num) -> Column:
    """A column by name, a column as it is, or a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def finite(x: Num) -> Column:
    """NULL for NaN and infinities."""
    v = c(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def ratio(a: Num, b: Num) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(c(a), c(b))


def typical_price(high="high", low="low", close="close") -> Column:
    return (c(high) + c(low) + c(close)) / 3


def true_range(previous_close: Num, high="high", low="low") -> Column:
    """Largest of the bar's range and its reach from the last close; the range alone on a first bar."""
    last = c(previous_close)
    return F.greatest(c(high) - c(low), F.abs(c(high) - last), F.abs(c(low) - last))


def directional_moves(previous_high: Num, previous_low: Num, high="high", low="low") -> tuple[Column, Column]:
    """(+DM, -DM); NULL on a first bar."""
    up, down = c(high) - c(previous_high), c(previous_low) - c(low)
    plus = F.when(up.isNull() | down.isNull(), None).when((up > down) & (up > 0), up).otherwise(0.0)
    minus = F.when(up.isNull() | down.isNull(), None).when((down > up) & (down > 0), down).otherwise(0.0)
    return plus, minus


def in_atr(distance: Num, atr="atr") -> Column:
    return ratio(distance, atr)


def pct_change(now: Num, before: Num) -> Column:
    return ratio(now, before) - 1


def round_trip_cost(price: Num, spread_bps: Num, slippage_bps: Num, commission: Num) -> Column:
    return c(price) * (c(spread_bps) + 2 * c(slippage_bps)) / 10_000 + 2 * c(commission)


def slipped(price: Num, bps: Num, sign: Num) -> Column:
    return c(price) * (1 + c(sign) * c(bps) / 10_000)


def funding_payment(notional: Num, rate: Num, is_long: Column) -> Column:
    return F.when(is_long, -c(notional) * c(rate)).otherwise(c(notional) * c(rate))


def funding_per_8h(rate: Num, interval_hours: Num) -> Column:
    return F.when(c(interval_hours) > 0, c(rate) * 8 / c(interval_hours))


def spread_bps(bid: Num, ask: Num) -> Column:
    """NULL for a crossed or empty book."""
    valid = (c(bid) > 0) & (c(ask) >= c(bid))
    return F.when(valid, ratio(c(ask) - c(bid), (c(ask) + c(bid)) / 2) * 10_000)


def mark_divergence(mark: Num, close: Num) -> Column:
    return ratio(c(mark) - c(close), close)


def exact(x: Num) -> Column:
    """As DECIMAL(20,8); NULL for what doesn't fit."""
    return c(x).try_cast("decimal(20,8)")


def floor_to(quantity: Num, step: Num) -> Column:
    """Whole steps below, counted in decimals; 0 for what isn't positive."""
    steps = F.floor(exact(quantity) / exact(step)).cast("decimal(20,0)")
    return F.when(c(quantity) <= 0, F.lit(0.0)).otherwise((steps * exact(step)).cast("double"))


def round_to_tick(price: Num, tick: Num, is_buy: Column, order_type: Num) -> Column:
    """Against the trader for market and stop orders, in favour of the limit for limit orders."""
    up = is_buy != (c(order_type) == F.lit("limit"))
    ticks = exact(price) / exact(tick)
    whole = F.when(up, F.ceil(ticks)).otherwise(F.floor(ticks)).cast("decimal(20,0)")
    return (whole * exact(tick)).cast("double")


def clamp01(x: Num) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c(x)))


def capped_ratio(value: Num, most: Num) -> Column:
    """value / most, at most 1; a missing value counts as 1."""
    return F.coalesce(F.least(F.lit(1.0), c(value) / c(most)), F.lit(1.0))


def bands(center: Num, atr: Num, k: float) -> tuple[Column, Column]:
    return c(center) - k * c(atr), c(center) + k * c(atr)


def initial_stop(entry: Num, atr: Num, k: Num, is_buy: Column) -> Column:
    stop = F.when(is_buy, c(entry) - c(k) * c(atr)).otherwise(c(entry) + c(k) * c(atr))
    return F.when(stop > 0, stop).when(stop.isNull(), None).otherwise(F.raise_error("a stop must be positive").cast("double"))


def tightened_stop(old: Num, new: Num, is_buy: Column) -> Column:
    return F.when(is_buy, F.greatest(c(old), c(new))).otherwise(F.least(c(old), c(new)))


def fixed_levels(entry: Num, stop_fraction: Num, target_fraction: Num, is_buy: Column) -> tuple[Column, Column]:
    sign = F.when(is_buy, 1.0).otherwise(-1.0)
    return c(entry) * (1 - sign * c(stop_fraction)), c(entry) * (1 + sign * c(target_fraction))


def liquidation_is_safe(leverage: Num, mark: Num, stop: Num, broker: Num, estimate: Num, buffer: Num = 0.0) -> Column:
    """Without leverage, or: both liquidation prices known, within 5 % of each other, and 3 stop distances away."""
    agree = F.abs(c(broker) - c(estimate)) <= 0.05 * c(broker)
    far = F.abs(c(mark) - c(broker)) - c(buffer) >= 3 * F.abs(c(mark) - c(stop))
    known = (F.least(c(broker), c(estimate), c(mark)) > 0) & c(broker).isNotNull() & c(estimate).isNotNull()
    return (c(leverage) <= 1) | F.coalesce(known & agree & far, F.lit(False))


def choose_leverage(notional: Num, equity: Num, fraction: Num, ceiling: Num) -> Column:
    """The smallest of 1, 2, 3, 5 up to the ceiling whose margin fits the fraction of equity; else NULL."""
    known = c(ceiling).isin(1, 2, 3, 5) & (c(notional) > 0) & (c(equity) > 0)
    fits = F.filter(F.array(*[F.lit(x) for x in (1, 2, 3, 5)]), lambda lev: (lev <= c(ceiling)) & (c(notional) / lev <= c(equity) * c(fraction)))
    return F.when(known, F.try_element_at(fits, F.lit(1)))


def barrier_hit(low: Num, high: Num, stop: Num, target: Num) -> Column:
    """Of a long position; the stop counts first where both are in the bar."""
    return F.when(c(low) <= c(stop), "stop").when(c(high) >= c(target), "target")


def liquidation_gate(leverage: Num, buffer: Num, stop_fraction: Num) -> Column:
    return 1 / c(leverage) - c(buffer) >= 3 * c(stop_fraction)


def loss_limit_breached(equity: Num, reference: Num, most: Num) -> Column:
    return (c(reference) <= 0) | (c(equity) <= c(reference) * (1 - c(most)))


def drawdown(equity: Num, peak: Num) -> Column:
    """Share of the peak that is lost; 1 for a peak that isn't positive."""
    return F.when(c(peak) <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), (c(peak) - c(equity)) / c(peak)))


def weighted_mean(value: Num, weight: Num) -> Column:
    """An aggregate: sum(value * weight) / sum(weight)."""
    return F.try_divide(F.sum(c(value) * c(weight)), F.sum(c(weight)))
