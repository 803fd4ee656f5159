"""Risk: why an entry is blocked, how large it may be, when trading stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.config import Instrument, PortfolioRisk, RiskLimits, UniverseLimits
from marketspark.functions import price as P
from marketspark.functions.text import first_reason
from marketspark.operators.blocks import running


def block_reason(limits: RiskLimits) -> Column:
    """First reason that holds, of an account's columns; NULL where none does."""
    return first_reason(
        (F.col("kill_switch"), "kill switch active"),
        (F.col("equity") <= 0, "equity is zero"),
        (P.loss_limit_breached("equity", "day_start_equity", limits.max_daily_loss), "daily loss limit"),
        (P.loss_limit_breached("equity", "week_start_equity", limits.max_weekly_loss), "weekly loss limit"),
        (P.drawdown("equity", "peak_equity") >= limits.max_drawdown, "strategy drawdown limit"),
        (F.col("open_positions") >= limits.max_open_positions, "maximum open positions"),
        (F.col("correlated_positions") >= limits.max_correlated_positions, "maximum correlated positions"),
        (F.col("consecutive_losses") >= limits.max_consecutive_losses, "consecutive loss limit"),
        (F.col("cooldown_bars") > 0, "cooldown active"),
    )


def size_position(instrument: Instrument, limits: RiskLimits) -> dict[str, Column]:
    """quantity, risk_budget, effective_risk, reason, approved; of entry, stop, is_buy, cost, equity, buying_power."""
    entry, stop, is_buy = F.col("entry"), F.col("stop"), F.col("is_buy")
    cap = F.least(F.lit(limits.hard_notional_cap), F.col("equity") * limits.target_exposure)
    budget = F.col("equity") * limits.risk_per_trade
    per_unit = F.abs(entry - stop) * instrument.point_value + F.col("cost")
    quantity = P.floor_to(F.least(P.ratio(budget, per_unit), P.ratio("buying_power", entry), P.ratio(cap, entry)), instrument.lot_size)
    effective = quantity * per_unit
    reason = first_reason(
        ((F.col("equity") <= 0) | (F.col("buying_power") <= 0), "non-positive equity or buying power"),
        (is_buy & (stop >= entry), "long stop must be below entry"),
        (~is_buy & (stop <= entry), "short stop must be above entry"),
        ((budget <= 0) | (per_unit <= 0), "invalid risk budget"),
        (quantity < instrument.minimum_quantity, "quantity below instrument minimum"),
        (quantity * entry < instrument.minimum_notional, "notional below instrument minimum"),
        (effective > budget, "rounded risk exceeds budget"),
        otherwise="approved",
    )
    return {"quantity": F.when(reason == "approved", quantity).otherwise(0.0), "risk_budget": budget, "effective_risk": effective, "reason": reason, "approved": reason == "approved"}


def entry_fill(risk: PortfolioRisk) -> dict[str, Column]:
    """price, quantity, leverage, effective_risk, budget of a pending entry; quantity NULL if it is refused.

    Reads open, stop, is_buy, early (an aggressive entry), multiplier, heat (what is
    left), equity, lot_size, minimum_quantity, minimum_notional, maximum_leverage.
    """
    price = F.col("open") * (1 + F.when(F.col("is_buy"), 0.0005).otherwise(-0.0005))
    per_unit = F.abs(price - F.col("stop")) + price * (risk.round_trip_cost_bps / 10_000)
    share = F.when(F.col("early"), risk.early_entry_risk).otherwise(risk.risk_per_trade) * F.when(F.col("is_buy"), 1.0).otherwise(risk.short_multiplier)
    budget = F.least(F.col("equity") * F.least(share, F.lit(risk.hard_risk_cap)) * F.least(F.lit(1.0), F.col("multiplier")), F.col("heat"))
    most = F.least(F.lit(risk.hard_notional_cap), F.col("equity") * risk.max_margin_fraction * risk.leverage_ceiling)
    quantity = P.floor_to(F.least(P.ratio(budget, per_unit), P.ratio(most, price)), "lot_size")
    leverage = P.choose_leverage(quantity * price, "equity", risk.max_margin_fraction, F.least(F.lit(risk.leverage_ceiling), F.col("maximum_leverage").cast("int")))
    ok = (budget > 0) & (per_unit > 0) & leverage.isNotNull() & (quantity >= F.col("minimum_quantity")) & (quantity * price >= F.col("minimum_notional"))
    return {"price": price, "quantity": F.when(ok, quantity), "leverage": leverage, "effective_risk": quantity * per_unit, "budget": budget}


def entry_gate(limits: UniverseLimits) -> Column:
    """First reason against an assessed entry; NULL lets it pass.

    Reads is_buy, the assessment's columns and funding_8h, and of the active policy
    policy_reason (NULL if valid), policy_action and strategy_allowed, and the
    review's action (NULL: none yet).
    """
    is_buy, funding = F.col("is_buy"), F.col("funding_8h")
    least = F.when(is_buy, limits.minimum_p_win).otherwise(limits.minimum_short_p_win)
    return (
        F.when(F.col("policy_action").isNull(), "active_policy_missing")
        .when(F.col("policy_reason").isNotNull(), F.col("policy_reason"))
        .when(F.col("policy_action") != "allow_evaluation", F.concat(F.lit("market_policy_"), F.lower("policy_action")))
        .when(~F.col("strategy_allowed"), "strategy_not_allowed_by_policy")
        .when(F.col("liquidity_score").isNull(), "quantitative_quality_missing")
        .when(F.col("liquidity_score") < limits.minimum_liquidity, "liquidity_score_too_low")
        .when(F.col("manipulation_risk") > limits.maximum_manipulation, "manipulation_risk_too_high")
        .when(funding.isNull(), "funding_unavailable")
        .when(is_buy & (funding > limits.side_check_funding), "long_funding_cost_extreme")
        .when(~is_buy & (funding < -limits.side_check_funding), "short_funding_cost_extreme")
        .when(F.col("p_win") < least, "p_win_below_threshold")
        .when(F.col("expected_value_r") <= limits.minimum_expected_value_r, "expected_value_not_positive")
        .when(F.col("review_action").isNull(), "low_review_queued")
        .when(F.col("review_action") != "allow_evaluation", F.concat(F.lit("low_review_"), F.lower("review_action")))
    )


def admits(kill_switch: Column | str = "kill_switch") -> Column:
    """An order that a kill switch lets through."""
    active = F.col(kill_switch) if isinstance(kill_switch, str) else kill_switch
    return ~active | F.col("protective") | F.col("reduce_only")


def kill_switch(equity: DataFrame, limits: RiskLimits, key: str = "account", order: str = "timestamp", day: str = "day", week: str = "week", seconds: int = 90 * 86_400) -> DataFrame:
    """Adds day and week start, peak, drawdown, the bar's cause, and the latched switch with its first cause.

    Windows hash on the account and a week or a block of ``seconds``.
    """
    out = running(equity, [key], [order], seconds, maxima={"peak_equity": F.col("equity")})
    out = out.withColumns(
        {
            "week_start_equity": F.first("equity").over(Window.partitionBy(key, week).orderBy(order)),
            "day_start_equity": F.first("equity").over(Window.partitionBy(key, week, day).orderBy(order)),
        }
    )
    cause = first_reason(
        (P.loss_limit_breached("equity", "day_start_equity", limits.max_daily_loss), "daily_loss"),
        (P.loss_limit_breached("equity", "week_start_equity", limits.max_weekly_loss), "weekly_loss"),
        (P.drawdown("equity", "peak_equity") >= limits.max_drawdown, "drawdown"),
    )
    out = out.withColumns({"drawdown": P.drawdown("equity", "peak_equity"), "cause": cause})
    out = running(out, [key], [order], seconds, firsts={"latched_cause": F.col("cause")})
    return out.withColumn("latched", F.col("latched_cause").isNotNull())
