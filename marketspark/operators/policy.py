"""Trading policies: validity, promotion, review queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.text import first_reason, host_allowed, is_subset
from marketspark.functions.times import hours_between


def policy_reason(as_of: Column, domains: Sequence[str], strategies: Sequence[str], ceiling: int = 3) -> Column:
    """First reason a policy isn't valid; NULL for a valid one.

    Reads issued_at, expires_at, action, confidence, systemic_risk, leverage,
    strategies (array) and sources (array<struct<url, published_at>>).
    """
    pauses = F.col("action") == "pause_new_entries"
    known = F.array(*[F.lit(s) for s in strategies])
    stale = F.exists("sources", lambda s: (hours_between(F.col("issued_at"), s["published_at"]) > 24) | (hours_between(s["published_at"], as_of) * 60 > 5))
    strange = F.exists("sources", lambda s: ~host_allowed(s["url"], domains))
    return first_reason(
        (hours_between("issued_at", as_of) * 60 > 5, "policy_from_future"),
        (F.col("expires_at") <= as_of, "policy_expired"),
        (hours_between("expires_at", "issued_at") > 6, "policy_lifetime_exceeds_limit"),
        (~pauses & (F.col("confidence") < 0.60), "regime_confidence_too_low"),
        (~pauses & (F.col("systemic_risk") > 0.75), "systemic_risk_too_high"),
        (F.col("leverage") > ceiling, "leverage_exceeds_ceiling"),
        (((F.size("strategies") == 0) & ~pauses) | ~is_subset("strategies", known), "invalid_strategy_allowlist"),
        (F.size("sources") == 0, "missing_sources"),
        (stale, "stale_or_future_source"),
        (strange, "unapproved_source"),
    )


def active_policy(history: DataFrame, key: str = "scope") -> DataFrame:
    """The policy promoted last, per scope."""
    rest = [c for c in history.columns if c != key]
    return history.groupBy(key).agg(F.max_by(F.struct(*rest), "promoted_at").alias("p")).select(key, "p.*")


def pending_reviews(setups: DataFrame, reviews: DataFrame, key: str = "request_id") -> DataFrame:
    """Setups that no review answers, each once."""
    return setups.dropDuplicates([key]).join(reviews.select(key), key, "left_anti")


def new_actionable(current: DataFrame, previous: DataFrame, key: str = "symbol") -> DataFrame:
    return current.select(key).distinct().join(previous.select(key), key, "left_anti")


def per_day(policies: DataFrame) -> DataFrame:
    return policies.groupBy(F.to_date("issued_at").alias("day")).agg(F.count("*").alias("policies"))


def may_refresh(new_symbols: Column, minutes_since: Column, today: Column, cooldown_minutes: float = 15, daily_cap: int = 12) -> Column:
    """A policy is asked for: there is something new, the cooldown is over and the day's cap not reached."""
    return (new_symbols > 0) & F.coalesce(minutes_since >= cooldown_minutes, F.lit(True)) & (today < daily_cap)
