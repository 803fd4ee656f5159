"""The tradable universe: eligibility, quality, assessment, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.config import UniverseLimits
from marketspark.functions import price as P
from marketspark.functions.text import base_symbol, reasons
from marketspark.functions.times import hours_between


def eligible_contracts(pairs: DataFrame, quote: str = "USDT") -> DataFrame:
    """Open pairs of the quote currency that the API serves; with their base symbol."""
    keep = (F.upper("quote") == quote) & F.upper("symbol").endswith(quote) & F.upper("status").isin("OPEN", "TRADING", "ONLINE")
    api = F.coalesce(F.col("api_supported"), F.lit(True)) if "api_supported" in pairs.columns else F.lit(True)
    return pairs.filter(keep & api).withColumn("base", base_symbol("symbol", quote))


def unique_symbols(catalog: DataFrame, symbol: str = "symbol", id_col: str = "id") -> DataFrame:
    """(symbol, id) of the symbols that only one id has; upper case."""
    got = catalog.groupBy(F.upper(F.col(symbol)).alias("symbol")).agg(F.min(id_col).alias("id"), F.max(id_col).alias("_other"))
    return got.filter(F.col("id") == F.col("_other")).drop("_other")


def unambiguous_join(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pairs whose base the catalog names exactly once."""
    known = unique_symbols(catalog).withColumnRenamed("symbol", "base")
    return pairs.join(known, "base")


def market_quality(bars: DataFrame, volume_rows: int = 288, z_rows: int = 20, range_rows: int = 14, momentum_rows: int = 12) -> DataFrame:
    """Per symbol, from its last bars: close, quote volume, volume z-score, mean range, momentum, whole hours of history.

    The z-score compares the last volume with the up to ``z_rows`` before it and is 0
    where these don't vary; momentum is 0 where there is no bar ``momentum_rows``
    before the last, or no range. Rows are numbered from the end once; everything
    else is one aggregation.
    """
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("timestamp")))
    n = bars.withColumn("_i", back)
    upto = lambda k, x, first=1: F.when(F.col("_i").between(first, k), x)
    got = n.groupBy("symbol").agg(
        F.count("*").alias("bars"),
        F.sum(upto(volume_rows, F.col("close") * F.col("volume"))).alias("quote_volume"),
        F.max(upto(1, F.col("volume"))).alias("_last_volume"),
        F.avg(upto(z_rows + 1, F.col("volume"), 2)).alias("_mean"),
        F.stddev_pop(upto(z_rows + 1, F.col("volume"), 2)).alias("_sd"),
        F.avg(upto(range_rows, F.col("high") - F.col("low"))).alias("mean_range"),
        F.max(upto(1, F.col("close"))).alias("close"),
        F.max(F.when(F.col("_i") == momentum_rows + 1, F.col("close"))).alias("_before"),
        F.min("timestamp").alias("_first"),
        F.max("timestamp").alias("last_timestamp"),
    )
    z = F.when(F.col("_sd") > 0, (F.col("_last_volume") - F.col("_mean")) / F.col("_sd")).otherwise(0.0)
    momentum = F.when(F.col("mean_range") > 0, (F.col("close") - F.coalesce("_before", "close")) / F.col("mean_range")).otherwise(0.0)
    return got.select(
        "symbol",
        "bars",
        "quote_volume",
        "close",
        "mean_range",
        z.alias("volume_zscore"),
        momentum.alias("momentum_atr"),
        F.floor(hours_between("last_timestamp", "_first")).cast("long").alias("history_hours"),
        "last_timestamp",
    )


#: The spread of a state that tells none.
NO_SPREAD = 999_999.0


def snapshot_quality(states: DataFrame, bars: DataFrame, as_of: Column, **windows) -> DataFrame:
    """A quality row for every symbol that both a stream's snapshot and the bars have.

    Reads of ``states`` symbol, generated_at, mark_price, spread_bps,
    depth_half_percent, funding_rate, funding_interval_hours and, if it is there,
    quote_volume_24h, which counts before the bars' own volume. What a state doesn't
    tell: the mark is the close, the spread is too wide for anything, the depth is 0,
    the funding NULL.
    """
    q = market_quality(bars, **windows).join(states, "symbol")
    told = lambda name: F.when(F.col(name) != 0, F.col(name))  # noqa: E731  0 counts as not told
    volume = F.coalesce(told("quote_volume_24h"), "quote_volume") if "quote_volume_24h" in states.columns else F.col("quote_volume")
    age = F.greatest(F.lit(0.0), hours_between(as_of, "generated_at") * 3600)
    return q.select(
        "symbol",
        volume.alias("quote_volume"),
        F.coalesce(told("spread_bps"), F.lit(NO_SPREAD)).alias("spread_bps"),
        F.coalesce("depth_half_percent", F.lit(0.0)).alias("depth"),
        P.mark_divergence(F.coalesce(told("mark_price"), "close"), "close").alias("mark_divergence"),
        P.funding_per_8h(P.finite("funding_rate"), P.finite("funding_interval_hours")).alias("funding_8h"),
        "history_hours",
        "momentum_atr",
        "volume_zscore",
        age.alias("age_seconds"),
    )


def quality_risk(limits: UniverseLimits) -> Column:
    """Mean of four capped shares of their limits, rounded to 6 digits."""
    parts = [
        P.capped_ratio("spread_bps", limits.maximum_spread_bps),
        P.capped_ratio(F.abs("funding_8h"), limits.side_check_funding),
        P.capped_ratio(F.abs("mark_divergence"), limits.maximum_mark_divergence),
        P.capped_ratio("age_seconds", limits.stale_stream_seconds),
    ]
    return F.round((parts[0] + parts[1] + parts[2] + parts[3]) / 4, 6)


def assess(limits: UniverseLimits, reward: float = 1.75, cost_bps: float = 20.0, notional_cap: float = 40.0) -> dict[str, Column]:
    """liquidity_score, manipulation_risk, p_win, expected_value_r, max_safe_notional."""
    spread = P.capped_ratio("spread_bps", limits.maximum_spread_bps)
    depth = P.capped_ratio("depth", notional_cap * limits.depth_multiple)
    funding = P.capped_ratio(F.abs("funding_8h"), limits.side_check_funding)
    divergence = P.capped_ratio(F.abs("mark_divergence"), limits.maximum_mark_divergence)
    liquidity = P.clamp01(0.5 * (1 - spread) + 0.5 * depth)
    stretch = F.greatest(F.lit(0.0), F.abs("momentum_atr") - 3)
    manipulation = P.clamp01(0.25 * spread + 0.30 * funding + 0.30 * divergence + 0.05 * stretch)
    surge = F.least(F.lit(0.1), F.greatest(F.lit(0.0), F.col("volume_zscore")) / 50)
    p = P.clamp01(0.5 + surge + 0.05 * liquidity - 0.10 * manipulation)
    return {
        "liquidity_score": liquidity,
        "manipulation_risk": manipulation,
        "p_win": p,
        "expected_value_r": p * reward - (1 - p) - cost_bps / 10_000,
        "max_safe_notional": F.greatest(F.lit(0.0), F.least(F.lit(notional_cap), F.col("depth") / limits.depth_multiple)),
    }


def rank_candidates(contracts: DataFrame, qualities: DataFrame, limits: UniverseLimits, requested: float) -> DataFrame:
    """Contracts with status, reasons, risk multiplier and, if eligible, rank.

    A contract without a quality is blocked for missing data. The rank goes by
    momentum, volume, spread and depth; it numbers the eligible ones only.
    """
    joined = contracts.join(qualities, "symbol", "left")
    missing = F.col("quote_volume").isNull()
    hard = reasons(
        (F.col("history_hours") < limits.minimum_listing_hours, "listing_too_new"),
        (F.col("quote_volume") < limits.minimum_quote_volume, "insufficient_volume"),
        (F.col("spread_bps") > limits.maximum_spread_bps, "spread_too_wide"),
        (F.col("depth") < requested * limits.depth_multiple, "insufficient_depth"),
        (F.abs("mark_divergence") > limits.maximum_mark_divergence, "mark_divergence"),
        (F.col("funding_8h").isNull(), "funding_unavailable"),
        (F.col("age_seconds") > limits.stale_stream_seconds, "stale_stream"),
    )
    soft = reasons(
        (F.col("spread_bps") > limits.preferred_spread_bps, "spread_above_preferred"),
        (F.abs("funding_8h") > limits.side_check_funding, "extreme_funding_requires_side_check"),
        ((F.abs("funding_8h") > limits.elevated_funding) & (F.abs("funding_8h") <= limits.side_check_funding), "funding_elevated"),
    )
    out = joined.withColumns({"_hard": F.when(missing, F.array(F.lit("missing_data"))).otherwise(hard), "_soft": F.when(missing, F.array().cast("array<string>")).otherwise(soft)})
    status = F.when(F.size("_hard") > 0, "blocked").when(F.size("_soft") > 0, "eligible_reduced").otherwise("eligible")
    out = out.withColumns({"status": status, "reasons": F.concat("_hard", "_soft")})
    out = out.withColumns({"risk_multiplier": F.when(F.col("status") == "blocked", 0.0).when(F.col("status") == "eligible_reduced", limits.reduced_multiplier).otherwise(1.0), "eligible": F.col("status") != "blocked"})
    order = Window.partitionBy("eligible").orderBy(F.desc_nulls_last(F.abs("momentum_atr")), F.desc_nulls_last("volume_zscore"), F.asc_nulls_last("spread_bps"), F.desc_nulls_last("depth"), "symbol")
    return out.withColumn("rank", F.when(F.col("eligible"), F.row_number().over(order))).drop("_hard", "_soft")


def trade_flow(trades: DataFrame) -> DataFrame:
    """Per symbol: bought and sold volume and the number of trades; what isn't a buy is a sale."""
    buy = F.lower("side") == "buy"
    return trades.groupBy("symbol").agg(
        F.sum(F.when(buy, F.col("quantity")).otherwise(0)).alias("buy_volume"),
        F.sum(F.when(buy, 0).otherwise(F.col("quantity"))).alias("sell_volume"),
        F.count("*").alias("trade_count"),
    )
