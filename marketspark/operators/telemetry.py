"""What a bar's row tells a reader: bands, activity, change of state, allowed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.config import RangeConfig
from marketspark.functions import price as P


#: The sentences that a reader is told.
SENTENCES = {
    "kill_switch": "Kill switch active — new entries blocked",
    "cooldown": "Cooldown active — %d bars remaining",
    "regime": "No entry — market regime is ",
    "near": "No entry — |z| %.2f is below %.2f",
    "other": "No order — position, session or direction constraints are not satisfied",
}


def waiting_reason(config: RangeConfig) -> Column:
    """Why a bar without a signal has none; reads kill_switch, cooldown_bars, regime and z."""
    return (
        F.when(F.col("kill_switch"), SENTENCES["kill_switch"])
        .when(F.col("cooldown_bars") > 0, F.format_string(SENTENCES["cooldown"], F.col("cooldown_bars").cast("int")))
        .when(F.col("regime") != "range", F.concat(F.lit(SENTENCES["regime"]), F.replace("regime", F.lit("_"), F.lit(" "))))
        .when(F.abs("z") < config.entry_z, F.format_string(SENTENCES["near"], F.abs("z"), F.lit(config.entry_z)))
        .otherwise(SENTENCES["other"])
    )


def telemetry(df: DataFrame, config: RangeConfig) -> DataFrame:
    """The points of a chart: close, center, bands, finite indicators, regime."""
    low, high = P.bands("center", "atr", config.band_atr)
    numbers = ("atr", "adx", "z", "atr_percentile", "ema_slope")
    return df.select("symbol", "timestamp", "close", "center", low.alias("lower_band"), high.alias("upper_band"), *[P.finite(n).alias(n) for n in numbers], "regime")


def allowed_keys(snapshot: Column | str, keys: Sequence[str]) -> Column:
    """A map with the allowed keys only."""
    m = F.col(snapshot) if isinstance(snapshot, str) else snapshot
    return F.map_filter(m, lambda k, v: k.isin(list(keys)))


def instrument_of(contracts: DataFrame, ceiling: float) -> DataFrame:
    """Contracts with the leverage that is used: the smaller of theirs and the ceiling."""
    return contracts.withColumn("max_leverage", F.least(F.lit(ceiling), F.col("maximum_leverage")))
