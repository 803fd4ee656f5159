"""Triple-barrier labels and the gate of a research dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def triple_barrier(horizon: int, is_buy: Column, stop: Column, target: Column, key: str = "symbol", order: str = "timestamp") -> Column:
    """1 target first, -1 stop first (or both in one bar), 0 neither within the next ``horizon`` bars."""
    if horizon <= 0:
        raise ValueError("the horizon is positive")
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(1, horizon)
    bars = F.collect_list(F.struct("high", "low")).over(ahead)
    outcome = F.transform(
        bars,
        lambda b: F.when(F.when(is_buy, b["low"] <= stop).otherwise(b["high"] >= stop), -1)
        .when(F.when(is_buy, b["high"] >= target).otherwise(b["low"] <= target), 1)
        .otherwise(0),
    )
    return F.coalesce(F.try_element_at(F.filter(outcome, lambda x: x != 0), F.lit(1)), F.lit(0))


def dataset_gate(setups: DataFrame, samples: int = 1000, weeks: float = 20.0, symbols: int = 10) -> DataFrame:
    """One row: setups, symbols, weeks, positives, ready."""
    got = setups.agg(F.count("*").alias("setups"), F.countDistinct("symbol").alias("symbols"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.count_if(F.col("label") == 1).alias("positives"))
    span = F.coalesce((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / (7 * 24 * 3_600_000_000), F.lit(0.0))
    ready = (F.col("setups") >= samples) & (span >= weeks) & (F.col("symbols") >= symbols)
    return got.select("setups", "symbols", span.alias("weeks"), "positives", ready.alias("ready"))
