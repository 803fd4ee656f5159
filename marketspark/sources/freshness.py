"""Is what a cache or a history file holds still good enough to use?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.times import hours_between


def cache_state(age_hours: float | None, fresh_hours: float = 24, fail_hours: float = 72) -> str:
    """"fresh": use it; "stale": refresh, or use it if that fails; "closed": don't use it."""
    if age_hours is None or age_hours > fail_hours:
        return "closed"
    return "fresh" if age_hours <= fresh_hours else "stale"


def current_histories(bars: DataFrame, as_of: Column, least_bars: int = 2016, most_hours: float = 24) -> DataFrame:
    """Per symbol: bars, age in hours, and whether the history is long and recent enough."""
    got = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.max("timestamp").alias("last"))
    age = hours_between(as_of, "last")
    return got.select("symbol", "bars", age.alias("age_hours"), ((F.col("bars") >= least_bars) & (age <= most_hours)).alias("current"))
