"""Market regimes: rules on features, and confirmation without a state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.config import MomentumConfig, RangeConfig
from marketspark.operators.blocks import over_blocks, running
from marketspark.operators.indicators import by


def raw_regime(config: RangeConfig, spread: Column | str = "spread_bps", missing_ratio: Column | str | None = None) -> Column:
    """First rule that holds: unknown features or data, shock, range, trends, else unknown."""
    needed = ["adx", "atr_percentile", "ema_slope", "atr_change", "cumulative_move"]
    spread = F.col(spread) if isinstance(spread, str) else spread
    missing = F.lit(0.0) if missing_ratio is None else (F.col(missing_ratio) if isinstance(missing_ratio, str) else missing_ratio)
    unknown = spread.isNull() | missing.isNull()
    for n in needed:
        unknown = unknown | F.col(n).isNull()
    shock = (F.col("atr_percentile") > 90) | (F.col("atr_change") > config.atr_change_threshold) | (F.abs("cumulative_move") > config.cumulative_move_atr)
    strong = F.col("adx") > 25
    up = strong & (F.col("ema_slope") >= config.slope_threshold) & (F.col("cumulative_move") >= 0)
    down = strong & (F.col("ema_slope") <= -config.slope_threshold) & (F.col("cumulative_move") <= 0)
    return (
        F.when(unknown | (missing > 0) | (spread > config.max_spread_bps), "unknown")
        .when(shock, "shock")
        .when(F.col("adx") < 20, "range")
        .when(up, "trend_up")
        .when(down, "trend_down")
        .otherwise("unknown")
    )


def confirmed(df: DataFrame, candidate: str, bars: int = 3, name: str = "regime", seconds: int = 7 * 86_400) -> DataFrame:
    """Adds the regime that has held for ``bars`` bars, shock at once; and what is pending, for how long.

    The last candidate that was a shock, or that ended a run of at least ``bars``
    equal ones, is the regime: how long a run is matters up to ``bars`` only, and the
    rest is a running last value. Both are split by blocks of ``seconds``.
    """
    alike, length = F.lit(True), F.lit(1)
    for k in range(1, bars):
        alike = alike & F.coalesce(F.lag(candidate, k).over(by()) == F.col(candidate), F.lit(False))
        length = length + alike.cast("int")
    out = over_blocks(df, lambda c: c.withColumn("_length", length), seconds, bars - 1) if bars > 1 else df.withColumn("_length", length)
    sure = F.when((F.col(candidate) == "shock") | (F.col("_length") >= bars), F.col(candidate))
    out = running(out, ["symbol"], ["timestamp"], seconds, lasts={name: sure})
    out = out.withColumn(name, F.coalesce(name, F.lit("unknown")))
    waits = F.col(candidate) != F.col(name)
    return out.withColumns({f"pending_{name}": F.when(waits, F.col(candidate)), "pending_count": F.when(waits, F.col("_length")).otherwise(0)}).drop("_length")


#: Features the momentum strategy can't do without.
MOMENTUM_FEATURES = (
    "atr",
    "breakout_high",
    "breakout_low",
    "volume_zscore",
    "range_atr",
    "three_bar_atr",
    "momentum_atr",
    "adaptive_center",
    "adaptive_z",
    "ema_fast_1h",
    "ema_slow_1h",
    "ema_slope_1h",
    "adx_1h",
    "ema_fast_5m",
    "previous_close",
)


def any_missing(columns=MOMENTUM_FEATURES) -> Column:
    out = F.lit(False)
    for n in columns:
        out = out | F.col(n).isNull()
    return out


def is_shock(config: MomentumConfig) -> Column:
    return (F.col("range_atr") > config.shock_candle_atr) | (F.col("three_bar_atr") > config.shock_three_bar_atr)


def momentum_regime(config: MomentumConfig) -> Column:
    fast, slow, slope, momentum = (F.col(n) for n in ("ema_fast_1h", "ema_slow_1h", "ema_slope_1h", "momentum_atr"))
    return (
        F.when(any_missing(), "unknown")
        .when(is_shock(config) & (momentum < 0), "panic_crash")
        .when(is_shock(config), "euphoric_pump")
        .when(F.col("adx_1h") < config.minimum_adx, "sideways")
        .when((fast > slow) & (slope > 0) & (momentum >= config.aggressive_momentum_atr), "euphoric_pump")
        .when((fast > slow) & (slope > 0), "bullish_expansion")
        .when((fast < slow) & (slope < 0), "bearish_expansion")
        .otherwise("distribution")
    )


#: Momentum regimes as market regimes.
COARSE = {"euphoric_pump": "trend_up", "bullish_expansion": "trend_up", "distribution": "trend_down", "bearish_expansion": "trend_down", "sideways": "range", "panic_crash": "shock"}


def coarse_regime(regime: Column | str) -> Column:
    r = F.col(regime) if isinstance(regime, str) else regime
    table = F.create_map(*[F.lit(x) for pair in COARSE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, r), F.lit("unknown"))
