"""The momentum strategy's features: five-minute bars with an hourly context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.config import MomentumConfig
from marketspark.functions import price as P
from marketspark.functions.scan import smooth
from marketspark.operators import indicators as I
from marketspark.operators.bars import asof, keep_last, resample

CONTEXT = ("ema_fast_1h", "ema_slow_1h", "ema_slope_1h", "adx_1h")


def hourly_context(bars: DataFrame, config: MomentumConfig, seconds: int = 3600) -> DataFrame:
    """(symbol, timestamp, ema_fast_1h, ema_slow_1h, ema_slope_1h, adx_1h) at each hour's end."""
    hours = resample(bars, seconds, "left", "right")
    means = {"ema_fast_1h": ("close", config.fast_ema, 1), "ema_slow_1h": ("close", config.slow_ema, 1)}
    hours = I.with_adx(hours, config.adx_period, ("adx_1h", "_p", "_m"), means)
    hours = hours.withColumn("ema_slope_1h", I.lagged_change("ema_fast_1h", 3))
    return hours.select("symbol", "timestamp", *CONTEXT)


def momentum_features(bars: DataFrame, config: MomentumConfig, arrival: str | None = None, context_seconds: int = 3600) -> DataFrame:
    """Features of every bar; of bars with one timestamp the last by ``arrival`` counts."""
    out = keep_last(bars, ["symbol", "timestamp"], [arrival]) if arrival else bars
    base = out
    out = smooth(I.with_true_range(out, "_tr"), I.KEY, I.ORDER, {"ema_fast_5m": ("close", config.fast_ema, 1)}, {"atr": ("_tr", config.atr_period)}).drop("_tr")
    high, low = I.breakout(config.breakout_bars)
    center = I.rolling_vwap(config.vwap_window)
    out = out.withColumns(
        {
            "breakout_high": high,
            "breakout_low": low,
            "volume_zscore": I.volume_zscore(config.volume_window),
            "range_atr": P.in_atr(F.col("high") - F.col("low")),
            "three_bar_atr": P.in_atr(F.abs(I.lagged_change("close", 3)) * F.col("close")),
            "momentum_atr": P.in_atr(F.col("close") - F.lag("close", 12).over(I.by())),
            "adaptive_center": center,
            "previous_close": F.lag("close").over(I.by()),
        }
    )
    out = out.withColumn("adaptive_z", P.in_atr(F.col("close") - F.col("adaptive_center")))
    return asof(out, hourly_context(base, config, context_seconds), I.KEY, I.ORDER, CONTEXT)


def scanner(bars: DataFrame, vwap_window: int = 96, least_bars: int = 96) -> DataFrame:
    """Per symbol, at its last bar: adx, z, favourable, score (higher is better; NULL if there are too few bars)."""
    out = I.with_adx(bars, atr=("atr", 14))
    out = out.withColumn("z", P.in_atr(F.col("close") - I.rolling_vwap(vwap_window)))
    out = out.withColumns(
        {
            "range_atr": P.in_atr(F.col("high") - F.col("low")),
            "move_atr": P.in_atr(F.abs(F.col("close") - F.lag("close", 3).over(I.by()))),
            "quote_volume": F.col("close") * F.col("volume"),
        }
    )
    fields = ["close", "atr", "adx", "z", "range_atr", "move_atr"]
    last = out.groupBy("symbol").agg(F.count("*").alias("bars"), F.max_by(F.struct(*fields), "timestamp").alias("r"), F.sum("quote_volume").alias("quote_volume"))
    last = last.select("symbol", "bars", "quote_volume", *[F.col(f"r.{n}").alias(n) for n in fields])
    known = (F.col("bars") >= least_bars) & F.col("adx").isNotNull() & F.col("z").isNotNull()
    good = (F.col("adx") < 20) & (F.col("range_atr") <= 2.5) & (F.col("move_atr") <= 4)
    score = 10 * F.abs("z") + F.greatest(F.lit(0.0), 20 - F.col("adx"))
    return last.withColumns({"favourable": F.coalesce(known & good, F.lit(False)), "score": F.when(known, score)})


def scan_rank(scanned: DataFrame, top: int) -> DataFrame:
    """Adds rank (favourable first, then score, then volume) and whether it is among the ``top``."""
    order = Window.orderBy(F.desc("favourable"), F.desc_nulls_last("score"), F.desc("quote_volume"), "symbol")
    return scanned.withColumn("rank", F.row_number().over(order)).withColumn("selected", F.col("rank") <= top)


def top_liquid(catalog: DataFrame, k: int) -> DataFrame:
    return catalog.orderBy(F.desc("quote_volume"), "symbol").limit(k)
