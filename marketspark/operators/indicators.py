"""Indicators over bars, all by windows on (symbol, timestamp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.config import RangeConfig
from marketspark.functions import price as P
from marketspark.functions.scan import smooth, wilder

KEY, ORDER = ["symbol"], "timestamp"


def by():
    """Made when it is used: a window needs a session, and executors import this module too."""
    return Window.partitionBy(*KEY).orderBy(ORDER)


def rows(n: int, end: int = 0):
    return by().rowsBetween(end - n + 1, end)


def full(value: Column, column: str, n: int, end: int = 0) -> Column:
    """NULL unless the frame holds n values."""
    return F.when(F.count(column).over(rows(n, end)) == n, value)


def with_true_range(df: DataFrame, name: str = "tr") -> DataFrame:
    return df.withColumn(name, P.true_range(F.lag("close").over(by())))


def with_atr(df: DataFrame, period: int = 14, name: str = "atr") -> DataFrame:
    return wilder(with_true_range(df, "_tr"), KEY, ORDER, {name: "_tr"}, period).drop("_tr")


def with_adx(df: DataFrame, period: int = 14, names: tuple[str, str, str] = ("adx", "plus_di", "minus_di"), emas: dict | None = None, atr: tuple[str, int] | None = None) -> DataFrame:
    """Wilder's averages of the range and the two moves share their windows; the one of DX follows.

    ``emas`` (as for ``smooth``) and ``atr``, (name, period), ride along in the same windows.
    """
    adx, plus_di, minus_di = names
    plus, minus = P.directional_moves(F.lag("high").over(by()), F.lag("low").over(by()))
    out = df.withColumns({"_tr": P.true_range(F.lag("close").over(by())), "_plus": plus, "_minus": minus})
    wanted = {"_s_tr": ("_tr", period), "_s_plus": ("_plus", period), "_s_minus": ("_minus", period)}
    if atr is not None and atr[1] != period:
        wanted[atr[0]] = ("_tr", atr[1])
    out = smooth(out, KEY, ORDER, emas, wanted)
    if atr is not None and atr[1] == period:
        out = out.withColumn(atr[0], F.col("_s_tr"))
    out = out.withColumns({plus_di: P.ratio(100 * F.col("_s_plus"), "_s_tr"), minus_di: P.ratio(100 * F.col("_s_minus"), "_s_tr")})
    dx = P.ratio(100 * F.abs(F.col(plus_di) - F.col(minus_di)), F.col(plus_di) + F.col(minus_di))
    out = wilder(out.withColumn("_dx", dx), KEY, ORDER, {adx: "_dx"}, period)
    return out.drop("_tr", "_plus", "_minus", "_s_tr", "_s_plus", "_s_minus", "_dx")


def session_vwap(session: str = "session") -> Column:
    w = Window.partitionBy(*KEY, session).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return F.try_divide(F.sum(P.typical_price() * F.col("volume")).over(w), F.sum("volume").over(w))


def rolling_vwap(n: int) -> Column:
    if n < 2:
        raise ValueError("a window is at least 2")
    value = F.try_divide(F.sum(P.typical_price() * F.col("volume")).over(rows(n)), F.sum("volume").over(rows(n)))
    return full(value, "volume", n)


def rolling_percentile(column: str, n: int = 100) -> Column:
    """Percent of the last n values that are at most the present one."""
    held = F.collect_list(column).over(rows(n))
    value = F.size(F.filter(held, lambda v: v <= F.col(column))) * 100 / F.lit(n)
    return full(value, column, n)


def breakout(n: int = 20) -> tuple[Column, Column]:
    """(highest high, lowest low) of the n bars before."""
    return full(F.max("high").over(rows(n, -1)), "high", n, -1), full(F.min("low").over(rows(n, -1)), "low", n, -1)


def volume_zscore(n: int = 20) -> Column:
    mean, sd = F.avg("volume").over(rows(n, -1)), F.stddev_pop("volume").over(rows(n, -1))
    return full(F.try_divide(F.col("volume") - mean, F.when(sd != 0, sd)), "volume", n, -1)


def lagged_change(column: str, k: int) -> Column:
    return P.pct_change(column, F.lag(column, k).over(by()))


def ema_slope(lookback: int = 5, mean: str = "_ema", atr: str = "atr") -> Column:
    return P.ratio(F.col(mean) - F.lag(mean, lookback).over(by()), F.col(atr) * lookback)


def with_ema_slope(df: DataFrame, period: int = 50, lookback: int = 5, atr: str = "atr", name: str = "ema_slope") -> DataFrame:
    return smooth(df, KEY, ORDER, {"_ema": ("close", period, period)}).withColumn(name, ema_slope(lookback, "_ema", atr)).drop("_ema")


def range_features(df: DataFrame, config: RangeConfig, session: str | None = "session") -> DataFrame:
    """atr, adx, center, z, atr_percentile, atr_change, ema_slope, cumulative_move.

    All windows hash on the symbol: one shuffle for the whole table.
    The center is the session's VWAP, or the rolling one where ``session`` is None.
    """
    out = with_adx(df, config.adx_period, emas={"_ema": ("close", config.ema_period, config.ema_period)}, atr=("atr", config.atr_period))
    out = out.withColumn("center", session_vwap(session) if session else rolling_vwap(config.vwap_window))
    return out.withColumns(
        {
            "z": P.in_atr(F.col("close") - F.col("center")),
            "atr_percentile": rolling_percentile("atr", config.percentile_window),
            "atr_change": P.finite(lagged_change("atr", 1)),
            "cumulative_move": P.in_atr(F.col("close") - F.lag("close", 3).over(by())),
            "ema_slope": ema_slope(config.slope_lookback),
        }
    ).drop("_ema")


RANGE_FEATURES = ("atr", "adx", "center", "z", "atr_percentile", "ema_slope")


def warmed_up(df: DataFrame, columns=RANGE_FEATURES) -> DataFrame:
    return df.dropna(subset=list(columns))
