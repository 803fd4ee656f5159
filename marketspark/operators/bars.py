"""Bars: resampling, deduplication, merging and continuous grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.times import bucket
from marketspark.operators.blocks import running


def resample(df: DataFrame, seconds: int, closed: str = "left", label: str = "right", tie: str | None = None) -> DataFrame:
    """Bars (symbol, timestamp, open, high, low, close, volume) of wider buckets; empty ones don't appear.

    One aggregation with a map-side part: first and last are a minimum and a maximum
    by (timestamp, tie), so input order doesn't matter.
    """
    at = F.struct("timestamp", *([tie] if tie else []))
    return df.groupBy("symbol", bucket("timestamp", seconds, closed, label).alias("bucket")).agg(
        F.min_by("open", at).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", at).alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("bucket", "timestamp")


def candles_from_trades(trades: DataFrame, seconds: int, closed: str = "left", label: str = "right", tie: str = "trade_id") -> DataFrame:
    ticks = trades.select("symbol", "timestamp", tie, *[F.col("price").alias(n) for n in ("open", "high", "low", "close")], F.col("quantity").alias("volume"))
    return resample(ticks, seconds, closed, label, tie)


def keep_last(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The row that arrived last for each key, as an aggregate (no sort of whole groups)."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*arrival)).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def append_keep_last(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both, and the new row where both have a key."""
    return keep_last(old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True), keys, ["_gen"]).drop("_gen")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return keep_last(df, keys, order)


def closed_unseen(df: DataFrame, cutoff, seen: DataFrame | None = None, keys: Sequence[str] = ("symbol", "timestamp")) -> DataFrame:
    """Bars that ended before the cutoff and aren't in ``seen``."""
    out = df.filter(F.col("timestamp") < cutoff)
    return out.join(seen, list(keys), "left_anti") if seen is not None else out


def expected_grid(df: DataFrame, seconds: int) -> DataFrame:
    """(symbol, timestamp) from each symbol's first bar to its last."""
    ends = df.groupBy("symbol").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    step = F.expr(f"INTERVAL {seconds} SECONDS")
    return ends.select("symbol", F.explode(F.sequence("a", "b", step)).alias("timestamp"))


def gaps(df: DataFrame, seconds: int) -> DataFrame:
    """(symbol, timestamp) of the bars that are missing between a symbol's first and last."""
    return expected_grid(df, seconds).join(df.select("symbol", "timestamp"), ["symbol", "timestamp"], "left_anti")


def gap_counts(df: DataFrame, seconds: int) -> DataFrame:
    """Per symbol: bars, expected, missing, longest gap in bars, against the grid from its first bar to its last.

    No grid is built: a bar's place on it is its distance from the first. Bars off
    the grid and repeated ones count as bars, but fill no place.
    """
    first = df.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("timestamp").alias("_a"), F.max("timestamp").alias("_b"))
    micros = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    width = F.lit(seconds * 1_000_000)
    placed = df.select("symbol", "timestamp").join(first.select("symbol", "_a"), "symbol").withColumn("_d", micros("timestamp") - micros("_a"))
    placed = placed.filter(F.pmod("_d", width) == 0).select("symbol", F.floor(F.col("_d") / width).alias("_place")).distinct()
    step = F.col("_place") - F.lag("_place").over(Window.partitionBy("symbol").orderBy("_place"))
    got = placed.withColumn("_step", step).groupBy("symbol").agg(F.count("*").alias("_here"), F.max("_place").alias("_end"), F.coalesce(F.max(F.col("_step") - 1), F.lit(0)).alias("_gap"))
    got = got.join(first, "symbol").withColumn("expected", (F.floor((micros("_b") - micros("_a")) / width) + 1).cast("long"))
    longest = F.greatest(F.col("_gap"), F.col("expected") - 1 - F.col("_end"))
    return got.select("symbol", "bars", "expected", (F.col("expected") - F.col("_here")).cast("long").alias("missing"), longest.cast("long").alias("longest_gap"))


def session_grid(sessions: DataFrame, minutes: int) -> DataFrame:
    """(session, timestamp) of every bar end of every session (market_open, market_close]."""
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    return sessions.select("session", F.explode(F.sequence(F.col("market_open") + step, F.col("market_close"), step)).alias("timestamp"))


def in_session(df: DataFrame, sessions: DataFrame, minutes: int) -> DataFrame:
    """The bars that the sessions expect."""
    return df.join(session_grid(sessions, minutes).select("timestamp"), "timestamp", "left_semi")


def with_session(df: DataFrame, sessions: DataFrame, outside: str = "fail") -> DataFrame:
    """Bars with the session they end in: open < timestamp <= close.

    A bar outside any session is an error, or with ``outside="drop"`` it goes. An
    equality on the dates that a session touches keeps this a hash join.
    """
    if outside not in ("fail", "drop"):
        raise ValueError("outside is 'fail' or 'drop'")
    before = lambda x: F.col(x) - F.expr("INTERVAL 1 MICROSECOND")
    keyed = sessions.withColumn("_day", F.explode(F.sequence(F.to_date("market_open"), F.to_date(before("market_close")))))
    inside = (F.col("timestamp") > F.col("market_open")) & (F.col("timestamp") <= F.col("market_close"))
    bars = df.withColumn("_at", F.to_date(before("timestamp")))
    out = bars.join(keyed, (F.col("_at") == F.col("_day")) & inside, "inner" if outside == "drop" else "left").drop("_at", "_day")
    if outside == "drop":
        return out
    told = F.raise_error(F.concat(F.lit("a bar lies outside all sessions: "), F.col("timestamp").cast("string"))).cast("boolean")
    return out.filter(F.when(F.col("market_open").isNotNull(), True).otherwise(told))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, columns: Sequence[str], seconds: int = 7 * 86_400) -> DataFrame:
    """Left rows with the columns of the last right row at or before them.

    A union and a running last value over blocks of ``seconds``: no range join, and a
    key with most of the rows is spread over its blocks.
    """
    a = left.withColumn("_side", F.lit(1))
    b = right.select(*keys, on, F.struct(*columns).alias("_context"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True)
    held = running(both, list(keys), [on, "_side"], seconds, lasts={"_held": F.col("_context")}).filter("_side = 1")
    return held.select(*left.columns, *[F.col(f"_held.{c}").alias(c) for c in columns])


def stride_sample(df: DataFrame, most: int, order: str, keys: Sequence[str] = (), seconds: int = 7 * 86_400) -> DataFrame:
    """Every k-th row so that at most about ``most`` are left; the last always. Rows are numbered over blocks of ``seconds``."""
    total = df.groupBy(*keys).agg(F.count("*").alias("_n")).select("_n", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbered = running(df, list(keys), [order], seconds, sums={"_i": F.lit(1)})
    out = (numbered.join(total, met) if keys else numbered.join(F.broadcast(total), met)).drop(*[f"_k{i}" for i in range(len(keys))])  # without keys: one row
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / most))
    return out.filter((F.pmod(F.col("_i") - 1, step) == 0) | (F.col("_i") == F.col("_n"))).drop("_i", "_n")


def tail(df: DataFrame, n: int, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """The last n rows, of each key if keys are given, newest first."""
    if not keys:
        return df.orderBy(F.desc(order)).limit(n)
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n).drop("_i")


def timeline(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All symbols side by side: one row per timestamp, a map from symbol to the columns."""
    return df.groupBy("timestamp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("symbol", F.struct(*columns))))).alias("rows"))
