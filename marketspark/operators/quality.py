"""Validation of bars: repair, one-pass reports, row invariants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def repair_ohlc(df: DataFrame, mode: str = "flag", most_bps: float = 1.0) -> DataFrame:
    """Widens high and low to hold open and close, with ``ohlc_adjusted``.

    A bar that needs more than ``most_bps`` of its close: an error in mode "fail",
    gone in mode "drop", ``ohlc_rejected`` in mode "flag". So are bars with a price
    that isn't positive or a volume below 0.
    """
    high, low = F.greatest("high", "open", "close"), F.least("low", "open", "close")
    off = F.greatest(high - F.col("high"), F.col("low") - low)
    bad = (F.least(*PRICES) <= 0) | (F.col("volume") < 0) | (off > F.col("close") * (most_bps / 10_000))
    out = df.withColumns({"_bad": F.coalesce(bad, F.lit(True)), "ohlc_adjusted": F.coalesce(off > 0, F.lit(False)), "_high": high, "_low": low})
    out = out.withColumns({"high": F.col("_high"), "low": F.col("_low")}).drop("_high", "_low")
    if mode == "drop":
        return out.filter(~F.col("_bad")).drop("_bad")
    if mode == "fail":
        checked = F.when(F.col("_bad"), F.raise_error("a bar's prices contradict each other").cast("boolean")).otherwise(F.col("ohlc_adjusted"))
        return out.withColumn("ohlc_adjusted", checked).drop("_bad")
    if mode != "flag":
        raise ValueError("mode is 'flag', 'drop' or 'fail'")
    return out.withColumnRenamed("_bad", "ohlc_rejected")


#: The report's errors, in the order they are told.
ERRORS = (
    "timestamps without a time zone",
    "invalid timestamps",
    "duplicate timestamps",
    "timestamps out of order",
    "null or non-numeric OHLCV",
    "non-positive price",
    "negative volume",
    "high below low",
    "open or close outside range",
    "unexplained price jump",
    "missing candles",
)
REQUIRED = ("timestamp", "open", "high", "low", "close", "volume")
REPORT = "symbol string, rows long, missing long, errors array<string>, warnings array<string>, score double, passed boolean"


def report(df: DataFrame, seconds: int, arrival: str = "ordinal", most_jump: float = 0.20, grid: DataFrame | None = None, split_adjusted: bool = True, rules: Sequence[str] = ERRORS) -> DataFrame:
    """Per symbol: rows, missing, errors (array), warnings (array), score = max(0, 1 - (errors + missing) / (rows + missing)), passed.

    Each error counts once, and of ``ERRORS`` only those named in ``rules`` do. ``arrival``
    numbers the rows as they came; jumps beyond ``most_jump`` are excused by
    ``corporate_action``, and what follows a close of 0 is a jump. A ``timestamp`` of text is
    parsed, and one without an offset is an error. Missing are the bars of a grid of
    ``seconds`` from a symbol's first bar to its last that it doesn't have; bars off
    that grid don't count as any of them. With ``grid`` (``session_grid``'s) it is
    the grid's bars in that span instead, and data that aren't ``split_adjusted`` get a
    warning. Without rows, or without one of the columns, the report is one row
    that says so, for no symbol.
    """
    if unknown := set(rules) - set(ERRORS):
        raise ValueError(f"no such rules: {', '.join(sorted(unknown))}")
    lacking = [c for c in REQUIRED if c not in df.columns]
    if lacking:
        return _refused(df, f"missing columns: {', '.join(lacking)}")
    zoneless = F.lit(False)
    if df.schema["timestamp"].dataType.typeName() == "string":
        zoneless = F.coalesce(~F.col("timestamp").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.lit(False))
        df = df.withColumn("_zoneless", zoneless).withColumn("timestamp", F.try_to_timestamp("timestamp"))
        zoneless = F.col("_zoneless")
    by_arrival = Window.partitionBy("symbol").orderBy(arrival)
    by_time = Window.partitionBy("symbol").orderBy("timestamp", arrival)
    action = F.coalesce(F.col("corporate_action").cast("boolean"), F.lit(False)) if "corporate_action" in df.columns else F.lit(False)
    o, h, lo, c, v = (F.col(x).try_cast("double") for x in (*PRICES, "volume"))
    null = F.coalesce(o + h + lo + c + v, F.lit(float("nan")))
    before, close = F.lag("timestamp").over(by_time), F.lag(c).over(by_arrival)
    jump = F.when(close == 0, c.isNotNull()).otherwise(F.abs(F.try_divide(c, close) - 1) > most_jump)
    at, first = F.unix_micros(F.col("timestamp").cast("timestamp")), F.unix_micros(F.min("timestamp").over(Window.partitionBy("symbol")).cast("timestamp"))
    flags = df.withColumns(
        {
            "_unordered": F.col("timestamp") < F.lag("timestamp").over(by_arrival),
            "_again": F.col("timestamp") == before,
            "_on_grid": F.pmod(at - first, F.lit(seconds * 1_000_000)) == 0,
            "_jump": jump & ~action,
            "_null": F.isnan(null),
            "_zone": zoneless,
        }
    )
    holds = lambda x: F.max(F.coalesce(x, F.lit(False)))
    span = (F.unix_micros(F.max("timestamp").cast("timestamp")) - F.unix_micros(F.min("timestamp").cast("timestamp"))) / (seconds * 1_000_000)
    got = flags.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        holds(F.col("_zone")).alias("e0"),
        F.max(F.col("timestamp").isNull()).alias("e1"),
        holds(F.col("_again")).alias("e2"),
        holds(F.col("_unordered")).alias("e3"),
        F.max("_null").alias("e4"),
        holds(F.least(o, h, lo, c) <= 0).alias("e5"),
        holds(v < 0).alias("e6"),
        holds(h < lo).alias("e7"),
        holds((F.least(o, c) < lo) | (F.greatest(o, c) > h)).alias("e8"),
        holds(F.col("_jump")).alias("e9"),
        F.coalesce(F.floor(span) + 1 - F.count_if(F.col("_on_grid") & ~F.coalesce("_again", F.lit(False))), F.lit(0)).cast("long").alias("missing"),
        F.min("timestamp").alias("_first"),
        F.max("timestamp").alias("_last"),
    )
    if grid is not None:
        expected = grid.select(F.col("timestamp").alias("_at"))
        absent = got.select("symbol", "_first", "_last").join(F.broadcast(expected), F.col("_at").between(F.col("_first"), F.col("_last")))  # a calendar's bars
        absent = absent.select("symbol", F.col("_at").alias("timestamp")).join(df.select("symbol", "timestamp"), ["symbol", "timestamp"], "left_anti")
        got = got.drop("missing").join(absent.groupBy("symbol").agg(F.count("*").alias("missing")), "symbol", "left").fillna(0, ["missing"])
    got = got.withColumn("e10", F.col("missing") > 0)
    errors = F.array_compact(F.array(*[F.when(F.col(f"e{i}"), F.lit(name)) for i, name in enumerate(ERRORS) if name in rules]).cast("array<string>"))
    warnings = F.array(*([F.lit("split adjustment is not told")] if grid is not None and not split_adjusted else [])).cast("array<string>")
    got = got.withColumns({"errors": errors, "warnings": warnings})
    score = F.greatest(F.lit(0.0), 1 - (F.size("errors") + F.col("missing")) / F.greatest(F.lit(1), F.col("rows") + F.col("missing")))
    got = got.select("symbol", "rows", "missing", "errors", "warnings", score.alias("score"), (F.size("errors") == 0).alias("passed"))
    empty = df.agg(F.count("*").alias("n")).filter("n = 0")
    return got.unionByName(_refused(empty, "no rows", whole=False))


def _refused(df: DataFrame, why: str, whole: bool = True) -> DataFrame:
    """The report of data that can't be looked at: one row, or (not ``whole``) one for each row of ``df``."""
    rows = df.sparkSession.range(1) if whole else df
    none = F.array().cast("array<string>")
    return rows.select(F.lit(None).cast("string").alias("symbol"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("missing"), F.array(F.lit(why)).alias("errors"), none.alias("warnings"), F.lit(0.0).alias("score"), F.lit(False).alias("passed"))


def invariants(df: DataFrame, mode: str = "flag") -> DataFrame:
    """Adds ``violations``: the names of the row's broken rules, for the columns that are there.

    A time that is text must name UTC. Mode "drop": rows that break a rule go; "error":
    the first of them is an error that names its rules.
    """
    if mode not in ("flag", "drop", "error"):
        raise ValueError("mode is 'flag', 'drop' or 'error'")
    has = set(df.columns)
    rules = [
        ({"received_timestamp", "timestamp"}, lambda: F.col("received_timestamp") < F.col("timestamp"), "received before exchange"),
        ({"low", "open", "close"}, lambda: F.col("low") > F.least("open", "close"), "low above body"),
        ({"high", "open", "close"}, lambda: F.col("high") < F.greatest("open", "close"), "high below body"),
        ({"bid", "ask"}, lambda: F.col("ask") < F.col("bid"), "crossed quote"),
        ({"filled_quantity", "quantity"}, lambda: F.col("filled_quantity") > F.col("quantity"), "overfilled"),
        ({"quantity"}, lambda: F.col("quantity") <= 0, "non-positive quantity"),
        ({"order_type", "limit_price"}, lambda: (F.col("order_type") == "limit") & F.col("limit_price").isNull(), "limit without price"),
        ({"order_type", "stop_price"}, lambda: (F.col("order_type") == "stop") & F.col("stop_price").isNull(), "stop without price"),
    ]
    parts = [F.when(make(), F.lit(name)) for need, make, name in rules if need <= has]
    for name in ("timestamp", "received_timestamp"):
        if name in has and df.schema[name].dataType.typeName() == "string":
            parts.append(F.when(~F.col(name).rlike(r"(Z|[+-]00:?00)$"), F.lit(f"{name} is not UTC")))
    out = df.withColumn("violations", F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>"))
    if mode == "drop":
        return out.filter(F.size("violations") == 0)
    if mode == "error":
        told = F.raise_error(F.concat(F.lit("a row breaks its rules: "), F.array_join("violations", ", "))).cast("array<string>")
        return out.withColumn("violations", F.when(F.size("violations") == 0, F.col("violations")).otherwise(told))
    return out


def parts_all(df: DataFrame, flags: str = "ok") -> DataFrame:
    """Health roll-up: are all checks fine."""
    return df.agg(F.bool_and(flags).alias("healthy"), F.count_if(~F.col(flags)).alias("failing"))
