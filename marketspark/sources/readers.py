"""Readers. Every one names its schema, so nothing is inferred by a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark import schema as S
from marketspark.functions.text import json_field, json_number
from marketspark.functions.times import bucket, from_epoch, parse_utc
from marketspark.operators.bars import keep_last
from marketspark.operators.quality import repair_ohlc


def parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value, _arrival) of every line. Lines come in order of file name, and within a file of their place."""
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return spark.read.text(path).select("value", at.alias("_arrival"))


def candle_lines(spark: SparkSession, path: str, symbol: str, most_bps: float = 1.0, mode: str = "flag") -> DataFrame:
    """Collected candles of one symbol, the last line of a time wins, prices repaired.

    Lines that aren't JSON, or whose numbers aren't, are left out.
    """
    raw = lines_of(spark, path)
    row = F.from_json("value", S.CANDLE_LINE, {"mode": "PERMISSIVE"})
    lines = raw.select("_arrival", row.alias("r")).select("_arrival", F.col("r.spread_bps").alias("spread_bps"), "r.candle.*")
    numbers = {n: F.col(n).try_cast("double") for n in ("open", "high", "low", "close")}
    bars = lines.select(
        F.lit(symbol).alias("symbol"),
        from_epoch("time").alias("timestamp"),
        *[v.alias(n) for n, v in numbers.items()],
        F.col("baseVol").try_cast("double").alias("volume"),
        "spread_bps",
        "_arrival",
    ).dropna(subset=["timestamp", "open", "high", "low", "close", "volume"])
    return repair_ohlc(keep_last(bars, ["symbol", "timestamp"], ["_arrival"]).drop("_arrival"), mode, most_bps)


def message_log(spark: SparkSession, path: str, as_of: Column | None = None, channel: str = "market_kline_5min", seconds: int = 300) -> DataFrame:
    """Bars of a recorded message log: each bucket's last update, without the bucket still open at ``as_of``."""
    raw = lines_of(spark, path)
    m = "message"
    text = json_field("value", [m])
    data = F.get_json_object(text, "$.data")
    at = bucket(from_epoch(F.coalesce(json_field(data, ["t"]), json_field(text, ["ts"]))), seconds)
    bars = raw.filter(json_field(text, ["ch"]) == channel).select(
        F.upper(json_field(text, ["symbol"])).alias("symbol"),
        at.alias("timestamp"),
        *[json_field(data, [n[0]]).try_cast("double").alias(n) for n in ("open", "high", "low", "close")],
        F.coalesce(json_field(data, ["v", "b"]).try_cast("double"), F.lit(0.0)).alias("volume"),
        "_arrival",
    )
    bars = bars.dropna(subset=["symbol", "timestamp", "open", "high", "low", "close"])
    if as_of is not None:
        bars = bars.filter(F.col("timestamp") < bucket(as_of, seconds))
    return keep_last(bars, ["symbol", "timestamp"], ["_arrival"]).drop("_arrival")


def history(spark: SparkSession, path: str) -> DataFrame:
    """Bars from per-symbol JSON arrays; the symbol is the file's name."""
    rows = spark.read.option("multiLine", True).schema("time string, timestamp string, open string, high string, low string, close string, baseVol string, volume string").json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return rows.select(
        F.upper(name).alias("symbol"),
        F.coalesce(from_epoch("time"), parse_utc("timestamp")).alias("timestamp"),
        *[F.col(n).try_cast("double").alias(n) for n in ("open", "high", "low", "close")],
        F.coalesce(F.col("baseVol").try_cast("double"), F.col("volume").try_cast("double")).alias("volume"),
    ).dropna()


def merged_history(spark: SparkSession, log: str, files: str, as_of: Column | None = None) -> DataFrame:
    """Both, and the live log where both have a bar."""
    live = message_log(spark, log, as_of).withColumn("_gen", F.lit(1))
    return keep_last(history(spark, files).withColumn("_gen", F.lit(0)).unionByName(live), ["symbol", "timestamp"], ["_gen"]).drop("_gen")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Contracts of a cached catalog, by any of the names a field goes by."""
    raw = spark.read.option("wholetext", True).text(path)
    entries = F.from_json(F.coalesce(F.get_json_object("value", "$.data"), F.col("value")), "array<map<string,string>>")
    rows = raw.select(F.explode(entries).alias("e")).select(F.to_json("e").alias("j"))
    return rows.select(
        F.upper(json_field("j", ["symbol", "symbolName"])).alias("symbol"),
        F.upper(json_field("j", ["base", "baseCoin"])).alias("base"),
        F.upper(json_field("j", ["quote", "quoteCoin"])).alias("quote"),
        F.upper(json_field("j", ["status", "symbolStatus"])).alias("status"),
        json_number("j", ["tickSize", "priceStep"], 0.0).alias("tick_size"),
        json_number("j", ["lotSize", "minTradeVolume"], 1.0).alias("lot_size"),
        json_number("j", ["minTradeVolume", "minQty"], 0.0).alias("minimum_quantity"),
        json_number("j", ["minNotional"], 0.0).alias("minimum_notional"),
        json_number("j", ["maxLeverage"], 1.0).alias("maximum_leverage"),
        F.coalesce(json_field("j", ["apiSupport", "isApiSupported"]).try_cast("boolean"), F.lit(True)).alias("api_supported"),
    )


def stream_states(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot file's map from symbol to state, as rows with numbers."""
    raw = spark.read.option("wholetext", True).text(path)
    states = F.from_json(F.coalesce(F.get_json_object("value", "$.symbols"), F.col("value")), f"map<string,{S.STREAM_STATE}>")
    made = parse_utc(json_field("value", ["generated_at"])).alias("generated_at")
    rows = raw.select(F.explode(states).alias("symbol", "s"), made).select("symbol", "generated_at", "s.*")
    numbers = ["best_bid", "best_ask", "spread_bps", "depth_half_percent", "mark_price", "index_price", "funding_rate", "funding_interval_hours", "buy_volume", "sell_volume"]
    return rows.withColumns({n: F.col(n).try_cast("double") for n in numbers}).withColumn("updated_at", parse_utc("updated_at"))


def live_quote(spark: SparkSession, path: str, as_of: Column, most_age_seconds: float = 90.0) -> DataFrame:
    """The quote of a side file if it is whole, uncrossed and fresh; else no row."""
    raw = spark.read.option("wholetext", True).text(path)
    q = raw.select(json_number("value", ["bid"]).alias("bid"), json_number("value", ["ask"]).alias("ask"), parse_utc(json_field("value", ["timestamp"])).alias("timestamp"))
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros("timestamp")) / 1_000_000
    return q.filter((F.col("bid") > 0) & (F.col("ask") >= F.col("bid")) & (age >= 0) & (age <= most_age_seconds))


def unseen(new: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(table.select(*keys).distinct(), keys, "left_anti")
