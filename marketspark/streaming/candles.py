"""Streams: candles by watermark, latest values, idempotent sinks, stateful sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def read_table(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; NTZ times become TIMESTAMP, which watermarks need."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    fixed = {f.name: F.col(f.name).cast("timestamp") for f in reader.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    return reader.withColumns(fixed) if fixed else reader


def candles(trades: DataFrame, width: str = "1 hour", late: str = "10 minutes", tie: str = "trade_id") -> DataFrame:
    """Bars labelled with their end, each once, when the watermark has passed it."""
    at = F.struct("timestamp", tie)
    grouped = trades.withWatermark("timestamp", late).groupBy("symbol", F.window("timestamp", width).alias("w"))
    return grouped.agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("quantity").alias("volume"),
    ).select("symbol", F.col("w.end").alias("timestamp"), "open", "high", "low", "close", "volume")


def latest_values(messages: DataFrame, key: str = "symbol", order: str = "timestamp") -> DataFrame:
    """The last message per key and the running flow; for update mode."""
    rest = [c for c in messages.columns if c != key]
    return messages.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last"), F.count("*").alias("messages")).select(key, "messages", "last.*")


def distinct_events(events: DataFrame, keys: list[str], at: str = "timestamp", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def stale(latest: DataFrame, as_of: Column, seconds: float, at: str = "timestamp") -> DataFrame:
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1_000_000
    return latest.withColumns({"age_seconds": age, "stale": age > seconds})


def order_events(updates: DataFrame) -> DataFrame:
    """Each update as an order row and, where it filled something, a fill row."""
    order = F.struct(F.lit("order").alias("kind"), F.col("status"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("quantity"))
    fill = F.struct(F.lit("fill").alias("kind"), F.col("status"), F.col("price"), F.col("quantity"))
    filled = F.col("status").isin("fill", "partial_fill") & F.col("price").isNotNull() & F.col("quantity").isNotNull()
    return updates.select("symbol", "order_id", "timestamp", F.explode(F.when(filled, F.array(order, fill)).otherwise(F.array(order))).alias("e")).select("symbol", "order_id", "timestamp", "e.*")


def upsert_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").start()


class BarIndicators(StatefulProcessor):
    """Per symbol, Wilder's ATR and an EMA kept as a few numbers: constant work for each new bar."""

    SCHEMA = "symbol string, timestamp timestamp, close double, atr double, ema double, bars long"
    STATE = "bars long, last_close double, total double, atr double, ema double"

    def __init__(self, period: int = 14, span: int = 50):
        self.period, self.alpha = period, 2 / (span + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bars", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n, last, total, atr, ema = self.state.get() if self.state.exists() else (0, None, 0.0, None, None)
        frame = pd.concat(list(rows)).sort_values("timestamp", kind="stable")
        out = []
        for bar in frame.itertuples(index=False):
            n += 1
            tr = bar.high - bar.low if last is None else max(bar.high - bar.low, abs(bar.high - last), abs(bar.low - last))
            total += tr if n <= self.period else 0.0
            atr = None if n < self.period else total / self.period if n == self.period else (atr * (self.period - 1) + tr) / self.period
            ema = bar.close if ema is None else ema + self.alpha * (bar.close - ema)
            last = bar.close
            out.append((key[0], bar.timestamp, bar.close, atr, ema, n))
        self.state.update((n, last, total, atr, ema))
        yield pd.DataFrame(out, columns=["symbol", "timestamp", "close", "atr", "ema", "bars"])

    def close(self) -> None:
        pass


def indicators(bars: DataFrame, period: int = 14, span: int = 50) -> DataFrame:
    """ATR and EMA of a stream of bars, carried in the state store (needs the RocksDB provider)."""
    return bars.groupBy("symbol").transformWithStateInPandas(BarIndicators(period, span), outputStructType=BarIndicators.SCHEMA, outputMode="Append", timeMode="None")


