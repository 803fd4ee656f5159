"""A Python data source for histories that come in pages, newest first.

``spark.read.format("paged_history")`` reads a function's pages by a backward
cursor: each page ends before the oldest bar of the page after it. One partition
per symbol and span of time; a page that doesn't get older ends its partition.
``fetch`` names ``module:function(symbol, start_ms, end_ms, limit) -> list of dicts``,
so tests read files and a deployment a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "symbol string, time_ms bigint, open double, high double, low double, close double, volume double"


def resolve(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


def backward(fetch: Callable, symbol: str, start: int, end: int, limit: int) -> Iterator[tuple]:
    """Bars of [start, end), each time once, until a page brings nothing older."""
    seen, cursor = set(), end - 1
    while cursor >= start:
        page = [r for r in fetch(symbol, start, cursor, limit) if start <= int(r["time"]) < end]
        fresh = [r for r in page if int(r["time"]) not in seen]
        if not fresh:
            return
        for r in fresh:
            seen.add(int(r["time"]))
            yield symbol, int(r["time"]), float(r["open"]), float(r["high"]), float(r["low"]), float(r["close"]), float(r.get("baseVol", r.get("volume", 0)))
        cursor = min(int(r["time"]) for r in fresh) - 1


class Span(InputPartition):
    def __init__(self, symbol: str, start: int, end: int):
        self.symbol, self.start, self.end = symbol, start, end


class PagedHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PollReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.symbols = options["fetch"], options["symbols"].split(",")
        self.start, self.end = int(options["start"]), int(options["end"])
        self.limit, self.chunk = int(options.get("limit", 200)), int(options.get("chunk", 7 * 86_400_000))

    def partitions(self) -> list[Span]:
        return [Span(s, a, min(a + self.chunk, self.end)) for s in self.symbols for a in range(self.start, self.end, self.chunk)]

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from backward(resolve(self.fetch), partition.symbol, partition.start, partition.end, self.limit)


class PollReader(SimpleDataSourceStreamReader):
    """Polls for what is new, of every symbol for itself.

    A symbol's offset is the time behind its last bar read, so bars that come late
    to the source are read by a later poll. Without ``end`` a poll reads up to the
    present. A span of ``step`` without a bar is passed only if a later one has some.
    """

    def __init__(self, options):
        self.ends = int(options["end"]) if "end" in options else None
        self.inner = PagedReader({**options, "end": "0"})
        self.step = int(options.get("step", 300_000 * 200))

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.inner.symbols, self.inner.start)

    def bars(self, symbol: str, start: int, end: int) -> list[tuple]:
        return sorted(backward(resolve(self.inner.fetch), symbol, start, end, self.inner.limit))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        most = self.ends if self.ends is not None else int(time.time() * 1000)
        rows, end = [], dict(start)
        for symbol in self.inner.symbols:
            at, span = start[symbol], self.step
            while at < most:
                found = self.bars(symbol, at, min(at + span, most))
                if found:
                    rows += (some := [r for r in found if r[1] < found[0][1] + self.step])
                    end[symbol] = some[-1][1] + 1
                    break
                at, span = at + span, 2 * span  # a long gap takes few requests
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for symbol in self.inner.symbols:
            yield from self.bars(symbol, start[symbol], end[symbol])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedHistory)
