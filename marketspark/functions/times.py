"""Buckets, labels and parsing of times (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketspark.functions.price import Num, c


def _micros(ts: Num) -> Column:
    return F.unix_micros(c(ts).cast("timestamp"))


def bucket(ts: Num, seconds: int, closed: str = "left", label: str = "left") -> Column:
    """The edge of the bucket a time is in.

    ``closed="left"``: [b, b + w); ``"right"``: (b, b + w]. ``label`` picks the edge.
    """
    if closed not in ("left", "right") or label not in ("left", "right"):
        raise ValueError("closed and label are 'left' or 'right'")
    width = seconds * 1_000_000
    at = _micros(ts) - (1 if closed == "right" else 0)
    start = at - F.pmod(at, F.lit(width))
    return F.timestamp_micros(start + (width if label == "right" else 0))


def from_epoch(x: Num) -> Column:
    """Epoch seconds or milliseconds, told apart by size (below 1e10: seconds)."""
    v = c(x).try_cast("bigint")
    return F.timestamp_millis(F.when(v < 10_000_000_000, v * 1000).otherwise(v))


def parse_utc(text: Num) -> Column:
    """An ISO time with an offset or ``Z``; NULL for one without."""
    t = c(text)
    return F.when(t.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(t))


def iso_week(ts: Num) -> Column:
    return F.struct(F.extract(F.lit("YEAROFWEEK"), c(ts)).alias("year"), F.extract(F.lit("WEEK"), c(ts)).alias("week"))


def local_date(ts: Num, zone: str = "America/New_York") -> Column:
    return F.to_date(F.from_utc_timestamp(c(ts), zone))


def day_start(ts: Num) -> Column:
    return F.date_trunc("DAY", c(ts))


def hours_between(later: Num, earlier: Num) -> Column:
    return (_micros(later) - _micros(earlier)) / 3_600_000_000


def in_entry_window(ts: Num, opens: Num, closes: Num, after_open_min: int = 15, before_close_min: int = 15) -> Column:
    after = F.expr(f"INTERVAL {after_open_min} MINUTES")
    before = F.expr(f"INTERVAL {before_close_min} MINUTES")
    return (c(ts) >= c(opens) + after) & (c(ts) < c(closes) - before)
