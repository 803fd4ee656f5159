"""Sinks: tables, reports, idempotent appends, keyed state."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bars(df: DataFrame, path: str, days: str = "timestamp") -> None:
    """Bars in folders by symbol and day, so that both prune."""
    out = df.withColumn("date", F.to_date(days)).repartition("symbol", "date").sortWithinPartitions("symbol", "timestamp")
    out.write.mode("overwrite").partitionBy("symbol", "date").parquet(path)


def _file_context(spark: SparkSession, path: str):
    """(Hadoop's file context of the path's store, the path)."""
    hadoop, settings = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    at = hadoop.Path(path)
    at = at.makeQualified(at.getFileSystem(settings).getUri(), at.getFileSystem(settings).getWorkingDirectory())
    return hadoop.FileContext.getFileContext(at.toUri(), settings), at


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that appears whole or not at all, in any store that Spark reaches."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    context, target = _file_context(spark, path)
    draft = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    gateway = spark.sparkContext._gateway
    flags = spark._jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE, hadoop.CreateFlag.OVERWRITE)
    options = gateway.new_array(getattr(hadoop, "Options$CreateOpts"), 1)
    options[0] = getattr(hadoop, "Options$CreateOpts").createParent()
    out = context.create(draft, flags, options)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    rename = gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    rename[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context.rename(draft, target, rename)


def write_report(report: DataFrame, path: str | Path) -> None:
    """A report of one row as a JSON file that appears whole or not at all, in any store that Spark reaches."""
    rows = report.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a report is one row")
    write_text(report.sparkSession, str(path), json.dumps(json.loads(rows[0])))


def append_stream(df: DataFrame, path: str, checkpoint: str, form: str = "json") -> StreamingQuery:
    return df.writeStream.format(form).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def insert_new(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends the rows whose key the table doesn't have; returns how many. Rerunning adds none.

    Of rows that share a key, the least stays, compared in order of the columns.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(*rest)).alias("_row") if rest else F.count("*").alias("_row")
    new = df.groupBy(*keys).agg(least).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
    before = 0
    if exists(spark, path):
        table = spark.read.schema(df.schema).parquet(path)
        before = table.count()
        new = new.join(table.select(*keys), keys, "left_anti").select(df.columns)
    new.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path).count() - before


def known(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``known``: does the table hold the key."""
    held = table.select(key).distinct().withColumn("known", F.lit(True))
    return rows.join(held, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def upsert_state(old: DataFrame | None, new: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """One row per key, of the highest version."""
    both = new if old is None else old.unionByName(new)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("s")).select(key, "s.*")
