"""SQL over a Parquet table: any Spark SQL on a view named ``candles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def query(spark: SparkSession, path: str, sql: str, view: str = "candles", **tables: str) -> DataFrame:
    """The result of ``sql``; ``tables`` are further views by path. Views live in a session of their own."""
    own = spark.newSession()
    for name, where in {view: path, **tables}.items():
        own.read.parquet(where).createOrReplaceTempView(name)
    return own.sql(sql)


def query_frame(df: DataFrame, sql: str, view: str = "candles") -> DataFrame:
    """The same over a DataFrame, named in the SQL as ``{candles}``."""
    return df.sparkSession.sql(sql, **{view: df})
