"""Market tables derived from the driver's tables, the same in Spark and in SQL (see ``SQL``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketspark.operators.bars import candles_from_trades


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("trade_id"),
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("long").alias("quantity"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
    )


def candles(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    bars = candles_from_trades(trades(spark, sf_dir), seconds)
    return bars.withColumn("volume", F.col("volume").cast("double"))


def with_session(bars: DataFrame) -> DataFrame:
    """Sessions are UTC dates, (midnight, midnight]."""
    return bars.withColumn("session", F.to_date(F.col("timestamp") - F.expr("INTERVAL 1 MICROSECOND")))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_tax").alias("commission"),
        F.col("l_discount").alias("slippage"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        "l_orderkey",
        "l_linenumber",
    )


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order status (the account), one point a day: 1e7 and the running sum of signed order values."""
    o = table(spark, sf_dir, "orders")
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    days = o.groupBy(F.col("o_orderstatus").alias("account"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.round(signed * 100).cast("long")).alias("_d"))
    by = Window.partitionBy("account").orderBy("day")
    value = F.lit(10_000_000.0) + F.sum("_d").over(by) / 100
    return days.select("account", "day", F.col("day").cast("timestamp").alias("timestamp"), value.alias("equity"), F.date_trunc("week", "day").alias("week"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_name").alias("symbol"), F.col("s_nationkey").alias("nation"))


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(
        F.col("s_name").alias("symbol"),
        (F.abs("s_acctbal") * 2000).alias("quote_volume"),
        (k % 23).cast("double").alias("spread_bps"),
        (k % 13 * 400).cast("double").alias("depth"),
        (k % 7 * 0.0008).alias("mark_divergence"),
        F.when(k % 17 != 0, k % 7 * 0.0003).alias("funding_8h"),
        (k * 7 + 100).cast("double").alias("history_hours"),
        (k % 6).cast("double").alias("age_seconds"),
        (k % 9 - 4).cast("double").alias("momentum_atr"),
        (k % 5 - 1).cast("double").alias("volume_zscore"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accounts with an entry they want to make."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("account"),
        (F.col("c_acctbal") * 10).alias("equity"),
        (F.col("c_acctbal") * 8).alias("buying_power"),
        (50 + k % 100).cast("double").alias("entry"),
        (50 + k % 100 - (k % 7 - 1) * 0.5).alias("stop"),
        (k % 3 != 0).alias("is_buy"),
        F.lit(0.125).alias("cost"),
        (k % 50 == 0).alias("kill_switch"),
        (F.col("c_acctbal") * 10 + k % 400).alias("day_start_equity"),
        (F.col("c_acctbal") * 10 + k % 900).alias("week_start_equity"),
        (F.col("c_acctbal") * 10 + k % 700).alias("peak_equity"),
        (k % 11 == 0).cast("int").alias("open_positions"),
        (k % 13 == 0).cast("int").alias("correlated_positions"),
        (k % 5).alias("consecutive_losses"),
        (k % 4).alias("cooldown_bars"),
    )


#: The same as SQL, as the beginning of a WITH clause.
SQL = {
    "trades": """trades AS (SELECT event_id AS trade_id, event_type AS symbol, ts AS timestamp, value AS price,
  CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS quantity, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side FROM events)""",
    "candles": """candles AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, timestamp) + INTERVAL 1 HOUR AS timestamp, arg_min(price, row(timestamp, trade_id)) AS open,
  max(price) AS high, min(price) AS low, arg_max(price, row(timestamp, trade_id)) AS close, CAST(sum(quantity) AS DOUBLE) AS volume FROM trades GROUP BY 1, 2)""",
    "bars": """bars AS (SELECT *, CAST(timestamp - INTERVAL 1 MICROSECOND AS DATE) AS session, row_number() OVER w AS rn,
  greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
  CASE WHEN lag(high) OVER w IS NULL THEN NULL WHEN high - lag(high) OVER w > lag(low) OVER w - low AND high > lag(high) OVER w THEN high - lag(high) OVER w ELSE 0 END AS pdm,
  CASE WHEN lag(high) OVER w IS NULL THEN NULL WHEN lag(low) OVER w - low > high - lag(high) OVER w AND lag(low) OVER w > low THEN lag(low) OVER w - low ELSE 0 END AS mdm
  FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))""",
    "fills": """fills AS (SELECT l_suppkey AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity, l_extendedprice / l_quantity AS price,
  l_tax AS commission, l_discount AS slippage, l_shipdate AS timestamp, l_orderkey, l_linenumber FROM lineitem)""",
    "equity": """days AS (SELECT o_orderstatus AS account, CAST(o_orderdate AS DATE) AS day,
  CAST(sum(CAST(round(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END * 100) AS BIGINT)) AS BIGINT) AS d FROM orders GROUP BY 1, 2),
equity AS (SELECT account, day, CAST(day AS TIMESTAMP) AS timestamp, 10000000.0 + CAST(sum(d) OVER (PARTITION BY account ORDER BY day) AS BIGINT) / 100 AS equity, date_trunc('week', day) AS week FROM days)""",
    "qualities": """qualities AS (SELECT s_name AS symbol, abs(s_acctbal) * 2000 AS quote_volume, CAST(s_suppkey % 23 AS DOUBLE) AS spread_bps, CAST(s_suppkey % 13 * 400 AS DOUBLE) AS depth,
  CAST(s_suppkey % 7 AS DOUBLE) * 0.0008::DOUBLE AS mark_divergence, CASE WHEN s_suppkey % 17 <> 0 THEN CAST(s_suppkey % 7 AS DOUBLE) * 0.0003::DOUBLE END AS funding_8h,
  CAST(s_suppkey * 7 + 100 AS DOUBLE) AS history_hours, CAST(s_suppkey % 6 AS DOUBLE) AS age_seconds, CAST(s_suppkey % 9 - 4 AS DOUBLE) AS momentum_atr,
  CAST(s_suppkey % 5 - 1 AS DOUBLE) AS volume_zscore FROM supplier)""",
    "accounts": """accounts AS (SELECT c_custkey AS account, c_acctbal * 10 AS equity, c_acctbal * 8 AS buying_power, CAST(50 + c_custkey % 100 AS DOUBLE) AS entry,
  50 + c_custkey % 100 - (c_custkey % 7 - 1) * 0.5::DOUBLE AS stop, c_custkey % 3 <> 0 AS is_buy, 0.125::DOUBLE AS cost, c_custkey % 50 = 0 AS kill_switch,
  c_acctbal * 10 + c_custkey % 400 AS day_start_equity, c_acctbal * 10 + c_custkey % 900 AS week_start_equity, c_acctbal * 10 + c_custkey % 700 AS peak_equity,
  CAST(c_custkey % 11 = 0 AS INT) AS open_positions, CAST(c_custkey % 13 = 0 AS INT) AS correlated_positions, c_custkey % 5 AS consecutive_losses, c_custkey % 4 AS cooldown_bars FROM customer)""",
}


def wilder_sql(name: str, source: str, x: str, period: int) -> str:
    """CTEs that end in ``name`` (symbol, rn, y), Wilder's average by recursion."""
    return f"""{name}_c AS MATERIALIZED (SELECT symbol, rn, {x} AS x, count({x}) OVER w AS c, avg({x}) OVER w AS m FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
{name}_s AS (SELECT symbol, min(rn) AS rn0 FROM {name}_c WHERE c = {period} GROUP BY symbol),
{name} AS (SELECT c.symbol, c.rn, c.m AS y FROM {name}_c c JOIN {name}_s s ON c.symbol = s.symbol AND c.rn = s.rn0
  UNION ALL SELECT r.symbol, c.rn, (r.y * {period - 1} + c.x) / {period} FROM {name} r JOIN {name}_c c ON c.symbol = r.symbol AND c.rn = r.rn + 1)"""


def ema_sql(name: str, source: str, x: str, span: int) -> str:
    a = 2 / (span + 1)
    return f"""{name} AS (SELECT symbol, rn, {x} AS y FROM {source} WHERE rn = 1
  UNION ALL SELECT r.symbol, c.rn, r.y * {1 - a!r}::DOUBLE + c.{x} * {a!r}::DOUBLE FROM {name} r JOIN {source} c ON c.symbol = r.symbol AND c.rn = r.rn + 1)"""
