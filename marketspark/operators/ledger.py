"""Analytics of fills and equity by windows and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.blocks import running

#: Rows of a key that are worked out together.
QUARTER = 90 * 86_400


def max_drawdown(equity: DataFrame, keys: Sequence[str] = (), order: str = "timestamp", seconds: int = QUARTER) -> DataFrame:
    """Largest share of a running peak that was lost, per key."""
    lost = F.when(F.col("_peak") > 0, (F.col("_peak") - F.col("equity")) / F.col("_peak"))
    return running(equity, keys, [order], seconds, maxima={"_peak": F.col("equity")}).groupBy(*keys).agg(F.coalesce(F.max(lost), F.lit(0.0)).alias("max_drawdown"))


def pnl_summary(fills: DataFrame, key: str = "symbol") -> DataFrame:
    """Per key: fills, bought and sold quantity, mean prices, fees, slippage, cash flow."""
    buy = F.col("side") == "buy"
    qty, px = F.col("quantity"), F.col("price")
    return fills.groupBy(key).agg(
        F.count("*").alias("fills"),
        F.sum(F.when(buy, qty).otherwise(0.0)).alias("bought"),
        F.sum(F.when(buy, 0.0).otherwise(qty)).alias("sold"),
        F.try_divide(F.sum(F.when(buy, px * qty)), F.sum(F.when(buy, qty))).alias("mean_buy"),
        F.try_divide(F.sum(F.when(~buy, px * qty)), F.sum(F.when(~buy, qty))).alias("mean_sell"),
        F.sum("commission").alias("fees"),
        F.sum("slippage").alias("slippage"),
        F.sum(F.when(buy, -px * qty).otherwise(px * qty) - F.col("commission")).alias("cash_flow"),
    )


def gross_pnl(net: Column, fees: Column, slippage: Column) -> Column:
    return net + fees + slippage


def mark_to_market(positions: DataFrame, marks: DataFrame, keys: Sequence[str] = ("account",)) -> DataFrame:
    """Per account: equity = cash + sum of signed quantity * (close - entry); positions without a mark count 0."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    open_pnl = F.coalesce(sign * F.col("quantity") * (F.col("close") - F.col("entry_price")), F.lit(0.0))
    joined = positions.join(marks.select("symbol", "close"), "symbol", "left")
    return joined.groupBy(*keys).agg(F.sum(open_pnl).alias("unrealized"), F.sum(F.abs("quantity") * F.col("entry_price")).alias("notional"), F.count("*").alias("positions"))


def portfolio_heat(positions: DataFrame, keys: Sequence[str] = ("account",)) -> DataFrame:
    return positions.groupBy(*keys).agg(F.sum("risk_amount").alias("heat"))


def operations(fills: DataFrame, key: str = "symbol", order: Sequence[str] = ("timestamp",), seconds: int = QUARTER) -> DataFrame:
    """Each fill with the position before and after and what it did to it. ``order`` begins with a time."""
    signed = F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity"))
    out = running(fills, [key], order, seconds, sums={"after": signed}).withColumn("before", F.col("after") - signed)
    before, after = F.col("before"), F.col("after")
    what = (
        F.when((before == 0) & (after > 0), "OPEN LONG")
        .when((before == 0) & (after < 0), "OPEN SHORT")
        .when(after == 0, "CLOSE")
        .when(F.signum(before) != F.signum(after), "REVERSE")
        .when(F.abs(after) < F.abs(before), "REDUCE")
        .otherwise("INCREASE")
    )
    return out.withColumn("operation", what)


def change_points(df: DataFrame, columns: Sequence[str], key: str = "symbol", order: str = "timestamp") -> DataFrame:
    """The rows where one of the columns differs from the row before; a key's first row is one."""
    by = Window.partitionBy(key).orderBy(order)
    changed = F.row_number().over(by) == 1
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(by))
    return df.withColumn("_changed", changed).filter("_changed").drop("_changed")


def loss_streaks(trades: DataFrame, key: str = "account", order: Sequence[str] = ("timestamp",), pnl: str = "pnl", seconds: int = QUARTER) -> DataFrame:
    """Adds the number of losses in a row up to each trade. ``order`` begins with a time."""
    out = running(trades, [key], order, seconds, sums={"_losses": F.when(F.col(pnl) < 0, 1).otherwise(0)})
    out = running(out, [key], order, seconds, lasts={"_till_win": F.when(F.col(pnl) >= 0, F.col("_losses"))})
    return out.withColumn("consecutive_losses", F.col("_losses") - F.coalesce("_till_win", F.lit(0))).drop("_losses", "_till_win")


def summary(telemetry: DataFrame, fills: DataFrame) -> DataFrame:
    """A dashboard's totals, one row."""
    a = telemetry.agg(F.count("*").alias("bars"), F.max("timestamp").alias("last_timestamp"), F.max_by("equity", "timestamp").alias("equity"), F.max_by("regime", "timestamp").alias("regime"), F.max_by("close", "timestamp").alias("close"))
    b = fills.agg(F.count("*").alias("fills"), F.coalesce(F.sum("commission"), F.lit(0.0)).alias("fees"), F.coalesce(F.sum("slippage"), F.lit(0.0)).alias("slippage"))
    # one row each
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")
