import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.functions.scan import smooth
from marketspark.operators import indicators as I
from marketspark.operators import labels
from marketspark.operators.blocks import memory, over_blocks, running

T0 = pd.Timestamp("2025-03-03")


@pytest.fixture(scope="module")
def walks(spark):
    """Two symbols, one with most of the bars, with gaps of every length."""
    rng = np.random.default_rng(3)
    parts = []
    for symbol, n in (("hot", 1500), ("few", 40)):
        minutes = rng.choice([1, 1, 1, 2, 30, 400], n).cumsum()
        close = 100 + rng.normal(0, 1, n).cumsum()
        parts.append(pd.DataFrame({"symbol": symbol, "timestamp": [T0 + pd.Timedelta(minutes=int(m)) for m in minutes], "open": close, "high": close + rng.random(n), "low": close - rng.random(n), "close": close, "volume": rng.random(n) * 100}))
    return spark.createDataFrame(pd.concat(parts)).cache()


def values(df, names):
    return [tuple(None if v is None else round(v, 9) for v in r) for r in df.orderBy("symbol", "timestamp").select(*names).collect()]


@pytest.mark.parametrize("seconds", [600, 86_400, 10**9])
def test_bounded_windows_do_not_see_the_blocks(walks, seconds):
    up, down = I.breakout(20)
    new = {"up": up, "down": down, "v": I.rolling_vwap(24), "z": I.volume_zscore(20), "p": I.rolling_percentile("close", 15), "c": I.lagged_change("close", 12)}
    add = lambda c: I.with_true_range(c).withColumns(new)
    names = [*new, "tr"]
    got = over_blocks(walks, add, seconds, before=24)
    assert got.columns == add(walks).columns and values(got, names) == values(add(walks), names)


def test_labels_look_ahead(walks):
    add = lambda c: c.withColumn("y", labels.triple_barrier(12, F.lit(True), F.col("close") - 1, F.col("close") + 1))
    assert values(over_blocks(walks, add, 3600, after=12), ["y"]) == values(add(walks), ["y"])


def test_recurrences_forget(walks):
    add = lambda c: I.with_adx(smooth(c, I.KEY, I.ORDER, {"e": ("close", 5, 3)}, {}), 4, atr=("atr", 4))
    rows = max(memory(5), memory(wilder=(4, 4))) + 2
    assert rows < 700
    assert values(over_blocks(walks, add, 86_400, rows), ["e", "adx", "atr", "plus_di"]) == values(add(walks), ["e", "adx", "atr", "plus_di"])


def test_a_symbol_is_spread_over_tasks(walks):
    """Windows hash on (symbol, block): the hot symbol's rows are in many partitions."""
    got = over_blocks(walks, lambda c: I.with_true_range(c).withColumn("task", F.spark_partition_id()), 86_400, 1)
    assert got.filter("symbol = 'hot'").select("task").distinct().count() > 1
    assert over_blocks(walks.limit(0), I.with_true_range, 60, 3).count() == 0


@pytest.mark.parametrize("seconds", [600, 86_400, 10**9])
def test_running_values_do_not_see_the_blocks(walks, seconds):
    from pyspark.sql import Window

    some = F.when(F.col("volume") > 90, F.col("close"))
    by = Window.partitionBy("symbol").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    want = walks.withColumns({"s": F.sum(F.col("volume")).over(by), "m": F.max("close").over(by), "f": F.first(some, ignorenulls=True).over(by), "l": F.last(some, ignorenulls=True).over(by)})
    got = running(walks, ["symbol"], ["timestamp"], seconds, {"s": F.col("volume")}, {"m": F.col("close")}, {"f": some}, {"l": some})
    assert got.columns == want.columns
    a, b = (pd.DataFrame(values(x, ["s", "m", "f", "l"])) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-6)
    assert running(walks.limit(0), ["symbol"], ["timestamp"], seconds, {"s": F.col("volume")}).count() == 0
