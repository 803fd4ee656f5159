"""Shapes of physical plans: what must not shuffle, and what must stay in the JVM."""

from pyspark.sql import functions as F

from marketspark import queries as Q
from marketspark.operators import indicators as I
from marketspark.sources import derived as D
from tests.compare import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_one_shuffle_after_the_bars(spark):
    bars = D.with_session(D.candles(spark, SMALL))
    text = plan(I.range_features(bars, Q.RANGE))
    assert text.count("Exchange hashpartitioning(symbol") - plan(bars).count("Exchange hashpartitioning(symbol") <= 1
    assert "Python" not in text and "SinglePartition" not in text


def test_scans_read_few_columns_and_push_filters(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    text = plan(li.filter(F.col("l_quantity") > 49).groupBy("l_suppkey").count())
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in text
    assert "l_comment" not in text and "l_extendedprice" not in text


def test_resampling_has_a_map_side_part(spark):
    assert "partial_min" in plan(D.candles(spark, SMALL)) and "partial_max" in plan(D.candles(spark, SMALL))


def test_gap_counts_need_no_grid(spark):
    assert "Generate" not in plan(Q.gap_counts(spark, SMALL))
