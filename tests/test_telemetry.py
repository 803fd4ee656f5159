from pyspark.sql import functions as F

from marketspark.config import RangeConfig
from marketspark.operators import telemetry as T
from marketspark.sources import freshness
from marketspark.streaming import guard


def test_reasons_to_wait(spark):
    rows = [(True, 0, "range", 0.0), (False, 3, "range", 0.0), (False, 0, "trend_up", 0.0), (False, 0, "range", -0.5), (False, 0, "range", 2.0)]
    d = spark.createDataFrame(rows, "kill_switch boolean, cooldown_bars long, regime string, z double")
    got = [r.w for r in d.select(T.waiting_reason(RangeConfig()).alias("w")).collect()]
    assert got == [
        "Kill switch active — new entries blocked",
        "Cooldown active — 3 bars remaining",
        "No entry — market regime is trend up",
        "No entry — |z| 0.50 is below 1.50",
        "No order — position, session or direction constraints are not satisfied",
    ]


def test_keys_leverage_and_ages(spark):
    m = spark.range(1).select(T.allowed_keys(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), ["a"]).alias("m")).first().m
    assert m == {"a": "1"}
    c = spark.createDataFrame([("s", 20.0)], "symbol string, maximum_leverage double")
    assert T.instrument_of(c, 5).first().max_leverage == 5
    assert [freshness.cache_state(x) for x in (1, 30, 80, None)] == ["fresh", "stale", "closed", "closed"]
    bars = spark.createDataFrame([("s", "2026-01-01 00:00:00")], "symbol string, t string").select("symbol", F.to_timestamp("t").alias("timestamp"))
    assert freshness.current_histories(bars, F.lit("2026-01-01 02:00:00").cast("timestamp"), 1).first().current


def test_streams_meet_and_a_lost_one_is_told(spark):
    a, b = spark.range(2).withColumnRenamed("id", "x"), spark.range(3).withColumnRenamed("id", "y")
    assert sorted(r.kind for r in guard.merged(market=a, orders=b).collect()) == ["market"] * 2 + ["orders"] * 3
    told = []
    event = type("E", (), {"exception": "gone"})()
    guard.DisconnectGuard(lambda *x: told.append(x)).onQueryTerminated(event)
    assert told == [("websocket_disconnected", "gone")]
