import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.operators import indicators as I
from marketspark.plans import sql
from marketspark.sources import paged, readers, sinks
from marketspark.streaming import candles as S


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_candle_lines(spark, tmp_path):
    candle = {"time": "1735700000000", "open": "40.002", "high": "40", "low": "38", "close": "39", "baseVol": "3"}
    p = lines(tmp_path / "c.jsonl", [{"spread_bps": 2.0, "candle": {**candle, "close": "38.5"}}, "not json", {"spread_bps": 2.5, "candle": candle}])
    got = readers.candle_lines(spark, p, "s").collect()
    assert len(got) == 1 and got[0].high == 40.002 and got[0].close == 39 and got[0].ohlc_adjusted and got[0].spread_bps == 2.5


def test_arrival_goes_by_file_and_place(spark, tmp_path):
    """Spark reads large files first; the older, larger one must not win."""
    log = tmp_path / "log"
    log.mkdir()

    def m(close, pad=""):
        return {"pad": pad, "message": {"ch": "market_kline_5min", "symbol": "catusdt", "ts": 1735700100000, "data": {"o": "1", "h": "9", "l": "0.5", "c": close, "v": "9"}}}

    lines(log / "2025-01-01.jsonl", [m(str(2 + i / 1000), "x" * 500) for i in range(500)])
    lines(log / "2025-01-02.jsonl", [m("7"), m("8")])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert [r.close for r in readers.message_log(spark, str(log)).collect()] == [8.0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_message_log(spark, tmp_path):
    def m(ts, c, ch="market_kline_5min"):
        return {"received_at": "x", "message": {"ch": ch, "symbol": "dogeusdt", "ts": ts, "data": {"o": "1", "h": "2", "l": "0.5", "c": c, "v": "9"}}}

    p = lines(tmp_path / "e.jsonl", [m(1735689900000, "3.5"), m(1735690000000, "3.7"), "{", m(1735690200000, "3.8"), m(1735689900000, "9", "price")])
    got = readers.message_log(spark, p, F.lit("2025-01-01 00:12:00").cast("timestamp")).collect()
    assert [(r.symbol, r.close) for r in got] == [("DOGEUSDT", 3.7)]


def test_catalog_and_states(spark, tmp_path):
    c = tmp_path / "catalog.json"
    c.write_text(json.dumps({"data": [{"symbolName": "dogeusdt", "baseCoin": "doge", "quoteCoin": "usdt", "status": "OPEN", "priceStep": "0.1", "lotSize": "1", "maxLeverage": "20"}]}))
    got = readers.catalog(spark, str(c)).first()
    assert (got.symbol, got.base, got.tick_size, got.maximum_leverage, got.api_supported) == ("DOGEUSDT", "DOGE", 0.1, 20.0, True)
    s = tmp_path / "stream.json"
    s.write_text(json.dumps({"symbols": {"DOGEUSDT": {"best_bid": "99", "best_ask": "101", "funding_rate": "x", "updated_at": "2026-01-01T00:00:00Z"}}}))
    got = readers.stream_states(spark, str(s)).first()
    assert (got.best_bid, got.funding_rate) == (99.0, None) and got.updated_at == pd.Timestamp("2026-01-01")


def test_history_is_overridden_by_the_log(spark, tmp_path):
    (tmp_path / "h").mkdir()
    bar = {"time": 1767225600000, "open": "1", "high": "2", "low": "0.5", "close": "1.5", "baseVol": "4"}
    (tmp_path / "h" / "DOGEUSDT.json").write_text(json.dumps([bar, {**bar, "time": 1767225900000}]))
    p = lines(tmp_path / "e.jsonl", [{"message": {"ch": "market_kline_5min", "symbol": "DOGEUSDT", "ts": 1767225600000, "data": {"o": "1", "h": "2", "l": "0.5", "c": "7"}}}])
    got = readers.merged_history(spark, p, str(tmp_path / "h")).orderBy("timestamp").collect()
    assert [r.close for r in got] == [7.0, 1.5]


PAGES = [{"time": 1000 * i, "open": 1, "high": 2, "low": 0, "close": i, "baseVol": 1} for i in range(25)]


def fetch(symbol, start, end, limit):
    return [p for p in PAGES if start <= p["time"] <= end][-limit:]


def test_pages_go_backward_and_end():
    got = list(paged.backward(fetch, "s", 2000, 20000, 4))
    assert sorted(r[1] for r in got) == [1000 * i for i in range(2, 20)]
    stuck = lambda symbol, start, end, limit: PAGES[:3]
    assert len(list(paged.backward(stuck, "s", 0, 10**6, 4))) == 3


def test_paged_source(spark):
    paged.register(spark)
    df = spark.read.format("paged_history").options(fetch="tests.test_sources_streams:fetch", symbols="a,b", start="0", end="25000", chunk="7000", limit="3").load()
    assert df.groupBy("symbol").count().collect()[0]["count"] == 25 and df.count() == 50


LATE: list[dict] = []


def fetch_late(symbol, start, end, limit):
    return [p for p in LATE if start <= p["time"] <= end][-limit:]


def test_polls_lose_no_late_bar():
    """What the source didn't have yet is read by the next poll; spans without bars are passed when later ones have some."""
    options = {"fetch": "tests.test_sources_streams:fetch_late", "symbols": "a", "start": "0", "step": "10000", "limit": "4"}
    LATE[:] = PAGES[:6]
    for more in ({}, {"end": "60000"}):
        LATE[:] = PAGES[:6]
        reader = paged.PollReader({**options, **more})
        rows, offset = reader.read(reader.initialOffset())
        assert [r[1] for r in rows] == [1000 * i for i in range(6)]
        LATE[:] = PAGES[:9]
        rows, offset = reader.read(offset)
        assert [r[1] for r in rows] == [6000, 7000, 8000]
        rows, same = reader.read(offset)
        assert list(rows) == [] and same == offset
        LATE[:] = [*PAGES[:9], {**PAGES[0], "time": 47_000}]
        rows, last = reader.read(offset)
        assert [r[1] for r in rows] == [47_000] and [r[1] for r in reader.readBetweenOffsets(offset, last)] == [47_000]


def test_a_report_replaces_the_last(spark, tmp_path):
    for n in (1, 2):
        sinks.write_report(spark.range(n).agg(F.count("*").alias("n")), f"file://{tmp_path}/deep/er/r.json")
    assert json.loads((tmp_path / "deep" / "er" / "r.json").read_text()) == {"n": 2}
    assert sorted(p.name for p in (tmp_path / "deep" / "er").iterdir() if not p.name.endswith(".crc")) == ["r.json"]


def test_inserts_keep_the_least_of_a_key(spark, tmp_path):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (2, "z")], "k int, v string")
    assert sinks.insert_new(spark, d.repartition(3), str(tmp_path / "t"), ["k"]) == 2
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "a"), (2, "z")]
    held = sinks.known(spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame([(2,), (9,)], "k int"), "k")
    assert sorted(map(tuple, held.collect())) == [(2, True), (9, False)]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    assert sinks.insert_new(spark, d, path, ["k"]) == 2
    assert sinks.insert_new(spark, d.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), path, ["k"]) == 1
    assert spark.read.parquet(path).count() == 3
    sinks.write_report(d.agg(F.count("*").alias("n")), tmp_path / "r" / "report.json")
    assert json.loads((tmp_path / "r" / "report.json").read_text()) == {"n": 2}
    with pytest.raises(ValueError):
        sinks.write_report(d, tmp_path / "r2.json")
    state = sinks.upsert_state(None, spark.createDataFrame([("x", 1, "old"), ("x", 2, "new")], "key string, version int, payload string"))
    assert [r.payload for r in state.collect()] == ["new"]


def test_sql_over_parquet(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "p"))
    assert sql.query(spark, str(tmp_path / "p"), "SELECT sum(id) AS s FROM candles").first().s == 10


def trades(spark, tmp_path):
    d = pd.DataFrame({"trade_id": range(60), "symbol": ["a", "b"] * 30, "timestamp": [pd.Timestamp("2026-01-01") + pd.Timedelta(minutes=7 * i) for i in range(60)], "price": [float(i % 9 + 1) for i in range(60)], "quantity": [1] * 60})
    p = str(tmp_path / "trades")
    spark.createDataFrame(d).repartition(3).write.parquet(p)
    return p, spark.read.parquet(p)


def test_streamed_candles_equal_batch(spark, tmp_path):
    from marketspark.operators.bars import candles_from_trades

    path, batch = trades(spark, tmp_path)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    q = S.candles(S.read_table(spark, path, batch.schema, 10)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.symbol, r.timestamp): r.close for r in spark.read.parquet(out).collect()}
    want = {(r.symbol, r.timestamp): r.close for r in candles_from_trades(batch, 3600).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 4


def test_stateful_indicators_equal_batch(spark, tmp_path):
    path, _ = trades(spark, tmp_path)
    from marketspark.operators.bars import candles_from_trades

    bars = candles_from_trades(spark.read.parquet(path), 1800).withColumn("volume", F.col("volume").cast("double"))
    source = str(tmp_path / "bars")
    bars.repartition(1).sortWithinPartitions("timestamp").write.parquet(source)
    q = S.indicators(spark.readStream.schema(bars.schema).parquet(source), 3, 5).writeStream.format("memory").queryName("ind").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.symbol, r.timestamp): r.atr for r in spark.table("ind").collect()}
    want = {(r.symbol, r.timestamp): r.atr for r in I.with_atr(bars, 3).collect()}
    assert got.keys() == want.keys() and all((a is None) == (want[k] is None) and (a is None or abs(a - want[k]) < 1e-9) for k, a in got.items())


def test_order_updates(spark):
    d = spark.createDataFrame([("s", "1", pd.Timestamp("2026-01-01").to_pydatetime(), "new", None, None), ("s", "1", pd.Timestamp("2026-01-02").to_pydatetime(), "fill", 5.0, 2.0)], "symbol string, order_id string, timestamp timestamp, status string, price double, quantity double")
    assert sorted(r.kind for r in S.order_events(d).collect()) == ["fill", "order", "order"]
