import math
from dataclasses import replace
from datetime import timedelta

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketspark.config import Costs, EngineConfig, Instrument, MomentumConfig, RangeConfig, RiskLimits, load_config
from marketspark.functions import price as P
from marketspark.functions import text as X
from marketspark.operators import orders, policy, quality, risk, universe
from marketspark.plans import momentum_ledger as M
from marketspark.plans import range_ledger as R


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_costs_by_hand(spark):
    got = one(spark, a=P.round_trip_cost(100, 2, 1, 0.005), b=P.slipped(100, 10, 1), c=P.funding_payment(1000, 0.001, F.lit(True)), d=P.barrier_hit(94, 106, 95, 105))
    assert (round(got.a, 9), round(got.b, 9), got.c, got.d) == (0.05, 100.1, -1, "stop")


def test_leverage_by_hand(spark):
    got = one(spark, **{f"x{n}": P.choose_leverage(n, 10000, 0.1, 5) for n in (1900, 2500, 4500, 6000)})
    assert tuple(got) == (2, 3, 5, None)


def test_sizing_by_hand(spark):
    a = spark.createDataFrame([(100000.0, 100000.0, 100.0, 95.0, True, 0.10)], "equity double, buying_power double, entry double, stop double, is_buy boolean, cost double")
    got = a.select(*[c.alias(n) for n, c in risk.size_position(Instrument(), RiskLimits()).items()]).first()
    assert got.approved and got.quantity == 196
    assert R.sized(EngineConfig(costs=Costs(commission=0.05, spread_bps=0, slippage_bps=0)), 1, 100, 95, 0, 100000, 100000) == (196, "approved")


@settings(max_examples=300, deadline=None)
@given(st.floats(1, 1e6), st.floats(10, 1000), st.floats(0.01, 100))
def test_risk_never_exceeds_the_budget(equity, entry, distance):
    config = EngineConfig(instrument=Instrument(lot_size=0.001, minimum_quantity=0.001, minimum_notional=0))
    stop = entry - min(distance, entry * 0.9)
    quantity, _ = R.sized(config, 1, entry, stop, 2.0, equity, equity)
    unit = entry - stop + entry * 4 / 10000 + 0.01
    assert quantity * unit <= equity * 0.01 * (1 + 1e-6)


def test_transitions(spark):
    pairs = [("created", "validated", True), ("filled", "canceled", False), ("unknown", "filled", True), ("odd", "filled", False)]
    d = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert d.filter(orders.legal_transition("a", "b") != F.col("want")).count() == 0


def test_order_ids_repeat(spark):
    import hashlib

    got = one(spark, i=X.order_id(F.lit("QQQ"), F.lit("enter_long"), F.lit("2026-01-05T00:00:00+00:00"), F.lit("u"), F.lit("entry"))).i
    assert got == "arb-" + hashlib.sha256(b"QQQ:enter_long:2026-01-05T00:00:00+00:00:u:entry").hexdigest()[:24]


def test_json_urls_and_secrets(spark):
    got = one(
        spark,
        a=X.json_number(F.lit('{"lotSize":"0.5"}'), ["tickSize", "lotSize"], 1.0),
        b=X.json_number(F.lit("not json"), ["x"], 1.0),
        c=X.host_allowed(F.lit("https://news.example.com/x"), ["example.com"]),
        d=X.host_allowed(F.lit("https://badexample.com/x"), ["example.com"]),
        e=X.redacted(F.create_map(F.lit("A_API_KEY"), F.lit("s"), F.lit("TRADING_MODE"), F.lit("paper"))),
    )
    assert (got.a, got.b, got.c, got.d, got.e) == (0.5, 1.0, True, False, {"A_API_KEY": "***", "TRADING_MODE": "paper"})


def test_policies(spark):
    at = pd.Timestamp("2026-01-05 12:00").to_pydatetime()
    base = {"issued_at": at, "expires_at": at + timedelta(hours=4), "action": "allow_evaluation", "confidence": 0.8, "systemic_risk": 0.2, "leverage": 2, "strategies": ["adaptive_range"], "sources": [("https://example.com/a", at)]}
    cases = [({}, None), ({"expires_at": at}, "policy_expired"), ({"systemic_risk": 0.9}, "systemic_risk_too_high"), ({"sources": [("https://evil.test/a", at)]}, "unapproved_source"), ({"sources": []}, "missing_sources"), ({"strategies": ["x"]}, "invalid_strategy_allowlist"), ({"confidence": 0.1}, "regime_confidence_too_low")]
    schema = "i int, issued_at timestamp, expires_at timestamp, action string, confidence double, systemic_risk double, leverage int, strategies array<string>, sources array<struct<url:string,published_at:timestamp>>"
    d = spark.createDataFrame([(i, *({**base, **c}).values()) for i, (c, _) in enumerate(cases)], schema)
    reason = policy.policy_reason(F.lit("2026-01-05 13:00").cast("timestamp"), ["example.com"], ["adaptive_range"])
    assert [r.reason for r in d.select("i", reason.alias("reason")).orderBy("i").collect()] == [w for _, w in cases]


def test_ambiguous_symbols_go(spark):
    pairs = spark.createDataFrame([("DOGEUSDT", "DOGE"), ("MEMEUSDT", "MEME")], "symbol string, base string")
    catalog = spark.createDataFrame([("doge", "1"), ("meme", "2"), ("meme", "3")], "symbol string, id string")
    assert [r.symbol for r in universe.unambiguous_join(pairs, catalog).collect()] == ["DOGEUSDT"]


def test_book_and_repair(spark):
    book = one(spark, s=P.spread_bps(99.0, 101.0), x=P.spread_bps(101.0, 99.0))
    assert book.s == pytest.approx(200) and book.x is None
    bar = spark.createDataFrame([("s", 20.001, 20.0, 19.0, 19.5, 1.0)], "symbol string, open double, high double, low double, close double, volume double")
    got = quality.repair_ohlc(bar).first()
    assert got.high == 20.001 and got.ohlc_adjusted and not got.ohlc_rejected
    assert quality.repair_ohlc(bar.withColumn("open", F.lit(200.0)), "drop").count() == 0


class Bar:
    def __init__(self, i, o, h, lo, c, z=0.0, **more):
        self.timestamp = pd.Timestamp("2026-01-05 14:30") + pd.Timedelta(minutes=15 * i)
        self.open, self.high, self.low, self.close, self.z = o, h, lo, c, z
        self.volume, self.spread_bps, self.atr, self.center, self.regime, self.usable = 1e6, 0.0, 2.0, 105.0, "range", True
        self.session, self.week = "a", "w"
        self.reliable, self.force_exit = True, None
        self.session_open, self.session_close = pd.Timestamp("2026-01-05 14:30"), pd.Timestamp("2026-01-05 21:00")
        self.__dict__.update(more)


def config(**rules):
    base = EngineConfig(range=RangeConfig(session_flatten=False), costs=Costs(spread_bps=0, slippage_bps=0, commission=0.005), instrument=Instrument(lot_size=1.0))
    return replace(base, range=replace(base.range, **rules))


def test_an_entry_fills_on_the_next_bar_and_a_stop_closes_it():
    rows = list(R.simulate([Bar(0, 100, 101, 99, 100, -2.0), Bar(1, 100, 101, 99, 100, -1.0), Bar(2, 100, 106, 94, 100, -1.0), Bar(3, 100, 101, 99, 100, -1.0, regime="unknown")], config()))
    assert [len(r["fills"]) for r in rows] == [0, 1, 1, 0]
    assert rows[1]["fills"][0]["purpose"] == "entry" and rows[2]["fills"][0]["purpose"] == "stop"
    assert rows[2]["fills"][0]["price"] == 95.0 and rows[3]["position"] == 0
    assert rows[0]["signal"] == "enter_long" and rows[0]["detail"] == "approved"


def test_time_stop_and_cash_identity():
    bars = [Bar(i, 100, 101, 99, 100 + 0.1 * i, -2.0) for i in range(14)]
    rows = list(R.simulate(bars, config(time_stop_bars=3)))
    assert any(r["detail"] == "time stop" for r in rows)
    fills = [f for r in rows for f in r["fills"]]
    cash = 100_000 - sum((1 if f["side"] == "buy" else -1) * f["price"] * f["quantity"] + f["commission"] for f in fills)
    assert rows[-1]["equity"] == pytest.approx(cash + rows[-1]["position"] * rows[-1]["close"])


def test_bars_up_to_the_start_warm_up_and_unreliable_ones_close():
    bars = [Bar(i, 100, 101, 99, 100, -2.0) for i in range(6)]
    assert not any(r["signal"] or r["fills"] for r in R.simulate(bars, config(), trade_after=bars[-1].timestamp))
    late = list(R.simulate(bars, config(), trade_after=bars[2].timestamp))
    assert [r["signal"] for r in late[:4]] == [None, None, None, "enter_long"]
    bad = [*bars[:2], Bar(2, 100, 101, 99, 100, -2.0, reliable=False), *[Bar(i, 100, 101, 99, 100, -2.0, reliable=False) for i in (3, 4)]]
    rows = list(R.simulate(bad, config()))
    assert rows[2]["detail"] == "data integrity compromised" and rows[3]["position"] == 0 and rows[4]["signal"] is None
    forced = list(R.simulate([*bars[:2], Bar(2, 100, 101, 99, 100, -2.0, force_exit="operator", reliable=False)], config()))
    assert forced[2]["detail"] == "operator"


def test_the_quality_gate(spark):
    bars = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "symbol string, n int")
    report = spark.createDataFrame([("a", True, 1.0), ("b", False, 0.9)], "symbol string, passed boolean, score double")
    assert [r.symbol for r in R.gated(bars, report, mode="drop").collect()] == ["a"]
    assert {r.symbol: r.reliable for r in R.gated(bars, report, mode="flag").collect()} == {"a": True, "b": False, "c": False}
    with pytest.raises(Exception, match="data quality is below the threshold"):
        R.gated(bars, report).collect()


def test_a_lost_account_stops():
    bars = [Bar(0, 100, 101, 99, 100, -2.0), Bar(1, 100, 101, 99, 100, -2.0), *[Bar(i, 60, 61, 59, 60, -2.0) for i in range(2, 6)]]
    rows = list(R.simulate(bars, replace(config(), risk=RiskLimits(risk_per_trade=0.5, hard_notional_cap=1e9))))
    assert rows[-1]["kill_switch"] is not None and rows[-1]["detail"] == "kill switch active"


class Row:
    def __init__(self, **more):
        self.warming, self.shock, self.momentum_regime = False, False, "bullish_expansion"
        self.open = self.close = 100.0
        self.high, self.low, self.atr = 100.5, 99.5, 1.0
        self.adaptive_z, self.adaptive_center, self.volume_zscore, self.momentum_atr = 0.0, 100.0, 1.0, 2.0
        self.breakout_high, self.breakout_low, self.ema_fast_5m, self.previous_close = 99.8, 90.0, 95.0, 99.0
        self.__dict__.update(more)


def test_a_breakout_waits_for_its_retest():
    rules = MomentumConfig()
    first, watch = M.decide(Row(), M.NOTHING, rules)
    assert first.action == "watch" and watch == M.Watch(1, 99.8)
    then, after = M.decide(Row(low=99.8, close=100.8), watch, rules)
    assert then.action == "enter_long" and then.stop == pytest.approx(99.55) and then.target == pytest.approx(100.8 + 1.25 * 1.75) and after == M.NOTHING
    wait = watch
    for _ in range(3):
        d, wait = M.decide(Row(low=95, close=96), wait, rules)
        assert d.action == "watch"
    assert M.decide(Row(low=95, close=96), wait, rules)[0].reason == "retest_expired_or_shock"


def test_a_position_is_managed_by_its_risk():
    rules = MomentumConfig()
    for sign in (1, -1):
        at = lambda x, s=sign: 200 + s * x
        row = lambda reach, atr=2.0, s=sign: Row(high=max(at(reach, s), at(0, s)), low=min(at(reach, s), at(0, s)), atr=atr)  # noqa: E731, B023
        start = M.Managed(at(0), 4.0)
        assert M.manage(Row(shock=True), sign, 0, start, rules)[0].reason == "shock_exit"
        assert M.manage(row(1), sign, rules.time_stop_bars, start, rules)[0].reason == "time_stop"
        assert M.manage(row(1), sign, 0, M.Managed(at(0), 0.0), rules)[0].reason == "missing_protective_stop"
        held, state = M.manage(row(3), sign, 0, start, rules)
        assert held.action == "hold" and held.stop is None and state.best == at(3)
        cut, state = M.manage(row(4), sign, 1, state, rules)
        assert (cut.action, cut.reason, cut.stop) == ("reduce", "one_r_partial", at(0)) and state.one_r_hit
        trail, state = M.manage(row(20), sign, 2, state, rules)
        assert trail.stop == at(20 - 2.0 * rules.trailing_atr) and state.trailing == trail.stop
        back, state = M.manage(row(1), sign, 3, state, rules)
        assert back.stop == trail.stop  # it never loosens


def test_mean_reversion_and_shock():
    d, _ = M.decide(Row(momentum_regime="sideways", adaptive_z=-2.0, adaptive_center=104.0, close=98.75), M.NOTHING, MomentumConfig())
    assert d.action == "enter_long" and d.stop == pytest.approx(97.5) and d.target == 104
    assert M.decide(Row(shock=True), M.Watch(1, 5), MomentumConfig()) == (M.Decision("reject", "panic_or_vertical_candle"), M.NOTHING)


def test_staged_exits_keep_the_books():
    contract = {"lot_size": 0.001, "minimum_quantity": 0.001, "minimum_notional": 0.01, "maximum_leverage": 5}
    book = M.Portfolio(EngineConfig(), {"a": contract}, {"a": (1, 1.0)})
    t = pd.Timestamp("2026-01-05")
    book.pending = ("a", M.Decision("enter_long", "x", 99.0, 103.0), 1.0)
    flat = {"momentum_regime": "sideways", "adaptive_z": 0.0}
    book.step(t, {"a": Row(**flat)})
    held = book.held["a"]
    assert held.quantity > 0 and book.fees > 0
    book.step(t + pd.Timedelta(minutes=5), {"a": Row(high=held.entry + held.unit_risk + 0.1, low=99.9, **flat)})
    assert book.held["a"].stage == 1 and book.held["a"].stop == held.entry
    book.step(t + pd.Timedelta(minutes=10), {"a": Row(high=104, low=held.entry + 0.01, **flat)})
    assert book.held["a"].stage == 2
    book.step(t + pd.Timedelta(minutes=15), {"a": Row(low=50, open=held.entry, **flat)})
    assert not book.held and math.isclose(book.marked({}), book.equity)


def test_configs_are_checked(tmp_path):
    with pytest.raises(ValueError):
        MomentumConfig(fast_ema=50, slow_ema=20)
    with pytest.raises(ValueError):
        RangeConfig(fixed_stop_fraction=0.01)
    f = tmp_path / "c.json"
    f.write_text('{"range": {"entry_z": 2.0}}')
    assert load_config(f, {"risk.cooldown_bars": 3}).risk.cooldown_bars == 3
    f.write_text('{"range": {"nonsense": 1}}')
    with pytest.raises(ValueError):
        load_config(f)
