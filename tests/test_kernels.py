"""The kernels on the test tables' bars: against independent code, and by the identities that books obey."""

from dataclasses import replace

import pytest

from marketspark import queries as Q
from marketspark.operators import quality
from marketspark.plans import momentum_ledger, range_ledger
from marketspark.sources import derived as D

SF = "/root/testdata/sf0.001"
CONTRACT = {"lot_size": 0.0001, "minimum_quantity": 0.0001, "minimum_notional": 0.01, "maximum_leverage": 5}


@pytest.fixture(scope="module")
def features(spark):
    return Q.backtest_features(spark, SF).cache()


@pytest.fixture(scope="module")
def momentum(spark):
    return Q.momentum_table(spark, SF).cache()


def runs_of(n):
    return {f"z{i}": replace(Q.ENGINE, range=replace(Q.RANGE, entry_z=0.4 + 0.1 * i)) for i in range(n)}


def test_books_of_every_run_balance(features):
    runs = runs_of(11)  # more than pass together
    got = range_ledger.backtest(features, runs).toPandas()
    assert len(got) == 11 * features.count()
    traded = 0
    for (_, _), rows in got.groupby(["run_id", "symbol"]):
        rows = rows.sort_values("timestamp")
        cash, held = Q.ENGINE.costs.initial_equity, 0.0
        for r in rows.itertuples():
            for f in r.fills:
                sign = 1 if f["side"] == "buy" else -1
                cash -= sign * f["price"] * f["quantity"] + f["commission"]
                held += sign * f["quantity"]
                traded += 1
            assert r.position == pytest.approx(held, abs=1e-6) and r.equity == pytest.approx(cash + held * r.close)
    assert traded > 20


def test_runs_together_equal_runs_alone(features):
    runs = runs_of(3)
    key = ["run_id", "symbol", "timestamp"]
    together = range_ledger.backtest(features, runs).toPandas().sort_values(key, ignore_index=True)
    for name, config in runs.items():
        alone = range_ledger.backtest(features, {name: config}).toPandas().sort_values(key, ignore_index=True)
        part = together[together.run_id == name].reset_index(drop=True)
        assert (part.equity == alone.equity).all() and (part.signal.fillna("") == alone.signal.fillna("")).all()


def test_a_start_at_the_last_bar_gives_no_fills(features):
    last = max(r.timestamp for r in features.select("timestamp").collect())
    got = range_ledger.backtest(features, {"a": Q.ENGINE}, trade_after=last).toPandas()
    assert got.fills.map(len).sum() == 0 and got.signal.isna().all() and len(got) == features.count()


def test_portfolio_runs_have_their_own_rules(spark, momentum):
    symbols = [r.symbol for r in momentum.select("symbol").distinct().collect()]
    contracts, ranks = {s: CONTRACT for s in symbols}, {s: (i + 1, 1.0) for i, s in enumerate(sorted(symbols))}
    runs = {"a": Q.ENGINE, "b": replace(Q.ENGINE, momentum=replace(Q.MOMENTUM, shock_candle_atr=0.5)), "c": Q.ENGINE}
    both = momentum_ledger.portfolio(momentum, contracts, ranks, runs).toPandas().sort_values(["run_id", "timestamp"], ignore_index=True)
    for name, config in runs.items():
        alone = momentum_ledger.portfolio(momentum, contracts, ranks, {name: config}).toPandas().sort_values("timestamp", ignore_index=True)
        part = both[both.run_id == name].reset_index(drop=True)
        assert (part.equity == alone.equity).all() and [[e["event"] for e in x] for x in part.events] == [[e["event"] for e in x] for x in alone.events]
    shut = momentum_ledger.portfolio(momentum, contracts, ranks, {"a": Q.ENGINE}, {s: (None, "market_policy_pause_new_entries") for s in symbols}).toPandas()
    assert not any(e["event"] in ("OPEN", "ORDER_CREATED") for x in shut.events for e in x)


def brute_decisions(rows, c):
    """The rules as plain code of their own: (action, reason) of each bar of one symbol."""
    waiting, out = None, []
    for r in rows:
        if r.warming:
            out.append(("reject", "indicators_warming_up"))
            continue
        if r.shock:
            waiting = None
            out.append(("reject", "panic_or_vertical_candle"))
            continue
        if waiting:
            side, level, n = waiting
            n += 1
            edge = r.low if side == "long" else r.high
            beyond = r.close > level if side == "long" else r.close < level
            if n > c.retest_bars:
                waiting = None
                out.append(("reject", "retest_expired_or_shock"))
            elif abs(edge - level) > c.retest_tolerance_atr * r.atr + 1e-9 or not beyond:
                waiting = (side, level, n)
                out.append(("watch", "waiting_retest_confirmation"))
            else:
                waiting = None
                stop = edge - c.stop_buffer_atr * r.atr if side == "long" else edge + c.stop_buffer_atr * r.atr
                risk = abs(r.close - stop)
                fine = 0 < risk <= c.maximum_stop_atr * r.atr + 1e-9
                out.append(("enter_" + side, "breakout_retest_confirmed") if fine else ("reject", "invalid_stop_distance"))
            continue
        kind = r.momentum_regime
        if c.adaptive_enabled and kind == "sideways" and abs(r.adaptive_z) >= c.adaptive_entry_z and abs(r.adaptive_center - r.close) >= c.aggressive_reward * c.adaptive_stop_atr * r.atr:
            out.append(("enter_long" if r.adaptive_z < 0 else "enter_short", "adaptive_range_mean_reversion"))
        elif r.volume_zscore >= c.minimum_volume_z and kind in ("bullish_expansion", "euphoric_pump") and r.momentum_atr >= c.minimum_momentum_atr and r.close > r.breakout_high:
            waiting = ("long", r.breakout_high, 0)
            out.append(("watch", "aggressive_long_waiting_external_context_and_consolidation" if r.momentum_atr >= c.aggressive_momentum_atr else "long_breakout_waiting_retest"))
        elif c.short_enabled and r.volume_zscore >= c.minimum_volume_z and kind in ("distribution", "bearish_expansion") and r.momentum_atr <= -c.minimum_momentum_atr and r.close < r.breakout_low:
            waiting = ("short", r.breakout_low, 0)
            out.append(("watch", "short_breakout_waiting_retest"))
        else:
            risk = r.close - (r.low - c.stop_buffer_atr * r.atr)
            pulled = kind == "bullish_expansion" and r.volume_zscore >= c.minimum_volume_z and r.low <= r.ema_fast_5m < r.close and r.close > r.previous_close
            out.append(("enter_long", "momentum_pullback_confirmed") if pulled and 0 < risk <= c.maximum_stop_atr * r.atr else ("hold", "no_breakout"))
    return out


def test_decisions_equal_brute_force(momentum):
    for config in (Q.MOMENTUM, replace(Q.MOMENTUM, minimum_volume_z=-1.0, minimum_momentum_atr=0.1, retest_tolerance_atr=3.0, maximum_stop_atr=9.0)):
        got = momentum_ledger.decisions(momentum, config).toPandas()
        rows = momentum_ledger.prepared(momentum, config).toPandas()
        seen = set()
        for symbol, part in rows.groupby("symbol"):
            want = brute_decisions(list(part.sort_values("timestamp").itertuples()), config)
            mine = got[got.symbol == symbol].sort_values("timestamp")
            assert list(zip(mine.action, mine.reason)) == want
            seen |= {x[0] for x in want}
        assert {"reject", "hold"} <= seen and len(seen) >= 3


def test_entries_of_the_dataset_are_labelled_by_later_bars(spark, momentum):
    config = replace(Q.MOMENTUM, minimum_volume_z=-1.0, minimum_momentum_atr=0.1, retest_tolerance_atr=3.0, maximum_stop_atr=9.0)
    q = momentum.select("symbol").distinct().selectExpr("symbol", "5.0D spread_bps", "2000.0D depth", "0.0002D funding_8h", "0.001D mark_divergence", "0.5D quality_risk")
    got = {(r.symbol, r.timestamp): r for r in momentum_ledger.dataset(momentum, q, config).collect()}
    chosen = momentum_ledger.decisions(momentum, config).filter("action in ('enter_long', 'enter_short')").collect()
    assert len(got) == len(chosen) > 0
    by = {s: p.sort_values("timestamp").reset_index(drop=True) for s, p in momentum.toPandas().groupby("symbol")}
    for e in chosen:
        p = by[e.symbol]
        at = p.index[p.timestamp == e.timestamp][0]
        label = 0
        for b in p[at + 1 : at + 1 + config.time_stop_bars].itertuples():
            long = e.action == "enter_long"
            if b.low <= e.stop if long else b.high >= e.stop:
                label = -1
            elif b.high >= e.target if long else b.low <= e.target:
                label = 1
            if label:
                break
        assert got[e.symbol, e.timestamp].label == label


def test_reports_see_what_is_missing(spark):
    rows = [("s", f"2025-01-01 {h:02d}:{m:02d}:00", 1.0, 2.0, 0.5, 1.0, 1.0, i) for i, (h, m) in enumerate([(1, 0), (2, 0), (2, 30), (5, 0), (5, 0)])]
    d = spark.createDataFrame(rows, "symbol string, t string, open double, high double, low double, close double, volume double, ordinal int").selectExpr("*", "cast(t as timestamp) timestamp").drop("t")
    got = quality.report(d, 3600).first()
    assert (got.rows, got.missing, got.errors) == (5, 2, ["duplicate timestamps", "missing candles"])
    assert got.score == pytest.approx(1 - 4 / 7) and not got.passed
    zones = quality.report(d.selectExpr("symbol", "cast(timestamp as string) timestamp", "open", "high", "low", "close", "volume", "ordinal"), 3600).first()
    assert zones.errors[0] == "timestamps without a time zone"
    assert quality.report(d.drop("close"), 3600).first().errors == ["missing columns: close"]
    assert quality.report(d.limit(0), 3600).first().errors == ["no rows"]


def test_reports_look_for_the_rules_they_are_told(spark):
    rows = [("s", 0, 0.0, -1.0, 0), ("s", 1, 1.0, 1.0, 1)]
    d = spark.createDataFrame(rows, "symbol string, h int, close double, volume double, ordinal int")
    d = d.selectExpr("*", "timestamp'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, h) timestamp", "close open", "close high", "close low")
    assert quality.report(d, 3600).first().errors == ["non-positive price", "negative volume", "unexplained price jump"]
    got = quality.report(d, 3600, rules=("negative volume",)).first()
    assert got.errors == ["negative volume"] and got.score == pytest.approx(0.5) and not got.passed
    assert quality.report(d, 3600, rules=()).first().passed
    with pytest.raises(ValueError, match="no such rules: odd"):
        quality.report(d, 3600, rules=("odd",))


def test_bars_outside_sessions_are_errors(spark):
    from marketspark.operators import bars as B

    s = spark.sql("SELECT date'2025-01-01' session, timestamp'2025-01-01 22:00' market_open, timestamp'2025-01-02 02:00' market_close")
    d = spark.sql("SELECT * FROM VALUES (timestamp'2025-01-01 22:00'), (timestamp'2025-01-01 23:00'), (timestamp'2025-01-02 02:00'), (timestamp'2025-01-02 03:00') AS t(timestamp)")
    assert sorted(r.timestamp.hour for r in B.with_session(d, s, outside="drop").collect()) == [2, 23]
    with pytest.raises(Exception, match="outside all sessions"):
        B.with_session(d, s).collect()


def test_derived_tables_hold_all_suppliers(spark):
    assert D.qualities(spark, SF).count() == spark.read.parquet(f"{SF}/supplier.parquet").count()
