import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.functions import price as P
from marketspark.functions.scan import block_length, ema, wilder
from marketspark.operators import bars as B
from marketspark.operators import indicators as I
from marketspark.operators import labels, regime

T0 = pd.Timestamp("2026-01-05")


def bars(spark, high, low, close, volume=None, symbol="s", minutes=5, **more):
    n = len(close)
    d = pd.DataFrame({"symbol": symbol, "timestamp": [T0 + pd.Timedelta(minutes=minutes * i) for i in range(n)], "open": close, "high": high, "low": low, "close": close, "volume": volume or [1.0] * n})
    for k, v in more.items():
        d[k] = v
    return spark.createDataFrame(d.astype({c: float for c in ("open", "high", "low", "close", "volume")}))


def ordered(df, *names):
    return [tuple(r) for r in df.orderBy("timestamp").select(*names).collect()]


def walk(seed: int, n: int = 90) -> pd.DataFrame:
    """Bars of a random walk in whole cents."""
    rng = np.random.default_rng(seed)
    close = 50 + rng.normal(0, 0.4, n).cumsum().round(2)
    return pd.DataFrame({"high": close + rng.integers(1, 80, n) / 100, "low": close - rng.integers(1, 80, n) / 100, "close": close, "volume": rng.integers(1, 900, n).astype(float)})


def brute_wilder(values: list, period: int) -> list:
    out, seen, last = [], [], None
    for v in values:
        if last is not None:
            last = (last * (period - 1) + v) / period
        elif v is not None:
            seen.append(v)
            last = sum(seen) / period if len(seen) == period else None
        out.append(last)
    return out


def same(got, want) -> None:
    assert [x is None for x in got] == [x is None for x in want]
    assert [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None])


@pytest.mark.parametrize("period", [2, 7])
def test_atr_and_adx_equal_brute_force(spark, period):
    d = walk(period)
    h, lo, c = (d[n].tolist() for n in ("high", "low", "close"))
    true = [h[0] - lo[0]] + [max(h[i], c[i - 1]) - min(lo[i], c[i - 1]) for i in range(1, len(c))]
    plus, minus = [None], [None]
    for i in range(1, len(c)):
        up, down = h[i] - h[i - 1], lo[i - 1] - lo[i]
        plus.append(up if up > max(down, 0) else 0.0)
        minus.append(down if down > max(up, 0) else 0.0)
    atr, p, m = (brute_wilder(x, period) for x in (true, plus, minus))
    di = [(None, None) if t is None or x is None else (100 * x / t, 100 * y / t) for t, x, y in zip(atr, p, m)]
    adx = brute_wilder([None if x is None else 100 * abs(x - y) / (x + y) for x, y in di], period)
    b = bars(spark, h, lo, c)
    same([r[0] for r in ordered(I.with_atr(b, period), "atr")], atr)
    got = ordered(I.with_adx(b, period), "adx", "plus_di", "minus_di")
    same([r[0] for r in got], adx)
    same([r[1] for r in got], [x for x, _ in di])
    same([r[2] for r in got], [y for _, y in di])


def test_no_bar_knows_later_ones(spark):
    d = walk(11)
    columns = [d[n].tolist() for n in ("high", "low", "close", "volume")]

    def features(n):
        b = bars(spark, *[x[:n] for x in columns])
        out = I.with_adx(b, 5, emas={"e": ("close", 9, 1)}, atr=("atr", 4))
        up, down = I.breakout(6)
        return ordered(out.withColumns({"up": up, "down": down, "v": I.rolling_vwap(5), "z": I.volume_zscore(6), "q": I.rolling_percentile("close", 7)}), "adx", "atr", "e", "up", "down", "v", "z", "q")

    assert features(60) == features(90)[:60]


def test_windows_equal_brute_force(spark):
    d = walk(23)
    day = [f"day{i // 25}" for i in range(len(d))]
    b = bars(spark, *[d[n].tolist() for n in ("high", "low", "close", "volume")], session=day)
    up, down = I.breakout(8)
    got = ordered(b.withColumns({"s": I.session_vwap(), "r": I.rolling_vwap(6), "up": up, "down": down}), "s", "r", "up", "down")
    weigh = lambda x: float(((x.high + x.low + x.close) / 3 * x.volume).sum() / x.volume.sum())
    for i, (s, r, high, low) in enumerate(got):
        assert s == pytest.approx(weigh(d[25 * (i // 25) : i + 1]))
        same([r, high, low], [weigh(d[i - 5 : i + 1]) if i >= 5 else None, d.high[i - 8 : i].max() if i >= 8 else None, d.low[i - 8 : i].min() if i >= 8 else None])


def test_scans_equal_loops_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(100, 5, 4000)
    b = bars(spark, x + 1, x - 1, x)
    got = [r[0] for r in ordered(ema(b, I.KEY, I.ORDER, {"e": ("close", 20, 1)}), "e")]
    np.testing.assert_allclose(got, pd.Series(x).ewm(span=20, adjust=False).mean(), rtol=1e-12)
    got = [r[0] for r in ordered(wilder(b, I.KEY, I.ORDER, {"w": "close"}, 14), "w")]
    want = [None] * 13 + [x[:14].mean()]
    for v in x[14:]:
        want.append((want[-1] * 13 + v) / 14)
    np.testing.assert_allclose(got[13:], want[13:], rtol=1e-12)
    assert got[:13] == [None] * 13 and block_length(13 / 14) < 4000


def test_wilder_after_a_null_is_null(spark):
    b = bars(spark, [1] * 6, [1] * 6, [1] * 6).withColumn("x", F.when(F.minute("timestamp") != 20, F.col("close")))
    assert [r[0] for r in ordered(wilder(b, I.KEY, I.ORDER, {"w": "x"}, 2), "w")] == [None, 1, 1, 1, None, None]


def test_nothing_is_divided_by_zero(spark):
    got = spark.range(1).select(P.in_atr(F.lit(3.5), F.lit(0.0)).alias("z"), P.pct_change(F.lit(2.0), F.lit(0.0)).alias("p"), P.mark_divergence(F.lit(2.0), F.lit(0.0)).alias("m")).first()
    assert tuple(got) == (None, None, None)


def test_regime_needs_three_bars_but_shock_none(spark):
    b = bars(spark, [1] * 7, [1] * 7, [1] * 7, c=["range", "range", "range", "trend_up", "shock", "range", "range"])
    assert [r[0] for r in ordered(regime.confirmed(b, "c", 3), "regime")] == ["unknown", "unknown", "range", "range", "shock", "shock", "shock"]


def test_confirmation_equals_the_state_machine(spark):
    rng = np.random.default_rng(5)
    kinds = ["unknown", "range", "trend_up", "shock"]
    c = [kinds[i] for i in rng.integers(0, 4, 400)]
    got = [r[0] for r in ordered(regime.confirmed(bars(spark, [1] * 400, [1] * 400, [1] * 400, c=c), "c", 2), "regime")]
    now, pending, n, want = "unknown", None, 0, []
    for x in c:
        if x == "shock" or x == now:
            now, pending, n = x, None, 0
        else:
            n = n + 1 if x == pending else 1
            pending = x
            if n >= 2:
                now, pending, n = x, None, 0
        want.append(now)
    assert got == want


def test_triple_barrier_counts_the_stop_first(spark):
    b = bars(spark, [50, 54, 50, 56, 50], [50, 46, 50, 49, 50], [50, 50, 50, 50, 50])
    long = ordered(b.withColumn("y", labels.triple_barrier(2, F.lit(True), F.lit(47.0), F.lit(53.0))), "y")
    short = ordered(b.withColumn("y", labels.triple_barrier(2, F.lit(False), F.lit(53.0), F.lit(47.0))), "y")
    assert [r[0] for r in long] == [-1, 1, 1, 0, 0] and [r[0] for r in short] == [-1, -1, -1, 0, 0]
    with pytest.raises(ValueError):
        labels.triple_barrier(0, F.lit(True), F.lit(1.0), F.lit(2.0))


def test_edges_of_buckets(spark):
    b = bars(spark, [1, 2], [1, 2], [1, 2], minutes=60)
    left = ordered(B.resample(b, 3600, "left", "right"), "timestamp")
    right = ordered(B.resample(b, 3600, "right", "right"), "timestamp")
    assert [x[0] for x in left] == [T0 + pd.Timedelta(hours=1), T0 + pd.Timedelta(hours=2)]
    assert [x[0] for x in right] == [T0, T0 + pd.Timedelta(hours=1)]


def test_minutes_become_a_quarter(spark):
    d = walk(3, 40)
    b = bars(spark, *[d[n].tolist() for n in ("high", "low", "close", "volume")], minutes=1)
    for i, r in enumerate(B.resample(b, 600).orderBy("timestamp").collect()):
        part = d[10 * i : 10 * i + 10]
        assert r["timestamp"] == T0 + pd.Timedelta(minutes=10 * (i + 1))
        assert (r["open"], r["high"], r["low"], r["close"], r["volume"]) == (part.close.iloc[0], part.high.max(), part.low.min(), part.close.iloc[-1], part.volume.sum())


def test_the_last_row_wins(spark):
    d = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 9)], "symbol string, n int, v int")
    assert sorted(map(tuple, B.keep_last(d, ["symbol"], ["n"]).select("symbol", "v").collect())) == [("a", 7), ("b", 9)]


def test_empty_bars(spark):
    empty = bars(spark, [1], [1], [1]).filter("false")
    assert I.with_adx(empty).count() == 0 and B.resample(empty, 60).count() == 0 and B.gaps(empty, 60).count() == 0
