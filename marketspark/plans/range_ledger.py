"""The range strategy's simulated account: the part of a backtest that feeds back on itself.

Features, regimes and sessions are columns by the time a bar gets here; the kernel
holds cash, one position and open orders. One group per (run_id, symbol); a grid of
parameters is a grid of runs. What happens in a bar, in order: fills, orphaned
orders go, the account is marked, losses and limits are counted, a signal is made,
orders are placed for the next bar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.config import EngineConfig

EPS = 1e-9


def steps_down(x: float, step: float) -> float:
    return math.floor(x / step + EPS) * step if x > 0 else 0.0


def steps_up(x: float, step: float) -> float:
    return math.ceil(x / step - EPS) * step


@dataclass
class Order:
    number: int
    placed: object
    purpose: str  # entry, stop, target, exit
    sign: int
    kind: str  # market, stop, limit
    quantity: float
    price: float | None = None
    filled: float = 0.0

    @property
    def reduces(self) -> bool:
        return self.purpose != "entry"

    @property
    def priority(self) -> tuple[int, int]:
        return {"entry": 0, "stop": 1}.get(self.purpose, 2), self.number


@dataclass
class Account:
    config: EngineConfig
    cash: float
    sign: int = 0
    quantity: float = 0.0
    entry: float = 0.0
    held: int = 0
    realized: float = 0.0
    numbered: int = 0
    orders: list[Order] = field(default_factory=list)

    def place(self, placed, purpose: str, sign: int, kind: str, quantity: float, price: float | None = None) -> None:
        self.numbered += 1
        self.orders.append(Order(self.numbered, placed, purpose, sign, kind, quantity, price))

    def price_of(self, order: Order, bar, spread_bps: float) -> tuple[float, float] | None:
        """(fill price, price without costs), or None if the bar doesn't reach the order."""
        costs, tick = self.config.costs, self.config.instrument.tick_size
        market = bar.open * (1 + order.sign * (spread_bps / 2 + costs.slippage_bps) / 10_000)
        against = steps_up if order.sign > 0 else steps_down
        if order.kind == "market":
            return against(market, tick), bar.open * (1 + order.sign * spread_bps / 20_000)
        reached = bar.high >= order.price if (order.kind == "stop") == (order.sign > 0) else bar.low <= order.price
        if not reached:
            return None
        if order.kind == "stop":
            worse = max(order.price, market) if order.sign > 0 else min(order.price, market)
            return against(worse, tick), order.price
        better = min(order.price, market) if order.sign > 0 else max(order.price, market)
        return (steps_down if order.sign > 0 else steps_up)(better, tick), order.price

    def fill(self, bar, spread_bps: float) -> list[dict]:
        lot, costs = self.config.instrument.lot_size, self.config.costs
        volume, out = steps_down(bar.volume * costs.participation, lot), []
        for order in sorted((o for o in self.orders if o.placed < bar.timestamp), key=lambda o: o.priority):
            if volume <= 0:
                break
            if order.reduces and not self.sign:
                continue
            found = self.price_of(order, bar, spread_bps)
            if found is None:
                continue
            price, plain = found
            left = order.quantity - order.filled
            quantity = steps_down(min(left, volume, self.quantity if order.reduces else left), lot)
            if quantity <= 0:
                continue
            fee = quantity * costs.commission
            self.cash -= order.sign * price * quantity + fee
            self.book(order, price, quantity, bar.timestamp)
            order.filled += quantity
            volume -= quantity
            out.append({"purpose": order.purpose, "side": "buy" if order.sign > 0 else "sell", "price": price, "quantity": quantity, "commission": fee, "slippage": abs(price - plain) * quantity})
        self.orders = [o for o in self.orders if o.quantity - o.filled > EPS]
        if self.sign:
            self.held += 1
        return out

    def book(self, order: Order, price: float, quantity: float, at) -> None:
        if not self.sign:
            self.sign, self.quantity, self.entry, self.held = order.sign, quantity, price, 0
        elif order.sign == self.sign and not order.reduces:
            total = self.quantity + quantity
            self.entry = (self.entry * self.quantity + price * quantity) / total
            self.quantity = total
        else:
            closed = min(quantity, self.quantity)
            self.realized += self.sign * closed * (price - self.entry)
            self.quantity -= closed
            if self.quantity <= EPS:
                self.sign, self.quantity, self.held = 0, 0.0, 0

    def drop_orphans(self) -> None:
        if not self.sign and all(o.reduces for o in self.orders):
            self.orders.clear()

    def equity(self, close: float) -> float:
        return self.cash + self.sign * self.quantity * close


@dataclass
class Limits:
    """What the account may not lose, and what it has lost so far."""

    config: EngineConfig
    day: object = None
    week: object = None
    day_start: float = 0.0
    week_start: float = 0.0
    peak: float = 0.0
    losses: int = 0
    cooldown: int = 0
    realized: float = 0.0
    cause: str | None = None

    def mark(self, bar, equity: float, realized: float) -> None:
        risk = self.config.risk
        self.cooldown = max(0, self.cooldown - 1)
        if realized != self.realized:
            self.losses = self.losses + 1 if realized < self.realized else 0
            self.realized = realized
            if self.losses >= risk.max_consecutive_losses:
                self.cooldown = risk.cooldown_bars
        if not self.cooldown and self.losses >= risk.max_consecutive_losses:
            self.losses = 0
        if bar.session != self.day:
            self.day, self.day_start = bar.session, equity
        if bar.week != self.week:
            self.week, self.week_start = bar.week, equity
        self.peak = max(self.peak, equity)
        for cause, broken in (
            ("daily_loss", equity <= self.day_start * (1 - risk.max_daily_loss)),
            ("weekly_loss", equity <= self.week_start * (1 - risk.max_weekly_loss)),
            ("drawdown", self.peak > 0 and (self.peak - equity) / self.peak >= risk.max_drawdown),
        ):
            if broken and self.cause is None:
                self.cause = cause

    def blocked(self, equity: float, has_position: bool) -> str | None:
        risk = self.config.risk
        checks = (
            (self.cause is not None, "kill switch active"),
            (equity <= 0, "equity is zero"),
            (self.day_start <= 0 or equity <= self.day_start * (1 - risk.max_daily_loss), "daily loss limit"),
            (self.week_start <= 0 or equity <= self.week_start * (1 - risk.max_weekly_loss), "weekly loss limit"),
            (self.peak <= 0 or (self.peak - equity) / self.peak >= risk.max_drawdown, "strategy drawdown limit"),
            (int(has_position) >= risk.max_open_positions, "maximum open positions"),
            (int(has_position) >= risk.max_correlated_positions, "maximum correlated positions"),
            (self.losses >= risk.max_consecutive_losses, "consecutive loss limit"),
            (self.cooldown > 0, "cooldown active"),
        )
        return next((why for holds, why in checks if holds), None)


def exit_reason(config: EngineConfig, bar, account: Account, last_z: float | None) -> str | None:
    rules = config.range
    minutes = pd.Timedelta(minutes=rules.minutes_before_close)
    to_center = rules.fixed_target_fraction is None and account.sign * bar.z >= 0
    nearing = rules.partial_exit_enabled and abs(bar.z) <= 0.5 and last_z is not None and abs(last_z) > 0.5
    checks = (
        (bar.force_exit, bar.force_exit),
        (not bar.reliable, "data integrity compromised"),
        (bar.regime == "shock", "shock regime"),
        (rules.session_flatten and bar.timestamp >= bar.session_close - minutes, "session flatten"),
        (account.held >= rules.time_stop_bars, "time stop"),
        (to_center, "center reached"),
        (nearing, "partial center approach"),
    )
    return next((why for holds, why in checks if holds), None)


def entry_sign(config: EngineConfig, bar, cooldown: int) -> int:
    """1 long, -1 short, 0 none."""
    rules = config.range
    if rules.session_flatten:
        opens = bar.session_open + pd.Timedelta(minutes=rules.minutes_after_open)
        closes = bar.session_close - pd.Timedelta(minutes=rules.minutes_before_close)
        if not opens <= bar.timestamp < closes:
            return 0
    if cooldown > 0 or not bar.reliable or bar.regime != "range" or bar.spread_bps > rules.max_spread_bps:
        return 0
    if bar.z <= -rules.entry_z:
        return 1
    return -1 if rules.short_enabled and bar.z >= rules.entry_z else 0


def sized(config: EngineConfig, sign: int, entry: float, stop: float, spread_bps: float, equity: float, cash: float) -> tuple[float, str]:
    """(quantity, reason); the quantity is 0 unless the reason is "approved"."""
    it, risk, costs = config.instrument, config.risk, config.costs
    if it.max_leverage > 1:
        if not risk.allow_simulated_leverage:
            return 0.0, "reliable broker liquidation data is required for leveraged instruments"
        if 1 / it.max_leverage - risk.liquidation_buffer < 3 * abs(entry - stop) / entry:
            return 0.0, "simulated liquidation buffer is unsafe"
    if sign < 0 and not it.shortable:
        return 0.0, "short selling is disabled"
    if equity <= 0 or cash <= 0:
        return 0.0, "non-positive equity or buying power"
    if sign * (entry - stop) <= 0:
        return 0.0, "long stop must be below entry" if sign > 0 else "short stop must be above entry"
    budget = equity * risk.risk_per_trade
    unit = abs(entry - stop) * it.point_value + entry * (spread_bps + 2 * costs.slippage_bps) / 10_000 + 2 * costs.commission
    cap = min(risk.hard_notional_cap, equity * risk.target_exposure)
    quantity = steps_down(min(budget / unit, cash / entry, cap / entry), it.lot_size)
    if quantity < it.minimum_quantity:
        return 0.0, "quantity below instrument minimum"
    if quantity * entry < it.minimum_notional:
        return 0.0, "notional below instrument minimum"
    if quantity * unit > budget * (1 + EPS):
        return 0.0, "rounded risk exceeds budget"
    return quantity, "approved"


class Simulation:
    """One run over one symbol's bars; its state is the account, the limits and the last distance."""

    def __init__(self, config: EngineConfig, trade_after=None):
        self.config, self.trade_after = config, trade_after
        self.account = Account(config, config.costs.initial_equity)
        self.limits, self.last_z = Limits(config, peak=config.costs.initial_equity), None

    def step(self, bar) -> dict:
        """The bar's telemetry row, with its fills."""
        account, limits = self.account, self.limits
        fills = account.fill(bar, bar.spread_bps)
        account.drop_orphans()
        equity = account.equity(bar.close)
        limits.mark(bar, equity, account.realized)
        signal = detail = None
        if bar.usable and (self.trade_after is None or bar.timestamp > self.trade_after):
            signal, detail = self.act(bar, equity)
        self.last_z = None if bar.z is None or math.isnan(bar.z) else bar.z
        return {
            "timestamp": bar.timestamp,
            "close": bar.close,
            "regime": bar.regime,
            "equity": equity,
            "position": account.sign * account.quantity,
            "realized": account.realized,
            "signal": signal,
            "detail": detail,
            "kill_switch": limits.cause,
            "fills": fills,
        }

    def act(self, bar, equity: float) -> tuple[str | None, str | None]:
        """(signal, what became of it)."""
        config, account = self.config, self.account
        rules = config.range
        if account.sign:
            why = exit_reason(config, bar, account, self.last_z)
            if not why:
                return None, None
            partial = rules.partial_exit_enabled and abs(bar.z) <= 0.5
            quantity = steps_down(account.quantity / 2, config.instrument.lot_size) if partial else account.quantity
            if quantity > 0:
                account.place(bar.timestamp, "exit", -account.sign, "market", quantity)
            return "reduce" if partial else "exit", why if quantity > 0 else "Rounded exit quantity is zero"
        sign = entry_sign(config, bar, self.limits.cooldown)
        if not sign:
            return None, None
        if rules.fixed_stop_fraction is None:
            stop, target = bar.close - sign * rules.stop_atr * bar.atr, bar.center
        else:
            stop, target = bar.close * (1 - sign * rules.fixed_stop_fraction), bar.close * (1 + sign * rules.fixed_target_fraction)
        signal, detail = "enter_long" if sign > 0 else "enter_short", self.limits.blocked(equity, False)
        if detail is None:
            quantity, detail = sized(config, sign, bar.close, stop, bar.spread_bps, equity, max(0.0, account.cash))
            if quantity:
                account.place(bar.timestamp, "entry", sign, "market", quantity)
                account.place(bar.timestamp, "stop", -sign, "stop", quantity, stop)
                account.place(bar.timestamp, "target", -sign, "limit", quantity, target)
        return signal, detail


def simulate(bars: Iterator, config: EngineConfig, trade_after=None) -> Iterator[dict]:
    """One telemetry row per bar, with the bar's fills."""
    run = Simulation(config, trade_after)
    return map(run.step, bars)


FILL = "struct<purpose:string,side:string,price:double,quantity:double,commission:double,slippage:double>"
SCHEMA = f"run_id string, symbol string, timestamp timestamp, close double, regime string, equity double, position double, realized double, signal string, detail string, kill_switch string, fills array<{FILL}>"
NEEDED = ["open", "high", "low", "close", "volume", "spread_bps", "atr", "center", "z", "regime", "usable", "session", "week", "session_open", "session_close", "reliable", "force_exit"]
#: Runs that pass a symbol's bars together, so that its bars are shuffled once for all of them.
TOGETHER = 8


def gated(features: DataFrame, report: DataFrame, minimum_score: float = 1.0, mode: str = "fail") -> DataFrame:
    """The bars of symbols whose validation report passed with at least that score.

    Mode "fail": a symbol that didn't is an error that names it; "drop": its bars go;
    "flag": they stay, not ``reliable``, so that nothing is entered and positions go.
    A symbol without a report passes for none.
    """
    if mode not in ("fail", "drop", "flag"):
        raise ValueError("mode is 'fail', 'drop' or 'flag'")
    good = report.select("symbol", (F.col("passed") & (F.col("score") >= minimum_score)).alias("_good"))
    out = features.join(good, "symbol", "left").withColumn("_good", F.coalesce("_good", F.lit(False)))
    if mode == "flag":
        return out.withColumnRenamed("_good", "reliable") if "reliable" not in features.columns else out.withColumn("reliable", F.col("reliable") & F.col("_good")).drop("_good")
    if mode == "fail":
        told = F.raise_error(F.concat(F.lit("data quality is below the threshold: "), F.col("symbol"))).cast("boolean")
        return out.filter(F.when(F.col("_good"), True).otherwise(told)).drop("_good")
    return out.filter("_good").drop("_good")


def backtest(features: DataFrame, runs: Mapping[str, EngineConfig], trade_after=None) -> DataFrame:
    """Telemetry of every run over every symbol's bars (symbol, timestamp and NEEDED).

    ``reliable`` (default true) and ``force_exit`` (a reason; default none) are per
    bar. Bars up to ``trade_after``, a naive UTC time, warm up: orders are filled but
    nothing is decided.
    """
    runs = dict(runs)
    lots = [list(runs)[i : i + TOGETHER] for i in range(0, len(runs), TOGETHER)]

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        now, running, out = None, {}, []
        for frame in frames:
            for bar in frame.itertuples(index=False):
                if now != (bar.lot, bar.symbol):
                    now, running = (bar.lot, bar.symbol), {r: Simulation(runs[r], trade_after) for r in lots[bar.lot]}
                for run_id, run in running.items():
                    out.append({"run_id": run_id, "symbol": bar.symbol, **run.step(bar)})
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []

    has = set(features.columns)
    missing = {n: v for n, v in (("reliable", F.lit(True)), ("force_exit", F.lit(None).cast("string"))) if n not in has}
    rows = features.withColumns(missing) if missing else features
    rows = rows.select("symbol", "timestamp", *NEEDED).withColumn("lot", F.explode(F.array(*[F.lit(i) for i in range(len(lots))])))
    # bars pass in order, batch by batch: a task holds the state of a lot of runs, not a history
    return rows.repartition("lot", "symbol").sortWithinPartitions("lot", "symbol", "timestamp").mapInPandas(kernel, SCHEMA)


def summary(telemetry: DataFrame, initial: float) -> DataFrame:
    """Per run and symbol: final equity, net and gross result, fees, slippage, drawdown, fills, signals."""
    from pyspark.sql import Window

    by = Window.partitionBy("run_id", "symbol").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.max("equity").over(by), F.lit(initial))
    total = lambda name: F.aggregate("fills", F.lit(0.0), lambda s, x: s + x[name])
    rows = telemetry.withColumns({"_lost": F.try_divide(peak - F.col("equity"), peak), "_fees": total("commission"), "_slip": total("slippage"), "_n": F.size("fills")})
    got = rows.groupBy("run_id", "symbol").agg(
        F.max_by("equity", "timestamp").alias("final_equity"),
        F.sum("_fees").alias("fees"),
        F.sum("_slip").alias("slippage"),
        F.max("_lost").alias("max_drawdown"),
        F.sum("_n").alias("fills"),
        F.count("signal").alias("signals"),
        F.max(F.col("kill_switch").isNotNull()).alias("kill_switch"),
    )
    return got.withColumn("net_pnl", F.col("final_equity") - initial).withColumn("gross_pnl", F.col("net_pnl") + F.col("fees") + F.col("slippage"))
