"""The momentum strategy: decisions per symbol, and a portfolio over all symbols.

``decisions`` runs the retest state machine of each symbol; ``dataset`` labels its
entries with windows. ``portfolio`` is one group per run, because positions share
equity and heat; a parameter grid is a grid of runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.config import EngineConfig, MomentumConfig, PortfolioRisk
from marketspark.operators.indicators import lagged_change
from marketspark.operators.labels import triple_barrier
from marketspark.operators.regime import COARSE, MOMENTUM_FEATURES
from marketspark.plans.range_ledger import EPS, steps_down


@dataclass(frozen=True)
class Watch:
    """A breakout that waits for its retest."""

    sign: int = 0
    level: float = 0.0
    bars: int = 0


NOTHING = Watch()


@dataclass(frozen=True)
class Decision:
    action: str
    reason: str
    stop: float | None = None
    target: float | None = None
    strategy: str = "breakout_retest"

    @property
    def sign(self) -> int:
        return {"enter_long": 1, "enter_short": -1}.get(self.action, 0)


def decide(row, watch: Watch, config: MomentumConfig) -> tuple[Decision, Watch]:
    """What a symbol without a position does at a bar whose momentum regime is known."""
    if row.warming:
        return Decision("reject", "indicators_warming_up"), watch
    if row.shock:
        return Decision("reject", "panic_or_vertical_candle"), NOTHING
    if watch.sign:
        return _retest(row, watch, config)
    close, atr, regime = row.close, row.atr, row.momentum_regime
    if config.adaptive_enabled and regime == "sideways" and abs(row.adaptive_z) >= config.adaptive_entry_z:
        distance = config.adaptive_stop_atr * atr
        sign = 1 if row.adaptive_z < 0 else -1
        if abs(row.adaptive_center - close) >= config.aggressive_reward * distance:
            return Decision(_enter(sign), "adaptive_range_mean_reversion", close - sign * distance, row.adaptive_center, "adaptive_range"), NOTHING
    loud = row.volume_zscore >= config.minimum_volume_z
    if loud and regime in ("bullish_expansion", "euphoric_pump") and row.momentum_atr >= config.minimum_momentum_atr and close > row.breakout_high:
        early = row.momentum_atr >= config.aggressive_momentum_atr
        reason = "aggressive_long_waiting_external_context_and_consolidation" if early else "long_breakout_waiting_retest"
        return Decision("watch", reason), Watch(1, row.breakout_high)
    if config.short_enabled and loud and regime in ("distribution", "bearish_expansion") and row.momentum_atr <= -config.minimum_momentum_atr and close < row.breakout_low:
        return Decision("watch", "short_breakout_waiting_retest"), Watch(-1, row.breakout_low)
    if regime == "bullish_expansion" and loud and row.low <= row.ema_fast_5m < close and close > row.previous_close:
        stop = row.low - config.stop_buffer_atr * atr
        risk = close - stop
        if 0 < risk <= config.maximum_stop_atr * atr:
            return Decision("enter_long", "momentum_pullback_confirmed", stop, close + config.confirmed_reward * risk, "momentum_pullback"), NOTHING
    return Decision("hold", "no_breakout"), watch


def _enter(sign: int) -> str:
    return "enter_long" if sign > 0 else "enter_short"


def _retest(row, watch: Watch, config: MomentumConfig) -> tuple[Decision, Watch]:
    bars, sign = watch.bars + 1, watch.sign
    if bars > config.retest_bars:
        return Decision("reject", "retest_expired_or_shock"), NOTHING
    edge = row.low if sign > 0 else row.high
    near = abs(edge - watch.level) <= config.retest_tolerance_atr * row.atr + EPS
    if not (near and sign * (row.close - watch.level) > 0):
        return Decision("watch", "waiting_retest_confirmation"), replace(watch, bars=bars)
    stop = edge - sign * config.stop_buffer_atr * row.atr
    risk = abs(row.close - stop)
    if not 0 < risk <= config.maximum_stop_atr * row.atr + EPS:
        return Decision("reject", "invalid_stop_distance"), NOTHING
    reward = config.confirmed_reward if sign > 0 else config.short_reward
    return Decision(_enter(sign), "breakout_retest_confirmed", stop, row.close + sign * reward * risk), NOTHING


@dataclass(frozen=True)
class Managed:
    """What is remembered of a position between bars."""

    entry: float
    risk: float
    best: float | None = None
    one_r_hit: bool = False
    trailing: float | None = None


def manage(row, sign: int, bars_held: int, position: Managed, config: MomentumConfig) -> tuple[Decision, Managed]:
    """What the strategy says at a bar of a position that is held: exit, reduce at one risk unit, or hold with its stop."""
    if row.shock:
        return Decision("exit", "shock_exit"), position
    if bars_held >= config.time_stop_bars:
        return Decision("exit", "time_stop"), position
    if position.risk <= 0:
        return Decision("exit", "missing_protective_stop"), position
    farther = max if sign > 0 else min
    reached = row.high if sign > 0 else row.low
    best = farther(position.entry if position.best is None else position.best, reached)
    moved = replace(position, best=best)
    if not position.one_r_hit:
        if sign * (reached - position.entry) >= position.risk:
            return Decision("reduce", "one_r_partial", position.entry), replace(moved, one_r_hit=True, trailing=position.entry)
        return Decision("hold", "position_managed", position.trailing), moved
    trail = farther(position.entry, best - sign * config.trailing_atr * row.atr)
    moved = replace(moved, trailing=farther(position.entry if position.trailing is None else position.trailing, trail))
    return Decision("hold", "position_managed", moved.trailing), moved


def prepared(features: DataFrame, config: MomentumConfig) -> DataFrame:
    """Adds warming, shock, momentum_regime and regime to the momentum features."""
    from marketspark.operators.regime import any_missing, coarse_regime, is_shock, momentum_regime

    return features.withColumns(
        {"warming": any_missing(), "shock": F.coalesce(is_shock(config), F.lit(False)), "momentum_regime": momentum_regime(config)}
    ).withColumn("regime", coarse_regime("momentum_regime"))


ROW = ["symbol", "timestamp", "open", "high", "low", "close", "warming", "shock", "momentum_regime", "regime", *MOMENTUM_FEATURES]
DECISION = "symbol string, timestamp timestamp, close double, action string, reason string, strategy string, stop double, target double, momentum_regime string"


def decisions(features: DataFrame, config: MomentumConfig) -> DataFrame:
    """A decision per bar of every symbol, as if no position were ever held."""

    def kernel(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        watch, out = NOTHING, []
        for row in frame.sort_values("timestamp", kind="stable").itertuples(index=False):
            decision, watch = decide(row, watch, config)
            out.append((row.symbol, row.timestamp, row.close, decision.action, decision.reason, decision.strategy, decision.stop, decision.target, row.momentum_regime))
        return pd.DataFrame(out, columns=[c.split()[0] for c in DECISION.split(", ")])

    return prepared(features, config).select(*ROW).groupBy("symbol").applyInPandas(kernel, DECISION)


def dataset(features: DataFrame, qualities: DataFrame, config: MomentumConfig) -> DataFrame:
    """The entries' features and triple-barrier labels, for symbols with known funding."""
    entries = decisions(features, config).filter(F.col("action").isin("enter_long", "enter_short"))
    entries = entries.select("symbol", "timestamp", "action", "stop", "target")
    rows = features.join(entries, ["symbol", "timestamp"], "left")
    is_buy = F.col("action") == "enter_long"
    rows = rows.withColumns(
        {
            "label": triple_barrier(config.time_stop_bars, is_buy, F.col("stop"), F.col("target")),
            "return_5m": lagged_change("close", 1),
            "return_15m": lagged_change("close", 3),
            "return_1h": lagged_change("close", 12),
        }
    ).filter("action is not null")
    known = qualities.filter("funding_8h is not null").select("symbol", "spread_bps", "depth", "funding_8h", "mark_divergence", "quality_risk")
    return rows.join(known, "symbol").select(
        "timestamp", "symbol", F.when(is_buy, "buy").otherwise("sell").alias("side"), "return_5m", "return_15m", "return_1h",
        (F.col("atr") / F.col("close")).alias("atr_normalized"), "volume_zscore", "range_atr", "three_bar_atr",
        ((F.col("ema_fast_1h") - F.col("ema_slow_1h")) / F.col("close")).alias("ema_spread_1h"), "ema_slope_1h", "adx_1h",
        "spread_bps", "depth", "funding_8h", "mark_divergence", "quality_risk", "label",
    )


@dataclass(frozen=True)
class Held:
    symbol: str
    sign: int
    quantity: float
    initial: float
    entry: float
    stop: float
    target: float
    unit_risk: float
    risk_amount: float
    leverage: int
    opened: object
    lot: float
    best: float
    stage: int = 0
    bars: int = 0


class Portfolio:
    """Equity shared by up to ``max_open_positions`` positions; one entry waits for the next bar."""

    def __init__(self, config: EngineConfig, contracts: Mapping[str, Mapping], ranks: Mapping[str, tuple[int, float]], gates: Mapping[str, tuple[float | None, str]] | None = None):
        self.rules, self.risk, self.contracts, self.ranks, self.gates = config.momentum, config.portfolio, contracts, ranks, gates or {}
        self.equity = self.peak = self.day_start = self.week_start = config.portfolio.initial_equity
        self.realized = self.fees = 0.0
        self.held: dict[str, Held] = {}
        self.pending = None
        self.watches: dict[str, Watch] = {}
        self.cooldown = self.losses = 0
        self.day = self.week = None
        self.log: list[dict] = []

    def fee(self, notional: float) -> float:
        """Half of a round trip. What entries pay is summed in ``fees``; exits are in the equity only."""
        return notional * self.risk.round_trip_cost_bps / 20_000

    def marked(self, rows: Mapping) -> float:
        return self.equity + sum(p.sign * p.quantity * (rows[s].close - p.entry) for s, p in self.held.items() if s in rows)

    def note(self, moment, symbol: str, what: str, quantity: float = 0.0, price: float | None = None, detail: str = "") -> None:
        self.log.append({"timestamp": moment, "symbol": symbol, "event": what, "quantity": quantity, "price": price, "equity": self.equity, "detail": detail})

    def enter(self, moment, row) -> None:
        symbol, decision, multiplier = self.pending
        risk, contract = self.risk, self.contracts[symbol]
        price = row.open * (1 + decision.sign * 0.0005)
        unit = abs(price - decision.stop) + price * risk.round_trip_cost_bps / 10_000
        share = risk.early_entry_risk if decision.reason.startswith("aggressive_") else risk.risk_per_trade
        share *= risk.short_multiplier if decision.sign < 0 else 1.0
        heat = max(0.0, self.equity * risk.portfolio_heat - sum(p.risk_amount for p in self.held.values()))
        budget = min(self.equity * min(share, risk.hard_risk_cap) * min(1.0, multiplier), heat)
        most = min(risk.hard_notional_cap, self.equity * risk.max_margin_fraction * risk.leverage_ceiling)
        quantity = steps_down(min(budget / unit, most / price), contract["lot_size"]) if budget > 0 and unit > 0 else 0.0
        notional = quantity * price
        ceiling = min(risk.leverage_ceiling, int(contract["maximum_leverage"]))
        margin = self.equity * risk.max_margin_fraction
        leverage = next((x for x in (1, 2, 3, 5) if x <= ceiling and notional / x <= margin), None) if ceiling in (1, 2, 3, 5) and notional > 0 else None
        if leverage is None or quantity < contract["minimum_quantity"] or notional < contract["minimum_notional"]:
            self.note(moment, symbol, "REJECT", detail="risk_or_margin_rejected")
            return
        fee = self.fee(notional)
        self.equity -= fee
        self.fees += fee
        self.held[symbol] = Held(symbol, decision.sign, quantity, quantity, price, decision.stop, decision.target, abs(price - decision.stop), quantity * unit, leverage, moment, contract["lot_size"], price)
        self.note(moment, symbol, "OPEN", quantity, price, decision.reason)

    def close(self, p: Held, quantity: float, price: float, moment, why: str) -> Held | None:
        self.equity += p.sign * quantity * (price - p.entry) - self.fee(price * quantity)
        left = p.quantity - quantity
        self.note(moment, p.symbol, why, quantity, price, why.lower())
        return replace(p, quantity=left, risk_amount=p.risk_amount * left / p.quantity) if left > EPS else None

    def manage(self, p: Held, row, moment) -> Held | None:
        """At most one action in a bar: stop, first target, second target, time stop; else the stop may trail."""
        up = p.sign > 0
        if (row.low <= p.stop) if up else (row.high >= p.stop):
            return self.close(p, p.quantity, min(row.open, p.stop) if up else max(row.open, p.stop), moment, "STOP")
        reached = lambda level: row.high >= level if up else row.low <= level
        quarter = min(steps_down(p.initial * 0.25, p.lot) or p.quantity, p.quantity)
        first = p.entry + (p.unit_risk if up else -0.75 * p.unit_risk)
        if p.stage == 0 and reached(first):
            left = self.close(p, quarter, first, moment, "TAKE_PROFIT_1")
            return left and replace(left, stage=1, stop=left.entry)
        if p.stage == 1 and reached(p.target):
            left = self.close(p, quarter, p.target, moment, "TAKE_PROFIT_2")
            return left and replace(left, stage=2)
        bars = p.bars + 1
        if bars >= (self.rules.time_stop_bars if up else self.rules.short_time_stop_bars):
            return self.close(p, p.quantity, row.close, moment, "TIME_STOP")
        if p.stage:
            best = max(p.best, row.high) if up else min(p.best, row.low)
            trail = best - p.sign * self.rules.trailing_atr * row.atr
            if not math.isnan(trail):
                p = replace(p, best=best, stop=max(p.stop, trail) if up else min(p.stop, trail))
        return replace(p, bars=bars)

    def step(self, moment, rows: Mapping) -> float:
        risk = self.risk
        day, week = moment.date(), tuple(moment.isocalendar())[:2]
        if day != self.day:
            self.day, self.day_start = day, self.marked(rows)
        if week != self.week:
            self.week, self.week_start = week, self.marked(rows)
        self.cooldown = max(0, self.cooldown - 1)
        if self.pending and self.pending[0] in rows:
            self.enter(moment, rows[self.pending[0]])
            self.pending = None
        for symbol, p in list(self.held.items()):
            if symbol not in rows or moment <= p.opened:
                continue
            before, after = self.equity, self.manage(p, rows[symbol], moment)
            if after is not None:
                self.held[symbol] = after
                continue
            del self.held[symbol]
            gained = self.equity - before
            if gained:
                self.realized += gained
                self.losses = self.losses + 1 if gained < 0 else 0
                if self.losses >= risk.max_consecutive_losses:
                    self.cooldown = risk.cooldown_bars
                self.watches.clear()
        marked = self.marked(rows)
        self.peak = max(self.peak, marked)
        lost = marked <= max(self.day_start * (1 - risk.max_daily_loss), self.week_start * (1 - risk.max_weekly_loss), self.peak * (1 - risk.max_drawdown))
        options = []
        for symbol, row in rows.items():
            if symbol in self.held:
                continue
            decision, self.watches[symbol] = decide(row, self.watches.get(symbol, NOTHING), self.rules)
            if decision.action in ("watch", "reject") and decision.reason != "indicators_warming_up":
                self.note(moment, symbol, decision.action.upper(), detail=decision.reason)
            if decision.sign and symbol in self.ranks:
                options.append((self.ranks[symbol][0], symbol, decision))
        if options and self.pending is None and len(self.held) < risk.max_open_positions and not lost and not self.cooldown:
            _, symbol, decision = min(options, key=lambda o: o[0])
            multiplier, why = self.gates.get(symbol, (1.0, ""))
            if multiplier is None:
                self.note(moment, symbol, "REJECT", detail=why)
                return marked
            self.pending = (symbol, decision, min(self.ranks[symbol][1], multiplier))
            self.note(moment, symbol, "ORDER_CREATED", detail="fill_not_before_next_candle")
        return marked


EVENT = "struct<symbol:string,event:string,quantity:double,price:double,equity:double,detail:string>"
SCHEMA = f"run_id string, timestamp timestamp, equity double, realized double, fees double, open_positions int, events array<{EVENT}>"


def portfolio(
    features: DataFrame, contracts: Mapping[str, Mapping], ranks: Mapping[str, tuple[int, float]], runs: Mapping[str, EngineConfig], gates: Mapping[str, tuple[float | None, str]] | None = None
) -> DataFrame:
    """Per run and timestamp: marked equity, realized result, entry fees, open positions and events.

    ``contracts``: lot_size, minimum_quantity, minimum_notional, maximum_leverage by
    symbol. ``ranks``: (rank, risk multiplier) of the eligible symbols. ``gates``, of
    symbols whose entries are reviewed (``risk.entry_gate``): the review's risk
    multiplier, or none and the reason against the entry. A replay has no gates.
    """
    runs, contracts, ranks, gates = dict(runs), dict(contracts), dict(ranks), dict(gates or {})

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["run_id", "timestamp", "equity", "realized", "fees", "open_positions", "events"]
        book = run_id = None
        out = []
        for (run, moment), group in groupby((row for frame in frames for row in frame.itertuples(index=False)), key=lambda r: (r.run_id, r.timestamp)):
            if run != run_id:
                run_id, book = run, Portfolio(runs[run], contracts, ranks, gates)
            book.log = []
            equity = book.step(moment, {r.symbol: r for r in group})
            out.append((run, moment, equity, book.realized, book.fees, len(book.held), [{k: v for k, v in e.items() if k != "timestamp"} for e in book.log]))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    known = features.filter(F.col("symbol").isin(list(contracts)))
    alike: dict[MomentumConfig, list[str]] = {}
    for run, config in runs.items():
        alike.setdefault(config.momentum, []).append(run)
    # what depends on the configuration is worked out once for each
    parts = [prepared(known, config).select(*ROW).withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in names]))) for config, names in alike.items()]
    rows = reduce(DataFrame.unionByName, parts)
    # a run passes in order, batch by batch: its state is all that a task holds
    return rows.repartition("run_id").sortWithinPartitions("run_id", "timestamp", "symbol").mapInPandas(kernel, SCHEMA)


__all__ = ["COARSE", "Decision", "Managed", "Portfolio", "PortfolioRisk", "Watch", "dataset", "decide", "decisions", "manage", "portfolio", "prepared"]
