"""Parameters, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path
from typing import Any


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class RangeConfig:
    """The range strategy's features, regimes and levels."""

    timeframe_minutes: int = 15
    atr_period: int = 14
    adx_period: int = 14
    ema_period: int = 50
    slope_lookback: int = 5
    percentile_window: int = 100
    vwap_window: int = 96
    max_spread_bps: float = 5.0
    atr_change_threshold: float = 0.5
    cumulative_move_atr: float = 3.0
    slope_threshold: float = 0.05
    confirmation_bars: int = 3
    entry_z: float = 1.5
    band_atr: float = 2.0
    stop_atr: float = 2.5
    time_stop_bars: int = 8
    short_enabled: bool = False
    partial_exit_enabled: bool = False
    session_flatten: bool = True
    minutes_after_open: int = 15
    minutes_before_close: int = 15
    fixed_stop_fraction: float | None = None
    fixed_target_fraction: float | None = None

    def __post_init__(self):
        _check(min(self.atr_period, self.adx_period, self.ema_period, self.percentile_window) >= 1, "periods are at least 1")
        _check(self.vwap_window >= 2, "vwap_window is at least 2")
        _check(self.confirmation_bars >= 1, "confirmation_bars is at least 1")
        _check((self.fixed_stop_fraction is None) == (self.fixed_target_fraction is None), "fixed stop and target go together")
        if self.fixed_stop_fraction is not None:
            _check(0 < self.fixed_stop_fraction == self.fixed_target_fraction < 1, "fixed stop and target are one share")


@dataclass(frozen=True)
class RiskLimits:
    """Limits of one account; shares of equity where not said otherwise."""

    risk_per_trade: float = 0.01
    max_daily_loss: float = 0.02
    max_weekly_loss: float = 0.10
    max_drawdown: float = 0.08
    max_open_positions: int = 1
    max_correlated_positions: int = 1
    max_consecutive_losses: int = 3
    cooldown_bars: int = 8
    hard_notional_cap: float = 25_000.0
    target_exposure: float = 1.0
    allow_simulated_leverage: bool = False
    liquidation_buffer: float = 0.01

    def __post_init__(self):
        for name in ("risk_per_trade", "max_daily_loss", "max_weekly_loss", "max_drawdown"):
            _check(0 < getattr(self, name) < 1, f"{name} is between 0 and 1")
        _check(self.max_daily_loss <= self.max_weekly_loss, "the weekly limit isn't below the daily one")


@dataclass(frozen=True)
class Instrument:
    symbol: str = "SYM"
    tick_size: float = 0.01
    lot_size: float = 1.0
    point_value: float = 1.0
    minimum_quantity: float = 1.0
    minimum_notional: float = 1.0
    shortable: bool = False
    max_leverage: float = 1.0

    def __post_init__(self):
        _check(min(self.tick_size, self.lot_size, self.point_value) > 0, "tick, lot and point value are positive")


@dataclass(frozen=True)
class Costs:
    initial_equity: float = 100_000.0
    spread_bps: float = 2.0
    slippage_bps: float = 1.0
    commission: float = 0.005
    participation: float = 0.10


@dataclass(frozen=True)
class MomentumConfig:
    """The momentum strategy's features, decisions and exits."""

    timeframe_minutes: int = 5
    atr_period: int = 14
    adx_period: int = 14
    fast_ema: int = 20
    slow_ema: int = 50
    volume_window: int = 20
    breakout_bars: int = 20
    vwap_window: int = 96
    minimum_adx: float = 25.0
    minimum_volume_z: float = 0.0
    minimum_momentum_atr: float = 1.5
    aggressive_momentum_atr: float = 2.5
    adaptive_enabled: bool = True
    adaptive_entry_z: float = 2.0
    adaptive_stop_atr: float = 1.25
    aggressive_reward: float = 1.6
    confirmed_reward: float = 1.75
    short_reward: float = 1.8
    retest_bars: int = 3
    retest_tolerance_atr: float = 0.25
    stop_buffer_atr: float = 0.25
    maximum_stop_atr: float = 1.5
    shock_candle_atr: float = 2.5
    shock_three_bar_atr: float = 4.0
    trailing_atr: float = 2.0
    time_stop_bars: int = 24
    short_time_stop_bars: int = 12
    short_enabled: bool = True

    def __post_init__(self):
        _check(self.fast_ema < self.slow_ema, "the fast mean is shorter than the slow one")
        _check(self.retest_bars >= 1 and self.breakout_bars >= 2, "windows are long enough")


@dataclass(frozen=True)
class PortfolioRisk:
    initial_equity: float = 100.0
    risk_per_trade: float = 0.0025
    early_entry_risk: float = 0.00125
    short_multiplier: float = 0.75
    hard_risk_cap: float = 0.003
    max_margin_fraction: float = 0.20
    leverage_ceiling: int = 3
    hard_notional_cap: float = 40.0
    portfolio_heat: float = 0.01
    round_trip_cost_bps: float = 20.0
    max_open_positions: int = 2
    max_daily_loss: float = 0.015
    max_weekly_loss: float = 0.04
    max_drawdown: float = 0.08
    max_consecutive_losses: int = 3
    cooldown_bars: int = 8

    def __post_init__(self):
        _check(0 < self.max_margin_fraction <= 1, "max_margin_fraction is a share")
        _check(self.leverage_ceiling in (1, 2, 3, 5), "leverage_ceiling is 1, 2, 3 or 5")
        _check(self.risk_per_trade <= self.hard_risk_cap, "risk per trade isn't above its cap")


@dataclass(frozen=True)
class UniverseLimits:
    minimum_listing_hours: float = 168.0
    minimum_quote_volume: float = 5_000_000.0
    maximum_spread_bps: float = 20.0
    preferred_spread_bps: float = 10.0
    depth_multiple: float = 20.0
    maximum_mark_divergence: float = 0.005
    side_check_funding: float = 0.001
    elevated_funding: float = 0.0005
    stale_stream_seconds: float = 5.0
    reduced_multiplier: float = 0.6
    minimum_liquidity: float = 0.75
    maximum_manipulation: float = 0.55
    minimum_p_win: float = 0.56
    minimum_short_p_win: float = 0.58
    minimum_expected_value_r: float = 0.0


@dataclass(frozen=True)
class EngineConfig:
    range: RangeConfig = field(default_factory=RangeConfig)
    risk: RiskLimits = field(default_factory=RiskLimits)
    instrument: Instrument = field(default_factory=Instrument)
    costs: Costs = field(default_factory=Costs)
    momentum: MomentumConfig = field(default_factory=MomentumConfig)
    portfolio: PortfolioRisk = field(default_factory=PortfolioRisk)
    universe: UniverseLimits = field(default_factory=UniverseLimits)


def load_config(path: str | Path, overrides: dict[str, Any] | None = None) -> EngineConfig:
    """From a YAML or JSON file with one section per part; unknown names are errors.

    ``overrides``: {"section.name": value}, taken last.
    """
    text = Path(path).read_text()
    try:
        import yaml

        said = yaml.safe_load(text) or {}
    except ImportError:
        import json

        said = json.loads(text)
    for name, value in (overrides or {}).items():
        section, _, key = name.partition(".")
        said.setdefault(section, {})[key] = value
    config = EngineConfig()
    parts = {f.name: getattr(config, f.name) for f in fields(config)}
    for section, values in said.items():
        if section not in parts:
            raise ValueError(f"unknown section {section!r}")
        known = {f.name for f in fields(parts[section])}
        if extra := set(values) - known:
            raise ValueError(f"unknown settings in {section!r}: {sorted(extra)}")
        parts[section] = replace(parts[section], **values)
    return EngineConfig(**parts)
