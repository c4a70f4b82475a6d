"""Defaults of the metrics. Read on the driver when a plan is built, never inside a task."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MetricsConfig:
    risk_free_rate: float = 0.0
    periods_per_year: int = 252
    frequency: str = "D"
    var_confidence: float = 0.95
    rolling_window: int = 252
    mar: float = 0.0
    ddof: int = 1


@dataclass(frozen=True)
class TradeConfig:
    method: str = "simple"
    include_fees: bool = True
    fill_gaps: bool = True
    initial_capital: float | None = None


_now = {"metrics": MetricsConfig(), "trades": TradeConfig()}


def get_config() -> MetricsConfig:
    return _now["metrics"]


def set_config(config: MetricsConfig) -> None:
    _now["metrics"] = config


def reset_config() -> None:
    _now["metrics"] = MetricsConfig()


def get_trade_config() -> TradeConfig:
    return _now["trades"]


def set_trade_config(config: TradeConfig) -> None:
    _now["trades"] = config


def reset_trade_config() -> None:
    _now["trades"] = TradeConfig()
