"""Return-series analytics on Spark: metrics per key as DataFrame plans, trades to returns, reports."""

import sys

from pyspark import cloudpickle

from .config import MetricsConfig, TradeConfig, get_config, get_trade_config, reset_config, reset_trade_config, set_config, set_trade_config
from .errors import (
    BenchmarkMismatchError,
    EmptySeriesError,
    InsufficientDataError,
    InvalidDirectionError,
    InvalidFrequencyError,
    InvalidPriceError,
    InvalidTradeDataError,
    InvalidTradeTimesError,
    MetricsError,
    MissingColumnError,
)

# Functions of this package travel to executors by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "BenchmarkMismatchError", "EmptySeriesError", "InsufficientDataError", "InvalidDirectionError", "InvalidFrequencyError",
    "InvalidPriceError", "InvalidTradeDataError", "InvalidTradeTimesError", "MetricsConfig", "MetricsError", "MissingColumnError",
    "TradeConfig", "get_config", "get_trade_config", "reset_config", "reset_trade_config", "set_config", "set_trade_config",
]
