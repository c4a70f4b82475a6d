"""Round-trip trades to returns: per trade, per calendar bucket, or from a marked-to-market daily NAV.

The NAV is set-based: cash is a running sum of dated flows; a position's value is a running quantity
per symbol times the last price, found by carrying prices forward over the calendar.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import get_trade_config
from ..errors import EmptySeriesError, InsufficientDataError, InvalidDirectionError, InvalidPriceError, InvalidTradeTimesError, MissingColumnError
from ..functions.metrics import safe_div

PERIODS = {"D": 252, "W": 52, "M": 12}
UNITS = {"D": "day", "W": "week", "M": "month"}
DEFAULTS = {"quantity": 1.0, "direction": "long", "fees": 0.0}


@dataclass(frozen=True)
class Trade:
    """One round trip; without an exit it is open."""

    entry_time: datetime
    entry_price: float
    exit_time: datetime | None = None
    exit_price: float | None = None
    quantity: float = 1.0
    direction: str = "long"
    symbol: str | None = None
    fees: float = 0.0
    trade_id: str | None = None

    @property
    def is_closed(self) -> bool:
        return self.exit_time is not None and self.exit_price is not None

    @property
    def status(self) -> str:
        return "closed" if self.is_closed else "open"

    def single_return(self, method: str = "simple") -> float | None:
        """calculate_single_trade_return of a closed trade, None for an open one."""
        if not self.is_closed:
            return None
        return calculate_single_trade_return(self.entry_price, self.exit_price, direction=self.direction, fees=self.fees, quantity=self.quantity, method=method)


def calculate_single_trade_return(entry_price: float, exit_price: float, *, direction: str = "long", fees: float = 0.0, quantity: float = 1.0, method: str = "simple") -> float:
    """trade_return() for plain numbers; ValueError on prices that are not positive."""
    for name, price in (("entry_price", entry_price), ("exit_price", exit_price)):
        if not price > 0:
            raise ValueError(f"{name} has to be above 0")
    gross = math.log(exit_price / entry_price) if method == "log" else exit_price / entry_price - 1
    cost = fees / (entry_price * abs(quantity)) if fees > 0 and quantity else 0.0
    return (gross if direction == "long" else -gross) - cost


@dataclass
class TradeResult:
    returns: DataFrame
    periods_per_year: int
    summary: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)


def apply_column_defaults(df: DataFrame) -> DataFrame:
    """Adds missing optional columns and fills their nulls with the declared defaults."""
    out = {k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in DEFAULTS.items()}
    more = {k: F.lit(None).cast(t) for k, t in (("exit_time", "timestamp"), ("exit_price", "double"), ("symbol", "string")) if k not in df.columns}
    return df.withColumns(out | more)


def validate_trade_dataframe(df: DataFrame, *, require_exit: bool = False, times: bool = False) -> None:
    """Raises on missing columns, no rows, bad prices and directions and, with `times`, as validate_trade_times(); one pass over the rows."""
    need = ["entry_time", "entry_price"] + (["exit_time", "exit_price"] if require_exit else [])
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise MissingColumnError(f"missing: {', '.join(missing)}")
    bad_price = F.col("entry_price").isNull() | (F.col("entry_price") <= 0)
    if "exit_price" in df.columns:
        bad_price = bad_price | F.coalesce(F.col("exit_price") <= 0, F.lit(False))
    bad_side = ~F.col("direction").isin("long", "short") if "direction" in df.columns else F.lit(False)
    bad_times = F.col("exit_time") <= F.col("entry_time") if times and "exit_time" in df.columns else F.lit(False)
    n, prices, sides, late = df.agg(F.count("*"), F.count_if(bad_price), F.count_if(bad_side), F.count_if(bad_times)).first()
    if not n:
        raise EmptySeriesError("no trades")
    if prices:
        raise InvalidPriceError(f"{prices} prices are missing or not positive")
    if sides:
        raise InvalidDirectionError(f"{sides} directions are neither long nor short")
    if late:
        raise InvalidTradeTimesError(f"{late} trades end before they begin")


def validate_prices_dataframe(df: DataFrame, *, require_symbol: bool = False) -> None:
    missing = [c for c in ["date", "close"] + ["symbol"] * require_symbol if c not in df.columns]
    if missing:
        raise MissingColumnError(f"missing: {', '.join(missing)}")
    n, bad = df.agg(F.count("*"), F.count_if(F.col("close").isNull() | (F.col("close") <= 0))).first()
    if not n:
        raise EmptySeriesError("no prices")
    if bad:
        raise InvalidPriceError(f"{bad} prices are missing or not positive")


def validate_trade_times(df: DataFrame) -> None:
    bad = df.agg(F.count_if(F.col("exit_time") <= F.col("entry_time"))).first()[0]
    if bad:
        raise InvalidTradeTimesError(f"{bad} trades end before they begin")


def validate_min_trades(df: DataFrame, least: int, metric: str = "") -> None:
    n = df.count()
    if n < least:
        raise InsufficientDataError(least, n, metric)


def validate_initial_capital(capital: float | None, aggregation: str) -> None:
    if aggregation == "equity" and (capital is None or capital <= 0):
        raise ValueError("equity needs a positive initial_capital")


def sign(direction: Column) -> Column:
    return F.when(direction == "long", 1.0).otherwise(-1.0)


def trade_return(entry, exit_, direction, fees, quantity, method: str = "simple") -> Column:
    gross = F.log(exit_ / entry) if method == "log" else (exit_ - entry) / entry
    cost = F.when(fees > 0, safe_div(fees, entry * F.abs(quantity))).otherwise(0.0)
    return sign(direction) * gross - cost


def calculate_pnl(entry, exit_, quantity, direction, fees) -> Column:
    return sign(direction) * (exit_ - entry) * quantity - fees


def calculate_unrealized_pnl(entry, price, quantity, direction) -> Column:
    return sign(direction) * (price - entry) * quantity


def filter_closed_trades(df: DataFrame) -> DataFrame:
    return df.where(F.col("exit_time").isNotNull() & F.col("exit_price").isNotNull())


def configured(**given) -> list:
    """The values given, those of the trade configuration in place of None."""
    return [getattr(get_trade_config(), k) if v is None else v for k, v in given.items()]


def trade_returns(trades: DataFrame, *, method: str | None = None, include_fees: bool | None = None) -> DataFrame:
    """Closed trades with `trade_return`; what is None is taken from the trade configuration."""
    method, include_fees = configured(method=method, include_fees=include_fees)
    d = filter_closed_trades(apply_column_defaults(trades))
    fees = F.col("fees") if include_fees else F.lit(0.0)
    return d.withColumn("trade_return", trade_return(F.col("entry_price"), F.col("exit_price"), F.col("direction"), fees, F.col("quantity"), method))


def calendar(df: DataFrame, low: Column, high: Column, unit: str = "day") -> DataFrame:
    s = df.agg(low.alias("a"), high.alias("b")).where("a is not null")
    return s.select(F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("date"))


def build_equity_curve(trades: DataFrame, initial_capital: float, prices: DataFrame | None = None) -> DataFrame:
    """Daily date, cash, position_value, nav, daily_return (the first is 0).

    Half of the fee is paid on each side. With prices, an open position counts at its symbol's last
    price up to the day, or at cost while there is none; without, at cost. A trade counts from its entry
    day up to, not with, its exit day. Duplicate prices of a day: the largest is taken.
    """
    t = apply_column_defaults(trades).withColumn("s", sign(F.col("direction")))
    closed = F.col("exit_time").isNotNull() & F.col("exit_price").isNotNull()
    t = t.withColumns({"d0": F.to_date("entry_time"), "d1": F.when(closed, F.to_date("exit_time"))})
    half = F.col("fees") / 2
    cost = F.col("entry_price") * F.col("quantity") * F.col("s")
    with_symbol = prices is not None and "symbol" in prices.columns
    sym = F.coalesce(F.col("symbol"), F.lit("")) if with_symbol else F.lit("")
    opened = t.select(F.col("d0").alias("date"), sym.alias("symbol"), (-cost - half).alias("cash"), (F.col("s") * F.col("quantity")).alias("qty"), cost.alias("cost"))
    shut = t.where(F.col("d1").isNotNull()).select(
        F.col("d1").alias("date"), sym.alias("symbol"), (F.col("s") * F.col("exit_price") * F.col("quantity") - half).alias("cash"), (-F.col("s") * F.col("quantity")).alias("qty"), (-cost).alias("cost")
    )
    flows = opened.union(shut)
    days = calendar(t, F.min("d0"), F.max(F.greatest("d0", "d1")))
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    cash = flows.groupBy("date").agg(F.sum("cash").alias("flow"))
    daily = days.join(cash, "date", "left").select("date", (F.sum(F.coalesce("flow", F.lit(0.0))).over(run) + initial_capital).alias("cash"))
    by = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    held = flows.groupBy("date", "symbol").agg(F.sum("qty").alias("qty"), F.sum("cost").alias("cost"))
    # each symbol's days from its first flow to the last day of all; `end` is one row
    end = days.agg(F.max("date").alias("end"))
    own = flows.groupBy("symbol").agg(F.min("date").alias("first")).crossJoin(F.broadcast(end))
    own = own.select("symbol", F.explode(F.sequence("first", "end")).alias("date"))
    grid = own.join(held, ["date", "symbol"], "left")
    value: Column = F.col("held_cost")
    if prices is not None:
        p = prices.select(F.to_date("date").alias("date"), (F.coalesce(F.col("symbol"), F.lit("")) if with_symbol else F.lit("")).alias("symbol"), "close")
        p = p.groupBy("date", "symbol").agg(F.max("close").alias("close"))
        # prices before the first day count too: they come in as rows of their own
        grid = grid.join(p, ["date", "symbol"], "full")
        value = F.coalesce(F.col("held_qty") * F.last("close", ignorenulls=True).over(by), F.col("held_cost"))
    grid = grid.withColumns({"held_qty": F.sum(F.coalesce("qty", F.lit(0.0))).over(by), "held_cost": F.sum(F.coalesce("cost", F.lit(0.0))).over(by)})
    worth = grid.withColumn("v", value).groupBy("date").agg(F.sum("v").alias("position_value"))
    nav = daily.join(worth, "date", "left").withColumn("position_value", F.coalesce("position_value", F.lit(0.0)))
    nav = nav.withColumn("nav", F.col("cash") + F.col("position_value"))
    before = F.lag("nav").over(Window.orderBy("date"))
    return nav.withColumn("daily_return", F.coalesce(safe_div(F.col("nav") - before, before), F.lit(0.0)))


def build_equity_curve_no_mtm(trades: DataFrame, initial_capital: float) -> DataFrame:
    return build_equity_curve(trades, initial_capital)


def trades_to_returns(trades: DataFrame, *, prices: DataFrame | None = None, aggregation: str = "trade", initial_capital: float | None = None, method: str | None = None, include_fees: bool | None = None, fill_gaps: bool | None = None, trades_per_year: int | None = None) -> TradeResult:
    """aggregation: trade, equity, D, W or M. returns has (date, returns), and a row's trade columns in mode trade.

    What is None is taken from the trade configuration.
    """
    initial_capital, method, include_fees, fill_gaps = configured(initial_capital=initial_capital, method=method, include_fees=include_fees, fill_gaps=fill_gaps)
    validate_trade_dataframe(trades, require_exit=aggregation != "equity", times=True)
    validate_initial_capital(initial_capital, aggregation)
    if prices is not None:
        validate_prices_dataframe(prices)
    d = apply_column_defaults(trades)
    if not include_fees:
        d = d.withColumn("fees", F.lit(0.0))
    each = trade_returns(d, method=method, include_fees=True)  # left out above, if so
    summary = each.agg(
        F.count("*").alias("n_trades"), F.count_if(F.col("trade_return") > 0).alias("n_winning"),
        F.count_if(F.col("trade_return") < 0).alias("n_losing"), F.sum("fees").alias("total_fees"),
    )
    if aggregation == "trade":
        notes = [] if trades_per_year else ["252 trades a year are assumed"]
        return TradeResult(each.withColumn("date", F.col("exit_time")).withColumn("returns", F.col("trade_return")), trades_per_year or 252, summary, notes)
    if aggregation == "equity" or (aggregation in UNITS and initial_capital):
        curve = build_equity_curve(d, initial_capital, prices).select("date", F.col("daily_return").alias("returns"))
        notes = [] if prices is not None else ["no prices: open positions count at cost"]
        if method == "log":
            notes.append("method log holds for single trades; returns of the daily NAV are simple")
        if aggregation == "equity":
            return TradeResult(curve, 252, summary, notes)
        bucket = F.trunc("date", UNITS[aggregation]) if aggregation != "D" else F.col("date")
        r = curve.groupBy(bucket.alias("date")).agg((F.product(1 + F.col("returns")) - 1).alias("returns"))
        return TradeResult(r, PERIODS[aggregation], summary, notes)
    if aggregation not in UNITS:
        raise ValueError(f"unknown aggregation {aggregation}")
    bucket = F.to_date("exit_time") if aggregation == "D" else F.trunc("exit_time", UNITS[aggregation])
    r = each.groupBy(bucket.alias("date")).agg((F.product(1 + F.col("trade_return")) - 1).alias("returns"))
    if fill_gaps:
        days = calendar(r, F.min("date"), F.max("date"), UNITS[aggregation])
        r = days.join(r, "date", "left").withColumn("returns", F.coalesce("returns", F.lit(0.0)))
    notes = ["prices need an initial_capital and are not used"] if prices is not None else []
    return TradeResult(r, PERIODS[aggregation], summary, notes)
