"""`of(df, key)`: every metric of a keyed return series by name, each a DataFrame with a row per key or per row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..operators import ordered as o
from . import report


@dataclass(frozen=True)
class Series:
    """A return series for each value of `key`: r in the order of t, b a benchmark of the same rows.

    Metrics that need no order are also reached as attributes by their name in functions.metrics:
    `of(df, ["symbol"]).sharpe(ppy=365)` has the columns symbol and sharpe. Several in one pass: `select`.
    """

    df: DataFrame
    key: list[str]
    t: str = "t"
    r: str = "r"
    b: str | None = None

    def __getattr__(self, name: str):
        against = name in m.BENCHMARK
        f = m.BENCHMARK.get(name) or m.BASIC.get(name)
        if f is None:
            raise AttributeError(name)
        if against and self.b is None:
            raise ValueError(f"{name} needs a benchmark column")
        args = (self.r, self.b) if against else (self.r,)
        return lambda **options: o.clean(self.df, self.r).groupBy(*self.key).agg(f(*args, **options).alias(name))

    def select(self, *names: str) -> DataFrame:
        """Order-free metrics by name, in one aggregation."""
        cols = [m.BENCHMARK[n](self.r, self.b) if n in m.BENCHMARK else m.BASIC[n](self.r) for n in names]
        return o.clean(self.df, self.r).groupBy(*self.key).agg(*(c.alias(n) for c, n in zip(cols, names, strict=True)))

    def _of(self, wanted: tuple[str, ...], **options) -> DataFrame:
        full = report.full_metrics(self.df, self.key, self.t, self.r, self.b, **options)
        return full.select(*self.key, *(n for n in wanted if n in full.columns))

    def expected_return(self) -> DataFrame:
        return self.select("avg_return").withColumnRenamed("avg_return", "expected_return")

    def cvar(self, **options) -> DataFrame:
        return o.cvar(self.df, self.key, self.r, **options).select(*self.key, "cvar")

    def max_drawdown(self) -> DataFrame:
        return o.drawdown_stats(self.df, self.key, self.t, self.r).select(*self.key, "max_drawdown")

    def ulcer_index(self) -> DataFrame:
        return o.drawdown_stats(self.df, self.key, self.t, self.r).select(*self.key, "ulcer_index")

    def consecutive_wins(self) -> DataFrame:
        return o.streaks(self.df, self.key, self.t, self.r).select(*self.key, "consecutive_wins")

    def consecutive_losses(self) -> DataFrame:
        return o.streaks(self.df, self.key, self.t, self.r).select(*self.key, "consecutive_losses")

    def calmar(self, **options) -> DataFrame:
        return self._of(("calmar",), shapiro=False, **options)

    def ulcer_performance_index(self, **options) -> DataFrame:
        return self._of(("ulcer_performance_index",), shapiro=False, **options)

    def recovery_factor(self) -> DataFrame:
        return self._of(("recovery_factor",), shapiro=False)

    def smart_sharpe(self, **options) -> DataFrame:
        return self._of(("smart_sharpe",), shapiro=False, **options)

    def smart_sortino(self, **options) -> DataFrame:
        return self._of(("smart_sortino",), shapiro=False, **options)

    def serenity_index(self, **options) -> DataFrame:
        return self._of(("serenity_index",), shapiro=False, **options)

    def outlier_win_ratio(self, *, quantile: float = 0.99) -> DataFrame:
        return self._of(("outlier_win_ratio",), shapiro=False, quantile=quantile)

    def outlier_loss_ratio(self, *, quantile: float = 0.99) -> DataFrame:
        return self._of(("outlier_loss_ratio",), shapiro=False, quantile=quantile)

    def k_ratio(self) -> DataFrame:
        return o.k_ratio(self.df, self.key, self.t, self.r)

    def with_benchmark(self, benchmark: DataFrame, b: str = "b") -> Series:
        """This series with a benchmark that has rows of its own, aligned by time (and by the key's columns that it has)."""
        return Series(o.aligned(self.df, benchmark, self.key, self.t, b), self.key, self.t, self.r, b)

    def greeks(self, **options) -> DataFrame:
        """alpha and beta."""
        args = (self.r, self.b)
        return o.clean(self.df, self.r).groupBy(*self.key).agg(m.alpha(*args, **options).alias("alpha"), m.beta(*args).alias("beta"))

    def probabilistic_sharpe_ratio(self, benchmark_sr: float = 0.0, **options) -> DataFrame:
        """psr and p_value; null below three values."""
        z = F.when(m.n(self.r) >= 3, m.psr_z(self.r, benchmark_sr, **options))
        d = o.clean(self.df, self.r).groupBy(*self.key).agg(z.alias("psr_z"))
        return d.select(*self.key, m.phi(F.col("psr_z")).alias("psr"), (1.0 - m.phi(F.col("psr_z"))).alias("p_value"))

    def deflated_sharpe_ratio(self, trials: int, *, var_sharpe: float = 1.0, **options) -> DataFrame:
        z = F.when(m.n(self.r) >= 3, m.deflated_sharpe_z(self.r, trials, var_sharpe, **options))
        d = o.clean(self.df, self.r).groupBy(*self.key).agg(z.alias("dsr_z"))
        return d.select(*self.key, m.phi(F.col("dsr_z")).alias("dsr"))

    # a row for each row of df

    def drawdown_series(self) -> DataFrame:
        return o.drawdowns(self.df, self.key, self.t, self.r).drop("wealth", "peak")

    def rolling_volatility(self, **options) -> DataFrame:
        return self._rolling("rolling_volatility", **options)

    def rolling_sharpe(self, **options) -> DataFrame:
        return self._rolling("rolling_sharpe", **options)

    def rolling_sortino(self, **options) -> DataFrame:
        return self._rolling("rolling_sortino", **options)

    def rolling_greeks(self, **options) -> DataFrame:
        return self._rolling("rolling_alpha", "rolling_beta", **options)

    def rolling_beta(self, **options) -> DataFrame:
        return self._rolling("rolling_beta", **options)

    def _rolling(self, *names: str, **options) -> DataFrame:
        return o.rolling(self.df, self.key, self.t, self.r, self.b, **options).select(*self.df.columns, *names)

    # a report's sections, a row per key

    def returns_metrics(self, **options) -> DataFrame:
        return self._of(report.SECTIONS["returns"], shapiro=False, **options)

    def risk_metrics(self, **options) -> DataFrame:
        return self._of(report.SECTIONS["risk"], shapiro=False, **options)

    def performance_metrics(self, **options) -> DataFrame:
        return self._of(report.SECTIONS["performance"], shapiro=False, **options)

    def distribution_metrics(self, **options) -> DataFrame:
        return self._of(report.SECTIONS["distribution"], **options)

    def trading_metrics(self, **options) -> DataFrame:
        return self._of(report.SECTIONS["trading"], shapiro=False, **options)

    def benchmark_metrics(self, **options) -> DataFrame:
        if self.b is None:
            raise ValueError("benchmark metrics need a benchmark column")
        return self._of(report.SECTIONS["benchmark"], shapiro=False, **options)


def of(df: DataFrame, key=(), t: str = "t", r: str = "r", b: str | None = None) -> Series:
    return Series(df, list(key), t, r, b)
