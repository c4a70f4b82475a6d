"""Order-dependent operators. A series is DataFrame rows (key..., t, r); t is unique within a key.

Windows are partitioned by the key, so a table of many series spreads over the cluster; a single
series is one partition. Null returns are dropped first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import INF, safe_div

Keys = list[str]


def clean(df: DataFrame, r: str = "r") -> DataFrame:
    return df.where(F.col(r).isNotNull()).withColumn(r, F.col(r).cast("double"))


def w(key: Keys, t: str) -> Window:
    return Window.partitionBy(*key).orderBy(t)


def running(key: Keys, t: str) -> Window:
    return w(key, t).rowsBetween(Window.unboundedPreceding, 0)


def by_key(left: DataFrame, right: DataFrame, key: Keys) -> DataFrame:
    """left with the columns of right, which has one row per key; null keys meet."""
    if not key:
        return left.crossJoin(F.broadcast(right))
    named = right.select(*(F.col(c).alias(f"_k_{c}") if c in key else F.col(c) for c in right.columns))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]
    return left.join(named, same).drop(*(f"_k_{c}" for c in key))


def cumulative_returns(df: DataFrame, key: Keys, t: str = "t", r: str = "r") -> DataFrame:
    """df with `cumulative`, the compounded return so far; `equity_curve` and `compound_returns` are the same."""
    return clean(df, r).withColumn("cumulative", F.product(1.0 + F.col(r)).over(running(key, t)) - 1.0)


equity_curve = compound_returns = cumulative_returns


def drawdowns(df: DataFrame, key: Keys, t: str = "t", r: str = "r") -> DataFrame:
    """df with `wealth`, `peak` and `drawdown`; the first row is its own peak, so its loss is not seen."""
    d = clean(df, r).withColumn("wealth", F.product(1.0 + F.col(r)).over(running(key, t)))
    d = d.withColumn("peak", F.max("wealth").over(running(key, t)))
    return d.withColumn("drawdown", safe_div(F.col("wealth") - F.col("peak"), F.col("peak"), float("nan")))


def drawdown_stats(df: DataFrame, key: Keys, t: str = "t", r: str = "r") -> DataFrame:
    """max_drawdown and ulcer_index of each key."""
    return drawdowns(df, key, t, r).groupBy(*key).agg(*(c.alias(n) for n, c in drawdown_aggregates().items()))


def drawdown_aggregates() -> dict[str, Column]:
    """max_drawdown and ulcer_index over the rows of drawdowns()."""
    square = F.sum(F.col("drawdown") * F.col("drawdown"))
    n = F.count("*")
    return {"max_drawdown": F.min("drawdown"), "ulcer_index": F.when(n > 1, F.sqrt(square / F.nullif(n - 1, F.lit(0)))).otherwise(0.0)}


def streaks(df: DataFrame, key: Keys, t: str = "t", r: str = "r") -> DataFrame:
    """consecutive_wins and consecutive_losses of each key: longest runs by gaps and islands."""
    x = F.col(r)
    d = clean(df, r)
    won, lost = (F.sum(F.when(s, 0).otherwise(1)).over(running(key, t)) for s in (x > 0, x < 0))
    d = d.withColumns({"won": won, "lost": lost, "s": F.signum(x)})
    runs = d.groupBy(*key, "s", F.when(F.col("s") > 0, F.col("won")).otherwise(F.col("lost")).alias("island")).agg(F.count("*").alias("n"))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("s") == s, F.col("n"))), F.lit(0)).cast("long")
    return runs.groupBy(*key).agg(longest(1.0).alias("consecutive_wins"), longest(-1.0).alias("consecutive_losses"))


def autocorrelation(df: DataFrame, key: Keys, t: str = "t", r: str = "r", lag: int = 1) -> DataFrame:
    """`autocorr` of each key: lagged products about the whole mean over the whole sum of squares; null if undefined."""
    d = clean(df, r)
    mean = F.avg(r).over(Window.partitionBy(*key))
    d = d.withColumn("x", F.col(r) - mean)
    d = d.withColumn("y", F.lag("x", lag).over(w(key, t)))
    return d.groupBy(*key).agg(lagged_ratio(F.col("x"), F.col("y"), lag).alias("autocorr"))


def lagged_ratio(x: Column, before: Column, lag: int) -> Column:
    """Of deviations and those `lag` rows before: the sum of products over the sum of squares."""
    top, all_ = F.sum(x * before), F.sum(x * x)
    return F.when((F.count("*") > lag) & (all_ > 1e-300), top / F.nullif(all_, F.lit(0.0)))


def smart_penalty(autocorr: Column) -> Column:
    """What a Sharpe or Sortino ratio is divided by; null where the ratio counts as 0."""
    p = 1 + 2 * F.coalesce(autocorr, F.lit(0.0))
    return F.when(p > 0, F.sqrt(p))


def newey_west_se(df: DataFrame, key: Keys, t: str = "t", r: str = "r", lags: int | None = None) -> DataFrame:
    """Standard error of the mean with Bartlett weights over `lags` lagged products.

    Without `lags`, each key's number is max(1, min(floor(4 (n / 100)^(2/9)), n - 2)) for its n returns; one
    small aggregate finds the largest, up to which lags are computed.
    """
    d = clean(df, r)
    n = F.count("*")
    own = F.greatest(F.lit(1), F.least(F.floor(4 * F.pow(n / 100.0, F.lit(2 / 9))), n - 2)) if lags is None else F.lit(lags)
    most = (d.groupBy(*key).agg(own.alias("lags")).agg(F.max("lags")).first()[0] or 1) if lags is None else lags
    d = d.withColumn("x", F.col(r) - F.avg(r).over(Window.partitionBy(*key)))
    d = d.withColumns({f"x{j}": F.lag("x", j).over(w(key, t)) for j in range(1, most + 1)})
    gamma = lambda j: F.coalesce(F.sum(F.col("x") * F.col(f"x{j}" if j else "x")), F.lit(0.0)) / n
    s = gamma(0)
    for j in range(1, most + 1):
        s = s + 2 * F.greatest(1 - j / (own + 1), F.lit(0.0)) * gamma(j)
    return d.groupBy(*key).agg(F.when(s > 0, F.sqrt(F.greatest(s, F.lit(0.0)) / n)).otherwise(0.0).alias("newey_west_se"))


def k_ratio(df: DataFrame, key: Keys, t: str = "t", r: str = "r") -> DataFrame:
    """Slope of the running sum of returns over its standard error."""
    d = clean(df, r).withColumns({"y": F.sum(r).over(running(key, t)), "x": (F.row_number().over(w(key, t)) - 1).cast("double")})
    return d.groupBy(*key).agg(trend_ratio(F.col("y"), F.col("x")).alias("k_ratio"))


def trend_ratio(y: Column, x: Column) -> Column:
    """The slope of y on x over its standard error."""
    sxx, sxy, syy = F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)
    slope = sxy / F.nullif(sxx, F.lit(0.0))
    left = F.greatest(syy - sxy * sxy / F.nullif(sxx, F.lit(0.0)), F.lit(0.0))
    se = F.sqrt(left / F.nullif(F.count("*") - 2, F.lit(0)) / F.nullif(sxx, F.lit(0.0)))
    return F.when(F.count("*") < 3, 0.0).when(se != 0, slope / se).when(slope > 0, INF).otherwise(0.0)


# --- rolling windows ----------------------------------------------------------------------------------------

ROLLING_PPY = 365  # the rolling metrics' own default


def rolling(df: DataFrame, key: Keys, t: str = "t", r: str = "r", b: str | None = None, *, period: int = 126, ppy: int | None = None, rf: float = 0.0, annualize: bool = True) -> DataFrame:
    """df with rolling_volatility, rolling_sharpe, rolling_sortino and, with b, rolling_beta and rolling_alpha.

    Full windows only: the first period - 1 rows are null. One Window node gives all of them.
    """
    d = clean(df, r)
    p = float(ppy or ROLLING_PPY)
    scale = math.sqrt(p) if annualize else 1.0
    f = w(key, t).rowsBetween(-(period - 1), 0)
    full = lambda c: F.when(F.count(r).over(f) == period, c)
    a = F.col(r) - rf / p
    sd, mean = F.stddev_samp(r).over(f), F.avg(a).over(f)
    under = F.when(a < 0, a * a).otherwise(0.0)
    down = F.sqrt(F.sum(under).over(f) / period)
    out = {
        "rolling_volatility": full(sd * scale),
        "rolling_sharpe": full(safe_div(mean, sd, float("nan")) * scale),
        "rolling_sortino": full(safe_div(mean, down, float("nan")) * scale),
    }
    if b:
        slope = safe_div(F.covar_pop(r, b).over(f), F.var_pop(b).over(f), float("nan"))
        out["rolling_beta"] = full(slope)
        out["rolling_alpha"] = full((F.avg(r).over(f) - slope * F.avg(b).over(f)) * p)
    return d.withColumns(out)


# --- episodes, calendars, histograms ---------------------------------------------------------------------


def drawdown_details(df: DataFrame, key: Keys, t: str = "t", r: str = "r", *, top_n: int = 5, dates: bool = False) -> DataFrame:
    """The deepest episodes of each key: start, valley, end (row numbers from 0), depth, length, recovery.

    start: the peak before the first loss; end: the row that recovers, else the last one, and then
    recovery is null. With `dates`, start_date, valley_date and end_date are the values of t there.
    """
    by_time = w(key, t)
    d = drawdowns(df, key, t, r).withColumn("i", F.row_number().over(by_time) - 1)
    d = d.withColumns({"last": F.max("i").over(Window.partitionBy(*key)), "below": F.col("drawdown") < 0, "before": F.lag(t).over(by_time), "after": F.lead(t).over(by_time)})
    d = d.withColumn("island", F.sum(F.when(F.col("below"), 0).otherwise(1)).over(running(key, t)))
    e = d.where("below").groupBy(*key, "island").agg(
        F.min("i").alias("first"), F.max("i").alias("end_in"), F.min("drawdown").alias("depth"),
        F.min_by("i", F.struct("drawdown", "i")).alias("valley"), F.first("last").alias("last"),
        F.coalesce(F.min_by("before", "i"), F.min(t)).alias("start_date"), F.min_by(t, F.struct("drawdown", "i")).alias("valley_date"),
        F.coalesce(F.max_by("after", "i"), F.max(t)).alias("end_date"),
    )
    done = F.col("end_in") < F.col("last")
    e = e.withColumns({"start": F.greatest(F.col("first") - 1, F.lit(0)), "end": F.when(done, F.col("end_in") + 1).otherwise(F.col("last"))})
    e = e.withColumns({"length": F.col("end") - F.col("start") + 1, "recovery": F.when(done, F.col("end") - F.col("valley"))})
    by = Window.partitionBy(*key).orderBy("depth", "start")
    return e.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_n).select(
        *key, "rank", "start", "valley", "end", "depth", "length", "recovery", *(("start_date", "valley_date", "end_date") if dates else ())
    )


def period_returns(df: DataFrame, key: Keys, date: str, unit: str, r: str = "r", compounded: bool = True) -> DataFrame:
    """key, `period`, `ret` for unit D, W (calendar year and ISO week), M, Q or Y; yearly_returns is unit Y."""
    out = F.product(1.0 + F.col(r)) - 1.0 if compounded else F.sum(r)
    return clean(df, r).groupBy(*key, period_labels(date)[unit].alias("period")).agg(out.alias("ret"))


def period_labels(date: str) -> dict[str, Column]:
    y = F.year(date)
    return {
        "D": F.date_format(date, "yyyy-MM-dd"),
        "W": F.concat_ws("-", y, F.weekofyear(date)),
        "M": F.concat_ws("-", y, F.month(date)),
        "Q": F.concat_ws("-", y, F.quarter(date)),
        "Y": y.cast("string"),
    }


def monthly_returns(df: DataFrame, date: str, years: list[int] | None = None, r: str = "r", compounded: bool = True, key: Keys = ()) -> DataFrame:
    """A row per key and month, a column per year; without `years`, for every year of the series, which one small aggregate finds."""
    out = F.product(1.0 + F.col(r)) - 1.0 if compounded else F.sum(r)
    d = clean(df, r).withColumn("year", F.year(date))
    if years is None:
        years = sorted(x.year for x in d.where("year IS NOT NULL").select("year").distinct().collect())
    return d.groupBy(*key, F.month(date).alias("month")).pivot("year", years).agg(out)


def distribution(df: DataFrame, key: Keys, date: str, r: str = "r", compounded: bool = True) -> DataFrame:
    """Statistics of daily, weekly, monthly, quarterly and yearly returns, with the outliers of each.

    Quartiles are nearest-rank picks of the sorted values; outliers lie 1.5 interquartile ranges outside.
    """
    # one scan: each return goes to its five periods, aggregated before the shuffle
    each = F.explode(F.array(*(F.struct(F.lit(u).alias("frequency"), label.alias("period")) for u, label in period_labels(date).items()))).alias("of")
    d = clean(df, r).select(*key, F.col(r), each)
    out = F.product(1.0 + F.col(r)) - 1.0 if compounded else F.sum(r)
    d = d.groupBy(*key, F.col("of.frequency").alias("frequency"), F.col("of.period").alias("period")).agg(out.alias("ret"))
    by = Window.partitionBy(*key, "frequency")
    d = d.withColumns({"at": F.row_number().over(by.orderBy("ret")) - 1, "n": F.count("*").over(by)})
    pick = lambda q: F.max(F.when(F.col("at") == F.floor((F.col("n") - 1) * q + 0.5), F.col("ret"))).over(by)
    d = d.withColumns({"q1": pick(0.25), "q3": pick(0.75)})
    far = 1.5 * (F.col("q3") - F.col("q1"))
    out = (F.col("ret") < F.col("q1") - far) | (F.col("ret") > F.col("q3") + far)
    return d.groupBy(*key, "frequency").agg(
        F.avg("ret").alias("mean"), F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("std"), F.min("ret").alias("min"),
        F.max("ret").alias("max"), F.count("*").alias("count"), F.count_if(out).alias("outliers"),
    )


def aligned(df: DataFrame, benchmark: DataFrame, key: Keys, t: str = "t", b: str = "b") -> DataFrame:
    """df with the benchmark's column b of the same key and time; `benchmark` has the key's columns that it is kept by, or none.

    Rows without a counterpart are gone, as are null times; a (key, time) that the benchmark repeats repeats the row.
    """
    on = [*(k for k in key if k in benchmark.columns), t]
    other = benchmark.select(*(F.col(c).alias(f"_k_{c}") for c in on), b)
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in on if c != t]
    return df.join(other, [F.col(t) == F.col(f"_k_{t}"), *same]).drop(*(f"_k_{c}" for c in on))


def compare(df: DataFrame, r: str = "r", b: str = "b") -> DataFrame:
    """df with excess and win (0 or 1) against the benchmark column."""
    return df.withColumns({"excess": F.col(r) - F.col(b), "win": F.when(F.col(r) > F.col(b), 1).otherwise(0)})


def histogram(df: DataFrame, key: Keys, r: str = "r", *, bins: int = 50, density: bool = False) -> DataFrame:
    """All bins of each key, right-closed, the minimum in the first; constant data: one bin of width 1."""
    d = clean(df, r)
    s = d.groupBy(*key).agg(F.min(r).alias("lo"), F.max(r).alias("hi"), F.count("*").alias("n"))
    s = s.withColumn("bins", F.when(F.col("hi") > F.col("lo"), bins).otherwise(1))
    s = s.withColumns({"lo": F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5), "hi": F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5)})
    s = s.withColumn("width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    at = F.greatest(F.lit(0), F.least(F.ceil((F.col(r) - F.col("lo")) / F.col("width")) - 1, F.col("bins") - 1)).cast("int")
    j = by_key(d, s, key)
    counts = j.groupBy(*key, at.alias("bin")).agg(F.count("*").alias("count"))
    every = s.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    counts = counts.select(*(F.col(c).alias(f"_k_{c}") for c in [*key, "bin"]), "count")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*key, "bin"]]
    out = every.join(counts, same, "left").drop(*(f"_k_{c}" for c in [*key, "bin"])).withColumn("count", F.coalesce("count", F.lit(0)))
    out = out.withColumns({"bin_start": F.col("lo") + F.col("bin") * F.col("width"), "bin_end": F.col("lo") + (F.col("bin") + 1) * F.col("width"), "frequency": F.col("count") / F.col("n")})
    out = out.withColumn("bin_center", (F.col("bin_start") + F.col("bin_end")) / 2)
    extra = [(F.col("frequency") / F.col("width")).alias("density")] if density else []
    return out.select(*key, "bin", "bin_start", "bin_end", "bin_center", "count", "frequency", *extra)


# --- quantile-based filters and two-pass aggregates -------------------------------------------------------


def with_quantiles(df: DataFrame, key: Keys, r: str, **q: Column) -> DataFrame:
    """df joined with per-key aggregates; the aggregate is one row per key, so Spark may broadcast it."""
    d = clean(df, r)
    s = d.groupBy(*key).agg(*(c.alias(name) for name, c in q.items()))
    return by_key(d, s, key)


def outliers(df: DataFrame, key: Keys, r: str = "r", *, quantile: float = 0.95) -> DataFrame:
    d = with_quantiles(df, key, r, cut=F.percentile(F.col(r).cast("double"), F.lit(quantile)))
    return d.where(F.col(r) > F.col("cut")).drop("cut")


def remove_outliers(df: DataFrame, key: Keys, r: str = "r", *, quantile: float = 0.95) -> DataFrame:
    d = with_quantiles(df, key, r, cut=F.percentile(F.col(r).cast("double"), F.lit(quantile)))
    return d.where(F.col(r) < F.col("cut")).drop("cut")


def _iqr(df: DataFrame, key: Keys, r: str) -> tuple[DataFrame, Column]:
    x = F.col(r).cast("double")
    d = with_quantiles(df, key, r, q1=F.percentile(x, F.lit(0.25)), q3=F.percentile(x, F.lit(0.75)))
    far = 1.5 * (F.col("q3") - F.col("q1"))
    return d, (F.col(r) < F.col("q1") - far) | (F.col(r) > F.col("q3") + far)


def outliers_iqr(df: DataFrame, key: Keys, r: str = "r") -> DataFrame:
    d, out = _iqr(df, key, r)
    return d.where(out).drop("q1", "q3")


def remove_outliers_iqr(df: DataFrame, key: Keys, r: str = "r") -> DataFrame:
    d, out = _iqr(df, key, r)
    return d.where(~out).drop("q1", "q3")


def outlier_ratios(df: DataFrame, key: Keys, r: str = "r", *, quantile: float = 0.99) -> DataFrame:
    """outlier_win_ratio and outlier_loss_ratio: the mean beyond the quantile over the mean."""
    x = F.col(r).cast("double")
    gain, loss = F.when(x > 0, x), F.when(x < 0, -x)
    d = with_quantiles(df, key, r, qw=F.percentile(gain, F.lit(quantile)), ql=F.percentile(loss, F.lit(quantile)))
    far = lambda v, q: F.coalesce(safe_div(F.avg(F.when(v >= F.col(q), v)), F.avg(v)), F.lit(0.0))
    return d.groupBy(*key).agg(far(gain, "qw").alias("outlier_win_ratio"), far(loss, "ql").alias("outlier_loss_ratio"))


def cvar(df: DataFrame, key: Keys, r: str = "r", *, sigma: float = 1.0, confidence: float | None = None) -> DataFrame:
    """Mean return at or below the parametric VaR, else the least return."""
    from ..functions.metrics import var

    d = with_quantiles(df, key, r, cut=var(r, sigma, confidence))
    return d.groupBy(*key).agg(F.coalesce(F.avg(F.when(F.col(r) <= F.col("cut"), F.col(r))), F.min(r)).alias("cvar"))


def tail_dependence(df: DataFrame, key: Keys, a: str, b: str, *, quantile: float = 0.05) -> DataFrame:
    """lower_tail_dependence: of rows with a at or below its quantile, the share with b at or below its own."""
    if not 0 < quantile < 0.5:
        raise ValueError("quantile must lie between 0 and 0.5")
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = d.groupBy(*key).agg(F.percentile(a, F.lit(quantile)).alias("qa"), F.percentile(b, F.lit(quantile)).alias("qb"))
    j = by_key(d, s, key)
    low = F.col(a) <= F.col("qa")
    return j.groupBy(*key).agg(safe_div(F.count_if(low & (F.col(b) <= F.col("qb"))), F.count_if(low)).alias("lower_tail_dependence"))


def side_correlation(df: DataFrame, key: Keys, a: str, b: str, *, threshold: float = 0.0, down: bool = True) -> DataFrame:
    """downside_correlation or upside_correlation: over rows with a on that side of the threshold; NaN under two rows."""
    d = df.where((F.col(a) < threshold if down else F.col(a) > threshold) & F.col(b).isNotNull())
    c = F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))
    name = "downside_correlation" if down else "upside_correlation"
    return d.groupBy(*key).agg(F.coalesce(c, F.lit(float("nan"))).alias(name))


def infer_frequency(df: DataFrame, key: Keys, t: str) -> DataFrame:
    """`frequency` by the median gap between times."""
    gap = F.col(t).cast("timestamp").cast("double") - F.lag(F.col(t).cast("timestamp").cast("double")).over(w(key, t))
    m = F.median("gap")
    name = F.when(m < 60, "s").when(m < 3600, "min").when(m < 86400, "H").when(m < 7 * 86400, "D").when(m < 30 * 86400, "W").otherwise("M")
    return df.withColumn("gap", gap).groupBy(*key).agg(F.when(m.isNotNull(), name).alias("frequency"))


def log_returns(r: Column) -> Column:
    return F.when(r > -1, F.log1p(r)).when(r == -1, -INF).otherwise(float("nan"))


def simple_returns(x: Column) -> Column:
    return F.expm1(x)

