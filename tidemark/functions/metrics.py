"""Order-free metrics as aggregate Columns: usable in agg(), over windows and in streams.

Each takes the return column first. Null returns are skipped, in counts too. Sums of several metrics
in one agg() share one scan and the common aggregates. No ANSI division fails: see safe_div.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import get_config

INF = float("inf")
NAN = float("nan")
#: rows in a year by frequency: fixed values
ANNUAL = {"D": 252, "W": 52, "M": 12, "H": 1638, "min": 98_280, "s": 5_896_800}


def col(r: Column | str) -> Column:
    return (F.col(r) if isinstance(r, str) else r).cast("double")


def safe_div(x: Column, y: Column, default=0.0) -> Column:
    return F.when(y != 0, x / y).otherwise(default)


def ratio(x: Column, y: Column, by: Column | None = None) -> Column:
    """x / y; where y is 0, infinity if `by` (or x) is positive, else 0."""
    return F.when(y != 0, x / y).when((x if by is None else by) > 0, INF).otherwise(0.0)


def annual(ppy: int | None) -> float:
    return float(ppy or get_config().periods_per_year)


def get_annualization_factor(periods_per_year: int | None = None, frequency: str | None = None) -> float:
    return float(periods_per_year or (ANNUAL[frequency] if frequency else get_config().periods_per_year))


def n(r) -> Column:
    return F.count(col(r))


def total(r, test=None) -> Column:
    return F.coalesce(F.sum(col(r) if test is None else F.when(test, col(r))), F.lit(0.0))


def growth(r) -> Column:
    return F.product(1.0 + col(r))


def comp(r) -> Column:
    return growth(r) - 1.0


def cagr(r, ppy=None) -> Column:
    g = growth(r)
    return F.when(g < 0, -INF).otherwise(F.pow(F.greatest(g, F.lit(0.0)), annual(ppy) / n(r)) - 1.0)


def avg_return(r) -> Column:
    return F.avg(col(r))


expected_return = avg_return


def avg_win(r) -> Column:
    return F.coalesce(F.avg(F.when(col(r) > 0, col(r))), F.lit(0.0))


def avg_loss(r) -> Column:
    return F.coalesce(F.avg(F.when(col(r) < 0, col(r))), F.lit(0.0))


def best(r) -> Column:
    return F.max(col(r))


def worst(r) -> Column:
    return F.min(col(r))


def wins(r) -> Column:
    return F.count_if(col(r) > 0)


def win_rate(r) -> Column:
    return wins(r) / F.nullif(n(r), F.lit(0))


def payoff_ratio(r) -> Column:
    return ratio(avg_win(r), F.abs(avg_loss(r)))


def profit_factor(r) -> Column:
    return ratio(total(r, col(r) > 0), F.abs(total(r, col(r) < 0)))


def std(r, ddof: int = 1) -> Column:
    if ddof == 1:
        out = F.stddev_samp(col(r))
    elif ddof == 0:
        out = F.stddev_pop(col(r))
    else:
        out = F.when(n(r) > ddof, F.sqrt(F.var_pop(col(r)) * n(r) / F.nullif(n(r) - ddof, F.lit(0))))
    return F.coalesce(F.nanvl(out, F.lit(0.0)), F.lit(0.0))


def volatility(r, ppy=None, annualize: bool = True) -> Column:
    return std(r, get_config().ddof) * (math.sqrt(annual(ppy)) if annualize else 1.0)


def confidence(given: float | None) -> float:
    return get_config().var_confidence if given is None else given


def z(given: float | None) -> float:
    return NormalDist().inv_cdf(1 - confidence(given))


def var(r, sigma: float = 1.0, confidence: float | None = None) -> Column:
    return F.avg(col(r)) + z(confidence) * sigma * std(r)


def downside_deviation(r, mar=None, ppy=None, annualize: bool = True) -> Column:
    m = get_config().mar if mar is None else mar
    below = total((col(r) - m) * (col(r) - m), col(r) < m)
    return F.sqrt(below / F.nullif(n(r), F.lit(0))) * (math.sqrt(annual(ppy)) if annualize else 1.0)


def sharpe(r, rf=None, ppy=None) -> Column:
    p = annual(ppy)
    per = (get_config().risk_free_rate if rf is None else rf) / p
    return safe_div(F.avg(col(r)) - per, std(r, get_config().ddof)) * math.sqrt(p)


def sortino(r, rf=None, ppy=None) -> Column:
    p = annual(ppy)
    a = col(r) - (get_config().risk_free_rate if rf is None else rf) / p
    down = F.sqrt(total(a * a, a < 0) / F.nullif(n(r), F.lit(0)))
    return F.when(down != 0, F.avg(a) / down * math.sqrt(p)).when(F.avg(a) > 0, INF).otherwise(0.0)


def omega(r, threshold: float = 0.0, rf: float = 0.0, ppy=None) -> Column:
    p = annual(ppy)
    if threshold <= -1:
        return F.when(n(r) >= 0, NAN)
    a = col(r) - rf / p - ((1 + threshold) ** (1 / p) - 1)
    loss = F.abs(total(a, a < 0))
    return F.when((n(r) < 2) | (loss == 0), NAN).otherwise(safe_div(total(a, a > 0), loss, NAN))


def gain_to_pain_ratio(r) -> Column:
    return ratio(total(r), F.abs(total(r, col(r) < 0)))


def kelly_criterion(r) -> Column:
    w, p = win_rate(r), payoff_ratio(r)
    return F.when(avg_loss(r) == 0, w).when(avg_win(r) == 0, 0.0).otherwise(w - safe_div(1 - w, p))


def quantile(r, q: float) -> Column:
    """Exact, with linear interpolation."""
    return F.percentile(col(r), F.lit(q))


def tail_ratio(r) -> Column:
    return safe_div(F.abs(quantile(r, 0.95)), F.abs(quantile(r, 0.05)))


def common_sense_ratio(r) -> Column:
    return profit_factor(r) * tail_ratio(r)


def risk_return_ratio(r, ppy=None) -> Column:
    return safe_div(F.avg(col(r)), std(r))


def skewness(r) -> Column:
    m = n(r)
    g = F.coalesce(F.nanvl(F.skewness(col(r)), F.lit(0.0)), F.lit(0.0))
    return F.when(m >= 3, g * F.sqrt(m * (m - 1.0)) / F.nullif(m - 2.0, F.lit(0.0))).otherwise(0.0)


def kurtosis(r) -> Column:
    m = n(r)
    g = F.coalesce(F.nanvl(F.kurtosis(col(r)), F.lit(0.0)), F.lit(0.0))
    return F.when(m >= 4, (m - 1.0) / F.nullif((m - 2.0) * (m - 3.0), F.lit(0.0)) * ((m + 1.0) * g + 6.0)).otherwise(0.0)


def jarque_bera(r) -> Column:
    g, k = (F.coalesce(F.nanvl(f(col(r)), F.lit(0.0)), F.lit(0.0)) for f in (F.skewness, F.kurtosis))
    return F.when(n(r) >= 4, n(r) / 6.0 * (g * g + k * k / 4.0)).otherwise(0.0)


def jarque_bera_p(r) -> Column:
    return F.exp(-jarque_bera(r) / 2.0)


def geometric_mean(r) -> Column:
    g = growth(r)
    return F.when(g > 0, F.pow(F.greatest(g, F.lit(0.0)), 1.0 / n(r)) - 1.0).otherwise(0.0)


ghpr = geometric_mean


def exposure(r) -> Column:
    return F.count_if(col(r) != 0) / F.nullif(n(r), F.lit(0))


def rar(r, ppy=None) -> Column:
    return safe_div(cagr(r, ppy), exposure(r))


def cpc_index(r) -> Column:
    w, p = win_rate(r), payoff_ratio(r)
    return F.when(avg_loss(r) != 0, w * p - (1 - w) + 1).when(avg_win(r) > 0, INF).otherwise(0.0)


def risk_of_ruin(r, target_fraction: float = 1.0) -> Column:
    w, p = win_rate(r), payoff_ratio(r)
    e = w * p - (1 - w)
    risk = F.pow(F.greatest((1 - e) / F.nullif(1 + e, F.lit(0.0)), F.lit(0.0)), n(r).cast("double"))
    inner = F.when(e >= 1, 0.0).when(e <= -1, 1.0).otherwise(F.least(F.greatest(risk, F.lit(0.0)), F.lit(1.0)))
    return F.when(avg_loss(r) == 0, F.when(avg_win(r) == 0, 1.0).otherwise(0.0)).otherwise(inner)


def adjusted_sortino(r, rf=None, ppy=None) -> Column:
    s = sortino(r, rf, ppy)
    return s * (1 + skewness(r) / 6.0 * s - kurtosis(r) / 24.0 * s * s)


def sqn(r) -> Column:
    return F.when(n(r) >= 2, F.sqrt(n(r).cast("double")) * safe_div(F.avg(col(r)), std(r))).otherwise(0.0)


def expectancy(r) -> Column:
    w = win_rate(r)
    return w * avg_win(r) + (1 - w) * avg_loss(r)


# --- against a benchmark column of the same rows ----------------------------------------------------------


def paired(r, b) -> tuple[Column, Column]:
    both = col(r).isNotNull() & col(b).isNotNull()
    return F.when(both, col(r)), F.when(both, col(b))


def beta(r, b) -> Column:
    x, y = paired(r, b)
    return F.coalesce(safe_div(F.covar_pop(x, y), F.var_pop(y)), F.lit(0.0))


def alpha(r, b, ppy=None) -> Column:
    x, y = paired(r, b)
    return F.when(F.count(x) >= 2, (F.avg(x) - beta(r, b) * F.avg(y)) * annual(ppy)).otherwise(0.0)


def information_ratio(r, b) -> Column:
    x, y = paired(r, b)
    return F.coalesce(safe_div(F.avg(x - y), std(x - y)), F.lit(0.0))


def benchmark_correlation(r, b) -> Column:
    x, y = paired(r, b)
    return F.coalesce(safe_div(F.covar_samp(x, y), std(x) * std(y)), F.lit(0.0))


def r_squared(r, b) -> Column:
    return F.pow(benchmark_correlation(r, b), 2.0)


def treynor_ratio(r, b, rf=None, ppy=None) -> Column:
    f = get_config().risk_free_rate if rf is None else rf
    return ratio(cagr(r, ppy) - f, beta(r, b))


# --- institutional closed forms ------------------------------------------------------------------------------


def phi(x: Column) -> Column:
    """Standard normal distribution function: a series up to 3.5, a continued fraction beyond; the two meet to 1e-12."""
    a = F.abs(x)
    pdf = F.exp(-a * a / 2.0) / math.sqrt(2 * math.pi)
    start = F.struct(F.lit(0.0).alias("s"), a.alias("term"))

    def add(acc: Column, k: Column) -> Column:
        return F.struct((acc["s"] + acc["term"]).alias("s"), (acc["term"] * a * a / (2 * k + 1.0)).alias("term"))

    series = 0.5 + F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add, lambda acc: acc["s"]) * pdf
    deep = F.aggregate(F.sequence(F.lit(40), F.lit(1)), F.greatest(a, F.lit(1.0)), lambda acc, k: F.greatest(a, F.lit(1.0)) + k / acc)
    upper = F.when(a < 3.5, series).otherwise(1.0 - pdf / deep)
    return F.when(x < 0, 1.0 - upper).otherwise(upper)


def psr_z(r, benchmark: float = 0.0, ppy=None) -> Column:
    sr = safe_div(F.avg(col(r)), std(r)) * math.sqrt(annual(ppy))
    var_sr = F.abs(1 + sr * sr / 2 - skewness(r) * sr + kurtosis(r) / 4 * sr * sr)
    se = F.sqrt(var_sr / F.nullif(n(r) - 1.0, F.lit(0.0)))
    flat = F.when(F.avg(col(r)) > 0, INF).when(F.avg(col(r)) < 0, -INF).otherwise(F.lit(-INF if benchmark > 0 else INF if benchmark < 0 else 0.0))
    return F.when(std(r) == 0, flat).otherwise(safe_div(sr - benchmark, se))


def expected_max_sharpe(trials: int, var_sharpe: float = 1.0) -> float:
    if trials <= 1:
        return 0.0
    gamma, ln = 0.5772156649015329, math.log(trials)
    root = math.sqrt(2 * ln)
    return max(0.0, math.sqrt(var_sharpe) * (root - (gamma + math.log(ln + math.log(4 * math.pi))) / (2 * root)))


def deflated_sharpe_z(r, trials: int, var_sharpe: float = 1.0, ppy=None) -> Column:
    if trials < 1 or var_sharpe <= 0:
        raise ValueError("trials must be at least 1 and var_sharpe positive")
    return psr_z(r, expected_max_sharpe(trials, var_sharpe), ppy)


def minimum_track_record_length(r, target: float = 0.0, confidence: float = 0.95, ppy=None) -> Column:
    sr = safe_div(F.avg(col(r)), std(r)) * math.sqrt(annual(ppy))
    adj = F.abs(1 + sr * sr / 2 - skewness(r) * sr + kurtosis(r) / 4 * sr * sr)
    q = NormalDist().inv_cdf(confidence)
    need = F.ceil(1 + adj * F.pow(q / F.when(sr > target, sr - target), 2.0)).cast("double")
    return F.when(std(r) == 0, n(r).cast("double")).when(sr <= target, INF).otherwise(need)


def cornish_fisher_var(r, confidence: float | None = None) -> Column:
    q = z(confidence)
    g, k = skewness(r), kurtosis(r)
    cf = q + (q * q - 1) * g / 6 + (q**3 - 3 * q) * k / 24 - (2 * q**3 - 5 * q) * g * g / 36
    return F.when(std(r) == 0, 0.0).otherwise(-(F.avg(col(r)) + cf * std(r)))


modified_var = cornish_fisher_var


def historical_var(r, confidence: float = 0.95) -> Column:
    return -quantile(r, round(1 - confidence, 12))


def parametric_var(r, confidence: float | None = None) -> Column:
    return F.when(std(r) == 0, 0.0).otherwise(-(F.avg(col(r)) + z(confidence) * std(r)))


def vwap(price, quantity) -> Column:
    return safe_div(total(col(price) * col(quantity)), total(quantity))


def vwap_slippage(price, quantity, benchmark, side: int = 1) -> Column:
    return F.when(total(quantity) != 0, side * (vwap(price, quantity) - benchmark) / benchmark * 1e4).otherwise(0.0)


def spread_cost(bid, ask, mid=None) -> Column:
    m = (col(bid) + col(ask)) / 2 if mid is None else col(mid)
    return F.avg((col(ask) - col(bid)) / F.nullif(m, F.lit(0.0))) * 1e4


def market_impact_estimate(volume, adv, sigma, coefficient: float = 0.1, exponent: float = 0.5) -> Column:
    return coefficient * (col(sigma) / math.sqrt(252.0)) * F.pow(col(volume) / F.nullif(col(adv), F.lit(0.0)), exponent)


#: metrics of one return column that need no order and no second pass, by name
BASIC = {
    f.__name__: f
    for f in (
        comp, cagr, avg_return, avg_win, avg_loss, best, worst, win_rate, payoff_ratio, profit_factor, volatility, var,
        downside_deviation, sharpe, sortino, omega, gain_to_pain_ratio, kelly_criterion, tail_ratio, common_sense_ratio,
        risk_return_ratio, skewness, kurtosis, jarque_bera, jarque_bera_p, geometric_mean, exposure, rar, cpc_index,
        risk_of_ruin, adjusted_sortino, sqn, expectancy, cornish_fisher_var, historical_var, parametric_var,
    )
}
BENCHMARK = {f.__name__: f for f in (alpha, beta, information_ratio, r_squared, benchmark_correlation, treynor_ratio)}
