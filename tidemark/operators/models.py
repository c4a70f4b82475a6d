"""Models that no aggregate expresses: small matrices on the driver, per-key functions in Arrow batches."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import metrics as m
from .ordered import by_key, clean
from .validation import validate_probability


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-squared distribution: Poisson sum for even k, error function and a sum for odd."""
    if x <= 0:
        return 1.0
    h = x / 2
    if k % 2 == 0:
        term, s = 1.0, 1.0
        for i in range(1, k // 2):
            term *= h / i
            s += term
        return math.exp(-h) * s
    s, term = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for i in range(1, (k - 1) // 2 + 1):
        s += term
        term *= h / (i + 0.5)
    return s


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """(W, p) by Royston's 1995 approximation, for 3 to 5000 values."""
    n = len(x)
    if n < 3:
        return 0.0, 1.0
    x = np.sort(np.asarray(x, dtype=float))
    if x[0] == x[-1]:
        return 1.0, 1.0
    nd = NormalDist()
    m = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss = float(m @ m)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        u = 1 / math.sqrt(n)
        c = m / math.sqrt(ss)
        last = c[-1] + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0], u)
        if n > 5:
            prev = c[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
            scale = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2)
            a = m / math.sqrt(scale)
            a[-2], a[1] = prev, -prev
        else:
            a = m / math.sqrt((ss - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        g = 0.459 * n - 2.273
        if y >= g:
            return w, 0.0
        y, mu = -math.log(g - y), np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 0.5 * math.erfc((y - mu) / sigma / math.sqrt(2))


SHAPIRO_ROWS = 5000  # the test's own limit: its first rows only


@F.arrow_udf(StructType([StructField("w", DoubleType()), StructField("p", DoubleType())]))
def royston(values: pa.Array) -> pa.Array:
    """shapiro_wilk of each array."""
    found = [shapiro_wilk(v.values.to_numpy(zero_copy_only=False)) for v in values]
    return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.float64()) for i in (0, 1)], ["w", "p"])


def first_values(r: Column, at: Column) -> Column:
    """The values that the test is made on, at most SHAPIRO_ROWS of a key; at: the row's number from 1."""
    return F.collect_list(F.when(at <= SHAPIRO_ROWS, r))


def shapiro(df: DataFrame, key: list[str], t: str = "t", r: str = "r") -> DataFrame:
    """shapiro_w and shapiro_p of each key, null included, on its first SHAPIRO_ROWS values."""
    d = clean(df, r).withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(t)))
    d = d.groupBy(*key).agg(first_values(F.col(r), F.col("_i")).alias("_first")).withColumn("_first", royston("_first"))
    return d.select(*key, F.col("_first.w").alias("shapiro_w"), F.col("_first.p").alias("shapiro_p"))


LEAST = {"entropic_var": 10, "garch_volatility": 20}  # values that a key needs; below, its result is null


def entropic_var(df: DataFrame, key: list[str], r: str = "r", *, confidence: float | None = None, low: float = 0.01, high: float = 100.0, steps: int = 64) -> DataFrame:
    """Least over z in (low, high) of ln(E[exp(-z r)] / (1 - c)) / z; null below LEAST values.

    The rows are read twice, and only aggregates leave them. The function falls up to its least value and
    rises after it, so that lies in the cells around the best of `steps` values of z that grow by a constant
    factor; `steps` more are laid through these cells, and a parabola through the best and its neighbours ends it.
    """
    c = m.confidence(confidence)
    validate_probability(c, "confidence")
    d = clean(df, r).select(*key, F.col(r).alias("_r"))

    def laid(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
        """Each key's n, lo, step, the values v at lo + step * i, and the place `at` of the least one from 1."""
        rows = rows.withColumns({"lo": lo, "step": (hi - lo) / steps}).select(*key, "_r", "lo", "step", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
        z = F.exp(F.col("lo") + F.col("step") * F.col("i"))
        each = rows.groupBy(*key, "lo", "step", "i").agg(F.count("*").alias("n"), F.avg(F.exp(-z * F.col("_r"))).alias("mean"))
        # a mean that is not a number above zero rules its z out
        value = F.coalesce(F.when(F.col("mean") > 0, F.log(F.col("mean") / (1 - c)) / z), F.lit(m.INF))
        v = F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda x: x["v"])
        out = each.groupBy(*key, "lo", "step").agg(F.max("n").alias("n"), v.alias("v"))
        return out.withColumn("at", F.array_position("v", F.array_min("v")).cast("int"))

    lo, hi = math.log(low), math.log(high)
    first = laid(d, F.lit(lo), F.lit(hi))
    place = F.col("lo") + F.col("step") * (F.col("at") - 1)
    near = first.select(*key, F.greatest(F.lit(lo), place - F.col("step")).alias("_lo"), F.least(F.lit(hi), place + F.col("step")).alias("_hi"))
    s = laid(by_key(d, near, key), F.col("_lo"), F.col("_hi"))
    before, best, after = F.get("v", F.col("at") - 2), F.array_min("v"), F.get("v", F.col("at"))
    bend = before - 2 * best + after
    lowest = F.when((bend > 0) & (bend < m.INF), best - F.pow(after - before, 2.0) / (8 * bend)).otherwise(best)
    return s.select(*key, F.when(F.col("n") >= LEAST["entropic_var"], lowest).alias("entropic_var"))


def gram(df: DataFrame, assets: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, covariances with ddof 1) of a wide return matrix, nulls and NaN as 0, in one aggregate."""
    x = [F.coalesce(F.nanvl(F.col(a).cast("double"), F.lit(0.0)), F.lit(0.0)) for a in assets]
    d = df.select(*(c.alias(f"x{i}") for i, c in enumerate(x)))
    pairs = [(i, j) for i in range(len(assets)) for j in range(i, len(assets))]
    row = d.agg(F.count("*"), *(F.avg(f"x{i}") for i in range(len(assets))), *(F.covar_samp(f"x{i}", f"x{j}") for i, j in pairs)).first()
    p = len(assets)
    cov = np.zeros((p, p))
    for (i, j), v in zip(pairs, row[1 + p :], strict=True):
        cov[i, j] = cov[j, i] = v or 0.0
    return row[0], np.array([v or 0.0 for v in row[1 : 1 + p]]), cov


def marginal_contribution_to_risk(df: DataFrame, assets: list[str], weights: list[float]) -> dict:
    _, _, cov = gram(df, assets)
    wt = np.asarray(weights, dtype=float)
    v = float(wt @ cov @ wt)
    if v <= 0:
        return {"mcr": np.zeros(len(wt)), "pcr": np.full(len(wt), 1 / len(wt)), "volatility": 0.0, "assets": assets}
    mcr = cov @ wt / math.sqrt(v)
    pcr = wt * mcr
    return {"mcr": mcr, "pcr": pcr / pcr.sum(), "volatility": math.sqrt(v), "assets": assets}


def ledoit_wolf_covariance(df: DataFrame, assets: list[str]) -> dict:
    """Shrinkage towards mean variance times the identity; only the sum of fourth powers needs a second pass."""
    n, mean, cov = gram(df, assets)
    p = len(assets)
    s = cov * (n - 1) / n
    target = np.trace(s) / p * np.eye(p)
    x = [F.coalesce(F.nanvl(F.col(a).cast("double"), F.lit(0.0)), F.lit(0.0)) - float(m) for a, m in zip(assets, mean, strict=True)]
    norm = sum((c * c for c in x[1:]), x[0] * x[0])
    fourth = df.agg(F.sum(norm * norm)).first()[0]
    gap = ((s - target) ** 2).sum()
    delta = 1.0 if gap == 0 else float(np.clip((fourth - n * (s**2).sum()) / n**2 / gap, 0, 1))
    return {"covariance": delta * target + (1 - delta) * s, "shrinkage": delta, "target": target, "sample": s}


def correlation_from_covariance(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    sd = np.where(sd == 0, 1.0, sd)
    out = cov / np.outer(sd, sd)
    np.fill_diagonal(out, 1.0)
    return out


def portfolio_volatility(df: DataFrame, assets: list[str], weights: list[float], *, use_shrinkage: bool = False, annualize: bool = True, ppy: int = 252) -> float:
    cov = ledoit_wolf_covariance(df, assets)["covariance"] if use_shrinkage else gram(df, assets)[2]
    v = float(np.asarray(weights) @ cov @ np.asarray(weights))
    return math.sqrt(v) * (math.sqrt(ppy) if annualize else 1.0) if v > 0 else 0.0


def absorption_ratio(df: DataFrame, assets: list[str], components: int | None = None, *, fraction: float = 0.2) -> dict:
    n, _, cov = gram(df, assets)
    if len(assets) < 2 or n < len(assets):
        raise ValueError("at least two assets and as many rows as assets")
    eig = np.sort(np.linalg.eigvalsh(correlation_from_covariance(cov)))[::-1]
    k = components or max(1, int(fraction * len(assets)))
    return {"ratio": float(eig[:k].sum() / eig.sum()), "components": k, "eigenvalues": eig}


def arch_effect_test(df: DataFrame, key: list[str], t: str = "t", r: str = "r", lags: int = 12) -> DataFrame:
    """Engle's test per key: (arch_stat, arch_p, arch_effect) from lagged squares' covariances in one aggregate.

    Null for a key with fewer than lags + 2 values; a key without more than `lags` has no row.
    """
    d = clean(df, r).withColumn("e", F.pow(F.col(r) - F.avg(r).over(Window.partitionBy(*key)), 2.0))
    d = d.withColumns({f"l{j}": F.lag("e", j).over(Window.partitionBy(*key).orderBy(t)) for j in range(1, lags + 1)}).where(f"l{lags} is not null")
    names = ["e", *(f"l{j}" for j in range(1, lags + 1))]
    pairs = [(i, j) for i in range(lags + 1) for j in range(i, lags + 1)]
    s = d.groupBy(*key).agg(F.count("*").alias("n"), F.array(*(F.covar_pop(names[i], names[j]) for i, j in pairs)).alias("c"))
    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in key)

    def work(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                cov = np.zeros((lags + 1, lags + 1))
                for (i, j), v in zip(pairs, row.c, strict=True):
                    cov[i, j] = cov[j, i] = v
                r2 = 0.0 if cov[0, 0] <= 0 else float(cov[0, 1:] @ np.linalg.pinv(cov[1:, 1:]) @ cov[0, 1:] / cov[0, 0])
                stat = row.n * r2
                p = chi2_sf(stat, lags)
                rows.append([*(getattr(row, k) for k in key), *((stat, p, p < 0.05) if row.n >= 2 else (None, None, None))])
            yield pd.DataFrame(rows, columns=[*key, "arch_stat", "arch_p", "arch_effect"])

    return s.mapInPandas(work, f"{kinds}, arch_stat double, arch_p double, arch_effect boolean")


GARCH_ALPHA, GARCH_BETA = 0.10, 0.85  # fixed values of variance targeting


def decayed(x: np.ndarray, start: float, by: float, block: int = 256) -> np.ndarray:
    """s with s[0] = start and s[i + 1] = by * s[i] + x[i], len(x) + 1 values: a matrix product per row of blocks.

    Only the blocks' last values are carried on one by one.
    """
    n = len(x)
    rows = np.zeros((-(-n // block), block))
    rows.ravel()[:n] = x
    age = np.subtract.outer(np.arange(block), np.arange(block))
    inside = rows @ np.where(age >= 0, by ** np.maximum(age, 0), 0.0).T
    out, fade = np.empty_like(inside), by ** np.arange(1, block + 1)
    carry = start
    for i, row in enumerate(inside):
        out[i] = row + carry * fade
        carry = out[i, -1]
    return np.concatenate([[start], out.ravel()[:n]])


def garch_volatility(df: DataFrame, key: list[str], t: str = "t", r: str = "r", *, horizon: int = 1, p: int = 1, q: int = 1) -> DataFrame:
    """df with `garch_vol`, and each key's `garch_forecast` of `horizon` periods ahead, by variance targeting.

    Both are null for a key with fewer than LEAST values; ValueError for orders other than one.
    """
    if (p, q) != (1, 1):
        raise ValueError("only p = 1 and q = 1 are known")
    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in [*key, t])

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        x = pdf[r].to_numpy(dtype=float)
        if len(x) < LEAST["garch_volatility"]:
            return pdf[[*key, t]].assign(garch_vol=np.nan, garch_forecast=np.nan)
        var = x.var(ddof=1)
        omega = var * (1 - GARCH_ALPHA - GARCH_BETA)
        s = decayed(omega + GARCH_ALPHA * x * x, var, GARCH_BETA)
        ahead = s[-1]
        for _ in range(horizon - 1):
            ahead = omega + (GARCH_ALPHA + GARCH_BETA) * ahead
        return pdf[[*key, t]].assign(garch_vol=np.sqrt(s[:-1]), garch_forecast=math.sqrt(ahead))

    return clean(df, r).select(*key, t, r).groupBy(*key).applyInPandas(work, f"{kinds}, garch_vol double, garch_forecast double")
