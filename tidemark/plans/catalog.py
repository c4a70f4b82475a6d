"""Queries over the star-schema tables for each operator, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..operators import execution, models, ordered, trades
from ..sources import series
from . import report

KEY = ["l_returnflag", "l_linestatus"]
K = "l_returnflag, l_linestatus"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ASSETS = ["A", "N", "R"]
WEIGHTS = [0.5, 0.3, 0.2]


def rounded(c: Column, digits: int = 8) -> Column:
    return F.round(c, digits) + 0.0


def shown(df: DataFrame, *plain: str) -> DataFrame:
    """df with its doubles rounded, but for the columns named."""
    return df.select(*(rounded(F.col(c)).alias(c) if t == "double" and c not in plain else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def cte(*more: str, key: str = K) -> str:
    return "WITH " + ", ".join([series.DAILY_SQL.format(key=key), *more])


def picks(exprs: dict[str, str]) -> str:
    return ", ".join(f"round({e}, 8) + 0.0 AS {n}" for n, e in exprs.items())


# --- aggregates of one series per key -----------------------------------------------------------------------

W_, L_ = "(count(*) FILTER (WHERE r > 0) / CAST(count(*) AS DOUBLE))", "coalesce(avg(r) FILTER (WHERE r < 0), 0)"
G_ = "coalesce(avg(r) FILTER (WHERE r > 0), 0)"
P_ = f"({G_} / abs({L_}))"
COMP_ = "(product(1 + r) - 1)"
CAGR_ = "(pow(product(1 + r), 252.0 / count(*)) - 1)"
SHARPE_ = "(avg(r) / stddev_samp(r) * sqrt(252))"
SORT_ = "(avg(r) / sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / count(*)) * sqrt(252))"
PF_ = "(sum(r) FILTER (WHERE r > 0) / abs(sum(r) FILTER (WHERE r < 0)))"
TAIL_ = "(abs(quantile_cont(r, 0.95)) / abs(quantile_cont(r, 0.05)))"
SK_, KU_ = "skewness(r)", "kurtosis(r)"
E_ = f"({W_} * {P_} - (1 - {W_}))"
Z95, Z05 = "1.6448536269514722", "-1.6448536269514722"
EXP_ = "(count(*) FILTER (WHERE r <> 0) / CAST(count(*) AS DOUBLE))"
GPOP, KPOP = "skewness_pop(r)", "kurtosis_pop(r)"
BASIC_SQL = {
    "comp": COMP_, "cagr": CAGR_, "avg_return": "avg(r)", "avg_win": G_, "avg_loss": L_, "best": "max(r)", "worst": "min(r)", "win_rate": W_,
    "payoff_ratio": P_, "profit_factor": PF_, "volatility": "stddev_samp(r) * sqrt(252)", "var": f"avg(r) + {Z05} * stddev_samp(r)",
    "downside_deviation": "sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / count(*)) * sqrt(252)", "sharpe": SHARPE_, "sortino": SORT_,
    "omega": PF_, "gain_to_pain_ratio": "sum(r) / abs(sum(r) FILTER (WHERE r < 0))", "kelly_criterion": f"{W_} - (1 - {W_}) / {P_}",
    "tail_ratio": TAIL_, "common_sense_ratio": f"{PF_} * {TAIL_}", "risk_return_ratio": "avg(r) / stddev_samp(r)", "skewness": SK_, "kurtosis": KU_,
    "geometric_mean": "pow(product(1 + r), 1.0 / count(*)) - 1", "exposure": EXP_, "rar": f"{CAGR_} / {EXP_}", "cpc_index": f"{E_} + 1",
    "risk_of_ruin": f"CASE WHEN {E_} >= 1 THEN 0 WHEN {E_} <= -1 THEN 1 ELSE least(greatest(pow((1 - {E_}) / (1 + {E_}), count(*)), 0), 1) END",
    "adjusted_sortino": f"{SORT_} * (1 + {SK_} / 6 * {SORT_} - {KU_} / 24 * {SORT_} * {SORT_})", "sqn": "sqrt(count(*)) * avg(r) / stddev_samp(r)",
    "expectancy": f"{W_} * {G_} + (1 - {W_}) * {L_}",
    "cornish_fisher_var": f"-(avg(r) + ({Z05} + ({Z05} * {Z05} - 1) * {SK_} / 6 + (pow({Z05}, 3) - 3 * {Z05}) * {KU_} / 24 - (2 * pow({Z05}, 3) - 5 * {Z05}) * {SK_} * {SK_} / 36) * stddev_samp(r))",
    "historical_var": "-quantile_cont(r, 0.05)", "parametric_var": f"-(avg(r) + {Z05} * stddev_samp(r))",
}
BENCH_SQL = {
    "alpha": "(avg(r) - covar_pop(r, b) / var_pop(b) * avg(b)) * 252", "beta": "covar_pop(r, b) / var_pop(b)",
    "information_ratio": "avg(r - b) / stddev_samp(r - b)", "r_squared": "pow(covar_samp(r, b) / (stddev_samp(r) * stddev_samp(b)), 2)",
    "benchmark_correlation": "covar_samp(r, b) / (stddev_samp(r) * stddev_samp(b))", "treynor_ratio": f"{CAGR_} / (covar_pop(r, b) / var_pop(b))",
}


def basic(*names: str):
    return lambda spark, sf: shown(series.daily(spark, sf).groupBy(*KEY).agg(*(m.BASIC[n]("r").alias(n) for n in names)))


GROUPS = {
    "returns_metrics": ("comp", "cagr", "avg_return", "avg_win", "avg_loss", "best", "worst", "win_rate", "payoff_ratio", "profit_factor"),
    "risk_metrics": ("volatility", "var", "downside_deviation", "historical_var", "parametric_var", "cornish_fisher_var"),
    "performance_metrics": ("sharpe", "sortino", "omega", "gain_to_pain_ratio", "kelly_criterion", "tail_ratio", "common_sense_ratio", "risk_return_ratio"),
    "distribution_metrics": ("skewness", "kurtosis", "geometric_mean"),
    "trading_metrics": ("exposure", "rar", "cpc_index", "risk_of_ruin", "adjusted_sortino", "sqn", "expectancy"),
}
for _name, _metrics in GROUPS.items():
    query(_name, f"{cte()} SELECT {K}, {picks({n: BASIC_SQL[n] for n in _metrics})} FROM s GROUP BY {K}")(basic(*_metrics))


@query("jarque_bera", f"""{cte("c AS (SELECT *, r - avg(r) OVER (PARTITION BY " + K + ") AS x FROM s)")},
  j AS (SELECT {K}, count(*) / 6.0 * (pow(avg(x*x*x) / pow(avg(x*x), 1.5), 2) + pow(avg(x*x*x*x) / pow(avg(x*x), 2) - 3, 2) / 4) AS v FROM c GROUP BY {K})
  SELECT {K}, round(v, 6) + 0.0 AS jb, round(exp(-v / 2), 6) + 0.0 AS p FROM j""")  # fmt: skip
def jarque_bera(spark, sf):
    return series.daily(spark, sf).groupBy(*KEY).agg(rounded(m.jarque_bera("r"), 6).alias("jb"), rounded(m.jarque_bera_p("r"), 6).alias("p"))


@query("benchmark_metrics", f"{cte()} SELECT {K}, {picks(BENCH_SQL)} FROM s GROUP BY {K}")
def benchmark_metrics(spark, sf):
    return shown(series.daily(spark, sf).groupBy(*KEY).agg(*(f("r", "b").alias(n) for n, f in m.BENCHMARK.items())))


_ADJ = f"abs(1 + {SHARPE_} * {SHARPE_} / 2 - {SK_} * {SHARPE_} + {KU_} / 4 * {SHARPE_} * {SHARPE_})"


@query("sharpe_tests", f"""{cte()} SELECT {K}, {picks({"psr_z": f"{SHARPE_} / sqrt({_ADJ} / (count(*) - 1))", "dsr_z": f"({SHARPE_} - {m.expected_max_sharpe(10)!r}) / sqrt({_ADJ} / (count(*) - 1))"})},
  CASE WHEN {SHARPE_} > -9 THEN ceil(1 + {_ADJ} * pow({Z95} / ({SHARPE_} + 9), 2)) ELSE 'Infinity'::DOUBLE END AS min_track_record FROM s GROUP BY {K}""")
def sharpe_tests(spark, sf):
    return series.daily(spark, sf).groupBy(*KEY).agg(
        rounded(m.psr_z("r")).alias("psr_z"), rounded(m.deflated_sharpe_z("r", 10)).alias("dsr_z"), m.minimum_track_record_length("r", -9.0).alias("min_track_record")
    )


def _phi(z: str) -> str:
    """The normal distribution function as its power series, for |z| up to 9."""
    x = f"least(greatest({z}, -9), 9)"
    term = "pow(x, 2 * k + 1) / exp((k + 1) * ln(2) + lgamma(k + 1.5) - ln(pi()) / 2)"
    return f"(SELECT 0.5 + exp(-x * x / 2) / sqrt(2 * pi()) * sum({term}) FROM (SELECT {x} AS x, CAST(unnest(range(120)) AS DOUBLE) AS k) GROUP BY x)"


@query("probabilistic_sharpe", f"""{cte()}, z AS (SELECT {K}, {SHARPE_} / sqrt({_ADJ} / (count(*) - 1)) AS z, ({SHARPE_} - {m.expected_max_sharpe(10)!r}) / sqrt({_ADJ} / (count(*) - 1)) AS dz FROM s GROUP BY {K})
  SELECT {K}, round({_phi("z.z")}, 8) + 0.0 AS psr, round(1 - {_phi("z.z")}, 8) + 0.0 AS p_value, round({_phi("z.dz")}, 8) + 0.0 AS dsr FROM z""")
def probabilistic_sharpe(spark, sf):
    d = series.daily(spark, sf).groupBy(*KEY).agg(m.psr_z("r").alias("z"), m.deflated_sharpe_z("r", 10).alias("dz"))
    return shown(d.select(*KEY, m.phi(F.col("z")).alias("psr"), (1 - m.phi(F.col("z"))).alias("p_value"), m.phi(F.col("dz")).alias("dsr")))


# --- order-dependent --------------------------------------------------------------------------------------------

RUN = f"PARTITION BY {K} ORDER BY t ROWS UNBOUNDED PRECEDING"
DD = (
    f"a AS (SELECT *, product(1 + r) OVER ({RUN}) AS wealth FROM s)",
    f"c AS (SELECT *, max(wealth) OVER ({RUN}) AS peak FROM a)",
    "d AS (SELECT *, (wealth - peak) / peak AS drawdown FROM c)",
)


@query("cumulative_returns", f"{cte(*DD)} SELECT {K}, t, round(wealth - 1 + 1e-9, 6) + 0.0 AS cumulative FROM d")
def cumulative(spark, sf):
    return ordered.cumulative_returns(series.daily(spark, sf), KEY).select(*KEY, "t", rounded(F.col("cumulative") + 1e-9, 6).alias("cumulative"))


@query("drawdown_series", f"{cte(*DD)} SELECT {K}, t, round(drawdown + 1e-9, 6) + 0.0 AS drawdown FROM d")
def drawdown_series(spark, sf):
    return ordered.drawdowns(series.daily(spark, sf), KEY).select(*KEY, "t", rounded(F.col("drawdown") + 1e-9, 6).alias("drawdown"))


@query("drawdown_metrics", f"""{cte(*DD)} SELECT {K}, {picks({"max_drawdown": "min(drawdown)", "ulcer_index": "sqrt(sum(drawdown * drawdown) / (count(*) - 1))",
  "calmar": f"{CAGR_} / abs(min(drawdown))", "ulcer_performance_index": f"{COMP_} / sqrt(sum(drawdown * drawdown) / (count(*) - 1))",
  "recovery_factor": "abs(sum(r)) / abs(min(drawdown))", "serenity_index": f"{CAGR_} / sqrt(sum(drawdown * drawdown) / (count(*) - 1))"})} FROM d GROUP BY {K}""")  # fmt: skip
def drawdown_metrics(spark, sf):
    full = report.full_metrics(series.daily(spark, sf), KEY, shapiro=False)
    return shown(full.select(*KEY, "max_drawdown", "ulcer_index", "calmar", "ulcer_performance_index", "recovery_factor", "serenity_index"))


@query("drawdown_details", f"""{cte(*DD)},
  n AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY {K}) - 1 AS last FROM d),
  g AS (SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER ({RUN}) AS island FROM n),
  e AS (SELECT {K}, island, min(i) AS first, max(i) AS end_in, min(drawdown) AS depth, arg_min(i, struct_pack(a := drawdown, b := i)) AS valley, max(last) AS last
    FROM g WHERE drawdown < 0 GROUP BY {K}, island),
  f AS (SELECT {K}, greatest(first - 1, 0) AS start, valley, CASE WHEN end_in < last THEN end_in + 1 ELSE last END AS "end", depth,
    CASE WHEN end_in < last THEN end_in + 1 - valley END AS recovery FROM e)
  SELECT * FROM (SELECT {K}, CAST(row_number() OVER (PARTITION BY {K} ORDER BY depth, start) AS INT) AS rank, CAST(start AS INT) AS start, CAST(valley AS INT) AS valley,
    CAST("end" AS INT) AS "end", round(depth, 8) + 0.0 AS depth, CAST("end" - start + 1 AS INT) AS length, CAST(recovery AS INT) AS recovery FROM f) WHERE rank <= 5""")
def drawdown_details(spark, sf):
    d = ordered.drawdown_details(series.daily(spark, sf), KEY)
    return shown(d.select(*KEY, "rank", *(F.col(c).cast("int").alias(c) for c in ("start", "valley", "end")), "depth", *(F.col(c).cast("int").alias(c) for c in ("length", "recovery"))))


@query("drawdown_dates", f"""{cte(*DD)},
  n AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY {K}) - 1 AS last FROM d),
  g AS (SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER ({RUN}) AS island FROM n),
  e AS (SELECT {K}, island, greatest(min(i) - 1, 0) AS a, least(max(i) + 1, max(last)) AS z, min(drawdown) AS depth, arg_min(i, struct_pack(a := drawdown, b := i)) AS v
    FROM g WHERE drawdown < 0 GROUP BY {K}, island),
  f AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY depth, a) AS rank FROM e)
  SELECT {", ".join(f"f.{k}" for k in KEY)}, CAST(f.rank AS INT) AS rank, x.t AS start_date, y.t AS valley_date, w.t AS end_date FROM f
    JOIN n x ON x.i = f.a AND {" AND ".join(f"x.{k} = f.{k}" for k in KEY)} JOIN n y ON y.i = f.v AND {" AND ".join(f"y.{k} = f.{k}" for k in KEY)}
    JOIN n w ON w.i = f.z AND {" AND ".join(f"w.{k} = f.{k}" for k in KEY)} WHERE f.rank <= 5""")
def drawdown_dates(spark, sf):
    return ordered.drawdown_details(series.daily(spark, sf), KEY, dates=True).select(*KEY, "rank", "start_date", "valley_date", "end_date")


@query("streaks", f"""{cte()}, g AS (SELECT *, sum(CASE WHEN r > 0 THEN 0 ELSE 1 END) OVER ({RUN}) AS w, sum(CASE WHEN r < 0 THEN 0 ELSE 1 END) OVER ({RUN}) AS l FROM s),
  a AS (SELECT {K}, w, count(*) AS n FROM g WHERE r > 0 GROUP BY ALL), b AS (SELECT {K}, l, count(*) AS n FROM g WHERE r < 0 GROUP BY ALL)
  SELECT x.*, y.consecutive_losses FROM (SELECT {K}, max(n) AS consecutive_wins FROM a GROUP BY {K}) x JOIN (SELECT {K}, max(n) AS consecutive_losses FROM b GROUP BY {K}) y USING ({K})""")
def streaks(spark, sf):
    return ordered.streaks(series.daily(spark, sf), KEY)


_AC = f"x AS (SELECT *, r - avg(r) OVER (PARTITION BY {K}) AS x FROM s), y AS (SELECT *, lag(x) OVER (PARTITION BY {K} ORDER BY t) AS y FROM x)"


@query("smart_ratios", f"""{cte(_AC)}, z AS (SELECT {K}, sum(x * y) / sum(x * x) AS ac, {SHARPE_} AS sh, {SORT_} AS so FROM y GROUP BY {K})
  SELECT {K}, {picks({"autocorr": "ac", "smart_sharpe": "CASE WHEN 1 + 2 * ac > 0 THEN sh / sqrt(1 + 2 * ac) ELSE 0 END", "smart_sortino": "CASE WHEN 1 + 2 * ac > 0 THEN so / sqrt(1 + 2 * ac) ELSE 0 END"})} FROM z""")  # fmt: skip
def smart_ratios(spark, sf):
    d = series.daily(spark, sf)
    a = d.groupBy(*KEY).agg(m.sharpe("r").alias("sh"), m.sortino("r").alias("so"))
    a = ordered.by_key(a, ordered.autocorrelation(d, KEY), KEY)
    p = ordered.smart_penalty(F.col("autocorr"))
    return shown(a.select(*KEY, "autocorr", F.coalesce(F.col("sh") / p, F.lit(0.0)).alias("smart_sharpe"), F.coalesce(F.col("so") / p, F.lit(0.0)).alias("smart_sortino")))


_NW_MOST = 20  # lags that the SQL can add up: enough for 139,000 returns a key


def _bartlett(j: int) -> str:
    return f"greatest(1 - {j} / (max(lags) + 1.0), 0) * coalesce(sum(x * x{j}), 0)"


_NW = " + ".join(f"2 * {_bartlett(j)}" for j in range(1, _NW_MOST + 1))
_NL = ", ".join(f"lag(x, {j}) OVER (PARTITION BY {K} ORDER BY t) AS x{j}" for j in range(1, _NW_MOST + 1))


@query("newey_west_se", f"""{cte()}, x AS (SELECT *, r - avg(r) OVER (PARTITION BY {K}) AS x, count(*) OVER (PARTITION BY {K}) AS n FROM s),
  y AS (SELECT *, greatest(1, least(floor(4 * pow(n / 100.0, 2.0 / 9)), n - 2)) AS lags, {_NL} FROM x)
  SELECT {K}, round(sqrt((sum(x * x) + {_NW}) / count(*) / count(*)), 8) + 0.0 AS newey_west_se FROM y GROUP BY {K}""")
def newey_west(spark, sf):
    return shown(ordered.newey_west_se(series.daily(spark, sf), KEY))


@query("k_ratio", f"""{cte()}, a AS (SELECT *, sum(r) OVER ({RUN}) AS y, CAST(row_number() OVER (PARTITION BY {K} ORDER BY t) - 1 AS DOUBLE) AS x FROM s),
  g AS (SELECT {K}, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy, count(*) AS n FROM a GROUP BY {K})
  SELECT {K}, round(sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) + 0.0 AS k_ratio FROM g""")
def k_ratio(spark, sf):
    return ordered.k_ratio(series.daily(spark, sf), KEY).select(*KEY, rounded(F.col("k_ratio"), 6).alias("k_ratio"))


_F = f"PARTITION BY {K} ORDER BY t ROWS 125 PRECEDING"
_SD, _DOWN = f"stddev_samp(r) OVER ({_F})", f"sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) OVER ({_F}) / 126)"
_BETA = f"covar_pop(r, b) OVER ({_F}) / var_pop(b) OVER ({_F})"


def _full(expr: str) -> str:
    return f"CASE WHEN count(r) OVER ({_F}) = 126 THEN round({expr}, 6) + 0.0 END"


@query("rolling_metrics", f"""{cte()} SELECT {K}, t, {_full(f"{_SD} * sqrt(365)")} AS rolling_volatility, {_full(f"avg(r) OVER ({_F}) / {_SD} * sqrt(365)")} AS rolling_sharpe,
  {_full(f"avg(r) OVER ({_F}) / {_DOWN} * sqrt(365)")} AS rolling_sortino, {_full(_BETA)} AS rolling_beta, {_full(f"(avg(r) OVER ({_F}) - {_BETA} * avg(b) OVER ({_F})) * 365")} AS rolling_alpha FROM s""")
def rolling_metrics(spark, sf):
    d = ordered.rolling(series.daily(spark, sf), KEY, b="b")
    names = ("rolling_volatility", "rolling_sharpe", "rolling_sortino", "rolling_beta", "rolling_alpha")
    return d.select(*KEY, "t", *(rounded(F.col(c), 6).alias(c) for c in names))


# --- calendar, histogram, filters ------------------------------------------------------------------------------

LABELS = {
    "D": "strftime(t, '%Y-%m-%d')", "W": "concat(year(t), '-', weekofyear(t))", "M": "concat(year(t), '-', month(t))",
    "Q": "concat(year(t), '-', quarter(t))", "Y": "CAST(year(t) AS VARCHAR)",
}
for _u, _label in LABELS.items():
    query(f"period_returns_{_u.lower()}", f"{cte()} SELECT {K}, {_label} AS period, round(product(1 + r) - 1, 8) + 0.0 AS ret FROM s GROUP BY ALL")(
        lambda spark, sf, u=_u: shown(ordered.period_returns(series.daily(spark, sf), KEY, "t", u))
    )
YEARS = list(range(1995, 2002))  # that the tables hold, which the query finds by itself


@query("monthly_returns", cte(key="1 AS one") + f" SELECT CAST(month(t) AS INT) AS month, {', '.join(f'round(product(1 + r) FILTER (WHERE year(t) = {y}) - 1, 8) + 0.0 AS "{y}"' for y in YEARS)} FROM s GROUP BY 1")
def monthly_returns(spark, sf):
    return shown(ordered.monthly_returns(series.daily(spark, sf, []), "t"))


@query("monthly_returns_by_key", cte() + f" SELECT {K}, CAST(month(t) AS INT) AS month, {', '.join(f'round(product(1 + r) FILTER (WHERE year(t) = {y}) - 1, 8) + 0.0 AS "{y}"' for y in YEARS)} FROM s GROUP BY ALL")
def monthly_returns_by_key(spark, sf):
    return shown(ordered.monthly_returns(series.daily(spark, sf), "t", key=KEY))


@query("aligned_benchmark", f"""{cte()}, b AS (SELECT t AS bt, avg(b) AS m FROM s GROUP BY t HAVING count(*) > 2)
  SELECT {K}, round(covar_pop(r, m) / var_pop(m), 8) + 0.0 AS beta, round((avg(r) - covar_pop(r, m) / var_pop(m) * avg(m)) * 252, 8) + 0.0 AS alpha FROM s JOIN b ON s.t = b.bt GROUP BY {K}""")
def aligned_benchmark(spark, sf):
    """A benchmark with rows of its own, on some of the days only."""
    from . import api

    d = series.daily(spark, sf)
    days = d.groupBy("t").agg(F.avg("b").alias("m"), F.count("*").alias("n")).where("n > 2").drop("n")
    return shown(api.of(d.drop("b"), KEY).with_benchmark(days, "m").greeks())


_PERIODS = " UNION ALL ".join(f"SELECT {K}, '{u}' AS frequency, {label} AS period, product(1 + r) - 1 AS ret FROM s GROUP BY ALL" for u, label in LABELS.items())


@query("distribution", f"""{cte()}, p AS ({_PERIODS}),
  a AS (SELECT *, row_number() OVER (PARTITION BY {K}, frequency ORDER BY ret) - 1 AS rk, count(*) OVER (PARTITION BY {K}, frequency) AS n FROM p),
  q AS (SELECT *, max(CASE WHEN rk = floor((n - 1) * 0.25 + 0.5) THEN ret END) OVER (PARTITION BY {K}, frequency) AS q1,
    max(CASE WHEN rk = floor((n - 1) * 0.75 + 0.5) THEN ret END) OVER (PARTITION BY {K}, frequency) AS q3 FROM a)
  SELECT {K}, frequency, {picks({"mean": "avg(ret)", "std": "coalesce(stddev_samp(ret), 0)", "min": "min(ret)", "max": "max(ret)"})}, count(*) AS count,
    count(*) FILTER (WHERE ret < q1 - 1.5 * (q3 - q1) OR ret > q3 + 1.5 * (q3 - q1)) AS outliers FROM q GROUP BY {K}, frequency""")
def distribution(spark, sf):
    return shown(ordered.distribution(series.daily(spark, sf), KEY, "t"))


@query("compare", f"{cte()} SELECT {K}, t, round(r, 8) + 0.0 AS r, round(b, 8) + 0.0 AS b, round(r - b, 8) + 0.0 AS excess, CASE WHEN r > b THEN 1 ELSE 0 END AS win FROM s")
def compare(spark, sf):
    return shown(ordered.compare(series.daily(spark, sf)))


@query("histogram", f"""{cte()}, a AS (SELECT {K}, min(r) AS lo, (max(r) - min(r)) / 20 AS w, count(*) AS n FROM s GROUP BY {K}),
  c AS (SELECT {K}, CAST(greatest(0, least(ceil((r - lo) / w) - 1, 19)) AS INT) AS bin, count(*) AS count FROM s JOIN a USING ({K}) GROUP BY ALL),
  e AS (SELECT a.*, CAST(unnest(range(20)) AS INT) AS bin FROM a)
  SELECT {K}, bin, round(lo + bin * w, 8) + 0.0 AS bin_start, round(lo + (bin + 1) * w, 8) + 0.0 AS bin_end, round(lo + (bin + 0.5) * w, 8) + 0.0 AS bin_center,
    coalesce(count, 0) AS count, round(coalesce(count, 0) / CAST(n AS DOUBLE), 8) + 0.0 AS frequency, round(coalesce(count, 0) / CAST(n AS DOUBLE) / w, 6) + 0.0 AS density FROM e LEFT JOIN c USING ({K}, bin)""")
def histogram(spark, sf):
    d = ordered.histogram(series.daily(spark, sf), KEY, bins=20, density=True)
    return shown(d.withColumn("density", rounded(F.col("density"), 6)), "density")


_Q = f"q AS (SELECT {K}, quantile_cont(r, 0.95) AS cut, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.75) AS q3 FROM s GROUP BY {K})"
FILTERS = {
    "outliers": (ordered.outliers, "r > cut"), "remove_outliers": (ordered.remove_outliers, "r < cut"),
    "outliers_iqr": (ordered.outliers_iqr, "(r < q1 - 1.5 * (q3 - q1) OR r > q3 + 1.5 * (q3 - q1))"),
    "remove_outliers_iqr": (ordered.remove_outliers_iqr, "NOT (r < q1 - 1.5 * (q3 - q1) OR r > q3 + 1.5 * (q3 - q1))"),
}
for _n, (_f, _test) in FILTERS.items():
    query(_n, f"{cte(_Q)} SELECT {K}, t, round(r, 8) + 0.0 AS r FROM s JOIN q USING ({K}) WHERE {_test}")(
        lambda spark, sf, f=_f: shown(f(series.daily(spark, sf), KEY).select(*KEY, "t", "r"))
    )


@query("outlier_ratios", f"""{cte()}, q AS (SELECT {K}, quantile_cont(r, 0.99) FILTER (WHERE r > 0) AS qw, quantile_cont(-r, 0.99) FILTER (WHERE r < 0) AS ql FROM s GROUP BY {K})
  SELECT {K}, {picks({"outlier_win_ratio": "avg(r) FILTER (WHERE r > 0 AND r >= qw) / avg(r) FILTER (WHERE r > 0)", "outlier_loss_ratio": "avg(-r) FILTER (WHERE r < 0 AND -r >= ql) / avg(-r) FILTER (WHERE r < 0)"})} FROM s JOIN q USING ({K}) GROUP BY {K}""")
def outlier_ratios(spark, sf):
    return shown(ordered.outlier_ratios(series.daily(spark, sf), KEY))


@query("cvar", f"{cte()}, q AS (SELECT {K}, avg(r) + {Z05} * stddev_samp(r) AS v FROM s GROUP BY {K}) SELECT {K}, round(coalesce(avg(r) FILTER (WHERE r <= v), min(r)), 8) + 0.0 AS cvar FROM s JOIN q USING ({K}) GROUP BY {K}")
def cvar(spark, sf):
    return shown(ordered.cvar(series.daily(spark, sf), KEY))


@query("tail_dependence", f"""{cte()}, q AS (SELECT {K}, quantile_cont(r, 0.05) AS qa, quantile_cont(b, 0.05) AS qb FROM s GROUP BY {K})
  SELECT {K}, round(count(*) FILTER (WHERE r <= qa AND b <= qb) / CAST(count(*) FILTER (WHERE r <= qa) AS DOUBLE), 8) + 0.0 AS lower_tail_dependence FROM s JOIN q USING ({K}) GROUP BY {K}""")
def tail_dependence(spark, sf):
    return shown(ordered.tail_dependence(series.daily(spark, sf), KEY, "r", "b"))


_CORR = "covar_samp(r, b) FILTER (WHERE r {c} 0) / (stddev_samp(r) FILTER (WHERE r {c} 0) * stddev_samp(b) FILTER (WHERE r {c} 0))"


@query("side_correlations", f"{cte()} SELECT {K}, {picks({'downside_correlation': _CORR.format(c='<'), 'upside_correlation': _CORR.format(c='>')})} FROM s GROUP BY {K}")
def side_correlations(spark, sf):
    d = series.daily(spark, sf)
    return shown(ordered.by_key(ordered.side_correlation(d, KEY, "r", "b"), ordered.side_correlation(d, KEY, "r", "b", down=False), KEY))


@query("infer_frequency", f"""{cte()}, g AS (SELECT {K}, epoch(t) - epoch(lag(t) OVER (PARTITION BY {K} ORDER BY t)) AS gap FROM s), x AS (SELECT {K}, median(gap) AS m FROM g GROUP BY {K})
  SELECT {K}, CASE WHEN m < 60 THEN 's' WHEN m < 3600 THEN 'min' WHEN m < 86400 THEN 'H' WHEN m < 604800 THEN 'D' WHEN m < 2592000 THEN 'W' ELSE 'M' END AS frequency FROM x""")
def infer_frequency(spark, sf):
    return ordered.infer_frequency(series.daily(spark, sf), KEY, "t")


@query("log_returns", f"{cte()} SELECT {K}, t, round(ln(1 + r), 8) + 0.0 AS log_return, round(exp(ln(1 + r)) - 1, 8) + 0.0 AS simple_return FROM s")
def log_returns(spark, sf):
    d = series.daily(spark, sf).withColumn("log_return", ordered.log_returns(F.col("r")))
    return shown(d.select(*KEY, "t", "log_return", ordered.simple_returns(F.col("log_return")).alias("simple_return")))


# --- trades, execution ----------------------------------------------------------------------------------------

T = f"WITH {series.TRADES_SQL}"
RET = "(CASE direction WHEN 'long' THEN 1 ELSE -1 END) * (exit_price - entry_price) / entry_price - CASE WHEN fees > 0 THEN fees / (entry_price * quantity) ELSE 0 END"
CLOSED = f"c AS (SELECT *, {RET} AS ret FROM t WHERE exit_time IS NOT NULL)"


@query("trade_returns", f"{T}, {CLOSED} SELECT entry_time, exit_time, entry_price, quantity, round(ret, 8) + 0.0 AS ret FROM c")
def trade_returns(spark, sf):
    d = trades.trade_returns(series.trades(spark, sf))
    return d.select("entry_time", "exit_time", "entry_price", "quantity", rounded(F.col("trade_return")).alias("ret"))


@query("trade_summary", f"{T}, {CLOSED} SELECT count(*) AS n_trades, count(*) FILTER (WHERE ret > 0) AS n_winning, count(*) FILTER (WHERE ret < 0) AS n_losing, round(sum(fees), 2) AS total_fees FROM c")
def trade_summary(spark, sf):
    s = trades.trades_to_returns(series.trades(spark, sf)).summary
    return s.withColumn("total_fees", F.round("total_fees", 2))


for _u, _unit in (("W", "week"), ("M", "month")):
    query(
        f"trades_by_{_unit}",
        f"""{T}, {CLOSED}, b AS (SELECT CAST(date_trunc('{_unit}', exit_time) AS DATE) AS date, product(1 + ret) - 1 AS returns FROM c GROUP BY 1),
  d AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 {_unit})) AS DATE) AS date FROM b)
  SELECT date, round(coalesce(returns, 0), 6) + 0.0 AS returns FROM d LEFT JOIN b USING (date)""",
    )(lambda spark, sf, u=_u: trades.trades_to_returns(series.trades(spark, sf), aggregation=u).returns.select("date", rounded(F.col("returns"), 6).alias("returns")))

CAPITAL = 1e9
_NAV = f"""{T}, {series.PRICES_SQL},
  x AS (SELECT *, CASE direction WHEN 'long' THEN 1 ELSE -1 END AS s, CAST(entry_time AS DATE) AS d0, CAST(exit_time AS DATE) AS d1 FROM t),
  f AS (SELECT d0 AS date, symbol, -s * entry_price * quantity - fees / 2 AS cash, s * quantity AS qty, s * entry_price * quantity AS cost FROM x
    UNION ALL SELECT d1, symbol, s * exit_price * quantity - fees / 2, -s * quantity, -s * entry_price * quantity FROM x WHERE d1 IS NOT NULL),
  d AS (SELECT CAST(unnest(generate_series(min(d0), max(greatest(d0, coalesce(d1, d0))), INTERVAL 1 DAY)) AS DATE) AS date FROM x),
  c AS (SELECT d.date, sum(coalesce(sum(cash), 0)) OVER (ORDER BY d.date) + {CAPITAL!r} AS cash FROM d LEFT JOIN f USING (date) GROUP BY d.date),
  g AS (SELECT d.date, y.symbol, sum(coalesce(h.qty, 0)) OVER k AS qty, sum(coalesce(h.cost, 0)) OVER k AS cost FROM d CROSS JOIN (SELECT DISTINCT symbol FROM f) y
    LEFT JOIN (SELECT date, symbol, sum(qty) AS qty, sum(cost) AS cost FROM f GROUP BY ALL) h ON h.date = d.date AND h.symbol = y.symbol WINDOW k AS (PARTITION BY y.symbol ORDER BY d.date)),
  v AS (SELECT g.date, sum({{value}}) AS position_value FROM g ASOF LEFT JOIN p ON g.symbol = p.symbol AND g.date >= p.date GROUP BY g.date)
  SELECT date, round(cash, 4) + 0.0 AS cash, round(position_value, 4) + 0.0 AS position_value, round(cash + position_value, 4) + 0.0 AS nav FROM c JOIN v USING (date)"""


def _nav(d: DataFrame) -> DataFrame:
    return d.select("date", *(rounded(F.col(c), 4).alias(c) for c in ("cash", "position_value", "nav")))


@query("equity_curve", _NAV.format(value="coalesce(g.qty * p.close, g.cost)"))
def equity_curve(spark, sf):
    return _nav(trades.build_equity_curve(series.trades(spark, sf), CAPITAL, series.prices(spark, sf)))


@query("equity_curve_no_mtm", _NAV.format(value="g.cost"))
def equity_curve_no_mtm(spark, sf):
    return _nav(trades.build_equity_curve_no_mtm(series.trades(spark, sf), CAPITAL))


def fills(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    p = series.cents(F.col("l_extendedprice") / F.col("l_quantity"))
    d = li.select("l_orderkey", p.alias("price"), F.col("l_quantity").alias("qty"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("seq"))
    return d.withColumns({"decision_price": F.lit(1000.0), "side": F.lit(1)})


_FILLS = "f AS (SELECT l_orderkey, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS price, l_quantity AS qty, struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_shipdate) AS seq FROM lineitem)"


@query("implementation_shortfall", f"""WITH {_FILLS}, s AS (SELECT l_orderkey, sum(qty) AS n, sum(price * qty) / sum(qty) AS vwap, arg_min(price, seq) AS a, arg_max(price, seq) AS e FROM f GROUP BY 1)
  SELECT l_orderkey, {picks({"vwap": "vwap", "paper": "(e - 1000) * n", "realised": "(e - vwap) * n", "shortfall": "(e - 1000) * n - (e - vwap) * n", "delay": "(a - 1000) * n", "trading": "(vwap - a) * n", "opportunity": "CAST(0 AS DOUBLE)", "bps": "((e - 1000) * n - (e - vwap) * n) / (1000 * n) * 10000"}).replace(", 8)", " + 1e-7, 4)")} FROM s""")
def implementation_shortfall(spark, sf):
    d = execution.implementation_shortfall(fills(spark, sf), ["l_orderkey"])
    return d.select(*(rounded(F.col(c) + 1e-7, 4).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes))


@query("execution_costs", f"""WITH {_FILLS} SELECT round(sum(price * qty) / sum(qty), 4) AS vwap, round((sum(price * qty) / sum(qty) - 1000) / 1000 * 10000, 4) AS slippage_bps,
  round(avg((price + 1 - price) / ((price + price + 1) / 2)) * 10000, 4) AS spread_bps, round(max(0.1 * (0.2 / sqrt(252)) * sqrt(qty / 1e6)), 8) AS impact FROM f""")
def execution_costs(spark, sf):
    f = fills(spark, sf).withColumns({"ask": F.col("price") + 1, "adv": F.lit(1e6), "sigma": F.lit(0.2)})
    return f.agg(
        F.round(m.vwap("price", "qty"), 4).alias("vwap"), F.round(m.vwap_slippage("price", "qty", 1000.0), 4).alias("slippage_bps"),
        F.round(m.spread_cost("price", "ask"), 4).alias("spread_bps"), F.round(F.max(m.market_impact_estimate("qty", "adv", "sigma")), 8).alias("impact"),
    )


# --- portfolio, systemic, models --------------------------------------------------------------------------------


def wide(spark, sf) -> DataFrame:
    d = series.daily(spark, sf, ["l_returnflag"])
    return d.groupBy("t").pivot("l_returnflag", ASSETS).agg(F.first("r"))


_WIDE = series.DAILY_SQL.format(key="l_returnflag") + ", w AS (SELECT t, " + ", ".join(f"coalesce(max(r) FILTER (WHERE l_returnflag = '{a}'), 0) AS {a}" for a in ASSETS) + " FROM s GROUP BY t)"
_SIGMA = "sqrt(" + " + ".join(f"{x * y} * covar_samp({a}, {c})" for a, x in zip(ASSETS, WEIGHTS, strict=True) for c, y in zip(ASSETS, WEIGHTS, strict=True)) + ")"


def _mcr_sql(a: str, wa: float) -> str:
    mcr = "(" + " + ".join(f"{y} * covar_samp({a}, {c})" for c, y in zip(ASSETS, WEIGHTS, strict=True)) + f") / {_SIGMA}"
    return f"SELECT '{a}' AS asset, round({mcr}, 8) + 0.0 AS mcr, round({wa} * {mcr} / {_SIGMA}, 8) + 0.0 AS pcr, round({_SIGMA} * sqrt(252), 8) + 0.0 AS portfolio_volatility FROM w"


@query("marginal_contribution_to_risk", f"WITH {_WIDE} " + " UNION ALL ".join(_mcr_sql(a, x) for a, x in zip(ASSETS, WEIGHTS, strict=True)))
def marginal_contribution(spark, sf):
    d = wide(spark, sf)
    x = models.marginal_contribution_to_risk(d, ASSETS, WEIGHTS)
    vol = models.portfolio_volatility(d, ASSETS, WEIGHTS)
    rows = [(a, float(mc), float(pc), vol) for a, mc, pc in zip(ASSETS, x["mcr"], x["pcr"], strict=True)]
    return shown(spark.createDataFrame(rows, "asset string, mcr double, pcr double, portfolio_volatility double"))


_PAIRS = [(a, b) for a in ASSETS for b in ASSETS]
_LW = f"""{_WIDE}, g AS (SELECT count(*) AS rows_, {", ".join(f"covar_pop({a}, {b}) AS {a}{b}" for a, b in _PAIRS)}, {", ".join(f"avg({a}) AS m{a}" for a in ASSETS)} FROM w),
  f AS (SELECT sum(pow({" + ".join(f"({a} - m{a}) * ({a} - m{a})" for a in ASSETS)}, 2)) AS fourth FROM w, g),
  t AS (SELECT *, ({" + ".join(a + a for a in ASSETS)}) / 3 AS mu FROM g, f),
  d AS (SELECT *, greatest(0, least(1, (fourth - rows_ * ({" + ".join(f"{a}{b} * {a}{b}" for a, b in _PAIRS)})) / rows_ / rows_
    / ({" + ".join(f"pow({a}{b} - {'mu' if a == b else '0'}, 2)" for a, b in _PAIRS)}))) AS delta FROM t)"""


@query("ledoit_wolf_covariance", f"WITH {_LW} " + " UNION ALL ".join(
    f"SELECT '{a}' AS asset, '{b}' AS other, round(delta * {'mu' if a == b else '0'} + (1 - delta) * {a}{b}, 8) + 0.0 AS covariance, round(delta, 8) + 0.0 AS shrinkage FROM d" for a, b in _PAIRS))
def ledoit_wolf(spark, sf):
    x = models.ledoit_wolf_covariance(wide(spark, sf), ASSETS)
    rows = [(a, b, float(x["covariance"][i, j]), x["shrinkage"]) for i, a in enumerate(ASSETS) for j, b in enumerate(ASSETS)]
    return shown(spark.createDataFrame(rows, "asset string, other string, covariance double, shrinkage double"))


_EIG = "1 + 2 * sqrt(q / 3) * cos((acos(greatest(-1, least(1, det / pow(q / 3, 1.5)))) - 2 * pi() * {k}) / 3)"  # of a correlation matrix of three


@query("absorption_ratio", f"""WITH {_WIDE}, c AS (SELECT corr(A, N) AS a, corr(A, R) AS b, corr(N, R) AS c FROM w),
  e AS (SELECT a * a + b * b + c * c AS q, a * b * c AS det FROM c),
  v AS (SELECT list_reverse_sort([{", ".join(_EIG.format(k=k) for k in range(3))}]) AS x FROM e)
  SELECT round(x[1] / list_sum(x), 8) + 0.0 AS ratio, CAST(1 AS INT) AS components, round(x[1], 8) + 0.0 AS first, round(x[2], 8) + 0.0 AS second, round(x[3], 8) + 0.0 AS third FROM v""")
def absorption(spark, sf):
    x = models.absorption_ratio(wide(spark, sf), ASSETS)
    row = (x["ratio"], x["components"], *(float(v) for v in x["eigenvalues"]))
    return shown(spark.createDataFrame([row], "ratio double, components int, first double, second double, third double"))


_EVAR = "ln(avg(exp(-exp(x) * r)) / 0.05) / exp(x)"
_CELL = "ln(10000) / 200"  # 200 cells over all z, then 400 over the two around the best


@query("entropic_var", f"""{cte()}, c AS (SELECT {K}, x, {_EVAR} AS v FROM s, (SELECT ln(0.01) + i * {_CELL} AS x FROM range(201) q(i)) GROUP BY {K}, x),
  b AS (SELECT {K}, arg_min(x, v) AS top FROM c GROUP BY {K}),
  f AS (SELECT {K}, x, {_EVAR} AS v FROM (SELECT s.*, least(greatest(top + (i / 200.0 - 1) * {_CELL}, ln(0.01)), ln(100)) AS x FROM s JOIN b USING ({K}), range(401) q(i)) GROUP BY {K}, x)
  SELECT {K}, round(min(v), 6) + 0.0 AS entropic_var FROM f GROUP BY {K}""")
def entropic(spark, sf):
    d = models.entropic_var(series.daily(spark, sf), KEY)
    return d.withColumn("entropic_var", rounded(F.col("entropic_var"), 6))


@query("shapiro_wilk")
def shapiro(spark, sf):
    return shown(models.shapiro(series.daily(spark, sf), KEY))


@query("arch_effect_test")
def arch(spark, sf):
    return shown(models.arch_effect_test(series.daily(spark, sf), KEY))


_R2 = "(pow(corr(e, e1), 2) + pow(corr(e, e2), 2) - 2 * corr(e, e1) * corr(e, e2) * corr(e1, e2)) / (1 - pow(corr(e1, e2), 2))"


@query("arch_effect_two_lags", f"""{cte()}, c AS (SELECT *, pow(r - avg(r) OVER (PARTITION BY {K}), 2) AS e FROM s),
  l AS (SELECT *, lag(e) OVER (PARTITION BY {K} ORDER BY t) AS e1, lag(e, 2) OVER (PARTITION BY {K} ORDER BY t) AS e2 FROM c),
  g AS (SELECT {K}, count(*) * {_R2} AS stat FROM l WHERE e2 IS NOT NULL GROUP BY {K})
  SELECT {K}, round(stat, 6) + 0.0 AS arch_stat, round(exp(-stat / 2), 6) + 0.0 AS arch_p, exp(-stat / 2) < 0.05 AS arch_effect FROM g""")
def arch_two_lags(spark, sf):
    """The test by its closed form for two lags, whose statistic has an exponential tail."""
    d = models.arch_effect_test(series.daily(spark, sf), KEY, lags=2)
    return d.withColumns({c: rounded(F.col(c), 6) for c in ("arch_stat", "arch_p")})


@query("garch_volatility", f"""WITH RECURSIVE {series.DAILY_SQL.format(key=K)}, n AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY t) AS i, var_samp(r) OVER (PARTITION BY {K}) AS v FROM s),
  g AS (SELECT {K}, t, i, r, v, v AS s2 FROM n WHERE i = 1
    UNION ALL SELECT n.l_returnflag, n.l_linestatus, n.t, n.i, n.r, n.v, n.v * (1 - 0.10 - 0.85) + 0.10 * g.r * g.r + 0.85 * g.s2 FROM g JOIN n ON n.l_returnflag = g.l_returnflag AND n.l_linestatus = g.l_linestatus AND n.i = g.i + 1)
  SELECT {K}, t, round(sqrt(s2), 8) + 0.0 AS garch_vol FROM g""")
def garch(spark, sf):
    return shown(models.garch_volatility(series.daily(spark, sf), KEY).select(*KEY, "t", "garch_vol"))


# --- reports ---------------------------------------------------------------------------------------------------

_SUM = {k: BASIC_SQL[k] for k in ("comp", "cagr", "volatility", "sharpe", "sortino", "win_rate", "profit_factor", "var")}


@query("metrics_summary", f"""{cte(*DD)}, q AS (SELECT {K}, avg(r) + {Z05} * stddev_samp(r) AS v FROM s GROUP BY {K})
  SELECT {K}, {picks(_SUM | {"max_drawdown": "min(drawdown)", "calmar": f"{CAGR_} / abs(min(drawdown))", "cvar": "coalesce(avg(r) FILTER (WHERE r <= v), min(r))"})} FROM d JOIN q USING ({K}) GROUP BY {K}""")
def metrics_summary(spark, sf):
    return shown(report.full_metrics(series.daily(spark, sf), KEY, shapiro=False).select(*KEY, *report.HEADLINE))


_PARTS = (*GROUPS, "drawdown_metrics", "streaks", "smart_ratios", "k_ratio", "cvar", "outlier_ratios", "benchmark_metrics")
_SIX = ("k_ratio",)  # names that their own queries round to six places


@query("report_metrics", "SELECT * EXCLUDE (historical_var, parametric_var, cornish_fisher_var, benchmark_correlation) FROM " + " JOIN ".join(f"({SQL[n]}) AS {n}_" + (f" USING ({K})" if i else "") for i, n in enumerate(_PARTS)))
def report_metrics(spark, sf):
    """Every metric of the report that SQL can express, from the report's one pass."""
    names = [n for g in GROUPS.values() for n in g if n not in ("historical_var", "parametric_var", "cornish_fisher_var")]
    names += ["max_drawdown", "ulcer_index", "calmar", "ulcer_performance_index", "recovery_factor", "serenity_index", "consecutive_wins", "consecutive_losses"]
    names += ["autocorr", "smart_sharpe", "smart_sortino", "k_ratio", "cvar", "outlier_win_ratio", "outlier_loss_ratio", "alpha", "beta", "information_ratio", "r_squared", "treynor_ratio"]
    full = report.full_metrics(series.daily(spark, sf), KEY, b="b", shapiro=False).select(*KEY, *names)
    return shown(full.withColumns({n: rounded(F.col(n), 6) for n in _SIX}), *_SIX)


@query("full_metrics")
def full_metrics(spark, sf):
    return shown(report.long_form(report.full_metrics(series.daily(spark, sf), KEY, b="b"), KEY))


@query("windowed_event_metrics", """WITH e AS (SELECT event_type, CAST(ts AS DATE) AS day, (value - 50) / 10000 AS r FROM events)
  SELECT event_type, day, """ + picks({"comp": COMP_, "avg_return": "avg(r)", "win_rate": W_, "volatility": "stddev_samp(r) * sqrt(252)"}) + " FROM e GROUP BY ALL")
def windowed_event_metrics(spark, sf):
    from ..streaming.live import windowed_metrics

    e = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", ((F.col("value") - 50) / 10000).alias("r"))
    names = ("comp", "avg_return", "win_rate", "volatility")
    d = windowed_metrics(e, ["event_type"], names=names)
    return shown(d.select("event_type", F.to_date("window.start").alias("day"), *names))
