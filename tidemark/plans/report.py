"""Fused metric reports: one shuffle by key, its windows, and one aggregate over them for all metrics.

Nothing is joined, so null keys stay, the source is read once, and what a caller does not select is not computed.
"""

from __future__ import annotations

import html
import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EmptySeriesError
from ..functions import metrics as m
from ..operators import models
from ..operators import ordered as o

#: metrics of each report section, in order: fixed names
SECTIONS = {
    "returns": ("comp", "cagr", "avg_return", "avg_win", "avg_loss", "best", "worst", "win_rate", "payoff_ratio", "profit_factor", "consecutive_wins", "consecutive_losses"),
    "risk": ("volatility", "var", "cvar", "max_drawdown", "ulcer_index", "downside_deviation"),
    "performance": ("sharpe", "sortino", "calmar", "omega", "gain_to_pain_ratio", "ulcer_performance_index", "kelly_criterion", "tail_ratio", "common_sense_ratio", "risk_return_ratio", "recovery_factor"),
    "distribution": ("skewness", "kurtosis", "jarque_bera", "jarque_bera_p", "shapiro_w", "shapiro_p", "outlier_win_ratio", "outlier_loss_ratio", "expected_return", "geometric_mean"),
    "trading": ("exposure", "ghpr", "rar", "cpc_index", "serenity_index", "risk_of_ruin", "adjusted_sortino", "smart_sharpe", "smart_sortino", "sqn", "expectancy", "k_ratio"),
    "benchmark": ("alpha", "beta", "information_ratio", "r_squared", "treynor_ratio"),
}
HEADLINE = ("comp", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate", "profit_factor", "var", "cvar")


def full_metrics(
    df: DataFrame, key: list[str], t: str = "t", r: str = "r", b: str | None = None, *, rf: float | None = None, ppy: int | None = None,
    confidence: float | None = None, quantile: float = 0.99, shapiro: bool = True,
) -> DataFrame:
    """A row per key, null included, with every metric of SECTIONS as a column (the benchmark's only with b).

    Null returns are dropped first; a key without any other has no row.
    """
    c = F.col
    x = c(r)
    by, run = Window.partitionBy(*key), o.running(key, t)
    since = lambda test: c("_n") - F.coalesce(F.max(F.when(~test, c("_n"))).over(run), F.lit(0))
    d = o.drawdowns(df, key, t, r).withColumn("_n", F.row_number().over(o.w(key, t)))
    d = d.withColumns(
        {
            "_mean": F.avg(x).over(by), "_sd": F.coalesce(F.stddev_samp(x).over(by), F.lit(0.0)), "_sum": F.sum(x).over(run), "_before": F.lag(x).over(o.w(key, t)),
            "_far_win": F.percentile(F.when(x > 0, x), F.lit(quantile)).over(by), "_far_loss": F.percentile(F.when(x < 0, -x), F.lit(quantile)).over(by),
            "_wins": since(x > 0), "_losses": since(x < 0),
        }
    )
    aggregates = {n: f(r) for n, f in m.BASIC.items()} | {
        "cagr": m.cagr(r, ppy), "volatility": m.volatility(r, ppy), "var": m.var(r, confidence=confidence), "downside_deviation": m.downside_deviation(r, ppy=ppy),
        "sharpe": m.sharpe(r, rf, ppy), "sortino": m.sortino(r, rf, ppy), "omega": m.omega(r, ppy=ppy), "rar": m.rar(r, ppy), "adjusted_sortino": m.adjusted_sortino(r, rf, ppy),
        "expected_return": m.avg_return(r), "ghpr": m.ghpr(r), "total": m.total(r), "psr_z": m.psr_z(r, ppy=ppy),
    }
    if b:
        aggregates |= {"alpha": m.alpha(r, b, ppy), "beta": m.beta(r, b), "information_ratio": m.information_ratio(r, b), "r_squared": m.r_squared(r, b), "treynor_ratio": m.treynor_ratio(r, b, rf, ppy)}
    dev, dev_before = x - c("_mean"), c("_before") - c("_mean")
    cut = c("_mean") + m.z(confidence) * c("_sd")
    far = lambda v, q: F.coalesce(m.safe_div(F.avg(F.when(v >= c(q), v)), F.avg(v)), F.lit(0.0))
    longest = lambda n: F.coalesce(F.max(n), F.lit(0)).cast("long")
    aggregates |= o.drawdown_aggregates() | {
        "consecutive_wins": longest(c("_wins")), "consecutive_losses": longest(c("_losses")),
        "autocorr": o.lagged_ratio(dev, dev_before, 1), "k_ratio": o.trend_ratio(c("_sum"), (c("_n") - 1).cast("double")),
        "cvar": F.coalesce(F.avg(F.when(x <= cut, x)), F.min(x)),
        "outlier_win_ratio": far(F.when(x > 0, x), "_far_win"), "outlier_loss_ratio": far(F.when(x < 0, -x), "_far_loss"),
        "first_time": F.min(t), "last_time": F.max(t), "points": F.count("*"),
    }
    if shapiro:
        aggregates["_first"] = models.first_values(x, c("_n"))
    out = d.groupBy(*key).agg(*(v.alias(n) for n, v in aggregates.items()))
    if shapiro:
        out = out.withColumn("_first", models.royston(c("_first"))).withColumns({"shapiro_w": c("_first.w"), "shapiro_p": c("_first.p")}).drop("_first")
    f = m.get_config().risk_free_rate if rf is None else rf
    penalty = o.smart_penalty(c("autocorr"))
    return out.withColumns(
        {
            "calmar": m.ratio(c("cagr"), F.abs(c("max_drawdown"))),
            "ulcer_performance_index": m.ratio(c("comp") - f, c("ulcer_index")),
            "recovery_factor": F.when(c("max_drawdown") != 0, F.abs(c("total")) / F.abs(c("max_drawdown"))).when(c("total") > 0, m.INF).otherwise(0.0),
            "serenity_index": m.ratio(c("cagr"), c("ulcer_index")),
            "smart_sharpe": F.coalesce(c("sharpe") / penalty, F.lit(0.0)),
            "smart_sortino": F.coalesce(c("sortino") / penalty, F.lit(0.0)),
        }
    )


def long_form(full: DataFrame, key: list[str]) -> DataFrame:
    """key, category, metric, value."""
    rows = [
        F.struct(F.lit(s).alias("category"), F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
        for s, names in SECTIONS.items()
        for n in names
        if n in full.columns
    ]
    return full.select(*key, F.explode(F.array(*rows)).alias("x")).select(*key, "x.*")


@dataclass
class MetricsReport:
    """The sections of one series, as dicts, and its first and last time and number of values."""

    sections: dict[str, dict[str, float]]
    first: object = None
    last: object = None
    points: int | None = None

    def to_dict(self) -> dict:
        return self.sections

    def to_json(self) -> str:
        return json.dumps(self.sections, default=str)

    def to_df(self, spark) -> DataFrame:
        rows = [(s, n, None if v is None else float(v)) for s, x in self.sections.items() for n, v in x.items()]
        return spark.createDataFrame(rows, "category string, metric string, value double")


def report(df: DataFrame, t: str = "t", r: str = "r", b: str | None = None, **options) -> MetricsReport:
    """The report of a single series; EmptySeriesError without a row."""
    row = full_metrics(df.withColumn("_one", F.lit(1)), ["_one"], t, r, b, **options).first()
    if row is None:
        raise EmptySeriesError("the series has no values")
    have = row.asDict()
    sections = {s: {n: have[n] for n in names if n in have} for s, names in SECTIONS.items() if names[0] in have}
    return MetricsReport(sections, have["first_time"], have["last_time"], have["points"])


PERCENT = ("return", "cagr", "comp", "rate", "drawdown", "volatility", "var", "win", "loss", "alpha", "deviation")
HTML_KEYS = ("comp", "cagr", "sharpe", "max_drawdown")


def shown(name: str, v) -> str:
    if v is None:
        return "N/A"
    if isinstance(v, float) and not math.isfinite(v):
        return "∞" if v == math.inf else "-∞" if v == -math.inf else "N/A"
    if isinstance(v, int):
        return f"{v:,}"
    return f"{v:.2%}" if any(p in name for p in PERCENT) and "ratio" not in name else f"{v:.4f}"


def tone(v) -> str:
    """A value's class in the page, by its sign."""
    return "" if not isinstance(v, float) or math.isnan(v) or v == 0 else "up" if v > 0 else "down"


def html_report(rep: MetricsReport, title: str = "Metrics of a return series") -> str:
    flat = {n: v for x in rep.sections.values() for n, v in x.items()}
    heads = [k for k in (*HTML_KEYS, "alpha") if k in flat]
    label = lambda n: html.escape(n.replace("_", " "))
    top = "".join(f'<div class="head"><span>{label(k)}</span><b class="{tone(flat[k])}">{shown(k, flat[k])}</b></div>' for k in heads)
    cards = "".join(
        f"<section><h2>{label(s)}</h2><table>{''.join(f'<tr><td>{label(n)}</td><td class="{tone(v)}">{shown(n, v)}</td></tr>' for n, v in x.items())}</table></section>"
        for s, x in rep.sections.items()
    )
    style = "body{font-family:sans-serif}.heads{display:flex;gap:2em}.head b{display:block}main{display:grid;grid-template-columns:repeat(3,1fr)}.up{color:#176b3a}.down{color:#a3221c}"
    span = "" if rep.points is None else f"<p>{html.escape(str(rep.first))} to {html.escape(str(rep.last))}, {rep.points:,} values</p>"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{span}<div class='heads'>{top}</div><main>{cards}</main></body></html>"


def save_html_report(rep: MetricsReport, path, title: str = "Metrics of a return series"):
    from pathlib import Path

    out = Path(path)
    out.write_text(html_report(rep, title), encoding="utf-8")
    return out
