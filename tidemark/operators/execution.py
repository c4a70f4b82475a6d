"""Execution quality per order, from a table of fills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import safe_div, total


def implementation_shortfall(fills: DataFrame, key: list[str], seq: str = "seq", price: str = "price", qty: str = "qty", *, decision: str = "decision_price", side: str = "side", arrival: str | None = None, end: str | None = None, unfilled: str | None = None) -> DataFrame:
    """Perold's decomposition per order: vwap, paper and realised gain, shortfall, delay, trading, opportunity, bps.

    Arrival is the first fill and end the last one unless columns give them; an order without filled
    quantity has zeros.
    """
    p, q = F.col(price), F.col(qty)
    first, last = F.min_by(p, F.col(seq)), F.max_by(p, F.col(seq))
    s = fills.groupBy(*key).agg(
        total(q).alias("qty"), total(p * q).alias("cost"), F.first(decision).alias("d"), F.first(side).alias("side"),
        F.coalesce(F.first(arrival), first).alias("a") if arrival else first.alias("a"),
        F.coalesce(F.first(end), last).alias("e") if end else last.alias("e"),
        (F.coalesce(F.first(unfilled), F.lit(0.0)) if unfilled else F.lit(0.0)).alias("u"),
    )
    vwap = safe_div(F.col("cost"), F.col("qty"))
    sgn, d, a, e, n, u = (F.col(c) for c in ("side", "d", "a", "e", "qty", "u"))
    paper = sgn * (e - d) * (n + u)
    realised = sgn * (e - vwap) * n
    parts = {
        "vwap": vwap, "paper": paper, "realised": realised, "shortfall": paper - realised, "delay": sgn * (a - d) * n,
        "trading": sgn * (vwap - a) * n, "opportunity": sgn * (e - d) * u, "bps": safe_div(paper - realised, d * (n + u)) * 1e4,
    }
    return s.select(*key, *(F.when(n != 0, c).otherwise(0.0).alias(name) for name, c in parts.items()))
