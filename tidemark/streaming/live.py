"""Metrics over a stream of returns: the batch Columns in watermarked event-time windows, and a state per key for those that need order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import metrics as m
from ..operators.models import GARCH_ALPHA, GARCH_BETA, decayed

#: metrics whose state is a few sums: exact quantiles need every value and are left to batch
MERGEABLE = ("comp", "cagr", "avg_return", "avg_win", "avg_loss", "best", "worst", "win_rate", "payoff_ratio", "profit_factor", "volatility", "sharpe", "sortino", "gain_to_pain_ratio", "kelly_criterion", "expectancy")


def windowed_metrics(stream: DataFrame, key: list[str], ts: str = "ts", r: str = "r", *, every: str = "1 day", late: str = "1 hour", names=MERGEABLE) -> DataFrame:
    """A row per key and tumbling window; works on streams and on batches alike."""
    window = F.window(ts, every)
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream.withWatermark(ts, late).groupBy(*key, window.alias("window")).agg(*(m.BASIC[n](r).alias(n) for n in names))


STATE = "last timestamp, n long, wealth double, peak double, max_drawdown double, wins long, losses long, longest_wins long, longest_losses long, variance double"
STATUS = "ts timestamp, n long, wealth double, drawdown double, max_drawdown double, wins long, losses long, consecutive_wins long, consecutive_losses long, garch_vol double, late long"


def run_lengths(hit: np.ndarray, before: int) -> np.ndarray:
    """Length of the run of hits that ends at each place, after `before` hits in a row."""
    at = np.arange(1, len(hit) + 1)
    missed = np.maximum.accumulate(np.where(hit, -before, at))
    return at - missed


def live_status(stream: DataFrame, key: list[str], ts: str = "ts", r: str = "r", *, long_run_variance: float) -> DataFrame:
    """A row per key and micro-batch: drawdown, streaks and volatility of the series so far, as the batch operators find them.

    wealth, drawdown and max_drawdown are those of ordered.drawdowns (the first row is its own peak), wins and
    losses the runs that last row is in, garch_vol the next period's by variance targeting of `long_run_variance`,
    which a stream has to be told. The state is ten numbers a key, kept for good, in the query's checkpoint.

    Rows of a batch are put in order; a row that is not later than the key's last one has missed its place: it
    changes nothing and is counted in `late`. Null times and null returns are dropped. A key's rows of one batch
    are taken together, so bound a batch at its source (maxFilesPerTrigger, maxOffsetsPerTrigger). Key columns
    may hold nulls; other columns are not read.
    """
    kinds = {k: t for k, t in stream.dtypes}
    omega = long_run_variance * (1 - GARCH_ALPHA - GARCH_BETA)

    def work(name, batches, state):
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("_ts", kind="stable")
        last, n, wealth, peak, deepest, wins, losses, top_wins, top_losses, variance = state.get if state.exists else (None, 0, 1.0, -math.inf, 0.0, 0, 0, 0, 0, long_run_variance)
        fresh = ~pdf["_ts"].duplicated()
        if last is not None:
            fresh &= pdf["_ts"] > pd.Timestamp(last)
        x = pdf.loc[fresh, "_r"].to_numpy(dtype=float)
        drawdown = wealth / peak - 1 if peak > 0 else 0.0
        if len(x):
            path = wealth * np.cumprod(1 + x)
            peaks = np.maximum.accumulate(np.concatenate([[peak], path]))[1:]
            down = path / peaks - 1
            won, lost = run_lengths(x > 0, wins), run_lengths(x < 0, losses)
            last, n = pdf.loc[fresh, "_ts"].iloc[-1].to_pydatetime(), n + len(x)
            wealth, peak, drawdown, deepest = float(path[-1]), float(peaks[-1]), float(down[-1]), min(deepest, float(down.min()))
            wins, losses = int(won[-1]), int(lost[-1])
            top_wins, top_losses = max(top_wins, int(won.max())), max(top_losses, int(lost.max()))
            variance = float(decayed(omega + GARCH_ALPHA * x * x, variance, GARCH_BETA)[-1])
            state.update((last, n, wealth, peak, deepest, wins, losses, top_wins, top_losses, variance))
        found = [last, n, wealth, drawdown, deepest, wins, losses, top_wins, top_losses, math.sqrt(variance), len(pdf) - len(x)]
        yield pd.DataFrame([[*name, *found]], columns=[*key, *(f.split()[0] for f in STATUS.split(", "))])

    rows = stream.select(*key, F.col(ts).cast("timestamp").alias("_ts"), F.col(r).cast("double").alias("_r")).where("_ts is not null and _r is not null")
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), STATUS])
    return rows.groupBy(*key).applyInPandasWithState(work, out, STATE, "append", GroupStateTimeout.NoTimeout)
