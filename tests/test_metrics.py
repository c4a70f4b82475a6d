"""Published and hand-worked values, the SQL oracle, edge cases and the report."""

import glob
import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidemark as td
from tidemark.functions import metrics as m
from tidemark.operators import execution, models, ordered, trades
from tidemark.plans import catalog, report

#: published values on default_rng(42).normal(0.0004, 0.015, n): fixed values for n = 1000, 5000, 10000
GOLDEN = {
    "comp": (-0.133630, -0.051281, 2.7552), "cagr": (-0.035502, -0.002650, 0.033906), "avg_return": (-0.00003337, 0.000102, 0.000246),
    "avg_win": (0.011471, 0.011834, 0.012107), "avg_loss": (-0.012008, -0.011973, -0.011855), "best": (0.048083, 0.052211, 0.060787),
    "worst": (-0.054326, -0.054326, -0.065437), "win_rate": (0.51, 0.5072, 0.505), "profit_factor": (0.994328, 1.0173, 1.0420),
    "payoff_ratio": (0.955335, 0.988379, 1.0213), "volatility": (0.235550, 0.237988, 0.239626), "var": (-0.024440, -0.024558, -0.024583),
    "cvar": (-0.030708, -0.030724, -0.030885), "max_drawdown": (-0.396028, -0.736035, -0.736035), "sharpe": (-0.035704, 0.107841, 0.258968),
    "sortino": (-0.050041, 0.153116, 0.370827), "calmar": (-0.089645, -0.003600, 0.046065), "omega": (0.994328, 1.0173, 1.0420),
    "gain_to_pain_ratio": (-0.005672, 0.017261, 0.041965), "tail_ratio": (0.990317, 0.989797, 1.0133), "common_sense_ratio": (0.984699, 1.0069, 1.0559),
    "kelly_criterion": (-0.002909, 0.008606, 0.020339), "skewness": (-0.043754, 0.002143, -0.003358), "kurtosis": (0.091884, 0.037397, 0.053300),
}


def table(spark, **series):
    rows = [(k, i, float(x)) for k, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "k string, t int, r double")


def test_golden_values(spark):
    sizes = (1000, 5000, 10000)
    d = table(spark, **{f"n{n}": np.random.default_rng(42).normal(0.0004, 0.015, n) for n in sizes})
    got = {r.k: r for r in report.full_metrics(d, ["k"], shapiro=False).collect()}
    for name, want in GOLDEN.items():
        for n, v in zip(sizes, want, strict=True):
            assert got[f"n{n}"][name] == pytest.approx(v, rel=2e-4, abs=6e-7), (name, n)


def test_every_query_matches_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name, f in catalog.QUERIES.items():
        df = f(spark, sf)
        cols = sorted(df.columns)
        got = Counter(map(repr, map(tuple, df.select(*(f"`{c}`" for c in cols)).collect())))
        assert got, name
        if name in catalog.SQL:
            want = con.sql(catalog.SQL[name]).project(",".join(f'"{c}"' for c in cols)).fetchall()
            assert got == Counter(map(repr, want)), name


def test_edge_series(spark):
    d = table(spark, one=[0.05], up=[0.01, 0.02, 0.03, 0.01, 0.02], down=[-0.01, -0.02, -0.03, -0.01, -0.02], flat=[0.0] * 5)
    r = {x.k: x for x in report.full_metrics(d, ["k"]).collect()}
    assert r["one"].volatility == 0 and r["one"].ulcer_index == 0 and r["one"].sharpe == 0
    assert r["up"].profit_factor == math.inf and r["up"].max_drawdown == 0 and r["up"].calmar == math.inf and r["up"].sortino == math.inf
    assert math.isnan(r["up"].omega) and r["up"].risk_of_ruin == 0 and r["down"].risk_of_ruin == 1
    assert (r["up"].consecutive_wins, r["up"].consecutive_losses) == (5, 0)
    assert (r["down"].consecutive_wins, r["down"].consecutive_losses) == (0, 5)
    assert r["flat"].sharpe == 0 and r["flat"].k_ratio == 0 and r["flat"].exposure == 0 and r["flat"].rar == 0


def test_nulls_are_skipped_and_empty_raises(spark):
    d = spark.createDataFrame([("a", 0, 0.1), ("a", 1, None), ("a", 2, -0.1)], "k string, t int, r double")
    assert d.groupBy("k").agg(m.win_rate("r").alias("w")).first().w == 0.5
    with pytest.raises(td.EmptySeriesError):
        report.report(d.where("false"))


def test_null_keys_stay(spark):
    """Every operator that works in two steps per key keeps the null key's rows."""
    x = [0.01, -0.02, 0.03, 0.015, -0.01, 0.02, -0.03, 0.04, 0.01, -0.005, 0.02, 0.01]
    d = spark.createDataFrame([(k, i, v, v / 2 + 0.001 * i) for k in ("a", None) for i, v in enumerate(x)], "k string, t int, r double, b double")
    keys = {"a", None}

    def same(df, *names):
        rows = {r.k: tuple(r[n] for n in names) for r in df.collect()}
        assert set(rows) == keys and rows["a"] == pytest.approx(rows[None])

    same(report.full_metrics(d, ["k"], b="b"), "sharpe", "cvar", "outlier_win_ratio", "shapiro_w", "max_drawdown", "beta", "consecutive_wins")
    same(ordered.cvar(d, ["k"]), "cvar")
    same(ordered.outlier_ratios(d, ["k"]), "outlier_win_ratio")
    same(ordered.tail_dependence(d, ["k"], "r", "b", quantile=0.2), "lower_tail_dependence")
    same(models.entropic_var(d, ["k"]), "entropic_var")
    same(models.shapiro(d, ["k"]), "shapiro_w", "shapiro_p")
    for f in (ordered.outliers, ordered.remove_outliers, ordered.outliers_iqr, ordered.remove_outliers_iqr):
        rows = Counter(r.k for r in f(d, ["k"]).collect())
        assert rows["a"] == rows[None], f
    bins = {k: [r["count"] for r in ordered.histogram(d, ["k"], bins=4).where(F.col("k").eqNullSafe(F.lit(k))).orderBy("bin").collect()] for k in keys}
    assert bins["a"] == bins[None] and sum(bins[None]) == len(x)


def test_the_report_is_one_scan_and_one_shuffle(spark, sf):
    """The daily series costs one exchange; the report over it reads it once, and what is not selected is not computed."""
    from tidemark.sources import series

    for name in ("metrics_summary", "drawdown_metrics", "report_metrics", "full_metrics", "distribution"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1, name
    d = series.daily(spark, sf)
    plan = report.full_metrics(d, catalog.KEY, shapiro=False).select(*catalog.KEY, "sharpe")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "Window" not in plan


def test_a_benchmark_with_rows_of_its_own(spark):
    from tidemark.plans import api

    r, b = [0.01, -0.02, 0.03, 0.02], [0.02, -0.01, 0.01, 0.03]
    d = spark.createDataFrame([(k, i, x) for k in ("a", None) for i, x in enumerate(r)], "k string, t int, r double")
    own = spark.createDataFrame([(i, x) for i, x in enumerate(b[:3])] + [(9, 0.5)], "t int, b double")
    got = api.of(d, ["k"]).with_benchmark(own).greeks().collect()
    beta = np.cov(r[:3], b[:3])[0, 1] / np.var(b[:3], ddof=1)
    assert {x.k for x in got} == {"a", None} and all(x.beta == pytest.approx(beta) for x in got)
    keyed = spark.createDataFrame([(None, i, x) for i, x in enumerate(b)], "k string, t int, b double")
    assert [x.k for x in api.of(d, ["k"]).with_benchmark(keyed).greeks().collect()] == [None]


def test_a_single_trade(spark):
    from datetime import datetime

    f = trades.calculate_single_trade_return
    assert f(100.0, 105.0) == pytest.approx(0.05) and f(100.0, 95.0, direction="short") == pytest.approx(0.05)
    assert f(100.0, 105.0, fees=2.0, quantity=-2.0) == pytest.approx(0.04) and f(100.0, 110.0, method="log", direction="short") == pytest.approx(-math.log(1.1))
    for bad in ((0.0, 1.0), (1.0, -1.0), (float("nan"), 1.0)):
        with pytest.raises(ValueError):
            f(*bad)
    t = trades.Trade(datetime(2024, 1, 1), 100.0, datetime(2024, 1, 3), 105.0, quantity=2.0, fees=1.0)
    assert t.is_closed and t.status == "closed" and trades.Trade(datetime(2024, 1, 1), 100.0).single_return() is None
    rows = spark.createDataFrame([(t.entry_time, t.entry_price, t.exit_time, t.exit_price, t.quantity, t.fees)], "entry_time timestamp, entry_price double, exit_time timestamp, exit_price double, quantity double, fees double")
    assert trades.trade_returns(rows).first().trade_return == pytest.approx(t.single_return())


def test_arch_effect_by_least_squares(spark):
    rng = np.random.default_rng(3)
    x = [0.0]
    for e in rng.normal(size=400):
        x.append(e * math.sqrt(0.2 + 0.6 * x[-1] ** 2))
    lags = 3
    e = (np.array(x) - np.mean(x)) ** 2
    y, z = e[lags:], np.column_stack([np.ones(len(e) - lags), *(e[lags - j : len(e) - j] for j in range(1, lags + 1))])
    left = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    want = len(y) * (1 - (left**2).sum() / ((y - y.mean()) ** 2).sum())
    r = models.arch_effect_test(table(spark, a=x), ["k"], lags=lags).first()
    assert r.arch_stat == pytest.approx(want, rel=1e-6) and r.arch_p == pytest.approx(models.chi2_sf(want, lags)) and r.arch_effect


def test_drawdown_episodes_with_dates(spark):
    import datetime

    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=2 * i)
    d = spark.createDataFrame([("a", day(i), x) for i, x in enumerate([0.10, -0.20, 0.26, 0.05, -0.15, -0.05])], "k string, t date, r double")
    got = ordered.drawdown_details(d, ["k"], dates=True).orderBy("rank").collect()
    assert [(x.start_date, x.valley_date, x.end_date) for x in got] == [(day(0), day(1), day(2)), (day(3), day(5), day(5))]


def test_drawdown_episodes(spark):
    d = table(spark, a=[0.10, -0.20, 0.26, 0.05, -0.15, -0.05, 0.30], b=[0.10, -0.15, -0.10, 0.05, 0.20, -0.25, 0.10], c=[-0.05, 0.01])
    got = [tuple(r) for r in ordered.drawdown_details(d, ["k"]).orderBy("k", "rank").collect()]
    assert [g[:5] + (round(g[5], 6),) + g[6:] for g in got] == [
        ("a", 1, 0, 1, 2, -0.2, 3, 1), ("a", 2, 3, 5, 6, -0.1925, 4, 1), ("b", 1, 0, 5, 6, -0.277075, 7, None)
    ]


def test_rolling_needs_full_windows(spark):
    d = ordered.rolling(table(spark, a=np.linspace(-0.01, 0.02, 10)), ["k"], period=4).orderBy("t").collect()
    assert [r.rolling_volatility is None for r in d] == [True] * 3 + [False] * 7


def test_histogram_of_constant_data(spark):
    r = ordered.histogram(table(spark, a=[0.1] * 4), ["k"], bins=7).collect()
    assert len(r) == 1 and r[0]["count"] == 4 and r[0].bin_start == pytest.approx(-0.4)


def test_special_functions(spark):
    assert models.chi2_sf(21.026, 12) == pytest.approx(0.05, abs=1e-4) and models.chi2_sf(7.815, 3) == pytest.approx(0.05, abs=1e-4)
    w, p = models.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], dtype=float))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.002)
    xs = [-9.0, -4.0, -3.5, -1.0, 0.0, 0.3, 3.4999, 3.5, 5.0, 40.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(m.phi(F.col("x"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], abs=1e-9)
    x = np.random.default_rng(3).normal(0, 0.05, 500)
    z = np.linspace(0.01, 100, 400_000)[:, None]
    want = min((np.log(np.exp(-z[i : i + 2000] * x).mean(axis=1) / 0.05) / z[i : i + 2000, 0]).min() for i in range(0, len(z), 2000))
    assert models.entropic_var(table(spark, a=x), ["k"]).first().entropic_var == pytest.approx(want, rel=1e-5)


def test_portfolio(spark):
    rng = np.random.default_rng(42)
    x = np.stack([rng.normal(0, 0.02, 200), rng.normal(0, 0.015, 200)], axis=1)
    d = spark.createDataFrame(x.tolist(), "A double, B double")
    r = models.marginal_contribution_to_risk(d, ["A", "B"], [0.6, 0.4])
    wt = np.array([0.6, 0.4])
    assert r["pcr"].sum() == pytest.approx(1) and r["volatility"] == pytest.approx(math.sqrt(wt @ np.cov(x.T) @ wt))
    lw = models.ledoit_wolf_covariance(d, ["A", "B"])
    xc = x - x.mean(axis=0)
    s = xc.T @ xc / 200
    top = sum(((np.outer(v, v) - s) ** 2).sum() for v in xc) / 200**2
    target = np.trace(s) / 2 * np.eye(2)
    assert lw["shrinkage"] == pytest.approx(min(1, top / ((s - target) ** 2).sum()))
    ar = models.absorption_ratio(d, ["A", "B"])
    assert 0.5 <= ar["ratio"] <= 1 and ar["eigenvalues"].sum() == pytest.approx(2)


def test_execution(spark):
    d = spark.createDataFrame([("o", 1, 101.0, 500.0, 100.0, 1), ("o", 2, 102.0, 500.0, 100.0, 1)], "o string, seq int, price double, qty double, decision_price double, side int")
    r = execution.implementation_shortfall(d, ["o"]).first()
    assert tuple(r)[1:] == pytest.approx((101.5, 2000, 500, 1500, 1000, 500, 0, 150))


TRADES = "entry_time string, entry_price double, exit_time string, exit_price double, quantity double, direction string"
OVERLAP = [("2024-01-02", 100.0, "2024-01-05", 105.0, 10.0, "long"), ("2024-01-03", 102.0, "2024-01-06", 108.0, 20.0, "long"), ("2024-01-04", 104.0, "2024-01-08", 100.0, 15.0, "short")]


def trades_of(spark, rows):
    d = spark.createDataFrame(rows, TRADES)
    return d.withColumns({c: F.col(c).cast("timestamp") for c in ("entry_time", "exit_time")})


def test_equity_curves(spark):
    prices = spark.createDataFrame([(f"2024-01-0{i + 2}", c) for i, c in enumerate([100.0, 101.0, 103.0, 105.0, 106.0, 104.0, 102.0])], "date string, close double")
    d = trades_of(spark, OVERLAP)
    rows = trades.build_equity_curve(d, 10_000.0, prices.withColumn("date", F.to_date("date"))).orderBy("date").collect()
    assert [r.cash for r in rows] == [9000, 6960, 8520, 9570, 11730, 11730, 10230]
    assert [r.position_value for r in rows] == [1000, 3030, 1545, 525, -1590, -1560, 0]
    assert rows[0].daily_return == 0 and rows[1].daily_return == pytest.approx(-0.001)
    flat = trades.build_equity_curve_no_mtm(d, 10_000.0).orderBy("date").collect()
    assert [r.nav for r in flat] == [10000, 10000, 10000, 10050, 10170, 10170, 10230]


def test_trades_to_returns(spark):
    d = trades_of(spark, OVERLAP + [("2024-01-09", 10.0, None, None, None, None)])
    t = trades.trades_to_returns(d)
    assert sorted(round(r.returns, 6) for r in t.returns.collect()) == [0.038462, 0.05, 0.058824]
    assert t.summary.first().n_trades == 3 and t.warnings
    days = trades.trades_to_returns(d, aggregation="D").returns.orderBy("date").collect()
    assert len(days) == 4 and days[2].returns == 0
    assert trades.trades_to_returns(d, aggregation="M", initial_capital=1e4).periods_per_year == 12
    fee = trades_of(spark, [("2024-01-01", 100.0, "2024-01-02", 110.0, 10.0, "long")]).withColumn("fees", F.lit(5.0))
    assert trades.trade_returns(fee).first().trade_return == pytest.approx(0.095)


def test_trade_errors(spark):
    bad = lambda *row: trades_of(spark, [row])
    with pytest.raises(td.InvalidPriceError):
        trades.trades_to_returns(bad("2024-01-01", -1.0, "2024-01-02", 1.0, 1.0, "long"))
    with pytest.raises(td.InvalidDirectionError):
        trades.trades_to_returns(bad("2024-01-01", 1.0, "2024-01-02", 1.0, 1.0, "up"))
    with pytest.raises(td.InvalidTradeTimesError):
        trades.trades_to_returns(bad("2024-01-03", 1.0, "2024-01-02", 1.0, 1.0, "long"))
    with pytest.raises(td.MissingColumnError):
        trades.trades_to_returns(bad("2024-01-01", 1.0, "2024-01-02", 1.0, 1.0, "long").drop("exit_price"))
    with pytest.raises(td.EmptySeriesError):
        trades.trades_to_returns(bad("2024-01-01", 1.0, "2024-01-02", 1.0, 1.0, "long").limit(0))
    with pytest.raises(ValueError):
        trades.trades_to_returns(bad("2024-01-01", 1.0, "2024-01-02", 1.0, 1.0, "long"), aggregation="equity")


def test_report_and_html(spark, tmp_path):
    d = table(spark, a=[0.01, -0.02, 0.015, -0.01, 0.02, 0.005, -0.008, 0.012, -0.003, 0.018]).withColumn("b", F.col("r") * 0.8)
    rep = report.report(d, b="b")
    assert set(rep.to_dict()) == set(report.SECTIONS) and rep.to_dict()["benchmark"]["beta"] == pytest.approx(1.25)
    assert '"sharpe"' in rep.to_json() and rep.to_df(spark).count() == sum(map(len, report.SECTIONS.values()))
    page = report.save_html_report(rep, tmp_path / "r.html", title="<x>").read_text()
    assert f"{rep.points:,} values" in page and 'class="up"' in page and 'class="down"' in page
    assert "&lt;x&gt;" in page and "sharpe" in page
    assert report.shown("sortino", math.inf) == "∞" and report.shown("omega", math.nan) == "N/A"


def test_streaming_matches_batch(spark, sf, tmp_path):
    from tidemark.streaming.live import windowed_metrics

    e = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", ((F.col("value") - 50) / 10000).alias("r"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    names = ("avg_return", "win_rate", "volatility")
    stream = windowed_metrics(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), ["event_type"], names=names)
    stream.writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start().awaitTermination(60)
    key = lambda r: (r.event_type, r.window.start)
    live = {key(r): r for r in spark.table("live").collect()}
    batch = {key(r): r for r in windowed_metrics(e, ["event_type"], names=names).collect()}
    assert live.keys() == batch.keys()
    assert all(live[k].volatility == pytest.approx(batch[k].volatility) for k in batch)


def test_live_status_matches_batch(spark, tmp_path):
    from tidemark.streaming.live import live_status, run_lengths

    assert run_lengths(np.array([True, True, False, True]), 3).tolist() == [4, 5, 0, 1]
    rng = np.random.default_rng(5)
    rows = [(k, 60 * i, float(v)) for k in ("a", None) for i, v in enumerate(rng.normal(0.001, 0.02, 90))]
    schema = "k string, s int, r double"
    timed = lambda d: d.select("k", F.timestamp_seconds("s").alias("ts"), "r")
    given = [[x for x in rows if x[1] < 1800], [x for x in rows if x[1] >= 1800], [rows[3], ("a", None, 0.5), ("a", 9000, None)]]
    live = []
    for i, batch in enumerate(given):  # one micro-batch each, the state is taken up from the checkpoint
        spark.createDataFrame(batch[::-1], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = timed(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        found = live_status(stream, ["k"], long_run_variance=0.0004)
        name = f"status{i}"
        q = found.writeStream.foreachBatch(lambda d, _: live.append({r.k: r for r in d.collect()})).queryName(name)
        q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    live = [x for x in live if x]
    d = timed(spark.createDataFrame(rows, schema))
    down = {r.k: r.max_drawdown for r in ordered.drawdown_stats(d, ["k"], "ts", "r").collect()}
    runs = {r.k: (r.consecutive_wins, r.consecutive_losses) for r in ordered.streaks(d, ["k"], "ts", "r").collect()}
    for k in ("a", None):
        x = [r for name, _, r in rows if name == k]
        s = 0.0004
        for v in x:
            s = 0.0004 * 0.05 + 0.10 * v * v + 0.85 * s
        r = live[1][k]
        assert (r.n, r.late) == (90, 0) and r.max_drawdown == pytest.approx(down[k]) and (r.consecutive_wins, r.consecutive_losses) == runs[k]
        assert r.wealth == pytest.approx(np.prod(1 + np.array(x))) and r.garch_vol == pytest.approx(math.sqrt(s))
    assert live[2]["a"].late == 1 and live[2]["a"][2:-1] == live[1]["a"][2:-1]


def test_least_values_and_configuration(spark):
    d = table(spark, short=[0.01, -0.02] * 4, long=[0.01, -0.02] * 12)
    by = lambda f, c: {r.k: r[c] for r in f.collect()}
    e = by(models.entropic_var(d, ["k"]), "entropic_var")
    assert e["short"] is None and e["long"] > 0
    vol = {r.k: r.garch_vol for r in models.garch_volatility(d, ["k"]).where("t = 5").collect()}
    assert vol["short"] is None and vol["long"] > 0
    arch = by(models.arch_effect_test(d, ["k"], lags=7), "arch_stat")
    assert arch["short"] is None and arch["long"] is not None
    with pytest.raises(ValueError):
        models.garch_volatility(d, ["k"], p=2)
    with pytest.raises(ValueError):
        models.entropic_var(d, ["k"], confidence=1.5)
    # means that overflow or vanish rule their z out
    wild = models.entropic_var(table(spark, a=[100.0, -50.0] * 10), ["k"]).first().entropic_var
    assert 50 <= wild < math.inf
    td.set_config(td.MetricsConfig(var_confidence=0.99))
    try:
        got = d.groupBy("k").agg(m.var("r").alias("v"))
    finally:
        td.reset_config()
    assert by(got, "v") == by(d.groupBy("k").agg(m.var("r", confidence=0.99).alias("v")), "v")


def test_every_metric_by_name(spark):
    from tidemark.plans import api

    d = table(spark, a=[0.01, -0.02, 0.015, -0.01, 0.02, 0.005, -0.008, 0.012, -0.003, 0.018], z=[0.02, -0.01, 0.0, 0.03, -0.02])
    d, key = d.withColumn("r", F.when(F.col("r") != 0, F.col("r"))), "k"  # a null among the values
    s = api.of(d.withColumn("b", F.col("r") * 0.8), [key], b="b")
    full = {r[key]: r for r in report.full_metrics(s.df, [key], b="b").collect()}
    for name in (*m.BASIC, *m.BENCHMARK, "cvar", "max_drawdown", "ulcer_index", "consecutive_wins", "consecutive_losses", "calmar", "recovery_factor", "ulcer_performance_index", "expected_return"):
        rows = getattr(s, name)().collect()
        assert {r[key] for r in rows} == set(full)
        for r in rows:
            if name in full[r[key]]:
                assert r[name] == pytest.approx(full[r[key]][name], nan_ok=True), name
    assert [tuple(r) for r in s.select("sharpe", "beta").orderBy(key).collect()] == [(k, pytest.approx(full[k].sharpe), pytest.approx(1.25)) for k in sorted(full)]
    assert s.greeks().columns == [key, "alpha", "beta"] and s.rolling_greeks(period=3).columns == [*s.df.columns, "rolling_alpha", "rolling_beta"]
    assert s.rolling_volatility(period=3).count() == s.drawdown_series().count() == 14
    for r in s.probabilistic_sharpe_ratio().join(s.deflated_sharpe_ratio(10), key).collect():
        assert r.psr + r.p_value == pytest.approx(1) and 0 <= r.dsr <= r.psr <= 1
    for name in report.SECTIONS:
        assert getattr(s, f"{name}_metrics")().columns == [key, *report.SECTIONS[name]]
    with pytest.raises(ValueError):
        api.of(d, [key]).beta()
    with pytest.raises(AttributeError):
        s.no_such_metric


def test_validation(spark):
    from tidemark import errors
    from tidemark.operators import validation as v

    d = spark.createDataFrame([(0, 1, "x"), (1, None, "y")], "t int, r int, s string")
    assert [tuple(r) for r in v.validate_returns(d).collect()] == [(0, 1.0, "x")]
    assert v.validate_returns(d, drop_nulls=False).count() == 2 and v.validate_returns(d.limit(0), allow_empty=True).count() == 0
    with pytest.raises(TypeError):
        v.validate_returns(d, "s")
    with pytest.raises(errors.EmptySeriesError):
        v.validate_returns(d.where("t = 1"))
    v.validate_min_length(d, 2)
    with pytest.raises(errors.InsufficientDataError):
        v.validate_min_length(d, 3, "sharpe")
    v.validate_benchmark_match(d, d, ["t"])
    with pytest.raises(errors.BenchmarkMismatchError):
        v.validate_benchmark_match(d, d.limit(1), ["t"])
    for check, bad in ((v.validate_positive, 0), (v.validate_probability, 1.5)):
        with pytest.raises(ValueError):
            check(bad)
        check(0.5)


def test_monthly_returns_have_every_year(spark, sf):
    import duckdb

    got = catalog.QUERIES["monthly_returns"](spark, sf)
    want = duckdb.sql(f"""WITH s AS (SELECT CAST(l_shipdate AS DATE) AS t, sum(CAST(round(l_discount * 100) AS INT) - 5) / (count(*) * 100.0::DOUBLE) AS r
        FROM '{sf}/lineitem.parquet' GROUP BY 1) SELECT month(t), CAST(year(t) AS VARCHAR), product(1 + r) - 1 FROM s GROUP BY 1, 2""").fetchall()
    assert got.columns == ["month", *sorted({y for _, y, _ in want})]
    cells = {(r.month, y): r[y] for r in got.collect() for y in got.columns[1:] if r[y] is not None}
    assert cells == pytest.approx({(m_, y): v for m_, y, v in want}, abs=1e-8)
    d = spark.sql("SELECT DATE'2020-01-05' AS t, 0.1D AS r UNION ALL SELECT DATE'2031-01-05', 0.2D UNION ALL SELECT DATE'2040-01-05', NULL")
    assert ordered.monthly_returns(d, "t").columns == ["month", "2020", "2031"]
    assert ordered.monthly_returns(d.limit(0), "t").count() == 0


def test_newey_west_lags_grow_with_the_series(spark, sf):
    def want(xs, lags=None):
        n, x = len(xs), np.asarray(xs) - np.mean(xs)
        lags = max(1, min(math.floor(4 * (n / 100) ** (2 / 9)), n - 2)) if lags is None else lags
        s = x @ x + sum(2 * (1 - j / (lags + 1)) * (x[j:] @ x[:-j]) for j in range(1, min(lags, n - 1) + 1))
        return math.sqrt(s / n / n) if n > 1 and s > 0 else 0.0

    rng = np.random.default_rng(3)
    xs = {f"n{n}": np.convolve(rng.normal(0, 0.01, n + 9), np.ones(10), "valid") for n in (1, 2, 3, 4, 50, 272, 273, 1000, 2450)}
    got = {r.k: r.newey_west_se for r in ordered.newey_west_se(table(spark, **xs), ["k"]).collect()}
    assert got == pytest.approx({k: want(x) for k, x in xs.items()})
    five = {r.k: r.newey_west_se for r in ordered.newey_west_se(table(spark, **xs), ["k"], lags=5).collect()}
    assert five == pytest.approx({k: want(x, 5) for k, x in xs.items()})
    by = {}
    for r in catalog.series.daily(spark, sf).orderBy("t").collect():
        by.setdefault((r.l_returnflag, r.l_linestatus), []).append(r.r)
    rows = catalog.QUERIES["newey_west_se"](spark, sf).collect()
    assert {tuple(r[:2]): r.newey_west_se for r in rows} == pytest.approx({k: want(x) for k, x in by.items()}, abs=1e-8)
    edge = spark.sql("SELECT floor(4 * pow(51200 / 100.0D, 2 / 9.0D)) AS n").first().n  # 15.999... in the reference's arithmetic
    assert edge == math.floor(4 * (51200 / 100) ** (2 / 9))
    assert ordered.newey_west_se(table(spark, **xs).limit(0), ["k"]).count() == 0
