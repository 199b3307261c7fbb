"""Formula language, operators against pandas, metrics, stitching, simulation, storage."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallgrass.functions import formula as fm
from tallgrass.functions import metrics
from tallgrass.operators.compiler import evaluate, evaluate_long
from tallgrass.plans import catalog, fusion, mining, queries, queries_more, rollover, select, strategy
from tallgrass.plans.backtest import Options, backtest
from tallgrass.sources import panels, store


def walk(n, seed, name):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.012, n)))
    p = pd.DataFrame({"time": pd.date_range("2020-01-01", periods=n), "instrument_id": name, "open": close * (1 + rng.normal(0, 0.003, n)), "close": close})
    p["high"], p["low"] = p[["open", "close"]].max(axis=1) * 1.004, p[["open", "close"]].min(axis=1) * 0.996
    p["volume"], p["position"] = rng.integers(0, 50, n).astype(float), rng.integers(100, 900, n).astype(float)
    return p


@pytest.fixture(scope="module")
def prices():
    a, b, c = walk(120, 1, "C0"), walk(90, 2, "FG0"), walk(3, 3, "S0")
    a.loc[[0, 1, 17, 40], "close"] = np.nan
    a.loc[50:60, "volume"] = 7.0
    b.loc[20:30, "close"] = 5.0
    return pd.concat([a, b, c], ignore_index=True)


@pytest.fixture(scope="module")
def panel(spark, prices):
    rows = [tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in prices.sample(frac=1, random_state=1).itertuples(index=False)]
    return spark.createDataFrame(rows, "time timestamp, instrument_id string, open double, close double, high double, low double, volume double, position double")


def entropy(w):
    d, _ = np.histogram(w, bins=10, density=True)
    d = d[d > 0]
    return -np.sum(d * np.log(d + 1e-10))


def rank_corr(x, y, n):
    out = pd.Series(np.nan, x.index)
    for i in range(n - 1, len(x)):
        w = pd.DataFrame({"x": x.iloc[i - n + 1 : i + 1], "y": y.iloc[i - n + 1 : i + 1]}).dropna()
        if len(w) >= 2 and w.x.nunique() > 1 and w.y.nunique() > 1:
            out.iloc[i] = w.x.rank().corr(w.y.rank())
    return out


PANDAS = {
    "TsMean(close, 5)": lambda g: g.close.rolling(5).mean(),
    "TsStd(close, 5)": lambda g: g.close.rolling(5).std(),
    "TsSkew(close, 6)": lambda g: g.close.rolling(6).skew(),
    "TsKurt(close, 6)": lambda g: g.close.rolling(6).kurt(),
    "TsPctDelta(close, 2)": lambda g: g.close.ffill() / g.close.ffill().shift(2) - 1,
    "Ema(close, 3)": lambda g: g.close.ewm(span=3, adjust=False).mean(),
    "TsRank(volume, 7)": lambda g: g.volume.rolling(7).apply(lambda w: pd.Series(w).rank().iloc[-1] / 7),
    "TsArgmax(volume, 7)": lambda g: g.volume.rolling(7).apply(lambda w: 6 - np.flatnonzero(w == w.max())[-1]),
    "TsArgmin(volume, 7)": lambda g: g.volume.rolling(7).apply(lambda w: 6 - np.flatnonzero(w == w.min())[-1]),
    "TsCorr(close, open, 5)": lambda g: g.close.rolling(5).corr(g.open).where((g.close.rolling(5).max() != g.close.rolling(5).min())),
    "TsCov(close, open, 5)": lambda g: g.close.rolling(5).cov(g.open),
    "TsEntropy(open, 12)": lambda g: g.open.rolling(12).apply(entropy),
    "TsRankCorr(close, open, 6)": lambda g: rank_corr(g.close, g.open, 6),
    "TsTimeWeightedMean(close, 4)": lambda g: g.close.rolling(4).apply(lambda w: np.dot(w, [1, 2, 3, 4]) / 10),
    "RollNorm(close, 20, 5, 1e-6, 2)": lambda g: ((g.close - g.close.shift().rolling(20, min_periods=5).mean()) / (g.close.shift().rolling(20, min_periods=5).std() + 1e-6)).clip(-2, 2),
    "MaRibbon(close, 3, 5, 10)": lambda g: (lambda m: (m.max(axis=1) - m.min(axis=1)) / m.mean(axis=1).abs())(pd.concat([g.close.rolling(k).mean() for k in (3, 5, 10)], axis=1)),
    "Max(close, open)": lambda g: pd.Series(np.maximum(g.close, g.open), g.index),
    "Lt(close, open)": lambda g: (g.close > g.open).astype(float),
    "Inv(volume)": lambda g: (1 / g.volume).replace(np.inf, np.nan),
    "Volatility(close, 5)": lambda g: (g.close.ffill() / g.close.ffill().shift() - 1).rolling(5).std(),
    "TsResidual(close, open, 5)": lambda g: (g.close - g.close.rolling(5).mean()) - g.close.rolling(5).cov(g.open) / g.open.where(g.close.notna()).rolling(5).var() * (g.open - g.open.where(g.close.notna()).rolling(5).mean()),
}


def test_operators_against_pandas(panel, prices):
    got = evaluate(panel, {f"f{k}": f for k, f in enumerate(PANDAS)}).toPandas().sort_values(["instrument_id", "time"]).reset_index(drop=True)
    for k, (text, f) in enumerate(PANDAS.items()):
        want = pd.concat([f(g) for _, g in prices.groupby("instrument_id")]).to_numpy(float)
        np.testing.assert_allclose(got[f"f{k}"].to_numpy(float), want, rtol=1e-6, atol=1e-8, err_msg=text)


def test_every_operator_compiles(panel):
    made = {s.name: None for s in fm.SPECS.values()}
    samples = {v[0] for v in queries.FORMULAS.values()}
    used = {n.op for f in samples for n in nodes(fm.parse(f))}
    assert used == set(made)
    assert evaluate_long(panel.limit(50), {f: f for f in samples}).count() == 50 * len(samples)


def nodes(t):
    return [t, *(n for c in t.children for n in nodes(c))] if isinstance(t, fm.Node) else []


@pytest.mark.parametrize("bad", ["", "close +", "Add(close)", "TsMean(close, 0)", "TsMean(close, volume)", "Nope(close)", "Add(close, volume)", "Mul(close, volume)", "IfElse(close, open, high)", "Return(volume, 3)", "__import__('os')", "close.real", "nowhere", "RollNorm(close, 5, 5, 0, 1)", "Amihud(close, position, 3)"])
def test_parser_refuses(bad):
    with pytest.raises(ValueError):
        fm.parse(bad)


def test_parser_accepts_aliases_and_prints():
    assert fm.parse("ts_mean(close, 5.9)") == fm.parse("TsMean(close, 5)") == fm.parse("tsmean(close, 5)")
    assert str(fm.parse("oprollnorm(oi, 5, 3, 1e-6, 2)")) == "RollNorm(oi, 5, 3, 1e-06, 2)"
    assert fm.wrap_norm("RollNorm(close, 5, 3, 1e-6, 2)").count("RollNorm") == 1 and fm.wrap_norm("close").startswith("RollNorm(close")
    assert fm.fused(["close"]) == "close" and fm.fused(["close", "open"]) == "NanMean(close, open)"
    assert fm.kind_of(fm.parse("Div(volume, TsMean(volume, 3))")) is fm.Kind.RATIO


def test_shared_parts_are_one_window_column(panel):
    plan = evaluate(panel, {"a": "Sub(close, TsMean(close, 5))", "b": "Add(close, TsMean(close, 5))"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_metrics_by_hand(spark):
    rows = [("C0", "f", (pd.Timestamp("2020-12-30") + pd.Timedelta(days=k)).to_pydatetime(), x, r, k == 2) for k, (x, r) in enumerate([(None, 0.01), (1.0, 0.02), (-1.0, -0.01), (None, 0.03), (2.0, None)])]
    frame = spark.createDataFrame(rows, "instrument_id string, factor_name string, time timestamp, factor_value double, future_ret double, is_rollover boolean")
    series = metrics.daily(frame, {"C0": 0.001}).toPandas().sort_values("time")
    assert series.position.tolist() == [0, 1, -1, -1, 2] and series.turnover.tolist() == [0, 1, 2, 0, 3]
    np.testing.assert_allclose(series.gross_ret, [0, 0.02, 0.01, -0.03, 0])
    out = metrics.summary(metrics.daily(frame, {"C0": 0.001})).toPandas().set_index("year")
    assert sorted(out.index) == ["2020", "2021", "all"] and out.loc["all", "T-corr"] == 5 and out.loc["2020", "T-corr"] == math.sqrt(2)
    np.testing.assert_allclose(out.loc["all", "Gross Return"], 0.0, atol=1e-12)
    np.testing.assert_allclose(out.loc["all", "Gross MaxDD"], 0.03, rtol=1e-9)
    with pytest.raises(Exception, match="no fee"):
        metrics.daily(frame, {"X": 0.1}).collect()


def test_backtest_options(panel):
    with pytest.raises(ValueError):
        backtest(panel, {"a": "close"}, Options(method="1H"))
    with pytest.raises(ValueError, match="duplicate"):
        backtest(panel.unionByName(panel.limit(1)), {"a": "close"})
    summary, detail = backtest(panel, {"a": "StochasticK(close)"}, Options(baselines=True, interest="compound"))
    assert set(r["factor_name"] for r in summary.collect()) == {"a", "long", "short"} and detail.count() == 3 * panel.count()


def test_no_operator_looks_ahead(panel):
    formulas = {n: f for n, (f, _) in queries.FORMULAS.items() if n in ("ts_rank", "ema", "roll_norm", "ts_entropy", "ts_rank_corr", "volatility", "vp_divergence")}
    rows = select.look_ahead(panel, formulas, ["2020-02-01", "2020-03-15"]).collect()
    assert len(rows) == len(formulas) and all(r["passed"] and r["compared"] > 2 for r in rows)


def test_stitching_by_hand(spark):
    day = lambda d: pd.Timestamp(f"2020-01-0{d}").to_pydatetime()
    p = [(day(1), "A", 10.0, 5.0), (day(1), "B", 20.0, 4.0), (day(2), "A", 11.0, 1.0), (day(2), "B", 22.0, 9.0), (day(3), "A", 12.0, 1.0), (day(3), "B", 24.0, 9.0), (day(4), "C", 40.0, 1.0)]
    df = spark.createDataFrame([("R", t, s, o, o, o, o, o, v, v) for t, s, o, v in p], "instrument_id string, time timestamp, symbol string, open double, high double, low double, close double, settle double, volume double, position double")
    rows = rollover.stitched(df).orderBy("time").collect()
    assert [(r["symbol"], r["is_rollover"], r["weighted_factor"]) for r in rows] == [("A", False, 1.0), ("A", False, 1.0), ("B", True, 0.5), ("C", True, 0.5)]
    assert [r["weighted_factor"] for r in rollover.stitched(df, anchor="2021-01-01").collect()] == [1.0] * 4


def test_simulation_by_hand(spark):
    rows = [("C0", "f", (pd.Timestamp("2020-01-01") + pd.Timedelta(days=k)).to_pydatetime(), o, f) for k, (o, f) in enumerate([(100.0, 1.0), (110.0, -1.0), (90.0, 0.0), (95.0, 0.5)])]
    frame = spark.createDataFrame(rows, "instrument_id string, factor_name string, time timestamp, open double, factor_value double")
    account = strategy.Account(capital=10_000.0, multiplier=10, margin_rate=0.1, fee_per_lot=1.0, slippage=0.0, signal_delay=0)
    log = strategy.simulate(frame, account).toPandas().sort_values("time")
    assert log.lots.tolist() == [10, -9, 0, 5] and log.fee.tolist() == [10, 19, 9, 5]
    np.testing.assert_allclose(log.equity, [10_990, 12_771, 12_762, 12_757])
    ruin = strategy.simulate(frame, strategy.Account(capital=10_000.0, multiplier=10, fee_per_lot=2000.0, signal_delay=0)).toPandas()
    assert len(ruin) == 1 and ruin.warning[0] == "equity_gone_by_costs"
    act = spark.createDataFrame([(0, 0), (0, 2), (0, -1), (3, 1), (-2, -5), (2, -1), (-1, 4)], "a long, b long").select(strategy.action(F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in act.collect()] == ["HOLD", "OPEN_LONG", "OPEN_SHORT", "ADJUST_LONG", "ADJUST_SHORT", "REVERSE_TO_SHORT", "REVERSE_TO_LONG"]


def test_store(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "time int, instrument_id string, v double")
    store.upsert(a, path)
    new = spark.createDataFrame([(2, "y", 5.0), (3, "z", 3.0)], "time int, instrument_id string, v double")
    for _ in range(2):
        store.upsert(new, path)
        assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1.0, 3.0, 5.0]
    with pytest.raises(ValueError):
        store.insert(new.unionByName(new), path)
    assert store.exists(spark, path) and not store.exists(spark, path + "x") and store.exists(spark, path, F.col("v") == 5) and store.list_tables(spark, str(tmp_path)).first()["name"] == "t"
    assert store.delete(a).count() == 0 and store.delete(a, F.col("v") > 1).count() == 1


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "c")
    row = lambda v, n, f: ("gp", v, n, "C0", "2020", "2021", {"TS IC": (0.1, 0.1, 0.1)}, f, pd.Timestamp("2024-01-01").to_pydatetime(), "gp", None)
    catalog.save(spark.createDataFrame([row("v1", "a", "close"), row("v1", "b", "open")], catalog.SCHEMA), path)
    catalog.save(spark.createDataFrame([row("v1", "a", "high"), row("v2", "a", "low")], catalog.SCHEMA), path)
    df = catalog.read(spark, path)
    assert df.count() == 3 and catalog.formulas(catalog.read(spark, path, versions=["v1"])) == {"a": "high", "b": "open"}
    with pytest.raises(ValueError):
        catalog.formulas(df)
    assert catalog.remove(df, ["v1"]).count() == 1 and catalog.filtered(df, [("gp", None)]).count() == 3 and catalog.filtered(df, [("gp", "v2")]).count() == 1
    assert catalog.versions(df).first()["versions"] == ["v2", "v1"]


def test_search_is_seeded_and_typed(panel):
    import random

    search = mining.Search(population=4, generations=1, max_depth=3, elite=3)
    a, b = (mining.random_tree(random.Random(5), search) for _ in range(2))
    assert a == b
    rng = random.Random(1)
    for _ in range(200):
        t = mining.random_tree(rng, search)
        assert fm.kind_of(fm.parse(str(mining.mutated(rng, t, search)))) in fm.Kind
    assert mining.mine(panel, search) == mining.mine(panel, search)


def test_fusion_stops_where_nothing_improves(panel):
    names, text, path = fusion.fuse(panel.where("instrument_id <> 'S0'"), {"a": "StochasticK(close)", "b": "Neg(StochasticK(close))"}, most=2, weights={"TS IC": 1.0})
    assert len(names) == len(path) == 1 and text in ("StochasticK(close)", "Neg(StochasticK(close))")


@pytest.mark.parametrize("name", ["flagship", "rollover", "f_ts_corr", "f_ts_rank", "f_ema", "relative_spearman", "quantile_portfolios", "nav", "upsert"])
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
    c = sorted(a.columns)
    assert c == sorted(b.columns) and len(a) == len(b)
    keys = [k for k in c if a[k].dtype.kind not in "f"]
    a, b = (x[c].sort_values(keys).reset_index(drop=True) for x in (a, b))
    for k in c:
        if a[k].dtype.kind in "fi":
            np.testing.assert_allclose(a[k].astype(float), b[k].astype(float), atol=2e-6)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert queries_more.contracts is not None and panels.PANEL[0] == "open"


def test_rolling_model_predicts_every_test_month(spark, sf):
    from tallgrass.plans.learning import month
    from tallgrass.plans.queries_models import rolling_model

    months = sorted(r[0] for r in rolling_model(spark, sf).select(month().alias("m")).distinct().collect())
    assert months == list(range(months[0], months[-1] + 1)) and len(months) > 48
