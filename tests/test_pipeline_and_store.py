"""Storage by partitions, updates of prices, the elite archive, fitness and the chain from candidates to the registry."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallgrass.functions import scalars
from tallgrass.plans import catalog, mining, pipeline, rollover, select
from tallgrass.sources import panels, store


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(5)
    rows = []
    for name in ("C0", "FG0"):
        close = 100.0
        for k in range(400):
            close *= 1 + rng.gauss(0.0004, 0.012)
            low, high = close * (1 - rng.random() / 50), close * (1 + rng.random() / 50)
            rows.append((name, datetime(2020, 1, 1) + timedelta(k), close * (1 + rng.gauss(0, 0.003)), high, low, close, 1000.0 + rng.random() * 500, 500.0 + rng.random() * 90))
    return spark.createDataFrame(rows, "instrument_id string, time timestamp, open double, high double, low double, close double, volume double, position double").persist()


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path, by = str(tmp_path / "p"), {"month": F.date_format("time", "'m'yyyyMM")}
    made = lambda rows: spark.createDataFrame(rows, "time timestamp, instrument_id string, v double")
    store.upsert(made([(datetime(2024, m, 1), "x", float(m)) for m in (1, 2, 3)]), path, by=by)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "p" / "month=m202401").iterdir()}
    new = made([(datetime(2024, 2, 1), "x", 20.0), (datetime(2024, 2, 2), "y", 21.0), (datetime(2024, 4, 1), "x", 4.0)])
    for _ in range(2):
        store.upsert(new, path, by=by)
        assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1.0, 3.0, 4.0, 20.0, 21.0]
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "p" / "month=m202401").iterdir()} == before


def test_replace_leaves_nothing_beside(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace(spark.range(3), path)
    store.replace(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and [f.name for f in tmp_path.iterdir()] == ["t"]


def test_sinks_by_method(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a", 1.0)], "time int, instrument_id string, v double")
    store.update(one, path)
    store.update(one.withColumn("v", F.lit(2.0)), path, "update_one")
    two = one.unionByName(one.withColumn("time", F.lit(2)))
    store.update(two, path, "bulk_write_update")
    assert sorted((r["time"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 1.0)]
    with pytest.raises(ValueError):
        store.update(two, path, "update_one")
    with pytest.raises(ValueError):
        store.update(one, path, "other")
    store.insert(one.withColumn("v", F.lit(9.0)), path)
    backup = store.deduplicate(spark, path, ("time", "instrument_id"), [F.desc("v")])
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1.0, 9.0] and spark.read.parquet(backup).count() == 3
    assert {r["name"]: r["rows"] for r in store.details(spark, str(tmp_path)).collect()}["t"] == 2
    for form in ("parquet", "csv", "json"):
        store.export(spark.read.parquet(path), str(tmp_path / form), form)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.json(str(tmp_path / "json")).count() == 2
    with pytest.raises(ValueError):
        store.export(one, path, "pickle")


def test_config_files(tmp_path):
    path = str(tmp_path / "c.json")
    assert scalars.load_config(path, {"a": 1}) == {"a": 1}
    scalars.save_config(path, {"b": [1, 2]})
    assert scalars.load_config(path) == {"b": [1, 2]}
    (tmp_path / "c.json").write_text("[1")
    assert scalars.load_config(path) == {}


def test_prices_are_updated_by_what_is_missing(spark, tmp_path):
    asked = []

    def fetch(instrument, first, last):
        asked.append((instrument, first, last))
        days = [first + timedelta(k) for k in range((last - first).days + 1)]
        rows = [(instrument, f"{instrument}{m}", datetime(d.year, d.month, d.day), 100.0 + m, 101.0, 99.0, 100.0, 100.0, 10.0 * (m == (2 if d >= date(2024, 1, 10) else 1)) + 1, 5.0) for d in days for m in (1, 2)]
        return spark.createDataFrame(rows, "instrument_id string, symbol string, time timestamp, open double, high double, low double, close double, settle double, volume double, position double")

    stitch = lambda rows, factors: rollover.stitched(rows, "2020-01-01", next(iter(factors.values())))
    path = str(tmp_path / "prices")
    store.update_prices(spark, path, fetch, stitch, date(2024, 1, 5), date(2024, 1, 15), ["C"])
    first = spark.read.parquet(path)
    assert asked == [("C", date(2024, 1, 5), date(2024, 1, 15))] and first.count() == 11
    last = first.agg(F.max_by("weighted_factor", "time")).first()[0]
    assert last == pytest.approx(101.0 / 102.0)
    asked.clear()
    store.update_prices(spark, path, fetch, stitch, date(2024, 1, 3), date(2024, 2, 2), ["C"])
    assert asked == [("C", date(2024, 1, 3), date(2024, 1, 4)), ("C", date(2024, 1, 16), date(2024, 2, 2))]
    whole = spark.read.parquet(path)
    assert whole.count() == 31 and whole.where("time = '2024-02-02'").first()["weighted_factor"] == pytest.approx(last)
    asked.clear()
    assert store.update_prices(spark, path, fetch, stitch, date(2024, 1, 3), date(2024, 2, 2), ["C"]) == [] and asked == []
    assert len(store.update_prices(spark, path, fetch, stitch, date(2024, 1, 3), date(2024, 1, 4), ["C"], whole=True)) == 1


def test_archive_by_plain_rules():
    near = lambda a, b: 0.9 if a[0] == b[0] else 0.1  # noqa: E731  schools by first letter
    elite = mining.Archive(2, 0.75)
    assert elite.admit("a1", 1.0, near) and not elite.admit("a2", 0.5, near) and elite.admit("a3", 2.0, near)
    assert elite.held == {"a3": 2.0}
    assert elite.admit("b1", 0.2, near) and not elite.admit("c1", 0.1, near) and elite.admit("c2", 0.3, near)
    assert elite.best() == ["a3", "c2"] and not elite.admit("c2", 9.0, near)


def test_depth_penalty():
    s = mining.Search(depth_penalty=0.1, depth_start=3, depth_linear=0.2, depth_quadratic=0.5)
    assert mining.depth_penalty(2, s) == pytest.approx(0.2) and mining.depth_penalty(5, s) == pytest.approx(0.5 + 0.4 + 2.0)


def test_correlations_against_pandas(panel):
    formulas = ["TsDelta(close, 3)", "TsDelta(close, 5)", "Neg(TsDelta(close, 3))", "Sub(close, close)"]
    found = mining.correlations(panel, formulas)
    df = panel.toPandas().sort_values(["instrument_id", "time"])
    by = df.groupby("instrument_id")["close"]
    a, b = df["close"] - by.shift(3), df["close"] - by.shift(5)
    assert found[1, 0] == pytest.approx(abs(a.corr(b))) and found[2, 0] == pytest.approx(1.0) and found[3, 0] == 0.0
    assert mining.correlations(panel.limit(5), formulas)[1, 0] == 0.0


def test_short_instruments_are_left_out(panel):
    search = mining.Search(fitness={"TS IC": 1.0})
    few = panel.where("instrument_id = 'C0' or time < '2020-02-01'")
    one = mining.scores(panel.where("instrument_id = 'C0'"), {"f": "Delta(close)"}, search).first()["score"]
    assert mining.scores(few, {"f": "Delta(close)"}, search).first()["score"] == pytest.approx(one)


def test_chain_from_candidates_to_registry(spark, panel, tmp_path):
    path = str(tmp_path / "registry")
    candidates = {"fast": "TsDelta(close, 3)", "flat": "RollNorm(TsDelta(close, 3), 20, 10, 1e-06, 2)", "other": "Neg(StochasticK(close))"}
    rules = pipeline.Rules({"Turnover": (0.1, 0.0, 1)}, related=0.6, cuts=["2020-06-01"])
    first = pipeline.auto_mine(panel, path, rules, "v1", candidates=candidates)
    assert first.passed == first.honest == first.new == ["fast", "flat", "other"] and first.closest == {}
    stored = catalog.read(spark, path)
    assert stored.count() == 6 and catalog.formulas(stored) == candidates and stored.first()["fitness"]["TS IC"] is not None
    again = pipeline.auto_mine(panel, path, rules, "v1", candidates=candidates)  # its own version is no rival
    assert again.new == first.new and catalog.read(spark, path).count() == 6
    second = pipeline.auto_mine(panel, path, rules, "v2", candidates={"near": "TsDelta(close, 4)", "own": "TsMean(volume, 5)"})
    assert second.new == ["own"] and second.closest["near"] >= 0.6
    table = {r["factor_name"]: r["kept"] for r in second.table().collect()}
    assert table == {"near": False, "own": True} and catalog.read(spark, path).count() == 8
    impossible = pipeline.Rules({"Turnover": (999.0, 999.0, 1)})
    assert pipeline.auto_mine(panel, path, impossible, "v3", candidates=candidates).new == [] and catalog.read(spark, path).count() == 8
    with pytest.raises(ValueError):
        pipeline.auto_mine(panel, path, pipeline.Rules({"No Metric": (0, 0, 1)}), "v3", candidates=candidates)


def test_search_feeds_the_chain(spark, panel, tmp_path):
    search = mining.Search(population=6, generations=2, max_depth=3, elite=3)
    run = pipeline.auto_mine(panel, str(tmp_path / "r"), pipeline.Rules({"TS IC": (-1.0, -1.0, 1)}, cuts=["2020-08-01"]), "v1", search=search)
    assert set(run.new) <= {"fac_gp_0001", "fac_gp_0002", "fac_gp_0003"} and (run.new == [] or catalog.read(spark, str(tmp_path / "r")).count() == 2 * len(run.new))


def test_leaking_column_is_found(panel):
    knowing = lambda df: df.withColumn("peek", F.lead("close").over(panels.by_time()))
    out = {r["factor_name"]: r for r in select.look_ahead(panel, {"back": "Delta(close)", "leak": "Neg(peek)"}, prepare=knowing).collect()}
    assert out["back"]["passed"] and out["back"]["compared"] == 40 and not out["leak"]["passed"] and out["leak"]["changed"] == 38


def test_rows_on_one_side_count_as_changed(panel):
    gone = lambda df: df.where("instrument_id like 'C0%' or time < '2020-03-01'")
    calls = iter([gone, lambda df: df])
    out = select.look_ahead(panel, {"back": "Delta(close)"}, ["2020-06-01"], prepare=lambda df: next(calls)(df)).first()
    assert out["compared"] == 2 and out["changed"] == 1 and not out["passed"]


def test_exponential_means_go_on_over_batches(spark):
    import numpy as np
    import pandas as pd

    from tallgrass.operators.compiler import evaluate

    rng = random.Random(3)
    rows = [(name, datetime(2020, 1, 1) + timedelta(k), None if k < 2 or rng.random() < 0.3 or 30 < k < 50 else rng.random()) for name in ("a", "b", "c") for k in range(90)]
    df = spark.createDataFrame(rows, "instrument_id string, time timestamp, close double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = evaluate(df, {"e": "Ema(close, 5)"}).toPandas().sort_values(["instrument_id", "time"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plain = pd.DataFrame(rows, columns=["i", "t", "x"])
    want = plain.groupby("i")["x"].transform(lambda x: x.astype(float).ewm(span=5, adjust=False).mean())
    np.testing.assert_allclose(got["e"].to_numpy(float), want.to_numpy(), rtol=1e-12)


def test_formulas_out_of_answers(panel):
    answers = ['Sure! {"formulas": ["Delta(close)", "Nothing(close)", "TsMean(close, 5)"]} Enjoy.', "none", '{"formulas": ["delta(close)", "Add(close, volume)", 7]}', '{"formulas": {"a": 1}}', "{broken"]
    assert pipeline.proposed(answers, panel) == {"fac_llm_0001": "Delta(close)", "fac_llm_0002": "TsMean(close, 5)"}
    assert len(pipeline.proposed(answers, panel, most=1)) == 1
    before, after = pipeline.split(panel, "2020-07-01")
    assert before.count() + after.count() == panel.count() and after.agg(F.min("time")).first()[0] == datetime(2020, 7, 1)


def test_own_operators(panel):
    from tallgrass.functions import formula
    from tallgrass.operators import extend

    with extend.registered("Twice", lambda x: x * 2):
        assert str(formula.parse("twice(close)")) == "Twice(close)"
        with pytest.raises(ValueError):
            extend.register("Twice", lambda x: x)
    with pytest.raises(ValueError):
        formula.parse("Twice(close)")
    with pytest.raises(ValueError):
        extend.register("TsMean", lambda x: x)


def test_random_search_of_models(spark, panel):
    from tallgrass.operators.compiler import evaluate
    from tallgrass.plans import learning

    grid = learning.drawn({"regParam": [0.0, 0.1, 0.5], "elasticNetParam": [0.0, 0.5]}, 3)
    assert len(grid) == 3 and grid == learning.drawn({"regParam": [0.0, 0.1, 0.5], "elasticNetParam": [0.0, 0.5]}, 3) and len(learning.drawn({"a": [1]}, 3)) == 1
    df = evaluate(panels.future_return(panel), {"x": "Delta(close)"}, ["instrument_id", "time", "future_ret"])
    out = learning.rolling(df, ["x"], "linear", grid[:2], metric="top_return", train=4, validate=2, test=2, step=2)
    assert out.count() > 100 and learning.backtested(out).where("year = 'all'").count() == 2
    with pytest.raises(ValueError):
        learning.rolling(df, ["x"], metric="none")
