"""Rounds of proposals, and fusions from the registry with their checks."""

import json

import pytest
from pyspark.sql import functions as F

from tallgrass.plans import catalog, fusion, generator, pipeline
from tallgrass.sources import panels


@pytest.fixture(scope="module")
def panel(spark):
    return panels.lineitem_panel(spark, "/root/testdata/sf0.001").persist()


def test_rounds_with_feedback(panel, spark):
    answers = iter(
        [
            'Sure: {"formulas": ["TsMean(close, 5)", "TsMean( close ,5)", "Foo(close)", "Sub(close, close)", "Add(close, volume)"]} done',
            "no json",
            json.dumps({"factors": [{"formula": "Delta(close)", "logic": "x"}, {"formula": 3}, "TsMean(close, 5)"]}),
            json.dumps({"formulas": ["TsStd(close, 4)", "TsMax(high, 3)"]}),
        ]
    )
    asked = []

    def propose(request):
        asked.append(request)
        return next(answers)

    how = generator.Rounds(target=3, per_round=2, patience=3)
    out = generator.generated(panel, propose, how, "momentum")
    assert list(out.formulas.values()) == ["TsMean(close, 5)", "Delta(close)", "TsStd(close, 4)"] and out.reason == "target"
    assert out.rounds == [(1, 5, 1, 1), (2, 0, 0, 1), (3, 2, 1, 2), (4, 2, 1, 3)] and out.table(spark).count() == 4
    assert out.failed["Sub(close, close)"] == "it has one value only" and "Foo(close)" in out.failed and "answer 2" in out.failed
    assert [r.wanted for r in asked] == [2, 2, 2, 1] and asked[2].known == ("TsMean(close, 5)",)
    text = asked[2].prompt()
    assert "momentum" in text and "Do not repeat these: TsMean(close, 5)" in text and "Sub(close, close) (it has one value only)" in text


def test_rounds_end(panel):
    same = lambda request: '{"formulas": ["Delta(close)"]}'
    out = generator.generated(panel, same, generator.Rounds(target=5, per_round=5, patience=2))
    assert out.reason == "no growth" and len(out.rounds) == 3
    assert generator.generated(panel, same, stop=lambda: True).reason == "stopped"
    wide = generator.generated(panel, lambda r: '{"formulas": ["TsMean(close, 99999)"]}', generator.Rounds(target=1, most=1))
    assert wide.reason == "rounds" and wide.failed == {"TsMean(close, 99999)": "its windows are wider than the series"}
    norm = generator.generated(panel, same, generator.Rounds(target=1, normalise=True))
    assert list(norm.formulas.values())[0].startswith("RollNorm(Delta(close)")
    with pytest.raises(ValueError):
        generator.Rounds(target=0)


def test_fusion_is_checked_and_stored(panel, spark, tmp_path):
    path = str(tmp_path / "registry")
    formulas = {"x": "Neg(StochasticK(close))", "y": "Neg(TsRank(close, 5))", "z": "Neg(Bias(close, 5))"}
    rules = pipeline.Rules({"Gross Volatility": (100.0, 100.0, -1)}, need_all=False, every_instrument=False)
    run = pipeline.chosen(panel, formulas, {}, rules)
    run.new = list(formulas)
    catalog.save(pipeline.records(run, panel, "v1", "gp"), path)
    known = fusion.candidates(catalog.read(spark, path), {"gp": []})
    assert {k: r["formula"] for k, r in known.items()} == {f"v1::{k}": f for k, f in formulas.items()}
    assert fusion.candidates(catalog.read(spark, path), {"gp": ["v2"]}) == {}
    weights = {"TS IC": -1.0}  # these look the wrong way, so that their mean has something to gain
    made = fusion.fuse_stored(panel, path, {"gp": ["v1"]}, "f1", weights=weights)
    assert made.rows > 100 and made.difference < 1e-9 and made.honest
    assert made.stored == (len(made.chosen) > 1)
    kept = catalog.read(spark, path, collections=["factor_fusion"])
    if made.stored:
        row = kept.first()
        assert kept.count() == panel.select("instrument_id").distinct().count() and row["formula"] == made.formula and set(row["fusion_info"]["v1"]) == {c.split("::")[1] for c in made.chosen}
        again = fusion.fuse_stored(panel, path, {"gp": ["v1"]}, "f2", weights=weights, related=0.9)
        assert again.closest == pytest.approx(1.0) and not again.stored
    assert fusion.fuse_stored(panel, path, {"none": []}, "f3").chosen == []
    n, difference, corr = fusion.consistency(panel, ["close", "open"], "NanMean(close, high)")
    assert n > 0 and difference > 0.1 and corr < 1


def test_blended_scores(panel):
    formulas = {"x": "Neg(StochasticK(close))"}
    cut = panel.agg(F.expr("percentile_approx(cast(time as timestamp), 0.6)")).first()[0].date().isoformat()
    weights = {"TS IC": 1.0}
    one = lambda a, z, share=0.0: fusion.scores(panel, formulas, weights, fusion.Options(), fusion.Outside(share, (None, None), (a, z)))["x"]
    blended = fusion.scores(panel, formulas, weights, fusion.Options(), fusion.Outside(0.3, (cut, None), (None, cut)))["x"]
    assert blended == pytest.approx(0.7 * one(None, cut) + 0.3 * one(cut, None))
    assert fusion.scores(panel, formulas, weights, fusion.Options(), fusion.Outside(0.3, ("2100-01-01", None), (None, cut)))["x"] == pytest.approx(one(None, cut))
    with pytest.raises(ValueError):
        fusion.Outside(1.5, (None, None))
