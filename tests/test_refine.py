"""Refinement: derivatives against finite differences of the score, the score against the search's own, folding back."""

import random

import pytest

from tallgrass.functions.formula import Const, Node, kind_of, parse
from tallgrass.plans import mining, refine
from tallgrass.plans.refine import Parametric, Refine
from tallgrass.sources import panels

FORMULAS = [
    "Add(TsMean(TsPctDelta(close, 3), 5), TsResidual(TsPctDelta(high, 4), TsPctDelta(low, 4), 9))",
    "Sub(TsMean(Max(TsPctDelta(close, 4), TsPctDelta(open, 4)), 6), TsMax(TsPctDelta(high, 5), 4))",
    "TsCorr(NanMean(TsDelta(close, 3), Delta(low)), Ema(TsDelta(open, 4), 5), 8)",
    "IfElse(Lt(close, open), Add(Sig(Bias(close, 9)), Inv(TsSkew(close, 8))), Mul(0.7, TsKurt(close, 9)))",
]
METRICS = {"TS IC": 1.0, "TS ICIR": 0.3, "Gross Return": 0.1, "Net Return": 0.2, "Gross Volatility": -0.05, "Net Volatility": -0.03, "Gross Sharpe": 0.1, "Net Sharpe": 0.07, "Turnover": -0.5}


@pytest.fixture(scope="module")
def panel(spark):
    df = panels.lineitem_panel(spark, "/root/testdata/sf0.01").where("time < '1996-07-01' and instrument_id in ('AF', 'NO', 'RF')")
    return df.persist()


def scores(panel, models, search, how):
    return {(r["tree"], r["place"]): r for r in refine.gradients(panel, models, search, how).collect()}


@pytest.mark.parametrize("formula", FORMULAS)
def test_derivatives_by_finite_differences(panel, formula):
    """Along random directions in all parameters at once; the moved copies are in one plan."""
    how, search = Refine(radius=1, min_window=6 if "Kurt" in formula else 3), mining.Search(fitness=METRICS)
    h, tree, rng = 2e-6, parse(formula), random.Random(formula)
    many = len(Parametric(tree, how).params)
    start = [0.1 * rng.uniform(-1, 1) for _ in range(many)]
    ways = [[rng.uniform(-1, 1) for _ in range(many)] for _ in range(2)]
    models, first = {}, 0
    for name, by in [("base", [0.0] * many), *((f"{k}{sign:+d}", [sign * h * u for u in w]) for k, w in enumerate(ways) for sign in (1, -1))]:
        models[name] = Parametric(tree, how, first)
        for p, s, move in zip(models[name].params, start, by, strict=True):
            p.value = p.start + s + move
        first += many
    found = scores(panel, models, search, how)
    value = lambda name: found[list(models).index(name), -1]["score"]
    slopes = [found[0, j]["slope"] if (0, j) in found else 0.0 for j in range(many)]
    assert sum(abs(s) > 1e-6 for s in slopes) > many / 2
    for k, w in enumerate(ways):
        want = (value(f"{k}+1") - value(f"{k}-1")) / (2 * h)
        assert sum(s * u for s, u in zip(slopes, w, strict=True)) == pytest.approx(want, rel=1e-3, abs=1e-4)


def test_score_is_that_of_the_search(panel):
    search = mining.Search(fitness=METRICS)
    formulas = {f: parse(f) for f in FORMULAS[:2]}
    how = Refine(radius=0)  # no windows are mixed, all weights are 1
    models, first = {}, 0
    for f, t in formulas.items():
        models[f] = Parametric(t, how, first)
        first += len(models[f].params)
    found = scores(panel, models, search, how)
    want = {r["factor_name"]: r["score"] for r in mining.scores(panel, {f: f"RollNorm({f}, 60, 20, 1e-06, 3)" for f in formulas}, search).collect()}
    for k, f in enumerate(formulas):
        assert found[k, -1]["score"] == pytest.approx(want[f], abs=1e-6)


def test_parameters_and_folding():
    tree = parse("Add(Mul(0.5, Bias(close, 5)), Sub(Bias(close, 10), TsArgmax(close, 4)))")
    m = Parametric(tree, Refine())
    assert [p.kind for p in m.params].count("weight") == 4 and [p.kind for p in m.params].count("window") == 2 and [p.kind for p in m.params].count("constant") == 1
    assert m.materialised() == tree
    for p in m.params:
        p.value = {"weight": 2.0, "constant": 0.25, "window": p.start + 1.4}[p.kind]
    made = m.materialised()
    assert str(made) == "Add(Mul(0.5, Bias(close, 6)), Mul(2, Sub(Mul(2, Bias(close, 11)), Mul(2, TsArgmax(close, 4)))))"
    assert kind_of(made) is kind_of(tree) and parse(str(made)) == made
    shared = Parametric(parse("Add(Add(TsMean(close, 5), open), TsMean(open, 5))"), Refine(shared=True))
    assert [p.kind for p in shared.params].count("weight") == 2 and [p.kind for p in shared.params].count("window") == 1
    assert refine._scaled(2.0, Const(3.0)) == Const(6.0)
    windows = [p.choices for p in Parametric(parse("TsMean(close, 2)"), Refine()).params]
    assert windows == [(2, 3, 4)]


def test_bad_settings():
    for bad in ({"optimiser": "newton"}, {"steps": -1}, {"patience": 0}, {"min_window": 9, "max_window": 3}, {"rate": 0.0}):
        with pytest.raises(ValueError):
            Refine(**bad)
    with pytest.raises(ValueError):
        refine.score_gradients(None, {"TS RankIC": 1.0}, None)


def test_refinement_is_never_below(panel, optimiser="adam"):
    search = mining.Search(fitness={"TS IC": 1.0, "Net Return": 0.1})
    trees = [parse(f) for f in ("Add(Bias(close, 5), Bias(close, 10))", "TsArgmax(close, 5)")]
    scored = mining.fitness(panel, trees, search)
    got = refine.refined(panel, scored, search, Refine(steps=4, radius=1, optimiser=optimiser))
    assert set(got) == set(scored)
    assert all(got[f][1] >= scored[f][0] for f in scored)
    assert got["TsArgmax(close, 5)"][0] == "TsArgmax(close, 5)"  # a place has no derivative
    climbed = refine.climbed(panel, trees[:1], search, Refine(steps=4, radius=1, optimiser=optimiser))[str(trees[0])]
    assert climbed[2] > climbed[1] and isinstance(climbed[0], Node)


def test_search_with_gradient(panel):
    how = Refine(steps=1, radius=1, every=1)
    plain = dict(mining.mine(panel, mining.Search(population=4, generations=1, max_depth=2, seed=5)))
    found = dict(mining.mine(panel, mining.Search(population=4, generations=1, max_depth=2, seed=5, gradient=how)))
    assert max(found.values()) >= max(plain.values())


@pytest.mark.parametrize("optimiser", refine.OPTIMISERS)
def test_optimisers_climb_a_hill(optimiser):
    m = Parametric(parse("Add(TsMean(close, 10), open)"), Refine(rate=0.1, optimiser=optimiser))
    steps = refine._Steps(m, Refine(rate=0.1, optimiser=optimiser))
    start = None
    for _ in range(200):
        w, a, b = (p.value for p in m.params)
        score = -((a - 1.6) ** 2) - (b - 0.5) ** 2 - 0.1 * (w - 11.5) ** 2
        start = score if start is None else start
        steps.seen(score)
        steps.move([-0.2 * (w - 11.5), -2 * (a - 1.6), -2 * (b - 0.5)])
    steps.settle()
    assert steps.best > 0.2 * start and 8 <= m.params[0].value <= 12
