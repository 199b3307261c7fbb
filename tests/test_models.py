"""Boosting, support vectors and linear models from monthly sums against plain computations."""

import numpy as np
import pandas as pd
import pytest

from tallgrass.plans import boosting, learning
from tallgrass.plans.boosting import HistogramBoosting, binned
from tallgrass.plans.vectors import SupportVectors


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 3))
    x[:, 2] = rng.integers(0, 4, 700)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) * (1 + x[:, 2]) + 0.5 * x[:, 1] + rng.normal(0, 0.2, 700)
    x[rng.random(700) < 0.1, 1] = np.nan
    df = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)], "_x array<double>, future_ret double")
    return df.repartition(3).persist(), x, y


def plain_boosting(bins, y, how):
    """Leaf by leaf, each split found by trying all."""
    pred, trees = np.full(len(y), y.mean()), []

    def best(rows, g, h):
        def worth(at):
            return g[at].sum() ** 2 / (h[at].sum() + how.l2)

        out = None
        for f in range(bins.shape[1]):
            known = bins[rows, f] != 0
            for missing_left in (False, True):
                if missing_left and known.all():
                    continue
                for b in range(1, bins[:, f].max() + 1):
                    left = np.where(known, bins[rows, f] <= b, missing_left)
                    lo, hi = rows[left], rows[~left]
                    if min(len(lo), len(hi)) < how.least_rows:
                        continue
                    gain = 0.5 * (worth(lo) + worth(hi) - worth(rows))
                    if gain > max(how.least_gain, 1e-12) and (out is None or gain > out[0] * (1 + 1e-12)):
                        out = (gain, lo, hi)
        return out

    for _ in range(how.trees):
        g, h = boosting.slopes(pred, y, how.loss, how.delta)
        leaves = {0: (np.arange(len(y)), 0)}
        found = {0: best(leaves[0][0], g, h)}
        while len(leaves) < how.leaves:
            able = [k for k in leaves if found.get(k)]
            if not able:
                break
            k = max(able, key=lambda j: (found[j][0], -j))
            _, lo, hi = found[k]
            level = leaves.pop(k)[1] + 1
            for c, rows in ((2 * k + 1, lo), (2 * k + 2, hi)):
                leaves[c] = (rows, level)
                found[c] = best(rows, g, h) if level < how.depth else None
        if len(leaves) == 1:
            break
        trees.append(sorted(leaves))
        for rows, _ in leaves.values():
            pred[rows] -= how.rate * g[rows].sum() / (h[rows].sum() + how.l2)
    return pred, trees


@pytest.mark.parametrize("loss", ["squared", "huber"])
def test_boosting_by_plain_growth(points, loss):
    df, x, y = points
    how = HistogramBoosting(trees=5, depth=3, leaves=6, bins=12, rate=0.3, least_rows=15, least_gain=0.5, loss=loss, delta=0.7, hold=2)
    model = how.fit(df)
    want, trees = plain_boosting(binned(x, model.edges), y, how)
    assert [sorted(t.values) for t in model.trees] == trees
    got = model.transform(df).toPandas()
    assert list(got.columns) == ["_x", "future_ret", "prediction"]
    assert np.allclose(sorted(got.prediction), sorted(want))
    for k, e in enumerate(model.edges):  # a sketch of so few values is exact: a value of the column at each share
        known = np.sort(x[~np.isnan(x[:, k]), k])
        assert np.allclose(e, np.unique([known[int(np.ceil(s / 12 * len(known))) - 1] for s in range(1, 12)]))


def test_boosting_learns_from_shares_and_refuses_nonsense(points, spark):
    df, _, y = points
    got = HistogramBoosting(trees=20, share=0.5, columns=0.67, rate=0.3).fit(df).transform(df).toPandas()
    assert ((got.prediction - got.future_ret) ** 2).mean() < 0.3 * y.var()
    for bad in ({"loss": "hinge"}, {"leaves": 1}, {"bins": 1}):
        with pytest.raises(ValueError):
            HistogramBoosting(**bad)
    with pytest.raises(ValueError):
        HistogramBoosting().fit(df.where("future_ret is null"))
    flat = spark.createDataFrame([([1.0], 2.0)] * 50, "_x array<double>, future_ret double")
    assert {r["prediction"] for r in HistogramBoosting().fit(flat).transform(flat).collect()} == {2.0}


def test_support_vectors_by_plain_descent(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)) * (1.0, 5.0) + (0.0, 3.0)
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(0, 0.5, 300)
    y[:15] += 20
    df = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)], "_x array<double>, future_ret double")
    how = SupportVectors(C=0.5, epsilon=0.2)
    model = how.fit(df)
    z, t = model.features.of(x), (y - y.mean()) / y.std()
    loss = lambda w: how.C * np.maximum(np.abs(z @ w - t) - how.epsilon, 0).sum() + (w[:-1] ** 2).sum() / 2
    w, best = np.zeros(3), np.inf
    for k in range(40_000):
        r = z @ w - t
        w = w - 0.02 / (1 + k / 200) / len(y) * (how.C * z.T @ (np.sign(r) * (np.abs(r) > how.epsilon)) + np.append(w[:-1], 0))
        best = min(best, loss(w)) if k % 10 == 0 else best
    assert loss(model.weights) <= best * 1.002
    got = model.transform(df).toPandas()
    assert np.allclose(np.sort(got.prediction), np.sort(model.predicted(x)))
    assert np.abs(np.median(got.prediction - got.future_ret)) < 0.3  # the far rows hardly pull


def test_radial_features_follow_a_curve(spark):
    x = np.linspace(-3, 3, 400)
    df = spark.createDataFrame([([float(a)], float(np.sin(2 * a))) for a in x], "_x array<double>, future_ret double")
    error = lambda m: m.transform(df).selectExpr("avg(abs(prediction - future_ret))").first()[0]
    assert error(SupportVectors(C=10.0, epsilon=0.05, kernel="rbf", gamma=2.0, components=60).fit(df)) < 0.15 < error(SupportVectors(C=10.0, epsilon=0.05).fit(df))
    for bad in ({"kernel": "poly"}, {"C": 0.0}, {"epsilon": -1.0}):
        with pytest.raises(ValueError):
            SupportVectors(**bad)


def monthly(spark):
    rng = np.random.default_rng(8)
    days = pd.date_range("2020-01-05", "2021-12-28", freq="5D")
    rows = [(f"i{k}", d.to_pydatetime(), float(a), float(b), float(0.3 * a - 0.1 * b + rng.normal())) for k in range(7) for d in days for a, b in [rng.normal(50, 2, 2)]]
    rows[3] = (*rows[3][:2], None, 1.0, 1.0)
    rows[9] = (*rows[9][:4], None)
    return spark.createDataFrame(rows, "instrument_id string, time timestamp, a double, b double, future_ret double"), pd.DataFrame(rows, columns=["i", "t", "a", "b", "y"]).dropna()


@pytest.mark.parametrize("metric", ["rank_ic", "top_return", "mse"])
def test_rolling_linear_by_plain_fits(spark, metric):
    df, plain = monthly(spark)
    ridge = [0.0, 0.5, 20.0]
    got = learning.rolling_linear(df, ["a", "b"], ridge, metric=metric, train=8, validate=3, test=3, step=3).toPandas().sort_values(["instrument_id", "time"])
    plain["m"] = plain.t.dt.year * 12 + plain.t.dt.month

    def fit(p, r):
        x, y = p[["a", "b"]].to_numpy(), p.y.to_numpy()
        c = np.cov(x.T, bias=True)
        w = np.linalg.solve(c + r * np.diag(np.diag(c)), ((x - x.mean(0)) * (y - y.mean())[:, None]).mean(0))
        return lambda q: y.mean() + (q[["a", "b"]].to_numpy() - x.mean(0)) @ w

    out = []
    for a, b, c, d in learning.splits(plain.m.min(), plain.m.max(), 8, 3, 3, 3):
        part = lambda x, y: plain[(plain.m >= x) & (plain.m < y)]

        def worth(r):
            v = part(b, c).assign(p=lambda q: fit(part(a, b), r)(q))  # noqa: B023
            if metric == "mse":
                return -((v.p - v.y) ** 2).mean()
            if metric == "top_return":
                return np.mean([q.nlargest(10, "p").y.mean() for _, q in v.groupby("t")])
            return np.mean([q.p.rank().corr(q.y.rank()) for _, q in v.groupby("t")])

        best = max(ridge, key=lambda r: (round(worth(r), 12), -r))
        out.append(part(c, d).assign(p=lambda q: fit(part(a, c), best)(q)))  # noqa: B023
    want = pd.concat(out).sort_values(["i", "t"])
    assert len(got) == len(want) and np.allclose(got.prediction, want.p)


def test_rolling_linear_without_rows(spark):
    df, _ = monthly(spark)
    assert learning.rolling_linear(df.limit(0), ["a"]).count() == 0
    assert learning.rolling_linear(df, ["a"], train=40).count() == 0
    with pytest.raises(ValueError):
        learning.rolling_linear(df, ["a"], metric="none")


def test_own_models_in_rolling(spark):
    df, _ = monthly(spark)
    for model, params in (("histogram", {"trees": 3, "depth": 2}), ("support", {"C": 0.1})):
        out = learning.rolling(df, ["a", "b"], model, [params], train=12, validate=4, test=4, step=8)
        assert out.count() > 50 and out.where("prediction is null").count() == 0
