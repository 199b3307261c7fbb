"""Rolling training on factor columns: pyspark.ml's models, boosting and support vectors of our own, and linear models of
all splits and penalties from one pass of monthly sums."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from .backtest import Options
from .boosting import HistogramBoosting
from .vectors import SupportVectors
from .xsection import information

MODELS = {"linear": LinearRegression, "tree": DecisionTreeRegressor, "forest": RandomForestRegressor, "boosted": GBTRegressor, "histogram": HistogramBoosting, "support": SupportVectors}


def month(column: str = "time"):
    return F.year(column) * 12 + F.month(column)


def splits(first: int, last: int, train: int = 18, validate: int = 6, test: int = 6, step: int = 6) -> list[tuple[int, int, int, int]]:
    """(train from, validate from, test from, end) as month numbers, end exclusive."""
    out, at = [], first
    while at + train + validate < last + 1:
        out.append((at, at + train, at + train + validate, min(at + train + validate + test, last + 1)))
        at += step
    return out


def _fitted(df: DataFrame, model: str, params: dict, label: str):
    return MODELS[model](featuresCol="_x", labelCol=label, **params).fit(df)


def drawn(choices: Mapping[str, Sequence], n: int, seed: int = 1) -> list[dict]:
    """n different combinations of parameters by chance (all of them, if there are fewer): a grid for a random search."""
    every = [dict(zip(choices, v, strict=True)) for v in product(*choices.values())]
    return every if len(every) <= n else random.Random(seed).sample(every, n)


#: What a search holds predictions of the validation months against: larger is better.
WORTH = {
    "rank_ic": lambda scored, label: information(scored, "prediction", label).agg(F.avg("rank_ic")),
    "top_return": lambda scored, label: top_return(scored, 10, label).agg(F.avg("ret")),
}


class Moments:
    """Sums of products of (1, factors, label) by month, added up over months, for linear models of any span of them."""

    def __init__(self, sums: Mapping[int, np.ndarray]):
        self.first, self.last = min(sums), max(sums)
        size = len(next(iter(sums.values())))
        by_month = np.array([sums.get(m, np.zeros((size, size))) for m in range(self.first, self.last + 1)])
        self.upto = np.concatenate([np.zeros((1, size, size)), np.cumsum(by_month, axis=0)])

    def span(self, a: int, b: int) -> np.ndarray:
        """The sums over the months from a to before b."""
        place = lambda m: min(max(m - self.first, 0), len(self.upto) - 1)
        return self.upto[place(b)] - self.upto[place(a)]

    def fitted(self, a: int, b: int, ridge: float = 0.0) -> tuple[np.ndarray, float] | None:
        """Weights and intercept of least squares, ridge times each factor's variance added to the diagonal; None without rows."""
        m = self.span(a, b)
        if m[0, 0] < 0.5:
            return None
        mean = m[0] / m[0, 0]
        cov = m / m[0, 0] - np.outer(mean, mean)
        inner = cov[1:-1, 1:-1]
        w = np.linalg.pinv(inner + ridge * np.diag(np.diag(inner)), rcond=1e-12) @ cov[1:-1, -1]
        return w, float(mean[-1] - w @ mean[1:-1])

    def squared_error(self, a: int, b: int, w: np.ndarray, intercept: float) -> float | None:
        m = self.span(a, b)
        if m[0, 0] < 0.5:
            return None
        v = np.concatenate([[intercept], w, [-1.0]])
        return float(v @ m @ v / m[0, 0])


def monthly_moments(df: DataFrame, factors: list[str], label: str = "future_ret") -> Moments | None:
    """The moments of rows that have all factors and a label: one pass, whose result has months times factors squared numbers."""
    size = len(factors) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            z = np.column_stack([np.ones(batch.num_rows), *(batch.column(c).to_numpy() for c in (*factors, label))])
            months = batch.column("_month").to_numpy()
            for m in np.unique(months).tolist():
                part = z[months == m]
                total[m] = total.get(m, 0.0) + part.T @ part
        for m, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size * size, m)), pa.array(np.arange(size * size)), pa.array(v.ravel())], names=["month", "place", "v"])

    rows = df.dropna(subset=[*factors, label]).select(month().cast("long").alias("_month"), *(F.col(c).cast("double").alias(c) for c in (*factors, label)))
    sums: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(run, "month long, place long, v double").groupBy("month", "place").agg(F.sum("v").alias("v")).collect():
        sums.setdefault(r["month"], np.zeros((size, size))).flat[r["place"]] = r["v"]
    return Moments(sums) if sums else None


def _applied(df: DataFrame, factors: list[str], models: list[tuple], keys: str) -> DataFrame:
    """df with predictions of linear models (keys.., month, weights, intercept), a row for each model of the row's month.

    Models are few: months times the grid."""
    table = df.sparkSession.createDataFrame(models, f"{keys}_month long, _w array<double>, _b double")
    linear = sum((F.col(c) * F.get("_w", k) for k, c in enumerate(factors)), F.col("_b"))
    return df.withColumn("_month", month().cast("long")).join(F.broadcast(table), "_month").withColumn("prediction", linear).drop("_month", "_w", "_b")


def rolling_linear(df: DataFrame, factors: list[str], ridge: Sequence[float] = (0.0,), label: str = "future_ret", metric: str = "rank_ic", **widths) -> DataFrame:
    """Predictions over all test months as in rolling, for linear models with a choice of ridge penalties.

    All splits and penalties are solved from one job's monthly sums. A choice takes one more job, which scores all
    candidates on their validation months together; by squared error (metric mse) the sums tell that too."""
    if metric not in (*WORTH, "mse"):
        raise ValueError(f"unknown metric {metric}; there are mse, {', '.join(WORTH)}")
    known = df.dropna(subset=[*factors, label])
    moments = monthly_moments(known, factors, label)
    none = df.withColumn("prediction", F.lit(None).cast("double")).limit(0)
    if moments is None:
        return none
    plan = splits(moments.first, moments.last, **widths)
    fits = {(s, k): moments.fitted(a, b, r) for s, (a, b, _, _) in enumerate(plan) for k, r in enumerate(ridge)}
    fits = {at: f for at, f in fits.items() if f is not None}
    worth: dict[tuple[int, int], float] = {}
    if len(ridge) > 1 and metric == "mse":
        errors = {(s, k): moments.squared_error(plan[s][1], plan[s][2], *f) for (s, k), f in fits.items()}
        worth = {at: -e for at, e in errors.items() if e is not None}
    elif len(ridge) > 1:
        candidates = [(s, k, m, f[0].tolist(), f[1]) for (s, k), f in fits.items() for m in range(plan[s][1], plan[s][2])]
        scored = _applied(known.select("instrument_id", "time", *factors, label), factors, candidates, "_split long, _choice long, ")
        by = ("_split", "_choice", "time")
        made = information(scored, "prediction", label, by).withColumn("v", F.col("rank_ic")) if metric == "rank_ic" else top_return(scored, 10, label, by).withColumn("v", F.col("ret"))
        worth = {(r["_split"], r["_choice"]): r["v"] for r in made.groupBy("_split", "_choice").agg(F.avg("v").alias("v")).collect() if r["v"] is not None}
    models = []
    for s, (a, _, c, d) in enumerate(plan):
        best = max(range(len(ridge)), key=lambda k: (worth.get((s, k), -2.0), -k))
        fit = moments.fitted(a, c, ridge[best])
        models += [(m, fit[0].tolist(), fit[1]) for m in range(c, d)] if fit else []
    return _applied(known, factors, models, "") if models else none


def rolling(df: DataFrame, factors: list[str], model: str = "linear", grid: Iterable[dict] = ({},), label: str = "future_ret", metric: str = "rank_ic", **widths) -> DataFrame:
    """Predictions over all test months: per split the parameters with the best metric on the validation
    months are fitted again on training and validation months together. The prepared rows stay in memory as long as the
    caller's session wants them; `rolling_linear` does linear models without any."""
    if metric not in WORTH:
        raise ValueError(f"unknown metric {metric}; there are {', '.join(WORTH)}")
    if model not in MODELS:
        raise ValueError(f"unknown model {model}; there are {', '.join(MODELS)}")
    df = VectorAssembler(inputCols=factors, outputCol="_x").transform(df.dropna(subset=[*factors, label])).withColumn("_month", month()).persist()
    low, high = df.agg(F.min("_month"), F.max("_month")).first()
    out, grid = None, list(grid)
    for a, b, c, d in splits(low, high, **widths) if low is not None else []:
        part = lambda x, y: df.where(F.col("_month").between(x, y - 1))
        best = grid[0]
        if len(grid) > 1:
            def worth(p):  # noqa: ANN001, ANN202
                scored = _fitted(part(a, b), model, p, label).transform(part(b, c))  # noqa: B023
                found = WORTH[metric](scored, label).first()[0]
                return -2.0 if found is None else found
            best = max(grid, key=worth)
        made = _fitted(part(a, c), model, best, label).transform(part(c, d)).drop("_x", "_month")
        out = made if out is None else out.unionByName(made)
    return out if out is not None else df.drop("_x", "_month").withColumn("prediction", F.lit(None).cast("double")).limit(0)


def backtested(predictions: DataFrame, name: str = "signal", options: Options = Options()) -> DataFrame:
    """The summary of predictions (instrument_id, time, prediction, future_ret) as a factor's positions."""
    keep = [c for c in ("instrument_id", "time", "future_ret", "is_rollover") if c in predictions.columns]
    frame = predictions.select(*keep, F.lit(name).alias("factor_name"), F.col("prediction").alias("factor_value"))
    return metrics.summary(metrics.daily(frame, options.fees, options.rollover_cost), options.interest, options.calmar, options.method)


def top_return(predictions: DataFrame, n: int = 10, label: str = "future_ret", by: tuple[str, ...] = ("time",)) -> DataFrame:
    """Mean label of each time's n largest predictions."""
    order = Window.partitionBy(*by).orderBy(F.desc("prediction"), "instrument_id")
    return predictions.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).groupBy(*by).agg(F.avg(label).alias("ret"))
