"""Support vector regression: the epsilon-insensitive loss with an L2 penalty, linear or with random features for a kernel.

The loss is smoothed by a parabola of width mu past epsilon, which shrinks from step to step. Each Newton step is one job: a
partition adds up the gradient and the Gram matrix of the rows in the parabola, whose size depends on the features only.
The driver solves, and halves the step until the loss falls; the losses of all halvings come from one further job."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KERNELS = ("linear", "rbf")


def insensitive(r: np.ndarray, epsilon: float, mu: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smoothed loss of residuals, with its first two derivatives."""
    over = np.abs(r) - epsilon
    bend = (over > 0) & (over < mu)
    value = np.where(over <= 0, 0.0, np.where(bend, over * over / (2 * mu), over - mu / 2))
    return value, np.sign(r) * np.clip(over / mu, 0.0, 1.0), bend / mu


@dataclass
class Features:
    """Standardised columns, and for a radial kernel cosines of random projections; a last column of ones."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray | None = None
    shift: np.ndarray | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        if self.turn is not None:
            z = np.sqrt(2.0 / len(self.shift)) * np.cos(z @ self.turn + self.shift)
        return np.column_stack([z, np.ones(len(z))])

    @property
    def size(self) -> int:
        return (len(self.mean) if self.turn is None else len(self.shift)) + 1


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("_a").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width)
    return x, batch.column("_y").to_numpy()


def _summed(df: DataFrame, make, size: int, width: int) -> np.ndarray:
    """The sum over all rows of a vector of so many numbers: added up by partition, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                total += make(*_rows(batch.slice(at, 4096), width))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["place", "v"])

    out = np.zeros(size)
    for r in df.mapInArrow(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():
        out[r["place"]] = r["v"]
    return out


@dataclass
class SupportVectorModel:
    featuresCol: str
    features: Features
    weights: np.ndarray
    middle: float
    spread: float

    def predicted(self, x: np.ndarray) -> np.ndarray:
        return self.middle + self.spread * (self.features.of(x) @ self.weights)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the column prediction."""
        width, model = len(self.features.mean), self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("_array").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width)
                    keep = [k for k, c in enumerate(batch.schema.names) if c != "_array"]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(model.predicted(x))], names=[*(batch.schema.names[k] for k in keep), "prediction"])

        vector = dict(df.dtypes)[self.featuresCol] == "vector"
        sent = df.withColumn("_array", vector_to_array(self.featuresCol) if vector else F.col(self.featuresCol).cast("array<double>"))
        sent = sent.drop(self.featuresCol) if vector else sent
        rest = [f for f in sent.schema.fields if f.name != "_array"]
        return sent.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "prediction double"]))


@dataclass
class SupportVectors:
    """Minimises |w|^2 / 2 + C * the sum of max(0, |y - w x - b| - epsilon), on standardised features and label.

    kernel rbf: components random features of the kernel exp(-gamma |a - b|^2); gamma None is one over the features."""

    featuresCol: str = "_x"
    labelCol: str = "future_ret"
    C: float = 1.0
    epsilon: float = 0.1
    kernel: str = "linear"
    components: int = 100
    gamma: float | None = None
    steps: int = 40
    tolerance: float = 1e-5
    seed: int = 1

    def __post_init__(self) -> None:
        if self.kernel not in KERNELS:
            raise ValueError(f"unknown kernel {self.kernel}; there are {', '.join(KERNELS)}")
        if self.C <= 0 or self.epsilon < 0 or self.components < 1:
            raise ValueError("C and components are positive, epsilon is not negative")

    def fit(self, df: DataFrame) -> SupportVectorModel:
        vector = dict(df.dtypes)[self.featuresCol] == "vector"
        array = vector_to_array(self.featuresCol) if vector else F.col(self.featuresCol).cast("array<double>")
        rows = df.select(array.alias("_a"), F.col(self.labelCol).cast("double").alias("_y")).where("_y is not null and not isnan(_y)").persist()
        head = rows.agg(F.count(F.lit(1)), F.max(F.size("_a")), F.avg("_y"), F.stddev_pop("_y")).first()
        if not head[0]:
            rows.unpersist()
            raise ValueError("there is no labelled row to learn from")
        n, width, middle, spread = head[0], head[1], head[2], head[3] or 1.0
        places = [F.get("_a", k) for k in range(width)]
        moments = rows.agg(*(F.avg(p).alias(f"m{k}") for k, p in enumerate(places)), *(F.stddev_pop(p).alias(f"s{k}") for k, p in enumerate(places))).first()
        mean, scale = (np.array([moments[f"{c}{k}"] for k in range(width)], float) for c in "ms")
        made = Features(mean, np.where(scale > 0, scale, 1.0))
        if self.kernel == "rbf":
            rng, gamma = np.random.default_rng(self.seed), self.gamma or 1.0 / width
            made.turn, made.shift = rng.normal(0, np.sqrt(2 * gamma), (width, self.components)), rng.uniform(0, 2 * np.pi, self.components)
        w = self._solved(rows, made, width, n, middle, spread)
        rows.unpersist()
        return SupportVectorModel(self.featuresCol, made, w, middle, spread)

    def _solved(self, rows: DataFrame, made: Features, width: int, n: int, middle: float, spread: float) -> np.ndarray:
        size, eps = made.size, self.epsilon
        penalty = np.append(np.full(size - 1, 1.0 / (self.C * n)), 0.0)  # the loss as a mean, the last weight is free
        w, mu = np.zeros(size), 1.0
        for _ in range(self.steps):

            def step(x: np.ndarray, y: np.ndarray, w: np.ndarray = w, mu: float = mu) -> np.ndarray:
                z = made.of(x)
                value, slope, bend = insensitive(z @ w - (y - middle) / spread, eps, mu)
                return np.concatenate([[value.sum()], z.T @ slope, ((z * bend[:, None]).T @ z).ravel()])

            sums = _summed(rows, step, 1 + size + size * size, width) / n
            value, slope, gram = sums[0] + penalty @ (w * w) / 2, sums[1 : size + 1] + penalty * w, sums[size + 1 :].reshape(size, size)
            # where few rows lie in the bend the curvature says little: a floor keeps the step within reach
            move = np.linalg.solve(gram + np.diag(penalty) + 1e-6 * np.eye(size), -slope)
            if -(slope @ move) < self.tolerance * max(value, 1e-12) * 0.1:
                if mu <= 1e-3:
                    break
                mu = max(mu / 8, 1e-3)
                continue
            tries = 0.5 ** np.arange(14)

            def losses(x: np.ndarray, y: np.ndarray, w: np.ndarray = w, mu: float = mu, move: np.ndarray = move) -> np.ndarray:
                z, target = made.of(x), (y - middle) / spread
                base, by = z @ w - target, z @ move
                return np.array([insensitive(base + t * by, eps, mu)[0].sum() for t in tries])

            found = _summed(rows, losses, len(tries), width) / n + np.array([penalty @ ((w + t * move) ** 2) / 2 for t in tries])
            k = int(np.argmin(found))
            if found[k] >= value:
                if mu <= 1e-3:
                    break
                mu = max(mu / 8, 1e-3)
                continue
            w = w + tries[k] * move
        return w
