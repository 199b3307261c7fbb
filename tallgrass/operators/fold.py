"""Kernels: operators that walk along each series with a state, for what no window frame expresses or does fast.

A kernel gives its state at a series' start, and from a state and a run of values the results and the next state. The same
kernel serves tables, where sorted rows come in Arrow batches and the state is carried from batch to batch, and streams
(streaming.state), where it is kept from micro-batch to micro-batch; a long series never is in memory as a whole."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from itertools import pairwise
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 10


class Kernel:
    """step takes operands as arrays of doubles in which NaN is missing, and returns as many results."""

    def start(self) -> Any:
        return None

    def step(self, state: Any, *xs: np.ndarray) -> tuple[np.ndarray, Any]:
        raise NotImplementedError


@dataclass
class ExponentialMean(Kernel):
    """Weights of 2 / (span + 1) for the newest value; missing values age the mean and repeat it."""

    span: int

    def start(self) -> tuple[float, int]:
        return np.nan, 0  # the last mean, and the missing values since

    def step(self, state: tuple[float, int], x: np.ndarray) -> tuple[np.ndarray, tuple[float, int]]:
        value, gap = state
        before = np.concatenate([[value], np.full(gap, np.nan)]) if value == value else np.zeros(0)
        y = pd.Series(np.concatenate([before, x])).ewm(span=self.span, adjust=False).mean().to_numpy()[len(before) :]
        seen = np.flatnonzero(x == x)
        return y, (y[-1], int(len(x) - 1 - seen[-1]) if len(seen) else gap + len(x))


@dataclass
class RunningProduct(Kernel):
    """The product of all values so far; a missing one counts as 1."""

    def start(self) -> float:
        return 1.0

    def step(self, state: float, x: np.ndarray) -> tuple[np.ndarray, float]:
        y = np.cumprod(np.concatenate([[state], np.where(np.isnan(x), 1.0, x)]))[1:]
        return y, float(y[-1])


class Sorted(Kernel):
    """The last n values in order of time and, those that are known, of size: a value comes and goes by a search by halves."""

    n: int

    def start(self) -> tuple[deque, list]:
        return deque(), []

    def step(self, state: tuple[deque, list], x: np.ndarray) -> tuple[np.ndarray, tuple[deque, list]]:
        rows, held = state
        out = np.full(len(x), np.nan)
        for k, v in enumerate(x.tolist()):
            rows.append(v)
            if v == v:
                insort(held, v)
            if len(rows) > self.n:
                old = rows.popleft()
                if old == old:
                    del held[bisect_left(held, old)]
            if len(held) == self.n:
                out[k] = self.value(held, v)
        return out, (rows, held)

    def value(self, held: list, newest: float) -> float:
        raise NotImplementedError


@dataclass
class SlidingRank(Sorted):
    """TsRank: the newest value's average rank among the last n, over n."""

    n: int

    def value(self, held: list, newest: float) -> float:
        return ((bisect_left(held, newest) + bisect_right(held, newest)) / 2 + 0.5) / self.n


@dataclass
class SlidingEntropy(Sorted):
    """TsEntropy: of densities in ten equal bins; the bins' borders are searched among the values in order."""

    n: int

    def value(self, held: list, newest: float) -> float:
        low, high = held[0], held[-1]
        if low == high:
            low, high = low - 0.5, high + 0.5
        width = (high - low) / BINS
        ends = [bisect_left(held, b, key=lambda v: np.floor((v - low) / width)) for b in range(1, BINS)] + [self.n]
        density = [m / (self.n * width) for m in np.diff([0, *ends]).tolist() if m]
        return float(-sum(d * np.log(d + 1e-10) for d in density))


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, places, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[places]


@dataclass
class SlidingRankCorr(Kernel):
    """TsRankCorr: of the complete pairs in the last n rows; the pairs are ranked by a sort, not by comparing all with all."""

    n: int

    def start(self) -> deque:
        return deque()

    def step(self, rows: deque, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, deque]:
        out = np.full(len(x), np.nan)
        for k, pair in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            rows.append(pair)
            if len(rows) > self.n:
                rows.popleft()
            if len(rows) < self.n:
                continue
            pairs = np.array(rows)
            pairs = pairs[~np.isnan(pairs).any(axis=1)]
            if len(pairs) < 2:
                continue
            a, b = (average_ranks(pairs[:, side]) - (len(pairs) + 1) / 2 for side in (0, 1))
            size = (a @ a) * (b @ b)
            out[k] = a @ b / np.sqrt(size) if size > 0 else np.nan
        return out, rows


#: Window operators that are kernels from so many rows on: below that, one array expression is faster.
SLIDING: dict[str, Callable[[int], Kernel]] = {"TsRank": SlidingRank, "TsEntropy": SlidingEntropy, "TsRankCorr": SlidingRankCorr}
SLIDING_FROM = 64


def _fold(kernels: Mapping[str, tuple[Kernel, tuple[str, ...]]], by: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, states = object(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(by)
            edges = [0, *(k + 1 for k, same in enumerate(pc.equal(names[1:], names[:-1]).fill_null(False).to_pylist()) if not same), batch.num_rows]
            made = {out: np.empty(batch.num_rows) for out in kernels}
            for a, z in pairwise(edges):
                own = names[a].as_py()
                if own != now:
                    now, states = own, {out: kernel.start() for out, (kernel, _) in kernels.items()}
                for out, (kernel, operands) in kernels.items():
                    xs = (batch.column(c)[a:z].to_numpy(zero_copy_only=False).astype(float) for c in operands)
                    made[out][a:z], states[out] = kernel.step(states[out], *xs)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, from_pandas=True) for v in made.values())], names=[*batch.schema.names, *made])

    return run


def folded(df: DataFrame, kernels: Mapping[str, tuple[Kernel, tuple[Column, ...]]], by: str = "instrument_id", time: str = "time") -> DataFrame:
    """df with a column for each kernel (name -> kernel, operands) over each series in order of time."""
    df = df.withColumns({f"{name}_in{k}": c.cast("double") for name, (_, operands) in kernels.items() for k, c in enumerate(operands)})
    made = {name: (kernel, tuple(f"{name}_in{k}" for k in range(len(operands)))) for name, (kernel, operands) in kernels.items()}
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{m}` double" for m in made)])
    out = df.repartition(by).sortWithinPartitions(by, time).mapInArrow(_fold(made, by), schema)
    return out.drop(*(c for _, operands in made.values() for c in operands))
