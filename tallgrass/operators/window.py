"""Trailing-window operators. A window of N rows needs N values, or its result is null."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

BINS = 10


def _full(x: Column, n: int, frame: WindowSpec, value: Column) -> Column:
    return F.when(F.count(x).over(frame) == n, value)


def _last(n: int, by: WindowSpec) -> WindowSpec:
    return by.rowsBetween(-(n - 1), 0)


def simple(aggregate):
    return lambda x, by, n: _full(x, n, _last(n, by), aggregate(x).over(_last(n, by)))


def _extreme(sign: int):
    """Rows since the latest occurrence of the largest (1) or smallest (-1) value."""

    def build(x: Column, by: WindowSpec, n: int) -> Column:
        row = F.row_number().over(by)
        best = F.max(F.struct((sign * x).alias("v"), F.col("_row").alias("r"))).over(_last(n, by))
        return _full(x, n, _last(n, by), (row - best["r"]).cast("double"))

    return build


def weighted_mean(x: Column, by: WindowSpec, n: int) -> Column:
    """Weights 1..n, the newest the heaviest."""
    total = sum((F.lag(x, k).over(by) * float(n - k) for k in range(1, n)), x * float(n))
    return total / (n * (n + 1) / 2)


def rank(x: Column, by: WindowSpec, n: int) -> Column:
    """Average rank of the last value in its window, over n."""
    values = F.collect_list(x).over(_last(n, by))
    below = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.when(v < x, 1.0).when(v == x, 0.5).otherwise(0.0))
    return _full(x, n, _last(n, by), (below + 0.5) / n)


def skew(x: Column, by: WindowSpec, n: int) -> Column:
    if n < 3:
        return F.lit(None).cast("double")
    frame = _last(n, by)
    value = F.skewness(x).over(frame) * ((n * (n - 1)) ** 0.5 / (n - 2))
    return _full(x, n, frame, F.when(F.min(x).over(frame) == F.max(x).over(frame), 0.0).otherwise(value))


def kurtosis(x: Column, by: WindowSpec, n: int) -> Column:
    if n < 4:
        return F.lit(None).cast("double")
    frame = _last(n, by)
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(frame) + 6)
    return _full(x, n, frame, F.when(F.min(x).over(frame) == F.max(x).over(frame), -3.0).otherwise(value))


def std(x: Column, by: WindowSpec, n: int) -> Column:
    return F.lit(None).cast("double") if n < 2 else _full(x, n, _last(n, by), F.stddev_samp(x).over(_last(n, by)))


def entropy(x: Column, by: WindowSpec, n: int) -> Column:
    """-sum d ln(d + 1e-10) over the filled ones of ten equal bins, d being their densities."""
    if n < 3:
        return F.lit(None).cast("double")
    frame = _last(n, by)
    values, low, high = F.collect_list(x).over(frame), F.min(x).over(frame), F.max(x).over(frame)
    flat = low == high
    low, high = F.when(flat, low - 0.5).otherwise(low), F.when(flat, high + 0.5).otherwise(high)
    width = (high - low) / BINS
    bins = F.transform(values, lambda v: F.least(F.floor((v - low) / width), F.lit(BINS - 1)))
    density = F.transform(F.array_distinct(bins), lambda b: F.size(F.filter(bins, lambda c: c == b)) / (n * width))
    return _full(x, n, frame, -F.aggregate(density, F.lit(0.0), lambda s, d: s + d * F.log(d + 1e-10)))


def roll_norm(x: Column, by: WindowSpec, window: int, least: int, eps: float, clip: float) -> Column:
    """z-score against the rows before the current one, clipped."""
    frame = by.rowsBetween(-window, -1)
    z = (x - F.avg(x).over(frame)) / (F.stddev_samp(x).over(frame) + eps)
    return F.when((F.count(x).over(frame) >= least) & z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


WINDOW = {
    "Lag": lambda x, by, n: F.lag(x, n).over(by),
    "Pad": lambda x, by: F.last(x, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)),
    "TsMean": simple(F.avg),
    "TsSum": simple(F.sum),
    "TsMax": simple(F.max),
    "TsMin": simple(F.min),
    "TsStd": std,
    "TsArgmax": _extreme(1),
    "TsArgmin": _extreme(-1),
    "TsTimeWeightedMean": weighted_mean,
    "TsRank": rank,
    "TsSkew": skew,
    "TsKurt": kurtosis,
    "TsEntropy": entropy,
    "RollNorm": roll_norm,
}
