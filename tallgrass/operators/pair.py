"""Trailing-window operators on two series. A window of N rows needs N complete pairs, but for TsRankCorr."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _pairs(build: Callable) -> Callable:
    def over(x: Column, y: Column, by: WindowSpec, n: int) -> Column:
        if n < 2:
            return F.lit(None).cast("double")
        frame = by.rowsBetween(-(n - 1), 0)
        known = x.isNotNull() & y.isNotNull()
        a, b = F.when(known, x), F.when(known, y)
        return F.when(F.count(a).over(frame) == n, build(a, b, frame))

    return over


def _moves(x: Column, frame: WindowSpec) -> Column:
    return F.min(x).over(frame) != F.max(x).over(frame)


def _corr(x: Column, y: Column, frame: WindowSpec) -> Column:
    spread = F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame)
    return F.when(_moves(x, frame) & _moves(y, frame), F.try_divide(F.covar_samp(x, y).over(frame), spread))


def _beta(x: Column, y: Column, frame: WindowSpec) -> Column:
    return F.when(_moves(y, frame), F.try_divide(F.covar_samp(x, y).over(frame), F.var_samp(y).over(frame)))


def _residual(y: Column, x: Column, frame: WindowSpec) -> Column:
    beta = _beta(y, x, frame)
    return y - (F.avg(y).over(frame) - beta * F.avg(x).over(frame)) - beta * x


def rank_corr(x: Column, y: Column, by: WindowSpec, n: int) -> Column:
    """Spearman's correlation of the complete pairs in the last n rows; null below two or where a side is constant."""
    frame = by.rowsBetween(-(n - 1), 0)
    pairs = F.collect_list(F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))).over(frame)

    def ranks(side: str) -> Column:
        values = F.transform(pairs, lambda p: p[side])
        return F.transform(values, lambda v: F.aggregate(values, F.lit(0.5), lambda s, u: s + F.when(u < v, 1.0).when(u == v, 0.5).otherwise(0.0)))

    m = F.size(pairs)
    both = F.zip_with(ranks("x"), ranks("y"), lambda a, b: F.struct((a - (m + 1) / 2).alias("a"), (b - (m + 1) / 2).alias("b")))
    total = lambda f: F.aggregate(both, F.lit(0.0), lambda s, p: s + f(p))
    full = (F.row_number().over(by) >= n) & (m >= 2)
    return F.when(full, F.try_divide(total(lambda p: p["a"] * p["b"]), F.sqrt(total(lambda p: p["a"] * p["a"]) * total(lambda p: p["b"] * p["b"]))))


PAIR = {
    "TsCorr": _pairs(_corr),
    "TsCov": _pairs(lambda x, y, f: F.covar_samp(x, y).over(f)),
    "TsBeta": _pairs(_beta),
    "TsResidual": _pairs(_residual),
    "TsRankCorr": rank_corr,
}
