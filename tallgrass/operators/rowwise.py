"""Row-wise operators as column expressions. Null is the only missing value; a zero denominator gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def _both(x: Column, y: Column, value: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), value)


def nan_mean(*xs: Column) -> Column:
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
    return F.try_divide(total, sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int")))


def ribbon(*means: Column) -> Column:
    """Spread of the means that are there, over the size of their mean."""
    return F.try_divide(F.greatest(*means) - F.least(*means), F.abs(nan_mean(*means)))


def _candle(value: Column) -> Column:
    return value / (F.col("high") - F.col("low") + EPS)


def _known(*names: str) -> Column:
    out = F.col(names[0]).isNotNull()
    for n in names[1:]:
        out = out & F.col(n).isNotNull()
    return out


ROWWISE = {
    "Add": lambda x, y: x + y,
    "Sub": lambda x, y: x - y,
    "Mul": lambda x, y: x * y,
    "Div": F.try_divide,
    "Change": lambda x, y: F.try_divide(x, y) - 1,
    "Max": lambda x, y: _both(x, y, F.greatest(x, y)),
    "Min": lambda x, y: _both(x, y, F.least(x, y)),
    "Neg": lambda x: -x,
    "SqrtAbs": lambda x: F.sqrt(F.abs(x)),
    "Abs": F.abs,
    "Inv": lambda x: F.try_divide(F.lit(1.0), x),
    "Ln": lambda x: F.when(x > 0, F.log(x)),
    "Sig": lambda x: F.when(x.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))))),
    "Sign": F.signum,
    # the names are the wrong way round in the language; stored formulas depend on it
    "Lt": lambda x, y: F.coalesce((x > y).cast("double"), F.lit(0.0)),
    "Gt": lambda x, y: F.coalesce((x < y).cast("double"), F.lit(0.0)),
    "IfElse": lambda c, x, y: F.when(c > 0, x).otherwise(y),
    "NanMean": nan_mean,
    "Ribbon": ribbon,
    "BodyRatio": lambda _: _candle(F.col("close") - F.col("open")),
    "UpperShadowRatio": lambda _: F.when(_known("open", "close"), _candle(F.col("high") - F.greatest("open", "close"))),
    "LowerShadowRatio": lambda _: F.when(_known("open", "close"), _candle(F.least("open", "close") - F.col("low"))),
    "StochasticK": lambda _: _candle(F.col("close") - F.col("low")),
    "TypicalPrice": lambda _: (F.col("high") + F.col("low") + F.col("close")) / 3,
}
