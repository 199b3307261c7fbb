"""Reports on stored panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overview(panel: DataFrame, fields: list[str], days: DataFrame | None = None) -> DataFrame:
    """Per instrument: first and last time, rows, rows with missing fields and, given trading days (day), days without a row."""
    hole = F.lit(False)
    for f in fields:
        hole = hole | F.col(f).isNull()
    df = panel.groupBy("instrument_id").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count(F.lit(1)).alias("rows"), F.count_if(hole).alias("incomplete"))
    if days is None:
        return df
    wanted = df.select("instrument_id", "first", "last").join(F.broadcast(days.select(F.to_date("day").alias("day"))), F.expr("day between to_date(first) and to_date(last)"))  # a row per trading day
    missing = wanted.join(panel.select("instrument_id", F.to_date("time").alias("day")).distinct(), ["instrument_id", "day"], "left_anti").groupBy("instrument_id").agg(F.count(F.lit(1)).alias("missing_days"))
    return df.join(missing, "instrument_id", "left").fillna(0, ["missing_days"])


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row: how many, and which columns differ within."""
    others = [c for c in df.columns if c not in keys]
    text = lambda c: F.col(f"`{c}`").cast("string")
    two = lambda c: (F.min(text(c)) < F.max(text(c))) | (F.count(text(c)) > 0) & (F.count(text(c)) < F.count(F.lit(1)))  # noqa: E731  two values, or one and a null
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *(two(c).alias(f"_n_{c}") for c in others)).where("rows > 1")
    return out.select(*keys, "rows", F.array_join(F.array_compact(F.array(*(F.when(F.col(f"`_n_{c}`"), F.lit(c)) for c in others))), ",").alias("differing"))


def top(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(n)


def named_by_rank(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The n best rows with names fac_gp_0001 and on; a report of n rows."""
    best = top(df, by, n, *ties)
    return best.withColumn("factor_name", F.format_string("fac_gp_%04d", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), *ties))))


def difference_summary(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation, mean and 95th percentile of the absolute difference, share beyond a millionth."""
    d = F.abs(F.col(x) - F.col(y))
    corr = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    return df.agg(F.count(F.lit(1)).alias("rows"), corr.alias("corr"), F.avg(d).alias("mean_abs"), F.percentile(d, F.lit(0.95)).alias("p95_abs"), F.avg((d > 1e-6).cast("int")).alias("share_off"))
