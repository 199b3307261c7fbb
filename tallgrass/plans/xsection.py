"""Cross-sections: what instruments do relative to each other at each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import average_rank, safe_corr


def z_score(df: DataFrame, column: str) -> DataFrame:
    by = Window.partitionBy("time")
    return df.withColumn(f"{column}_z", F.try_divide(F.col(column) - F.avg(column).over(by), F.stddev_samp(column).over(by)))


def information(df: DataFrame, factor: str, ret: str = "future_ret", by: tuple[str, ...] = ("time",)) -> DataFrame:
    """(time, ic, rank_ic) over the instruments of each time (or of each of other keys)."""
    known = df.where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    ranked = known.withColumns({"_a": average_rank(F.col(factor), [*by]), "_b": average_rank(F.col(ret), [*by])})
    return ranked.groupBy(*by).agg(safe_corr(F.col(factor), F.col(ret)).alias("ic"), safe_corr(F.col("_a"), F.col("_b")).alias("rank_ic"))


def yearly_information(ic: DataFrame) -> DataFrame:
    mean, sd = F.avg("ic"), F.stddev_samp("ic")
    return ic.groupBy(F.year("time").alias("year")).agg(mean.alias("ic"), F.when(sd > 1e-12, mean / sd).alias("icir"), F.avg("rank_ic").alias("rank_ic"))


def quantile_portfolios(df: DataFrame, factor: str, ret: str = "future_ret", parts: int = 5) -> DataFrame:
    """(time, bucket, ret, n): mean return of the instruments strictly between two of the time's quantiles."""
    edges = F.percentile(factor, F.array(*(F.lit(k / parts) for k in range(1, parts)))).over(Window.partitionBy("time"))
    df = df.withColumn("_e", edges)
    bucket = F.when(F.col(factor) < F.get("_e", F.lit(0)), 1)
    for k in range(1, parts - 1):
        bucket = bucket.when((F.col(factor) > F.get("_e", F.lit(k - 1))) & (F.col(factor) < F.get("_e", F.lit(k))), k + 1)
    bucket = bucket.when(F.col(factor) > F.get("_e", F.lit(parts - 2)), parts)
    return df.withColumn("bucket", bucket).where("bucket is not null").groupBy("time", "bucket").agg(F.avg(ret).alias("ret"), F.count(F.lit(1)).alias("n"))


def long_leg(df: DataFrame, factor: str, share: float = 0.2) -> DataFrame:
    """The largest share of each time's instruments, rounded down; ties by instrument."""
    by = Window.partitionBy("time")
    df = df.withColumn("_n", F.floor(F.count(factor).over(by) * share)).withColumn("_r", F.row_number().over(by.orderBy(F.desc_nulls_last(factor), "instrument_id")))
    return df.where("_r <= _n").drop("_n", "_r")


def portfolio_turnover(leg: DataFrame) -> DataFrame:
    """(time, turnover) of an equal-weight portfolio: half the absolute change of all weights."""
    weights = leg.select("time", "instrument_id", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("time"))).alias("w"))
    times = weights.select("time").distinct().withColumn("next", F.lead("time").over(Window.orderBy("time")))  # one row per time
    now = weights.join(times, "time").where("next is not null").select(F.col("next").alias("time"), "instrument_id", (-F.col("w")).alias("w"))
    return weights.unionByName(now).groupBy("time", "instrument_id").agg(F.sum("w").alias("d")).groupBy("time").agg((F.sum(F.abs("d")) / 2).alias("turnover"))
