"""Continuous series from listed contracts: yesterday's most traded one, with factors at each change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dominant(panel: DataFrame, by: str = "volume") -> DataFrame:
    """(instrument_id, time, symbol) with the largest volume or position; ties go to the first symbol."""
    known = panel.where(F.col(by).isNotNull())
    return known.groupBy("instrument_id", "time").agg(F.min_by("symbol", F.struct(-F.col(by), F.col("symbol"))).alias("symbol"))


def mismatches(panel: DataFrame) -> DataFrame:
    """Days on which volume and position name different contracts."""
    a, b = dominant(panel).withColumnRenamed("symbol", "by_volume"), dominant(panel, "position").withColumnRenamed("symbol", "by_position")
    return a.join(b, ["instrument_id", "time"]).where("by_volume <> by_position")


def stitched(panel: DataFrame, anchor: str = "2020-01-01", initial: float = 1.0) -> DataFrame:
    """One row per instrument and day, raw prices, with weighted_factor, cur_weighted_factor and is_rollover.

    The contract of a day is the dominant one of the day before (of the first day, its own); one without a row
    that day gives way to the day's dominant one. From the anchor on, a change multiplies the factor by old
    open over new open, or by 1 where there is none."""
    by = Window.partitionBy("instrument_id").orderBy("time")
    days = panel.select("instrument_id", "time").distinct().join(dominant(panel), ["instrument_id", "time"], "left")
    days = days.withColumn("_before", F.lag("symbol").over(by)).withColumn("_used", F.when(F.row_number().over(by) == 1, F.col("symbol")).otherwise(F.col("_before")))
    days = days.withColumn("_used", F.coalesce(F.last("_used", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), "symbol"))
    rows = panel.select("instrument_id", "time", F.col("symbol").alias("_symbol"), F.struct("open", "high", "low", "close", "settle", "volume", "position").alias("_row"))
    own = days.join(rows, (days["instrument_id"] == rows["instrument_id"]) & (days["time"] == rows["time"]) & (days["_used"] == rows["_symbol"]), "left").select(days["*"], rows["_row"].alias("_own"))
    both = own.alias("d").join(rows.alias("r"), F.expr("d.instrument_id = r.instrument_id and d.time = r.time and d.symbol = r._symbol and d._own is null"), "left").select("d.*", F.col("r._row").alias("_other"))
    df = both.select("instrument_id", "time", F.when(F.col("_own").isNotNull(), F.col("_used")).otherwise(F.col("symbol")).alias("symbol"), F.coalesce("_own", "_other").alias("_row")).where("_row is not null and symbol is not null")
    df = df.withColumn("_old", F.lag("symbol").over(by)).withColumn("_started", F.col("time") >= F.lit(anchor).cast("timestamp"))
    df = df.withColumn("is_rollover", F.coalesce(F.col("_started") & (F.col("symbol") != F.col("_old")), F.lit(False)))
    old = rows.select("instrument_id", "time", "_symbol", F.col("_row.open").alias("_old_open"))
    df = df.alias("d").join(old.alias("o"), F.expr("d.is_rollover and d.instrument_id = o.instrument_id and d.time = o.time and d._old = o._symbol"), "left").select("d.*", "o._old_open")
    ratio = F.when(F.abs(F.col("_row.open")) > 1e-12, F.col("_old_open") / F.col("_row.open"))
    df = df.withColumn("_ratio", F.when(F.col("is_rollover"), F.coalesce(ratio, F.lit(1.0))))
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    factor = F.product(F.coalesce("_ratio", F.lit(1.0))).over(run) * initial
    return df.select(
        "instrument_id", "time", "symbol", "_row.*",
        F.when(F.col("_started"), factor).otherwise(1.0).alias("weighted_factor"),
        F.coalesce(F.last("_ratio", ignorenulls=True).over(run), F.lit(1.0)).alias("cur_weighted_factor"), "is_rollover",
    )


def previous_factor(series: DataFrame, before: str) -> DataFrame:
    """(instrument_id, weighted_factor) of the last row before a day, to go on from."""
    return series.where(F.col("time") < F.lit(before).cast("timestamp")).groupBy("instrument_id").agg(F.max_by("weighted_factor", "time").alias("weighted_factor"))
