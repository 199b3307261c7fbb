"""Streams of ticks to bars, and bars to a stored panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.store import upsert


def bars(ticks: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close, volume of (instrument_id, ts, price, size) per window; ticks later than the watermark
    are left out. Works on a stream as on a table."""
    w = F.window("ts", every)
    df = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if ticks.isStreaming else ticks
    return df.groupBy("instrument_id", w.alias("w")).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("ticks")).select("instrument_id", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume", "ticks")


def upserting(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that merges each batch into the panel at path by (time, instrument_id): replays change nothing.

    The panel is partitioned by day, and a batch rewrites the days that it has bars of."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert(batch, path, by={"day": F.date_format("time", "'d'yyyyMMdd")})

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
