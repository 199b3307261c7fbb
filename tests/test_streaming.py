from pyspark.sql import functions as F

from tallgrass.streaming.bars import bars, upserting


def test_stream_of_ticks_becomes_stored_bars(spark, sf, tmp_path):
    source = str(tmp_path / "ticks")
    ticks = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("instrument_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"))
    ticks.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(ticks.schema).parquet(source)
    out = str(tmp_path / "bars")
    for _ in range(2):  # a second run finds nothing new and changes nothing
        upserting(bars(stream), out, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    stored, whole = spark.read.parquet(out), bars(ticks)
    assert stored.groupBy("instrument_id", "time").count().where("count > 1").isEmpty()
    assert 0 < stored.count() <= whole.count() and stored.select("instrument_id", "time", "open", "close", "volume").exceptAll(whole.select("instrument_id", "time", "open", "close", "volume")).isEmpty()
