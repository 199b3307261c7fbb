"""Vendor prices as a data source: every instrument's missing range is a partition, so that all fetches are one plan.

    spark.dataSource.register(VendorSource)
    spark.read.format("vendor").option("client", "module:function").option("ranges", json).load()

The client is named, not shipped: a function of a module that the executors have, called as client(instrument, first, last),
which yields rows of COLUMNS (tuples, or mappings by name). A call that raises is repeated after a growing pause; the
last failure fails the read, or with onError "skip" leaves the range out."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.rollover import stitched
from . import store

COLUMNS = ("time", "symbol", "open", "high", "low", "close", "settle", "volume", "position")
SCHEMA = "instrument_id string, first date, time timestamp, symbol string, open double, high double, low double, close double, settle double, volume double, position double"


class Range(InputPartition):
    def __init__(self, parts: list[tuple[str, str, str]]):
        self.parts = parts


class VendorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        for name in ("client", "ranges"):
            if name not in options:
                raise ValueError(f"the vendor source needs the option {name}")
        self.client, self.ranges = options["client"], json.loads(options["ranges"])
        self.attempts, self.pause = int(options.get("attempts", "3")), float(options.get("pause", "1"))
        self.skip, self.each = options.get("onError", "fail") == "skip", int(options.get("rangesPerPartition", "1"))

    def partitions(self) -> list[Range]:
        return [Range(self.ranges[k : k + self.each]) for k in range(0, len(self.ranges), self.each)] or [Range([])]

    def _fetched(self, instrument: str, first: str, last: str) -> list[tuple]:
        module, _, name = self.client.partition(":")
        client = getattr(importlib.import_module(module), name)
        for k in range(self.attempts):
            try:
                rows = client(instrument, date.fromisoformat(first), date.fromisoformat(last))
                return [tuple(r[c] for c in COLUMNS) if isinstance(r, dict) else tuple(r) for r in rows]
            except Exception:
                if k + 1 == self.attempts:
                    if self.skip:
                        return []
                    raise
                time.sleep(self.pause * 2**k)
        return []

    def read(self, partition: Range) -> Iterator[tuple]:
        number = lambda v: None if v is None or v != v else float(v)
        for instrument, first, last in partition.parts:
            low, high = date.fromisoformat(first), date.fromisoformat(last)
            for row in self._fetched(instrument, first, last):
                at = row[0] if isinstance(row[0], datetime) else datetime(row[0].year, row[0].month, row[0].day)
                if low <= at.date() <= high:  # a vendor may send more than it is asked for
                    yield (instrument, low, at, row[1], *map(number, row[2:]))


class VendorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VendorReader:
        return VendorReader(self.options)


def read(spark: SparkSession, client: str, ranges: list[tuple[str, date, date]], **options: str) -> DataFrame:
    """Contract rows of SCHEMA of all ranges, in as many partitions."""
    spark.dataSource.register(VendorSource)
    asked = json.dumps([(i, a.isoformat(), z.isoformat()) for i, a, z in ranges])
    return spark.read.format("vendor").option("client", client).option("ranges", asked).options(**options).load()


def continued(raw: DataFrame, stored: DataFrame | None, anchor: str = "2020-01-01") -> DataFrame:
    """Continuous rows of fetched contract rows (SCHEMA), each range's factors going on from the last one that is stored
    before its first day (from 1 without one): one plan for all instruments and ranges."""
    own = F.concat_ws("\x1f", "instrument_id", F.col("first").cast("string"))
    series = stitched(raw.withColumn("instrument_id", own).drop("first"), anchor)
    parts = F.split("instrument_id", "\x1f")
    series = series.withColumns({"first": F.get(parts, 1).cast("date"), "instrument_id": F.get(parts, 0)})
    if stored is None:
        return series.drop("first")
    starts = raw.select("instrument_id", "first").distinct()
    # a row per instrument and range
    before = stored.select("instrument_id", "time", "weighted_factor").join(F.broadcast(starts), "instrument_id").where(F.col("time") < F.col("first").cast("timestamp"))
    before = before.groupBy("instrument_id", "first").agg(F.max_by("weighted_factor", "time").alias("_before"))
    carried = F.col("weighted_factor") * F.coalesce(F.when(F.col("time") >= F.lit(anchor).cast("timestamp"), F.when(F.col("_before") != 0, F.col("_before"))), F.lit(1.0))
    return series.join(F.broadcast(before), ["instrument_id", "first"], "left").withColumn("weighted_factor", carried).drop("first", "_before")


def update(spark: SparkSession, path: str, client: str, start: date, end: date, wanted: list[str], whole: bool = False, anchor: str = "2020-01-01", **options: str) -> list[tuple[str, date, date]]:
    """Bring the stored continuous prices of all wanted instruments up to a range of days: what is missing of each is
    fetched, stitched and upserted by month in one plan, with one write. whole fetches the whole range again.

    Returns the ranges, two an instrument at most; rows with nulls are left out."""
    stored = spark.read.parquet(path) if store.exists(spark, path) else None
    if whole or stored is None:
        ranges = [(i, start, end) for i in wanted]
    else:
        ranges = [(r["instrument_id"], r["first"], r["last"]) for r in store.missing_ranges(stored, start, end, wanted).orderBy("instrument_id", "first").collect()]
    if not ranges:
        return []
    raw = read(spark, client, ranges, **options).persist()  # the vendor is asked once
    rows = continued(raw, stored, anchor).dropna()
    if not rows.limit(1).isEmpty():
        store.upsert(rows, path, store.KEYS, {"month": F.date_format("time", "'m'yyyyMM")})
    raw.unpersist()
    return ranges
