"""Reads and writes of stored tables: appends with checks, keyed upserts, updates, deletions, calendars."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("time", "instrument_id")


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str, where: Column | None = None) -> bool:
    """Whether a stored table is there and, with where, whether it has such a row."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return False
    return True if where is None else not spark.read.parquet(path).where(where).limit(1).isEmpty()


def list_tables(spark: SparkSession, root: str) -> DataFrame:
    """name, bytes and files of the tables below root, largest first."""
    fs, p = _fs(spark, root)
    rows = []
    for s in fs.listStatus(p) if fs.exists(p) else []:
        c = fs.getContentSummary(s.getPath())
        rows.append((s.getPath().getName(), c.getLength(), c.getFileCount()))
    return spark.createDataFrame(rows, "name string, bytes long, files long").orderBy(F.desc("bytes"), "name")


def replace(df: DataFrame, path: str) -> None:
    """Write df where its own input may be: to a new folder first, then in the old one's place, which goes last.

    A crash in between leaves the old table beside its place, as path.<id>.old, and the new one as path.<id>.new."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    new, old = _fs(spark, aside + ".new")[1], _fs(spark, aside + ".old")[1]
    df.write.parquet(aside + ".new")
    there = fs.exists(p)
    if there and not fs.rename(p, old):
        raise OSError(f"{path} could not be put aside")
    if not fs.rename(new, p):
        if there:
            fs.rename(old, p)
        raise OSError(f"{aside}.new could not take the place of {path}")
    if there:
        fs.delete(old, True)


def details(spark: SparkSession, root: str) -> DataFrame:
    """list_tables with the number of rows and columns of each; counts come from the files' own statistics."""
    found = list_tables(spark, root).collect()  # a row per table
    out = []
    for r in found:
        df = spark.read.parquet(f"{root.rstrip('/')}/{r['name']}")
        out.append((r["name"], r["bytes"], r["files"], df.count(), len(df.columns)))
    return spark.createDataFrame(out, "name string, bytes long, files long, rows long, columns int").orderBy(F.desc("bytes"), "name")


def insert(df: DataFrame, path: str) -> None:
    """Append; rows with nulls and rows that occur twice raise."""
    holes = [r for r in df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns)).first().asDict().items() if r[1]]
    if holes:
        raise ValueError(f"nulls in {', '.join(c for c, _ in holes)}")
    if not df.groupBy(*df.columns).count().where("count > 1").limit(1).isEmpty():
        raise ValueError("rows occur twice")
    df.write.mode("append").parquet(path)


def merged(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """old with new's rows set on its keys: fields that new has replace old's, others stay; new keys are added."""
    twice = new.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {twice[0].asDict()}")
    values = [c for c in new.columns if c not in keys]
    both = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), list(keys), "full_outer")
    out = [*keys]
    for c in [*old.columns, *(c for c in values if c not in old.columns)]:
        if c in keys:
            continue
        mine = F.col(f"o.`{c}`") if c in old.columns else F.lit(None)
        out.append((F.when(F.col("n._new"), F.col(f"n.`{c}`")).otherwise(mine) if c in values else mine).alias(c))
    return both.select(*out)


def upsert(new: DataFrame, path: str, keys: tuple[str, ...] = KEYS, by: dict[str, Column] | None = None) -> None:
    """Idempotent keyed upsert; nulls in the keys or values raise.

    by names the columns that the table is partitioned by, each a text made of the keys that does not look like a number
    or a date: then only the partitions that new has rows of are read and written anew. Without it the whole table is."""
    spark = new.sparkSession
    if not new.where(" or ".join(f"`{c}` is null" for c in new.columns)).limit(1).isEmpty():
        raise ValueError("nulls in what is to be stored")
    if by is None:
        if exists(spark, path):
            replace(merged(spark.read.parquet(path), new, keys), path)
        else:
            merged(new.limit(0), new, keys).write.parquet(path)
        return
    new = new.withColumns(by)
    if exists(spark, path):
        old = spark.read.parquet(path)
        touched = new.select(*by).distinct().collect()  # a row per touched partition
        hit = F.lit(False)
        for r in touched:
            same = F.lit(True)
            for c in by:
                same = same & (F.col(c) == F.lit(r[c]))
            hit = hit | same
        rows = merged(old.where(hit), new, (*keys, *by))
    else:
        rows = merged(new.limit(0), new, (*keys, *by))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


METHODS = ("insert_many", "update_one", "bulk_write_update")


def update(df: DataFrame, path: str, method: str = "insert_many", keys: tuple[str, ...] = KEYS, by: dict[str, Column] | None = None) -> None:
    """The sink by its method: append with checks, set the fields of one row, or of many, by their keys."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; there are {', '.join(METHODS)}")
    if method == "insert_many":
        insert(df, path)
        return
    if method == "update_one" and df.limit(2).count() != 1:
        raise ValueError("update_one takes one row")
    upsert(df, path, keys, by)


def deduplicate(spark: SparkSession, path: str, keys: tuple[str, ...], order: list) -> str:
    """One row per key of a stored table, the first in the given order, in place; returns where the old table is kept."""
    fs, p = _fs(spark, path)
    backup = f"{path.rstrip('/')}.{uuid.uuid4().hex}.backup"
    if not fs.rename(p, _fs(spark, backup)[1]):
        raise OSError(f"{path} could not be put aside")
    keep_first(spark.read.parquet(backup), keys, order).write.parquet(path)
    return backup


def export(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Factor values, predictions or reports as files of Parquet, CSV (with names) or JSON lines."""
    if form not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown form {form}")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)


def update_prices(spark: SparkSession, path: str, fetch: Callable[[str, date, date], DataFrame], stitch: Callable[[DataFrame, dict[str, float]], DataFrame], start: date, end: date, wanted: list[str], whole: bool = False) -> list[tuple[str, date, date]]:
    """Bring stored continuous prices up to a range of days: what is missing is fetched (as contract rows), stitched to
    go on from each series' last factor, and upserted by month. whole fetches the whole range again. Returns what was fetched.

    fetch is asked once per instrument and range, of which there are two an instrument at most."""
    def stored() -> DataFrame:
        return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], "instrument_id string, time timestamp, weighted_factor double")

    if whole:
        ranges = [(i, start, end) for i in wanted]
    else:
        ranges = [(r["instrument_id"], r["first"], r["last"]) for r in missing_ranges(stored(), start, end, wanted).orderBy("instrument_id", "first").collect()]
    for instrument, first, last in ranges:
        before = stored().where((F.col("instrument_id") == instrument) & (F.col("time") < F.lit(first).cast("timestamp"))).agg(F.max_by("weighted_factor", "time").alias("f")).first()["f"]
        rows = stitch(fetch(instrument, first, last), {instrument: before if before else 1.0})
        upsert(rows.dropna(), path, KEYS, {"month": F.date_format("time", "'m'yyyyMM")})
    return ranges


def update_many(df: DataFrame, where: Column, values: dict[str, Column]) -> tuple[DataFrame, Column, Column]:
    """df with values set where the predicate holds; aggregates for the matched and modified counts."""
    hit = F.coalesce(where, F.lit(False))
    changed = F.lit(False)
    for c, v in values.items():
        changed = changed | ~F.col(c).eqNullSafe(v)
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}), F.count_if(hit), F.count_if(hit & changed)


def delete(df: DataFrame, where: Column | None = None) -> DataFrame:
    """df without the rows of the predicate (without one, none are left)."""
    return df.where(~F.coalesce(where, F.lit(False))) if where is not None else df.limit(0)


def keep_first(df: DataFrame, keys: tuple[str, ...], order: list) -> DataFrame:
    """One row per key, the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def normalised(raw: DataFrame, symbol: str) -> DataFrame:
    """Vendor rows as symbol prices: renamed, numeric, settle by default the close, volume and position by default 0."""
    df = raw.withColumnsRenamed({"date": "time", "hold": "position"})
    number = lambda c: F.when(~F.isnan(F.col(c).try_cast("double")), F.col(c).try_cast("double"))
    if "settle" not in df.columns:
        df = df.withColumn("settle", F.col("close"))
    df = df.withColumns({c: number(c) for c in ("open", "high", "low", "close", "settle", "volume", "position")})
    df = df.withColumn("settle", F.coalesce("settle", "close")).fillna(0.0, ["volume", "position"]).dropna(subset=["open", "high", "low", "close"])
    return df.select(F.to_timestamp("time").alias("time"), F.lit(symbol).alias("symbol"), F.lit(root_of(symbol)).alias("instrument_id"), "open", "high", "low", "close", "settle", "volume", "position")


def root_of(symbol: str) -> str:
    """Root of a contract or continuous symbol: its leading letters."""
    return re.match("[A-Z]*", symbol.strip().upper()).group()


def root_column(symbol: Column) -> Column:
    return F.regexp_extract(F.upper(F.trim(symbol)), "^([A-Z]*)", 1)


def symbols(spark: SparkSession, roots: dict[str, list[int]], start: int, end: int) -> DataFrame:
    """ROOT + YY + MM of the listing months from the year before start to the year after end."""
    listed = spark.createDataFrame([(r, m) for r, ms in roots.items() for m in ms], "instrument_id string, month int")
    return listed.withColumn("year", F.explode(F.sequence(F.lit(start - 1), F.lit(end + 1)))).select(F.format_string("%s%02d%02d", "instrument_id", F.col("year") % 100, "month").alias("symbol"), "instrument_id").distinct().orderBy("symbol")


def calendar(spark: SparkSession, start: date, end: date, holidays: DataFrame | None = None) -> DataFrame:
    """Trading days: weekdays that are no holidays (holidays has a column day)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day")).where(F.dayofweek("day").between(2, 6))
    return days.join(holidays.select(F.to_date("day").alias("day")), "day", "left_anti") if holidays is not None else days


def missing_ranges(stored: DataFrame, start: date, end: date, wanted: list[str]) -> DataFrame:
    """(instrument_id, first, last) still to be fetched: the whole range, or what lies before and after what is stored."""
    spark = stored.sparkSession
    asked = spark.createDataFrame([(i,) for i in wanted], "instrument_id string")
    have = stored.groupBy("instrument_id").agg(F.to_date(F.min("time")).alias("low"), F.to_date(F.max("time")).alias("high"))
    df = asked.join(have, "instrument_id", "left")
    part = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    parts = F.when(F.col("low").isNull(), F.array(part(F.lit(start), F.lit(end)))).otherwise(F.array(part(F.lit(start), F.date_sub("low", 1)), part(F.date_add("high", 1), F.lit(end))))
    return df.select("instrument_id", F.inline(parts)).where("first <= last")


def risk_free(rates: DataFrame, start: int, end: int) -> DataFrame:
    """Annual rates of the years, as decimals, by date."""
    return rates.where(F.year("date").between(start, end)).select("instrument_id", (F.col("rate") / 100).alias("rate"), "date").dropna().orderBy("date")


def compared(a: DataFrame, b: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = KEYS, atol: float = 1e-6) -> DataFrame:
    """Rows of both in which a column differs by more than atol; missing equals missing."""
    off = F.lit(False)
    for c in columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        off = off | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > atol, F.lit(False))
    return a.alias("a").join(b.alias("b"), list(keys)).where(off).select(*keys, *(F.col(f"{t}.{c}").alias(f"{c}_{t}") for c in columns for t in "ab"))
