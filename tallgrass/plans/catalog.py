"""The factor registry, a Parquet table with one row per version, factor, instrument and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.compiler import evaluate
from ..sources.store import delete, exists, merged, replace

KEYS = ("version", "factor_name", "instrument_id", "start_date", "end_date")
SCHEMA = "method string, version string, factor_name string, instrument_id string, start_date string, end_date string, fitness map<string, struct<original: double, penalized: double, value: double>>, formula string, created_at timestamp, collection string, fusion_info map<string, array<string>>"


def read(spark: SparkSession, path: str, names: list[str] | None = None, versions: list[str] | None = None, collections: list[str] | None = None) -> DataFrame:
    return wanted(spark.read.schema(SCHEMA).parquet(path), names, versions, collections)


def wanted(df: DataFrame, names: list[str] | None = None, versions: list[str] | None = None, collections: list[str] | None = None) -> DataFrame:
    """Records of these names, versions and collections; None asks for all."""
    for column, some in (("factor_name", names), ("version", versions), ("collection", collections)):
        df = df.where(F.col(column).isin(some)) if some else df
    return df


def save(records: DataFrame, path: str) -> None:
    """Upsert on KEYS."""
    spark = records.sparkSession
    if exists(spark, path):
        replace(merged(read(spark, path), records, KEYS), path)
    else:
        records.select(*(c.split()[0] for c in ("method version factor_name instrument_id start_date end_date fitness formula created_at collection fusion_info").split())).write.parquet(path)


def latest(df: DataFrame) -> DataFrame:
    """One record per version, collection and factor: the one created last."""
    order = Window.partitionBy("collection", "version", "factor_name").orderBy(F.desc_nulls_last("created_at"), "instrument_id", "start_date", "end_date")
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def formulas(df: DataFrame) -> dict[str, str]:
    """factor_name -> formula; a name with several formulas raises."""
    rows = df.groupBy("factor_name").agg(F.collect_set("formula").alias("f")).collect()  # as many rows as the names asked for
    for r in rows:
        if len(r["f"]) != 1:
            raise ValueError(f"{r['factor_name']} has {len(r['f'])} formulas")
    return {r["factor_name"]: r["f"][0] for r in rows}


def values(panel: DataFrame, records: DataFrame, names: list[str], version: str, collections: list[str]) -> DataFrame:
    """panel with the values of stored factors as columns of their names; a column of such a name is replaced."""
    if len(set(names)) < len(names) or not collections:
        raise ValueError("names are given once each, and one collection at least")
    found = formulas(wanted(records, names, [version], collections))
    if missing := sorted(set(names) - set(found)):
        raise ValueError(f"no formula of version {version} for {', '.join(missing)}")
    keep = [c for c in panel.columns if c not in names]
    return evaluate(panel.select(*keep), {n: found[n] for n in names}, keep)


def other_runs(df: DataFrame, version: str, collection: str) -> DataFrame:
    """Records but those of a version in a collection."""
    return df.where(~((F.col("version").eqNullSafe(version)) & (F.col("collection").eqNullSafe(collection))))


def versions(df: DataFrame) -> DataFrame:
    return df.groupBy("collection").agg(F.sort_array(F.collect_set("version"), asc=False).alias("versions"))


def remove(df: DataFrame, versions: list[str], collection: str | None = None) -> DataFrame:
    hit = F.col("version").isin(versions)
    return delete(df, hit & (F.col("collection") == collection) if collection else hit)


def rename_version(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumn("version", F.when(F.col("version") == old, new).otherwise(F.col("version")))


def fitness(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """(factor_name, fitness): the mean of the years of each metric, as original, penalized and value."""
    df = summary.where("year <> 'all'").groupBy("factor_name").agg(*(F.avg(f"`{m}`").alias(f"_{k}") for k, m in enumerate(metrics)))
    entry = lambda c: F.struct(c.alias("original"), c.alias("penalized"), c.alias("value"))
    return df.select("factor_name", F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*(entry(F.col(f"_{k}")) for k in range(len(metrics))))).alias("fitness"))


def filtered(df: DataFrame, spec: list[tuple[str, str | None]]) -> DataFrame:
    """Records of (collection, version) pairs; no version means all of the collection's."""
    wanted = df.sparkSession.createDataFrame(spec, "_c string, _v string")
    return df.join(F.broadcast(wanted), (F.col("collection") == F.col("_c")) & (F.col("_v").isNull() | (F.col("version") == F.col("_v"))), "left_semi")
