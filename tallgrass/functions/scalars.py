"""Small column functions and set operations around panels and records."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAYS = 252


def annual_to_daily(ret: Column) -> Column:
    return F.pow(1 + ret, F.lit(1 / DAYS)) - 1


def daily_to_annual(ret: Column) -> Column:
    return F.pow(1 + ret, F.lit(float(DAYS))) - 1


def adjusted_frequency(ret: Column, days_before: int, days_after: int) -> Column:
    """A return over so many days as one over others, at compound interest; 0 and null stay."""
    if days_before <= 0 or days_after <= 0:
        raise ValueError("frequencies are positive numbers of days")
    one_day = F.pow(1 + ret, F.lit(1 / days_before)) - 1
    return F.when(ret == 0, ret).otherwise(F.pow(1 + one_day, F.lit(float(days_after))) - 1)


def finite(x: Column) -> Column:
    """x, or null where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clipped(x: Column, limit: float) -> Column:
    """A finite number within [-limit, limit]; what is none counts as 0."""
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), F.coalesce(finite(x), F.lit(0.0))))


def sanitised(df: DataFrame, factor: str = "factor_value", label: str = "future_ret") -> DataFrame:
    """Factors clipped to 20 and returns to 1 either way."""
    return df.withColumns({factor: clipped(F.col(factor), 20.0), label: clipped(F.col(label), 1.0)})


def chunks(df: DataFrame, units: int, unit: str = "month", time: str = "time") -> DataFrame:
    """df with its chunk of so many years, months or days, from 1; rows of the first unit, which may be a part, go.

    Days are counted from the first, so that there the first chunk goes."""
    if unit not in ("year", "month", "day") or units < 1:
        raise ValueError(f"no chunks of {units} {unit}")
    at = {"year": F.year(time), "month": F.year(time) * 12 + F.month(time), "day": F.datediff(time, F.lit("1970-01-01"))}[unit]
    first = df.agg(F.min(at).alias("_first"))
    placed = df.crossJoin(F.broadcast(first))  # one row
    number = F.floor((at - F.col("_first")) / units) if unit == "day" else F.ceil((at - F.col("_first")) / units)
    return placed.withColumn("chunk", number.cast("int")).where("chunk >= 1").drop("_first")


def grid(spark: SparkSession, choices: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of the parameters' choices, a row each."""
    df = spark.range(1).select(*(F.array(*map(F.lit, v)).alias(k) for k, v in choices.items()))
    for k in choices:
        df = df.withColumn(k, F.explode(k))
    return df


def root_symbol(symbol: Column) -> Column:
    """The root of a main contract's name: upper case, without the 0 that ends it."""
    return F.regexp_replace(F.upper(F.trim(symbol)), "0$", "")


def main_symbol(symbol: Column) -> Column:
    return F.concat(root_symbol(symbol), F.lit("0"))


def factor_key(collection: Column, version: Column, name: Column) -> Column:
    return F.concat_ws("::", collection, version, name)


def reference(text: Column) -> Column:
    """struct(database, collection, version) of database.collection@version; the version may lack, the collection not."""
    part = lambda k: F.nullif(F.regexp_extract(F.trim(text), r"^([^.@]+)\.([^@]+)(?:@(.+))?$", k), F.lit(""))
    return F.struct(part(1).alias("database"), part(2).alias("collection"), part(3).alias("version"))


def json_part(text: Column) -> Column:
    """The outermost JSON object within an answer in prose; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def json_safe(df: DataFrame) -> DataFrame:
    """Columns as JSON can hold them: no NaN or infinity, times in ISO form."""
    out = []
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        out.append((finite(col) if t in ("double", "float") else F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss") if t.startswith("timestamp") else F.date_format(col, "yyyy-MM-dd") if t == "date" else col).alias(c))
    return df.select(*out)


def cleaned_fitness(fitness: Column) -> Column:
    """A map of metrics without blank names and values that are no finite numbers."""
    return F.map_filter(fitness, lambda k, v: (F.trim(k) != "") & finite(v).isNotNull())


def tag_shares(df: DataFrame, column: str, tags: Sequence[str]) -> DataFrame:
    """(tag, rows, share): in how many rows the text holds each tag."""
    hit = F.array(*(F.struct(F.lit(t).alias("tag"), F.coalesce(F.col(column).contains(t), F.lit(False)).cast("int").alias("hit")) for t in tags))
    return df.select(F.inline(hit)).groupBy("tag").agg(F.sum("hit").alias("rows"), F.avg("hit").alias("share"))


def head(df: DataFrame, n: int, keys: Sequence[str], *order) -> DataFrame:
    """The first n rows of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def worst(df: DataFrame, difference: Column, tolerance: float, n: int, *ties: str) -> DataFrame:
    """The n rows with the largest difference beyond the tolerance: a report of n rows."""
    return df.withColumn("difference", difference).where(F.col("difference") > tolerance).orderBy(F.desc("difference"), *ties).limit(n)


def by_priority(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows of all parts; of those with one key, those of the first part that has it, a row each."""
    tagged = [p.withColumn("_rank", F.lit(k)) for k, p in enumerate(parts)]
    both = tagged[0]
    for p in tagged[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    order = [c for c in both.columns if c not in (key, "_rank")]
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_rank", *order))).where("_n = 1").drop("_n", "_rank")


def load_config(path: str, default: Mapping | None = None) -> dict:
    """A JSON object from a local file of settings; the default where it is missing or none."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return dict(default or {})
    return found if isinstance(found, dict) else dict(default or {})


def save_config(path: str, config: Mapping) -> None:
    """Written beside the file and then put in its place."""
    import os

    new = f"{path}.new"
    with open(new, "w", encoding="utf-8") as f:
        json.dump(dict(config), f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(new, path)
