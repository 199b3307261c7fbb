"""Price panels: validation, adjustment, labels, and panels derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import root_column

PRICES = ("open", "high", "low", "close")
PANEL = (*PRICES, "volume", "position")


def by_time() -> Window:
    return Window.partitionBy("instrument_id").orderBy("time")


def check_columns(df: DataFrame, needed: tuple[str, ...]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def check_keys(df: DataFrame, keys: tuple[str, ...] = ("instrument_id", "time")) -> None:
    """Raises where a key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {twice[0].asDict()}")


def _stored(spark: SparkSession, path: str, names: dict[str, str | Column] | None) -> DataFrame:
    """A table, with its columns under the given names (all under their own without)."""
    df = spark.read.parquet(path)
    return df.select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in names.items())) if names else df


def _between(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        df = df.where(F.col("time") >= F.lit(start).cast("timestamp"))
    return df.where(F.col("time") <= F.lit(end).cast("timestamp")) if end else df


def scan(spark: SparkSession, path: str, instruments: list[str] | None = None, start: str | None = None, end: str | None = None, names: dict[str, str | Column] | None = None) -> DataFrame:
    """A stored panel; instrument and time predicates go down to the files, and prune the folders of one that is partitioned."""
    df = _stored(spark, path, names)
    return _between(df.where(F.col("instrument_id").isin(instruments)) if instruments else df, start, end)


def scan_symbols(spark: SparkSession, path: str, symbols: list[str], start: str | None = None, end: str | None = None, names: dict[str, str | Column] | None = None) -> DataFrame:
    """Prices of listed contracts by symbol and time, in that order, with the root of each; names are looked for in any case."""
    df = _stored(spark, path, names).withColumn("symbol", F.upper(F.trim("symbol"))).withColumn("instrument_id", root_column(F.col("symbol")))
    return _between(df.where(F.col("symbol").isin([s.strip().upper() for s in symbols])), start, end).orderBy("symbol", "time")


def contract_info(contracts: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The instruments that are listed, or those of them that are asked for."""
    known = contracts.select("instrument_id").distinct()
    return known.where(F.col("instrument_id").isin(wanted)) if wanted else known


def weighted_price(panel: DataFrame, factor: str = "weighted_factor", prices: tuple[str, ...] = PRICES) -> DataFrame:
    """Prices times the adjustment factor; a factor of 0 or null counts as 1."""
    f = F.coalesce(F.when(F.col(factor) != 0, F.col(factor)), F.lit(1.0))
    return panel.withColumns({p: F.col(p) * f for p in prices})


#: Holding periods of labels beside the day: so many units of the calendar.
PERIODS = {"1W": (7, "DAY"), "1M": (1, "MONTH"), "1Q": (3, "MONTH"), "1Y": (12, "MONTH")}


def future_return(panel: DataFrame, method: str = "1D") -> DataFrame:
    """panel with future_ret, opens carried forward. 1D: from tomorrow's open to the next, open[t+2] / open[t+1] - 1. A
    longer period of PERIODS: from tomorrow's open to the first open a calendar period or more after it, whatever days
    the series has; none within one period more leaves the label out."""
    padded = F.last("open", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    panel = panel.withColumn("_open", padded)
    if method == "1D":
        return panel.withColumn("future_ret", F.try_divide(F.lead("_open", 2).over(by_time()), F.lead("_open", 1).over(by_time())) - 1).drop("_open")
    if method not in PERIODS:
        raise ValueError(f"no label is defined for {method}; there are 1D, {', '.join(PERIODS)}")
    # the exit is a row of the same series in a frame of time, so that no join is needed and the sort is the one that others share
    n, unit = PERIODS[method]
    later = F.expr(f"first(_open) OVER (PARTITION BY instrument_id ORDER BY CAST(time AS TIMESTAMP) RANGE BETWEEN INTERVAL '{n}' {unit} FOLLOWING AND INTERVAL '{2 * n}' {unit} FOLLOWING)")
    panel = panel.withColumn("_exit", later)
    return panel.withColumn("future_ret", F.try_divide(F.lead("_exit").over(by_time()), F.lead("_open").over(by_time())) - 1).drop("_open", "_exit")


def excess_return(panel: DataFrame, rates: DataFrame) -> DataFrame:
    """future_ret less the daily risk-free rate of the day; days without one take the next, then the last known."""
    rates = F.broadcast(rates.select(F.to_date("date").alias("_date"), (F.col("rate") / 252).alias("_rate")))  # a row per day
    df = panel.join(rates, F.to_date("time") == F.col("_date"), "left")
    ahead = F.first("_rate", ignorenulls=True).over(by_time().rowsBetween(0, Window.unboundedFollowing))
    behind = F.last("_rate", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("future_ret", F.col("future_ret") - F.coalesce(ahead, behind, F.lit(0.0))).drop("_date", "_rate")


def _bars(rows: DataFrame, price: Column, volume: Column, order: list[str]) -> DataFrame:
    key = F.struct(*order, price.alias("p"))
    return rows.groupBy("instrument_id", "time").agg(
        F.min(key)["p"].alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(key)["p"].alias("close"), F.sum(volume).alias("volume"), F.count(F.lit(1)).cast("double").alias("position")
    )


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by return flag and line status; a price is 100 plus the hundreds' rest of the extended price over 50."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat("l_returnflag", "l_linestatus").alias("instrument_id"), F.col("l_shipdate").alias("time"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_extendedprice") % 1000 / 50 + 100).alias("price")
    )
    return _bars(rows, F.col("price"), F.col("l_quantity"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of orders by priority, prices as for line items."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("instrument_id"), F.col("o_orderdate").alias("time"), "o_orderkey", (F.col("o_totalprice") % 1000 / 50 + 100).alias("price"))
    return _bars(rows, F.col("price"), F.lit(1.0), ["o_orderkey"])


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values by type."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("instrument_id"), F.date_trunc("hour", "ts").alias("time"), "ts", "event_id", F.col("value").alias("price"))
    return _bars(rows, F.col("price"), F.lit(1.0), ["ts", "event_id"])
