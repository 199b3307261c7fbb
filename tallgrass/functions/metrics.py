"""Yearly and whole-period metrics of factor positions, for all instruments and factors in one plan.

A long frame (instrument_id, factor_name, time, factor_value, future_ret, optional is_rollover) becomes daily
series, then one row per instrument, factor and year, and one for 'all'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 252
SERIES = ("instrument_id", "factor_name")
# The metrics that filters and fitness accept, and whether larger (1) or smaller (-1) is better.
DIRECTIONS = {
    "Gross Return": 1, "Net Return": 1, "Gross Volatility": -1, "Net Volatility": -1, "Gross Sharpe": 1, "Net Sharpe": 1, "Gross Sortino": 1, "Net Sortino": 1,
    "Gross MaxDD": -1, "Net MaxDD": -1, "Gross Calmar": 1, "Net Calmar": 1, "Gross Win Rate": 1, "Net Win Rate": 1, "Turnover": -1, "TS IC": 1, "TS RankIC": 1, "TS ICIR": 1, "TS RankICIR": 1, "T-corr": 1,
}
#: Days that a label of a period overlaps with the next; others count as one.
OVERLAP = {"1D": 1, "1W": 7, "1M": 30, "1Q": 90, "1Y": 365}


def fee_of(fees: dict[str, float] | float) -> Column:
    """The fee of a row's instrument; a map without it raises at run time."""
    if not isinstance(fees, dict):
        return F.lit(float(fees))
    known = F.create_map(*(F.lit(x) for pair in fees.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.col("instrument_id")), F.raise_error(F.concat(F.lit("no fee for "), F.col("instrument_id"))).cast("double"))


def daily(frame: DataFrame, fees: dict[str, float] | float = 0.0002, rollover_cost: bool = True) -> DataFrame:
    """frame with position, gross_ret, turnover, net_ret."""
    by = Window.partitionBy(*SERIES).orderBy("time")
    held = F.coalesce(F.last("factor_value", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    df = frame.withColumn("position", held).withColumn("_last", F.lag("position").over(by))
    change = F.abs(F.col("position") - F.coalesce("_last", F.lit(0.0)))
    if rollover_cost and "is_rollover" in frame.columns:
        change = F.when(F.coalesce("is_rollover", F.lit(False)), F.abs(F.coalesce("_last", F.lit(0.0))) + F.abs("position")).otherwise(change)
    df = df.withColumn("gross_ret", F.col("position") * F.coalesce("future_ret", F.lit(0.0))).withColumn("turnover", change)
    return df.withColumn("net_ret", F.col("gross_ret") - F.col("turnover") * fee_of(fees)).drop("_last")


def baselines(frame: DataFrame) -> DataFrame:
    """frame with the constant long and short positions of each instrument added as factors."""
    base = frame.select([c for c in frame.columns if c not in ("factor_name", "factor_value", "is_rollover")]).distinct()
    extra = [base.withColumn("factor_name", F.lit(n)).withColumn("factor_value", F.lit(v)) for n, v in (("long", 1.0), ("short", -1.0))]
    return frame.unionByName(extra[0], allowMissingColumns=True).unionByName(extra[1], allowMissingColumns=True)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's correlation of the complete pairs of a group; null where a side has one value or none."""
    known = x.isNotNull() & y.isNotNull()
    a, b = F.when(known, x), F.when(known, y)
    return F.when((F.min(a) != F.max(a)) & (F.min(b) != F.max(b)), F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)))


def average_rank(x: Column, by: list[str]) -> Column:
    """Rank with ties at their mean, within groups."""
    order = Window.partitionBy(*by).orderBy(x)
    peers = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))  # in the same sort
    return F.rank().over(order) + (peers - 1) / 2


def _over(x: str, y: str) -> Column:
    """x / y; null where y is 0 but for rounding."""
    return F.when(F.col(y) > 1e-12, F.col(x) / F.col(y))


def nav(df: DataFrame, ret: str, by: list[str], method: str = "compound") -> Column:
    frame = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return F.product(1 + F.col(ret)).over(frame) if method == "compound" else 1 + F.sum(ret).over(frame)


def scoped(df: DataFrame) -> DataFrame:
    """Each row twice: for its year and for 'all'."""
    return df.withColumn("year", F.explode(F.array(F.year("time").cast("string"), F.lit("all"))))


def summary(series: DataFrame, interest: str = "simple", calmar: str = "reference", method: str = "1D") -> DataFrame:
    """One row per instrument, factor and year or 'all' of a daily() frame, with the metrics of DIRECTIONS and count.

    calmar='reference' divides by the volatility, 'true' by the largest drawdown; method is the labels' period."""
    if interest not in ("simple", "compound") or calmar not in ("reference", "true"):
        raise ValueError(f"unknown interest {interest} or calmar {calmar}")
    keys = [*SERIES, "year"]
    whole = Window.partitionBy(*SERIES).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    df = series.withColumns({f"_nav_{k}": F.product(1 + F.col(f"{k}_ret")).over(whole) for k in ("gross", "net")})
    df = scoped(df).withColumn("_known", F.col("factor_value").isNotNull() & F.col("future_ret").isNotNull())
    df = df.withColumns({f"_own_{k}": nav(df, f"{k}_ret", keys) for k in ("gross", "net")})
    run = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_dd_{k}": 1 - F.try_divide(F.col(f"_own_{k}"), F.max(f"_own_{k}").over(run)) for k in ("gross", "net")})
    ranks = {f"_rank_{c}": F.when(F.col("_known"), average_rank(F.col(c), [*keys, "_known"])) for c in ("factor_value", "future_ret")}
    df = df.withColumns(ranks)
    n = F.count(F.lit(1))
    out = [n.alias("_n"), F.avg("turnover").alias("Turnover"), safe_corr(F.col("factor_value"), F.col("future_ret")).alias("TS IC"), safe_corr(F.col("_rank_factor_value"), F.col("_rank_future_ret")).alias("TS RankIC")]
    for k in ("gross", "net"):
        name, r, v = k.title(), F.col(f"{k}_ret"), F.col(f"_nav_{k}")
        if interest == "simple":
            ret = F.avg(r) * DAYS
        else:
            first = F.when(F.first("year") == "all", F.lit(1.0)).otherwise(F.min_by(v, F.col("time")))
            ret = F.pow(F.try_divide(F.max_by(v, F.col("time")), first), F.lit(float(DAYS)) / n) - 1
        out += [ret.alias(f"{name} Return"), (F.stddev_samp(r) * DAYS**0.5).alias(f"{name} Volatility"), (F.stddev_samp(F.when(r < 0, r)) * DAYS**0.5).alias(f"_down_{k}"), F.max(f"_dd_{k}").alias(f"{name} MaxDD"), F.avg((r > 0).cast("int")).alias(f"{name} Win Rate")]
    df = df.groupBy(*keys).agg(*out)
    for k in ("Gross", "Net"):
        df = df.withColumn(f"{k} Sharpe", _over(f"{k} Return", f"{k} Volatility")).withColumn(f"{k} Sortino", _over(f"{k} Return", f"_down_{k.lower()}")).withColumn(f"{k} Calmar", _over(f"{k} Return", f"{k} Volatility" if calmar == "reference" else f"{k} MaxDD"))
    years = Window.partitionBy(*SERIES)
    for ic in ("TS IC", "TS RankIC"):
        x = F.when(F.col("year") != "all", F.col(ic))
        ratio = F.when(F.count(x).over(years) >= 2, F.avg(x).over(years) / (F.stddev_samp(x).over(years) + 1e-6))
        df = df.withColumn(f"{ic}IR", F.when(F.col("year") == "all", ratio))
    # the whole period's figure has no root: filters were tuned on it
    apart = F.col("_n") / float(OVERLAP.get(method, 1))
    df = df.withColumn("T-corr", F.when(F.col("year") == "all", apart).otherwise(F.sqrt(apart)))
    return df.select(*keys, *DIRECTIONS, F.lit(1).cast("long").alias("count"))


def since(series: DataFrame, start: str) -> DataFrame:
    """Net returns of a daily() frame from a day on: their sum, and their mean as a year's."""
    part = series.where(F.col("time") >= F.lit(start).cast("timestamp"))
    return part.groupBy(*SERIES).agg(F.sum("net_ret").alias("cumulative_return"), (F.avg("net_ret") * DAYS).alias("annualized_return"))


def triplet(value: Column, long: Column, short: Column, form: str = "%.6g") -> Column:
    """A metric with its baselines, as 'v(long,short)'."""
    show = lambda c: F.coalesce(F.format_string(form, c), F.lit("nan"))
    return F.concat(show(value), F.lit("("), show(long), F.lit(","), show(short), F.lit(")"))


def null_ratios(df: DataFrame) -> DataFrame:
    """Share of nulls by column, as (column, ratio)."""
    one = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in df.columns))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*(F.col(f"`{c}`") for c in df.columns)))).alias("column", "ratio"))
