"""Filters on candidate factors: thresholds, look-ahead, rank correlation with stored factors, what failed least."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import DIRECTIONS, average_rank
from ..operators.compiler import evaluate, evaluate_long

#: metric -> (least mean of the years, least year, direction); None leaves a part out.
Limits = Mapping[str, tuple[float | None, float | None, int]]


def checked(limits: Limits) -> Limits:
    for name, limit in limits.items():
        if name not in DIRECTIONS or len(limit) != 3 or limit[2] not in (1, -1):
            raise ValueError(f"not a limit: {name} {limit}")
    return limits


def _passes(value: Column, least: float | None, direction: int) -> Column:
    if least is None:
        return F.lit(True)
    return F.coalesce(value >= least if direction > 0 else value <= least, F.lit(False))


def verdicts(summary: DataFrame, limits: Limits, need_all: bool = True, outside: DataFrame | None = None, outside_share: float = 0.5) -> DataFrame:
    """Per factor and instrument whether every limit holds: the 'all' row's presence, each year, the mean of years
    (blended with that of an out-of-sample summary, if given)."""
    checked(limits)
    keys = ["factor_name", "instrument_id"]
    yearly = F.col("year") != "all"
    parts = [F.bool_or(~yearly).alias("_has_all")]
    for k, (name, (_, year, direction)) in enumerate(limits.items()):
        value = F.col(f"`{name}`")
        parts += [F.avg(F.when(yearly, value)).alias(f"_m{k}"), F.coalesce(F.bool_and(F.when(yearly, _passes(value, year, direction))), F.lit(False)).alias(f"_y{k}")]
    df = summary.groupBy(*keys).agg(*parts)
    if outside is not None:
        other = outside.groupBy(*keys).agg(*(F.avg(F.when(yearly, F.col(f"`{n}`"))).alias(f"_o{k}") for k, n in enumerate(limits)))
        df = df.join(other, keys, "left")
        df = df.withColumns({f"_m{k}": F.col(f"_m{k}") * (1 - outside_share) + F.col(f"_o{k}") * outside_share for k in range(len(limits))})
    ok = F.col("_has_all") if need_all else F.lit(True)
    for k, (mean, _, direction) in enumerate(limits.values()):
        ok = ok & F.col(f"_y{k}") & _passes(F.col(f"_m{k}"), mean, direction)
    return df.select(*keys, ok.alias("passed"), *(F.col(f"_m{k}").alias(n) for k, n in enumerate(limits)))


def selected(summary: DataFrame, limits: Limits, need_all: bool = True, every_instrument: bool = True, **more) -> DataFrame:
    """factor_name of the factors that pass on all (or any) of their instruments."""
    both = F.bool_and if every_instrument else F.bool_or
    return verdicts(summary, limits, need_all, **more).groupBy("factor_name").agg(both("passed").alias("passed")).where("passed").select("factor_name")


def best_failed(summary: DataFrame, limits: Limits, **more) -> DataFrame:
    """Per metric the failing factor and instrument with the best yearly mean, and its gap to the limit."""
    failed = verdicts(summary, limits, **more).where("not passed")
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("mean"), F.lit(float(d)).alias("direction"), F.lit(m).cast("double").alias("wanted")) for n, (m, _, d) in limits.items()))
    df = failed.select("factor_name", "instrument_id", F.inline(rows)).where("mean is not null")
    best = F.min_by(F.struct("factor_name", "instrument_id", "mean", "wanted", "direction"), F.struct(-F.col("mean") * F.col("direction"), F.col("factor_name"), F.col("instrument_id")))
    return df.groupBy("metric").agg(best.alias("_b")).select("metric", "_b.factor_name", "_b.instrument_id", "_b.mean", ((F.col("_b.mean") - F.col("_b.wanted")) * F.col("_b.direction")).alias("gap"))


def yearly_summary(summary: DataFrame, limits: Limits) -> DataFrame:
    """Per factor, instrument and metric the mean and the worst of the years."""
    rows = F.array(*(F.struct(F.lit(n).alias("metric"), (F.col(f"`{n}`") * d).alias("v"), F.lit(d).alias("d")) for n, (_, _, d) in limits.items()))
    df = summary.where("year <> 'all'").select("factor_name", "instrument_id", F.inline(rows))
    return df.groupBy("factor_name", "instrument_id", "metric").agg((F.avg("v") * F.first("d")).alias("mean"), (F.min("v") * F.first("d")).alias("worst"))


def cut_times(panel: DataFrame, n: int = 20) -> list:
    """The last time of each of n parts of the panel's times."""
    parts = panel.select("time").distinct().withColumn("_p", F.ntile(n).over(Window.orderBy("time")))  # a row per time
    return [r["t"] for r in parts.groupBy("_p").agg(F.max("time").alias("t")).orderBy("t").collect()]


def look_ahead(panel: DataFrame, formulas: Mapping[str, str], cuts: list | None = None, rtol: float = 1e-8, atol: float = 1e-10, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per factor whether its values change when the panel ends earlier, at each cut (cut_times by default). All cuts are
    one plan: the panel is repeated per cut with the cut as part of the instrument. prepare makes columns of a panel that
    the formulas use, anew for each cut. A row that only one of both has counts as changed."""
    cuts = cut_times(panel) if cuts is None else cuts
    prepare = prepare or (lambda df: df)
    ends = F.array(*(F.lit(c).cast("timestamp") for c in cuts))
    copies = panel.withColumn("_cut", F.explode(ends)).where("time <= _cut")
    tagged = copies.withColumn("_own", F.col("instrument_id")).withColumn("instrument_id", F.concat_ws("\x1f", "instrument_id", F.col("_cut").cast("string")))
    short = evaluate_long(prepare(tagged), formulas, ["_own", "_cut", "time"]).where("time = _cut").select(F.col("_own").alias("instrument_id"), "time", "factor_name", F.col("factor_value").alias("short"), F.lit(True).alias("_short"))
    whole = evaluate_long(prepare(panel), formulas).where(F.array_contains(ends, F.col("time").cast("timestamp"))).withColumn("_whole", F.lit(True))
    df = whole.join(short, ["instrument_id", "time", "factor_name"], "full_outer")
    x, y = F.col("factor_value"), F.col("short")
    alone = F.col("_short").isNull() | F.col("_whole").isNull()
    off = alone | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > atol + rtol * F.abs(y), F.lit(False))
    return df.groupBy("factor_name").agg(F.count_if(off).alias("changed"), F.count(F.lit(1)).alias("compared")).withColumn("passed", F.col("changed") == 0)


def spearman(panel: DataFrame, new: Mapping[str, str], stored: Mapping[str, str]) -> DataFrame:
    """(factor_name, other, spearman): absolute rank correlation over the pooled panel, on each pair's complete rows.

    A first pass tells the rows that each pair has by their number and the sum of their hashes; pairs with the same rows
    are a pattern. Each factor is ranked once per pattern it takes part in, not once per pair; a second pass over the rows'
    ranks adds up the products of blocks of new and stored factors by partition."""
    formulas = {f"n{i}": f for i, f in enumerate(new.values())} | {f"s{j}": f for j, f in enumerate(stored.values())}
    names = {(i, j): (a, b) for i, a in enumerate(new) for j, b in enumerate(stored)}
    spark, schema = panel.sparkSession, "factor_name string, other string, spearman double"
    if not names:
        return spark.createDataFrame([], schema)
    wide = evaluate(panel, formulas).withColumn("_key", F.xxhash64("instrument_id", "time")).persist()
    mark = F.col("_key").bitwiseAND((1 << 40) - 1)  # sums of so many bits do not overflow
    both = lambda i, j: F.col(f"n{i}").isNotNull() & F.col(f"s{j}").isNotNull()
    seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    places = list(names)
    for at in range(0, len(places), 500):
        part = places[at : at + 500]
        row = wide.agg(*(c for i, j in part for c in (F.count_if(both(i, j)), F.sum(F.when(both(i, j), mark))))).first()
        for k, pair in enumerate(part):
            seen.setdefault((row[2 * k], row[2 * k + 1]), []).append(pair)
    names = {pair: names[pair] for rows, pairs in seen.items() if rows[0] for pair in pairs}  # others have no row in common
    seen = {rows: pairs for rows, pairs in seen.items() if rows[0] > 1}
    cells = []
    for k, pairs in enumerate(seen.values()):
        known = both(*pairs[0])
        for c in dict.fromkeys(c for i, j in pairs for c in (f"n{i}", f"s{j}")):
            side, place = (0, int(c[1:])) if c[0] == "n" else (1, int(c[1:]))
            cells.append(F.when(known, F.struct(F.lit(k).alias("pattern"), F.lit(side).alias("side"), F.lit(place).alias("place"), F.col(c).alias("v"))))
    if not cells:
        wide.unpersist()
        return spark.createDataFrame([(a, b, None) for a, b in names.values()], schema)
    long = wide.select("instrument_id", "time", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("instrument_id", "time", "c.*")
    ranks = long.withColumn("r", average_rank(F.col("v"), ["pattern", "side", "place"]))
    # one row per time and pattern again, with the ranks of either side in their places
    rows = ranks.groupBy("pattern", "instrument_id", "time").agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.struct("place", "r"))))["r"].alias(f"r{k}") for k in (0, 1)))
    middle = {k: (n + 1) / 2 for k, (n, _) in enumerate(seen)}
    columns = {k: [sorted({p[side] for p in pairs}) for side in (0, 1)] for k, pairs in enumerate(seen.values())}
    sums: dict[tuple[int, int, int], tuple[float, float, float]] = {}
    for r in rows.select("pattern", "r0", "r1").mapInArrow(_products(middle, columns), "pattern int, i int, j int, xy double, xx double, yy double").groupBy("pattern", "i", "j").agg(F.sum("xy"), F.sum("xx"), F.sum("yy")).collect():
        sums[r[0], r[1], r[2]] = r[3], r[4], r[5]
    wide.unpersist()
    found = {}
    for k, pairs in enumerate(seen.values()):
        for i, j in pairs:
            xy, xx, yy = sums[k, i, j]
            found[i, j] = min(1.0, abs(xy) / math.sqrt(xx * yy)) if xx > 0 and yy > 0 else None
    return spark.createDataFrame([(a, b, found.get(pair)) for pair, (a, b) in names.items()], schema)


def _products(middle: Mapping[int, float], columns: Mapping[int, list[list[int]]]):
    """Per partition the sums of products of centred ranks, for every new and stored factor of each pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            patterns = batch.column("pattern").to_numpy()
            for k in np.unique(patterns).tolist():
                own = pa.array(patterns == k)
                x, y = (batch.column(f"r{side}").filter(own).flatten().to_numpy().reshape(-1, len(columns[k][side])) - middle[k] for side in (0, 1))
                now = [x.T @ y, (x * x).sum(axis=0), (y * y).sum(axis=0)]
                total[k] = [a + b for a, b in zip(total[k], now, strict=True)] if k in total else now
        for k, (xy, xx, yy) in total.items():
            new, stored = columns[k]
            i, j = np.repeat(np.array(new, np.int32), len(stored)), np.tile(np.array(stored, np.int32), len(new))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i), pa.array(j), pa.array(xy.ravel()), pa.array(np.repeat(xx, len(stored))), pa.array(np.tile(yy, len(new)))], names=["pattern", "i", "j", "xy", "xx", "yy"])

    return run


def unrelated(correlations: DataFrame, threshold: float) -> DataFrame:
    """Factors whose largest correlation stays below the threshold, with the closest stored one."""
    top = correlations.groupBy("factor_name").agg(F.coalesce(F.max("spearman"), F.lit(0.0)).alias("max_abs_spearman"), F.max_by("other", F.coalesce("spearman", F.lit(-1.0))).alias("closest"))
    return top.where(F.col("max_abs_spearman") < threshold)
