"""Forward selection of factors whose equal-weight mean scores best, its checks, and its place in the registry."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.formula import fused
from ..operators.compiler import evaluate
from . import catalog, select
from .backtest import Options, backtest, labelled

WEIGHTS = {"TS IC": 0.3, "TS ICIR": 0.7}


@dataclass(frozen=True)
class Outside:
    """Days that the blended score takes in with a share: 1 - share of the score within `inside`, share of that here.

    Either span is (first day, last day), None for no bound."""

    share: float
    days: tuple[str | None, str | None]
    inside: tuple[str | None, str | None] = (None, None)

    def __post_init__(self) -> None:
        if not 0 <= self.share <= 1:
            raise ValueError("the share lies between 0 and 1")


def weighted_score(weights: Mapping[str, float]) -> Column:
    """Weighted sum of a summary row's metrics; a missing one makes it minus infinity."""
    total = sum((F.col(f"`{m}`") * w for m, w in weights.items()), F.lit(0.0))
    return F.coalesce(total, F.lit(float("-inf")))


def _within(days: tuple[str | None, str | None]) -> Column:
    out = F.lit(True)
    for day, after in zip(days, (True, False), strict=True):
        if day is not None:
            at = F.lit(day).cast("date")
            out &= F.to_date("time") >= at if after else F.to_date("time") <= at
    return out


def scores(panel: DataFrame, formulas: Mapping[str, str], weights: Mapping[str, float], options: Options, outside: Outside | None = None) -> dict[str, float]:
    """Mean over instruments of the whole period's weighted score, per formula: one job for all of them.

    With outside, formulas are evaluated on all days, and the positions of either span start anew in it: both are rows of
    one plan. Where no row lies outside, the score inside stands alone."""
    score = F.avg(weighted_score(weights)).alias("s")
    if outside is None or not outside.share:
        span = outside.inside if outside else (None, None)
        frame = labelled(panel, formulas, options, check=False).where(_within(span))
        summary = metrics.summary(metrics.daily(frame, options.fees, options.rollover_cost), options.interest, options.calmar, options.method).where("year = 'all'")
        return {r["factor_name"]: r["s"] for r in summary.groupBy("factor_name").agg(score).collect()}
    spans = F.array_compact(F.array(*(F.when(_within(days), F.lit(k)) for k, days in (("in", outside.inside), ("out", outside.days)))))
    frame = labelled(panel, formulas, options, check=False).withColumn("_span", F.explode(spans)).withColumn("factor_name", F.concat_ws("\x1f", "_span", "factor_name")).drop("_span")
    summary = metrics.summary(metrics.daily(frame, options.fees, options.rollover_cost), options.interest, options.calmar, options.method).where("year = 'all'")
    found = {tuple(r["factor_name"].split("\x1f", 1)): r["s"] for r in summary.groupBy("factor_name").agg(score).collect()}
    out = {}
    for (span, name), s in found.items():
        if span == "in":
            out[name] = (1 - outside.share) * s + outside.share * found["out", name] if ("out", name) in found else s
    return out


def fuse(panel: DataFrame, formulas: Mapping[str, str], most: int = 5, weights: Mapping[str, float] = WEIGHTS, options: Options = Options(), outside: Outside | None = None) -> tuple[list[str], str, list[float]]:
    """(chosen names, fused formula, score after each round). A round adds the factor that improves the score most and
    ends where none does strictly; of equal scores the first name wins."""
    chosen: list[str] = []
    path: list[float] = []
    while len(chosen) < most:
        trial = {n: fused([formulas[c] for c in [*chosen, n]]) for n in sorted(formulas) if n not in chosen}
        if not trial:
            break
        found = scores(panel, trial, weights, options, outside)
        name = min(trial, key=lambda n: (-found.get(n, float("-inf")), n))
        score = found.get(name, float("-inf"))
        if score == float("-inf") or path and score <= path[-1]:
            break
        chosen.append(name)
        path.append(score)
    return chosen, fused([formulas[c] for c in chosen]) if chosen else "", path


def consistency(panel: DataFrame, formulas: list[str], formula: str) -> tuple[int, float | None, float | None]:
    """Rows that both have, largest difference and correlation of the mean of factors and the formula that stands for it."""
    wide = evaluate(panel, {**{f"f{k}": f for k, f in enumerate(formulas)}, "whole": formula})
    parts = [F.col(f"f{k}") for k in range(len(formulas))]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    mean = F.try_divide(total, sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int")))
    df = wide.select(mean.alias("mean"), "whole").where("mean is not null and whole is not null")
    row = df.agg(F.count(F.lit(1)), F.max(F.abs(F.col("mean") - F.col("whole"))), F.corr("mean", "whole")).first()
    return row[0], row[1], row[2]


@dataclass
class Fused:
    """A fusion with what its checks found, and whether it was stored."""

    chosen: list[str]
    formula: str
    path: list[float]
    summary: DataFrame | None = None
    rows: int = 0
    difference: float | None = None
    honest: bool = False
    closest: float | None = None
    name: str | None = None
    stored: bool = False
    details: list[dict[str, str]] = field(default_factory=list)


def candidates(registry: DataFrame, pairs: Mapping[str, list[str]]) -> dict[str, dict[str, str]]:
    """key -> record of the registry's factors by collection and versions (an empty list: all of them); of a name with
    several records the last counts."""
    wanted = F.lit(False)
    for collection, versions in pairs.items():
        wanted |= (F.col("collection") == collection) & (F.col("version").isin(versions) if versions else F.lit(True))
    rows = catalog.latest(registry.where(wanted)).select("collection", "version", "factor_name", "formula").distinct().collect()  # the registry's formulas
    return {f"{r['version']}::{r['factor_name']}": r.asDict() for r in rows}


def fuse_stored(panel: DataFrame, path: str, pairs: Mapping[str, list[str]], version: str, most: int = 5, weights: Mapping[str, float] = WEIGHTS, options: Options = Options(), outside: Outside | None = None, related: float | None = None, tolerance: float = 1e-6, collection: str = "factor_fusion") -> Fused:
    """Fuses factors of the registry at path and stores the result there, if it is made of two or more, looks back only, is
    what its formula says, and (with related) is no closer than that to another stored factor of the collection."""
    spark = panel.sparkSession
    registry = catalog.read(spark, path)
    known = candidates(registry, pairs)
    chosen, formula, scored = fuse(panel, {k: r["formula"] for k, r in known.items()}, most, weights, options, outside)
    out = Fused(chosen, formula, scored)
    if not chosen:
        return out
    out.details = [known[k] for k in chosen]
    out.name = f"fusion_avg_weight_{len(chosen) - 1}"
    out.summary = backtest(panel, {out.name: formula}, options, check=False)[0]
    out.rows, out.difference, _ = consistency(panel, [known[k]["formula"] for k in chosen], formula)
    out.honest = bool(select.look_ahead(panel, {out.name: formula}).first()["passed"])
    allowed = len(chosen) > 1 and out.honest and (out.difference is None or out.difference <= tolerance)
    if allowed and related is not None:
        others = {k: r["formula"] for k, r in candidates(registry.where(F.col("version") != version), {collection: []}).items()}
        near = select.spearman(panel, {out.name: formula}, others).agg(F.max("spearman")).first()[0] if others else None
        out.closest = near
        allowed = near is None or near < related
    if allowed:
        catalog.save(_records(out, panel, version, collection), path)
        out.stored = True
    return out


def _records(made: Fused, panel: DataFrame, version: str, collection: str) -> DataFrame:
    values = catalog.fitness(made.summary, [c for c in made.summary.columns if c not in ("instrument_id", "factor_name", "year", "count")])
    days = panel.groupBy("instrument_id").agg(F.date_format(F.min("time"), "yyyyMMdd").alias("start_date"), F.date_format(F.max("time"), "yyyyMMdd").alias("end_date"))
    info: dict[str, list[str]] = {}
    for r in made.details:
        info.setdefault(r["version"], []).append(r["factor_name"])
    pairs = F.create_map(*(x for k, v in info.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    columns = {"method": F.lit("fusion"), "version": F.lit(version), "collection": F.lit(collection), "formula": F.lit(made.formula), "created_at": F.lit(datetime.now()), "fusion_info": pairs}
    return days.withColumn("factor_name", F.lit(made.name)).join(F.broadcast(values), "factor_name").withColumns(columns).select(*("method version factor_name instrument_id start_date end_date fitness formula created_at collection fusion_info").split())
