"""From candidates to stored factors: backtest, thresholds, look-ahead, relation to what is stored, registry."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import parse
from ..sources.store import exists
from . import catalog, mining, select
from .backtest import Options, backtest


@dataclass(frozen=True)
class Rules:
    limits: select.Limits
    related: float = 0.7
    every_instrument: bool = True
    need_all: bool = True
    outside_share: float = 0.5
    cuts: list | None = None


@dataclass
class Run:
    """What each step left, and the records that were made of the rest."""

    formulas: dict[str, str]
    summary: DataFrame
    passed: list[str] = field(default_factory=list)
    honest: list[str] = field(default_factory=list)
    new: list[str] = field(default_factory=list)
    closest: dict[str, float] = field(default_factory=dict)
    records: DataFrame | None = None

    def table(self) -> DataFrame:
        """A row per candidate: its formula, the steps that it passed, its relation to stored factors."""
        rows = [(n, f, n in self.passed, n in self.honest, self.closest.get(n), n in self.new) for n, f in sorted(self.formulas.items())]
        return self.summary.sparkSession.createDataFrame(rows, "factor_name string, formula string, passed_limits boolean, passed_look_ahead boolean, max_abs_spearman double, kept boolean")


def chosen(panel: DataFrame, formulas: Mapping[str, str], stored: Mapping[str, str], rules: Rules, options: Options = Options(), outside: DataFrame | None = None) -> Run:
    """Which candidates pass every step; each step sees what the one before left. outside is a panel of other days."""
    summary = backtest(panel, formulas, options, check=False)[0].persist()
    more = {"outside": backtest(outside, formulas, options, check=False)[0], "outside_share": rules.outside_share} if outside is not None else {}
    run = Run(dict(formulas), summary)
    names = lambda df: sorted(r["factor_name"] for r in df.select("factor_name").collect())  # noqa: E731  of the candidates
    run.passed = names(select.selected(summary, rules.limits, rules.need_all, rules.every_instrument, **more))
    if run.passed:
        run.honest = names(select.look_ahead(panel, {n: formulas[n] for n in run.passed}, rules.cuts).where("passed"))
    run.new = run.honest
    if run.honest and stored:
        near = select.spearman(panel, {n: formulas[n] for n in run.honest}, stored).groupBy("factor_name").agg(F.max("spearman").alias("m")).collect()
        run.closest = {r["factor_name"]: r["m"] or 0.0 for r in near}
        run.new = [n for n in run.honest if run.closest.get(n, 0.0) < rules.related]
    return run


def split(panel: DataFrame, cut: str) -> tuple[DataFrame, DataFrame]:
    """The panel before a day and from it on: for a search and for what it has not seen."""
    at = F.lit(cut).cast("timestamp")
    return panel.where(F.col("time") < at), panel.where(F.col("time") >= at)


def proposed(answers: Iterable[str], panel: DataFrame, most: int = 100, prefix: str = "fac_llm") -> dict[str, str]:
    """Formulas out of texts that hold a JSON object {"formulas": [..]} somewhere: those that parse, fit the types and the
    panel's fields and come up for the first time, under numbered names, until there are most."""
    fields = [c for c, t in panel.dtypes if t in ("double", "float", "int", "bigint")]
    found: dict[str, str] = {}
    for text in answers:
        begin, end = text.find("{"), text.rfind("}")
        try:
            listed = json.loads(text[begin : end + 1]).get("formulas", []) if begin >= 0 else []
        except (ValueError, AttributeError):
            continue
        for one in listed if isinstance(listed, list) else []:
            try:
                printed = str(parse(one, fields))
            except ValueError:
                continue
            found.setdefault(printed, one)
            if len(found) >= most:
                return {f"{prefix}_{k:04d}": f for k, f in enumerate(found, 1)}
    return {f"{prefix}_{k:04d}": f for k, f in enumerate(found, 1)}


def records(run: Run, panel: DataFrame, version: str, collection: str, method: str = "gp") -> DataFrame:
    """Registry records of a run's new factors, one per instrument, with the fitness of each metric of its summary."""
    spark = panel.sparkSession
    made = spark.createDataFrame([(n, run.formulas[n]) for n in run.new], "factor_name string, formula string")
    days = panel.groupBy("instrument_id").agg(F.date_format(F.min("time"), "yyyyMMdd").alias("start_date"), F.date_format(F.max("time"), "yyyyMMdd").alias("end_date"))
    values = catalog.fitness(run.summary, [c for c in run.summary.columns if c not in ("instrument_id", "factor_name", "year", "count")])
    now = F.lit(datetime.now())
    df = made.join(values, "factor_name").crossJoin(F.broadcast(days))  # a row per instrument
    columns = {"method": F.lit(method), "version": F.lit(version), "collection": F.lit(collection), "created_at": now, "fusion_info": F.lit(None).cast("map<string, array<string>>")}
    return df.withColumns(columns).select(*(c.split()[0] for c in ("method version factor_name instrument_id start_date end_date fitness formula created_at collection fusion_info").split()))


def auto_mine(panel: DataFrame, path: str, rules: Rules, version: str, collection: str = "genetic_programming", search: mining.Search = mining.Search(), options: Options = Options(), outside: DataFrame | None = None, candidates: Mapping[str, str] | None = None) -> Run:
    """Search (or take the candidates), keep what passes every step, and store it in the registry at path.

    Factors are compared with all stored ones but those of the same version and collection; of a name with several
    records the last counts. A run that finds nothing stores nothing."""
    select.checked(rules.limits)
    spark = panel.sparkSession
    formulas = dict(candidates) if candidates is not None else mining.named(mining.mine(panel, search, options))
    known = {}
    if exists(spark, path):
        others = catalog.latest(catalog.other_runs(catalog.read(spark, path), version, collection))
        rows = others.select("collection", "version", "factor_name", "formula").collect()  # the registry's formulas
        known = {f"{r['collection']}::{r['version']}::{r['factor_name']}": r["formula"] for r in rows}
    if not formulas:
        return Run({}, backtest(panel, {"none": "Neg(close)"}, options, check=False)[0].limit(0))
    run = chosen(panel, formulas, known, rules, options, outside)
    if run.new:
        run.records = records(run, panel, version, collection)
        catalog.save(run.records, path)
    return run
