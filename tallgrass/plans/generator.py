"""Candidates in rounds from a proposer (a language model, or anything that answers a request with text).

Each round asks for what is missing, tells what is known already and why earlier answers failed, and tries all new
formulas in one plan on the first rows of each instrument. It ends with enough formulas, after rounds without a new
one, or when it is told to."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import Node, describe_operators, parse, wrap_norm
from ..operators.compiler import evaluate


@dataclass(frozen=True)
class Rounds:
    """target formulas in rounds of per_round; the trial panel has sample_rows of each instrument, or twice the widest
    window. A formula must have a value in least_known of the trial's rows that its windows leave, and more than one."""

    target: int = 20
    per_round: int = 10
    patience: int = 3
    most: int | None = None
    sample_rows: int = 60
    least_known: float = 0.1
    normalise: bool = False
    prefix: str = "fac_llm_prompt"

    def __post_init__(self) -> None:
        if self.target < 1 or self.per_round < 1 or self.sample_rows < 2:
            raise ValueError("target and per_round are positive, the trial has two rows at least")

    @property
    def rounds(self) -> int:
        return self.most or max(3, 3 * math.ceil(self.target / self.per_round))


@dataclass(frozen=True)
class Request:
    """What a proposer is asked in a round."""

    number: int
    wanted: int
    fields: tuple[str, ...]
    known: tuple[str, ...]
    failed: tuple[tuple[str, str], ...]
    requirement: str = ""

    def prompt(self) -> str:
        lines = [
            f"Write {self.wanted} formulas for factors of price panels. Answer with JSON alone: {{\"formulas\": [\"...\"]}}.",
            f"Fields: {', '.join(self.fields)}. Windows are positive whole numbers written out. Operators by operands and windows:",
            describe_operators(),
        ]
        if self.requirement:
            lines.append(f"They should serve this: {self.requirement}")
        if self.known:
            lines.append("Do not repeat these: " + "; ".join(self.known))
        if self.failed:
            lines.append("These failed: " + "; ".join(f"{f} ({why})" for f, why in self.failed))
        return "\n".join(lines)


@dataclass
class Outcome:
    formulas: dict[str, str]
    reason: str
    rounds: list[tuple[int, int, int, int]] = field(default_factory=list)  # number, proposed, new, total
    failed: dict[str, str] = field(default_factory=dict)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rounds, "round int, proposed int, new int, total int")


def answered(text: str) -> list[str]:
    """The formulas of an answer: a JSON object somewhere in it, with a list of texts or of objects that have a formula."""
    begin, end = text.find("{"), text.rfind("}")
    found = json.loads(text[begin : end + 1]) if begin >= 0 else None
    listed = found.get("formulas", found.get("factors")) if isinstance(found, dict) else None
    if not isinstance(listed, list):
        raise ValueError("no list of formulas")
    return [x.strip() for x in (one.get("formula") if isinstance(one, dict) else one for one in listed) if isinstance(x, str) and x.strip()]


def widest(tree) -> int:
    """Rows before the first value, at most: windows add up along a path."""
    if not isinstance(tree, Node):
        return 0
    own = max((p for p in tree.params if isinstance(p, int)), default=1)
    return own + max(map(widest, tree.children), default=0)


def tried(panel: DataFrame, formulas: list[str], how: Rounds) -> dict[str, str]:
    """formula -> why it fails on the first rows of each instrument, for those that do: one plan for all of them."""
    if not formulas:
        return {}
    reach = {f: widest(parse(f, _fields(panel))) for f in formulas}
    rows = max(how.sample_rows, 2 * max(reach.values()))
    by = Window.partitionBy("instrument_id").orderBy("time")
    sample = panel.withColumn("_place", F.row_number().over(by)).where(F.col("_place") <= rows)
    # cut before the factors' own windows: they see the sample only
    wide = evaluate(sample, {f"f{k}": f for k, f in enumerate(formulas)}, ["instrument_id", "time", "_place"])
    known = lambda k, f: F.when(F.col("_place") > reach[f], F.col(f"f{k}"))
    row = wide.agg(*(c for k, f in enumerate(formulas) for c in (F.avg((F.when(F.col("_place") > reach[f], F.col(f"f{k}").isNotNull())).cast("double")), F.min(known(k, f)), F.max(known(k, f))))).first()
    out = {}
    for k, f in enumerate(formulas):
        share, low, high = row[3 * k : 3 * k + 3]
        if share is None:
            out[f] = "its windows are wider than the series"
        elif share < how.least_known or low is None:
            out[f] = "it hardly has a value"
        elif low == high:
            out[f] = "it has one value only"
    return out


def _fields(panel: DataFrame) -> list[str]:
    return [c for c, t in panel.dtypes if t in ("double", "float", "int", "bigint")]


def generated(panel: DataFrame, propose: Callable[[Request], str], how: Rounds = Rounds(), requirement: str = "", stop: Callable[[], bool] = lambda: False) -> Outcome:
    """Valid formulas under numbered names. A proposer that raises, or whose answer is none, has spent a round."""
    panel, fields = panel.persist(), _fields(panel)
    found: dict[str, str] = {}  # by the printed tree, so that spellings of one formula are one
    failed: dict[str, str] = {}
    out, still = Outcome({}, "rounds"), 0
    for number in range(1, how.rounds + 1):
        if stop():
            out.reason = "stopped"
            break
        request = Request(number, min(how.per_round, how.target - len(found)), tuple(fields), tuple(found.values()), tuple(failed.items())[-how.per_round :], requirement)
        try:
            listed = answered(propose(request))
        except Exception as e:
            failed[f"answer {number}"] = str(e)
            listed = []
        fresh: dict[str, str] = {}
        for one in listed:
            try:
                printed = str(parse(one, fields))
            except ValueError as e:
                failed[one] = str(e)
                continue
            if printed not in found and printed not in failed:
                fresh.setdefault(printed, one)
        bad = tried(panel, list(fresh), how)
        failed |= bad
        before = len(found)
        for printed, one in fresh.items():
            if printed not in bad and len(found) < how.target:
                found[printed] = one
        out.rounds.append((number, len(listed), len(found) - before, len(found)))
        if len(found) >= how.target:
            out.reason = "target"
            break
        still = 0 if len(found) > before else still + 1
        if still >= how.patience:
            out.reason = "no growth"
            break
    panel.unpersist()
    out.failed = failed
    out.formulas = {f"{how.prefix}_{k:04d}": wrap_norm(f) if how.normalise else f for k, f in enumerate(found.values(), 1)}
    return out
