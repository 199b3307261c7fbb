"""Formulas to staged DataFrame columns: each distinct windowed subtree is one column, computed once.

All windows share one specification (instrument_id, time), so a batch of formulas costs one shuffle and one
sort. Exponential means recur without end, which no frame expresses: like ranks in wide windows and kernels of one's own
they are folded over the sorted rows (fold.py).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import Const, Field, Node, core, parse
from .fold import SLIDING, SLIDING_FROM, ExponentialMean, Kernel, folded
from .pair import PAIR
from .rowwise import ROWWISE
from .window import WINDOW

KEYS = ("instrument_id", "time")
#: Formulas in one plan at most, for the size of generated code.
BATCH = 50


def by_time() -> Window:
    return Window.partitionBy("instrument_id").orderBy("time")


def clean(panel: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Fields as doubles with null as the only missing value."""
    def number(name: str) -> Column:
        x = F.col(name).try_cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias(name)

    return panel.withColumns({f: number(f) for f in fields})


#: Operators of one's own that are kernels: name -> the kernel of a window (or of none).
KERNELS: dict[str, Callable[..., Kernel]] = {}


def kernel_of(node: Node) -> Kernel | None:
    """The kernel that computes a node, where it is one's work."""
    if node.op == "Ema":
        return ExponentialMean(node.params[0])
    if node.op in SLIDING and node.params[0] >= SLIDING_FROM:
        return SLIDING[node.op](node.params[0])
    return KERNELS[node.op](*node.params) if node.op in KERNELS else None


def with_means(df: DataFrame, means: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """df with exponential means over each instrument's time: name -> (operand, span)."""
    return folded(df, {name: (ExponentialMean(n), (c,)) for name, (c, n) in means.items()})


def evaluate(panel: DataFrame, formulas: Mapping[str, str], keep: Iterable[str] = KEYS) -> DataFrame:
    """keep columns and one double per formula, named by the mapping's keys."""
    names = set(panel.columns)
    aliases = {"oi": "position"} if "oi" not in names else {"position": "oi"} if "position" not in names else {}
    fields = [f for f in ("open", "high", "low", "close", "settle", "volume", "position", "oi") if f in names]
    others = [c for c, t in panel.dtypes if c not in (*fields, *KEYS) and t in ("double", "float", "int", "bigint")]
    trees = {k: core(parse(f, [*fields, *others])) for k, f in formulas.items()}
    df = clean(panel, [*fields, *others])
    columns: dict[Node, str] = {}

    def value(node) -> Column:
        if isinstance(node, Const):
            return F.lit(node.value)
        if isinstance(node, Field):
            return F.col(aliases.get(node.name, node.name))
        if node in columns:
            return F.col(columns[node])
        return ROWWISE[node.op](*map(value, node.children))

    def windowed(node) -> list[Node]:
        """Windowed subtrees, operands before those that use them."""
        if not isinstance(node, Node):
            return []
        below = [n for c in node.children for n in windowed(c)]
        return [*below, node] if node.op not in ROWWISE else below

    level: dict[Node, int] = {}
    for tree in trees.values():
        for n in windowed(tree):
            level.setdefault(n, 1 + max((level[m] for c in n.children for m in windowed(c)), default=0))
    if any(n.op in ("TsArgmax", "TsArgmin") for n in level):
        df = df.withColumn("_row", F.row_number().over(by_time()))
    for depth in range(1, max(level.values(), default=0) + 1):
        new, means = {}, {}
        # operands with arithmetic of their own become columns first: a window function takes no nested one
        for n in (n for n, d in level.items() if d == depth):
            args = [value(c) for c in n.children]
            name = f"_w{len(columns) + len(new) + len(means)}"
            if (kernel := kernel_of(n)) is not None:
                means[n] = (name, kernel, tuple(args))
            elif n.op in PAIR:
                new[n] = (name, PAIR[n.op](*args, by_time(), *n.params))
            else:
                new[n] = (name, WINDOW[n.op](*args, by_time(), *n.params))
        if new:
            df = df.withColumns({name: c for name, c in new.values()})
            columns.update({n: name for n, (name, _) in new.items()})
        if means:
            df = folded(df, {name: (kernel, operands) for name, kernel, operands in means.values()})
            columns.update({n: name for n, (name, _, _) in means.items()})
    return df.select(*keep, *(value(t).cast("double").alias(k) for k, t in trees.items()))


def evaluate_long(panel: DataFrame, formulas: Mapping[str, str], keep: Iterable[str] = KEYS) -> DataFrame:
    """keep columns, factor_name, factor_value; formulas in batches of BATCH."""
    keep, names, out = list(keep), list(formulas), None
    for k in range(0, len(names), BATCH):
        part = names[k : k + BATCH]
        wide = evaluate(panel, {f"f{i}": formulas[n] for i, n in enumerate(part)}, keep)
        pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("factor_name"), F.col(f"f{i}").alias("factor_value")) for i, n in enumerate(part))))
        long = wide.select(*keep, pairs.alias("_p")).select(*keep, "_p.factor_name", "_p.factor_value")
        out = long if out is None else out.unionByName(long)
    return out
