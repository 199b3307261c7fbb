"""Gradient refinement of formulas: weights, constants and windows as continuous parameters, moved up the search's score.

Every operand whose scale matters gets a weight, every constant and every single window a parameter; a window is a mix of
the operator at the windows around it, weighted by a bell around the parameter. A factor and its partial derivatives are
columns of one plan (forward mode: each operator passes its operands' derivatives on), with the operators' own
windows, so a batch of trees costs one shuffle and one sort. The score's gradient follows from sums over instrument and
year, so a step of all trees together is one job that returns a row per tree and parameter. The optimiser sees only these.

What is piecewise constant (ranks, places of extremes, entropies, comparisons, signs, candles) passes no derivative on;
weights below it stay. Refined formulas come back with weights folded into constants and windows rounded, and take the
original's place only where the search's own fitness is not below."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.formula import SPECS, Const, Field, Kind, Node, core, kind_of, parse
from ..functions.scalars import clipped
from ..operators import compiler
from ..operators.pair import PAIR
from ..operators.rowwise import ROWWISE
from ..operators.window import WINDOW
from ..sources.panels import future_return
from .backtest import Options

# The metrics that have a gradient, as the search's fitness names them.
SMOOTH = ("TS IC", "TS ICIR", "Gross Return", "Net Return", "Gross Volatility", "Net Volatility", "Gross Sharpe", "Net Sharpe", "Turnover")
#: Operators (with the operands) whose result depends on an operand's scale in more than scale.
WEIGHTED = {"Add": (0, 1), "Sub": (0, 1), "Max": (0, 1), "Min": (0, 1), "IfElse": (1, 2), "NanMean": None, "Sig": (0,), "TsResidual": (0, 1), "TsCov": ()}
OPTIMISERS = ("adam", "sgd", "rmsprop", "adagrad")


@dataclass(frozen=True)
class Refine:
    """steps at most, ending after patience steps without a better score; shared: one parameter for all places of one
    operator and operand; every: refine the new trees of each so many generations (0: the archive at the end)."""

    steps: int = 30
    rate: float = 0.05
    window_rate: float = 0.3
    patience: int = 8
    clip: float = 1.0
    optimiser: str = "adam"
    shared: bool = False
    radius: int = 2
    spread: float = 1.0
    min_window: int = 2
    max_window: int = 60
    every: int = 0

    def __post_init__(self) -> None:
        if self.optimiser not in OPTIMISERS:
            raise ValueError(f"unknown optimiser {self.optimiser}; there are {', '.join(OPTIMISERS)}")
        if self.steps < 0 or self.radius < 0 or self.patience < 1 or not 1 <= self.min_window <= self.max_window:
            raise ValueError("steps and radius are not negative, patience is positive, windows are ordered")
        if not (self.spread > 0 and self.rate > 0 and self.window_rate > 0 and self.clip > 0):
            raise ValueError("rates, spread and clip are positive")


@dataclass
class Parameter:
    kind: str
    start: float
    choices: tuple[int, ...] = ()
    value: float = field(init=False)

    def __post_init__(self) -> None:
        self.value = self.start


class Parametric:
    """A tree with its parameters: soft is the tree in core operators with Weighted, Mixed and Trained nodes."""

    def __init__(self, tree, how: Refine, first: int = 0):
        self.tree, self.how, self.first = tree, how, first
        self.params: list[Parameter] = []
        self._keys: dict[tuple, int] = {}
        self.soft = self._softened(tree, ())

    def _own(self, key: tuple, kind: str, start: float, choices: tuple[int, ...] = ()) -> int:
        if key not in self._keys:
            self._keys[key] = len(self.params)
            self.params.append(Parameter(kind, start, choices))
        return self._keys[key]

    def _key(self, kind: str, node, path: tuple, place: int) -> tuple:
        return (kind, node.op, node.params, place) if self.how.shared else (kind, path, place)

    def _weight(self, node: Node, path: tuple, k: int) -> int | None:
        places = WEIGHTED.get(node.op, ())
        if isinstance(node.children[k], Const) or (places is not None and k not in places):
            return None
        return self._own(self._key("weight", node, path, k), "weight", 1.0)

    def _window(self, node: Node, path: tuple) -> tuple[int, tuple[int, ...]] | None:
        if node.op not in SPECS or SPECS[node.op].windows != 1 or not (node.op in DIFFERENTIABLE and self.how.radius):
            return None
        w = node.params[0]
        near = tuple(c for c in range(w - self.how.radius, w + self.how.radius + 1) if self.how.min_window <= c <= self.how.max_window)
        return (self._own(self._key("window", node, path, 0), "window", float(w), near), near) if len(near) > 1 and w in near else None

    def _softened(self, node, path: tuple):
        if isinstance(node, Const):
            return Node("Trained", (), (self.first + self._own(("constant", path), "constant", node.value),))
        if not isinstance(node, Node):
            return node
        kids = []
        for k, child in enumerate(node.children):
            kid = self._softened(child, (*path, k))
            p = self._weight(node, path, k)
            kids.append(kid if p is None else Node("Weighted", (kid,), (self.first + p,)))
        found = self._window(node, path)
        if found is None:
            return _expanded(node, kids, node.params)
        p, near = found
        return Node("Mixed", tuple(_expanded(node, kids, (c,)) for c in near), (self.first + p, *near))

    def materialised(self):
        """The tree with weights and constants folded in and windows rounded."""

        def build(node, path: tuple):
            if isinstance(node, Const):
                return Const(round(self.params[self._keys["constant", path]].value, 6))
            if not isinstance(node, Node):
                return node
            kids = []
            for k, child in enumerate(node.children):
                kid, p = build(child, (*path, k)), self._weight(node, path, k)
                kids.append(kid if p is None else _scaled(round(self.params[p].value, 6), kid))
            found = self._window(node, path)
            near = found and found[1]
            window = found and min(near, key=lambda c: abs(c - self.params[found[0]].value))
            return Node(node.op, tuple(kids), (window,) if found else node.params)

        return build(self.tree, ())


def _scaled(weight: float, node):
    """weight times the node; constants that meet become one."""
    if weight == 1:
        return node
    if isinstance(node, Const):
        return Const(weight * node.value)
    if isinstance(node, Node) and node.op == "Mul" and isinstance(node.children[0], Const):
        return _scaled(round(weight * node.children[0].value, 6), node.children[1])
    return Node("Mul", (Const(weight), node))


def _expanded(node: Node, kids: list, params: tuple):
    """The node in core operators over operands that are core already."""
    # whether a volatility is one of prices shows in its operand's type, which the operand in core operators has lost
    names = ["open" if kind_of(c) is Kind.PRICE and node.op == "Volatility" else f"operand {k}" for k, c in enumerate(node.children)]
    made = core(Node(node.op, tuple(map(Field, names)), params))

    def put(x):
        if isinstance(x, Field) and x.name in names:
            return kids[names.index(x.name)]
        return Node(x.op, tuple(map(put, x.children)), x.params) if isinstance(x, Node) else x

    return put(made)


# --- forward mode: a column and its derivatives by the parameters that it depends on


class Dual(NamedTuple):
    value: Column
    parts: dict[int, Column]


def _mixed(terms: Iterable[tuple[Column | float, dict[int, Column]]]) -> dict[int, Column]:
    """The sum of derivatives, each times a factor."""
    out: dict[int, Column] = {}
    for by, parts in terms:
        for p, d in parts.items():
            out[p] = out[p] + by * d if p in out else by * d
    return out


def _zero_if(null: Column) -> Column:
    return F.coalesce(null, F.lit(0.0))


def _inv(x: Column) -> Column:
    return F.try_divide(F.lit(1.0), x)


#: For each row-wise operator its derivative by each operand, of the operands and the result.
PARTIALS = {
    "Add": lambda x, y, v: (1.0, 1.0),
    "Sub": lambda x, y, v: (1.0, -1.0),
    "Mul": lambda x, y, v: (y, x),
    "Div": lambda x, y, v: (_inv(y), -v * _inv(y)),
    "Change": lambda x, y, v: (_inv(y), -(v + 1) * _inv(y)),
    "Max": lambda x, y, v: ((x >= y).cast("double"), (x < y).cast("double")),
    "Min": lambda x, y, v: ((x <= y).cast("double"), (x > y).cast("double")),
    "Neg": lambda x, v: (-1.0,),
    "Abs": lambda x, v: (F.signum(x),),
    "SqrtAbs": lambda x, v: (_zero_if(F.try_divide(F.signum(x), 2 * v)),),
    "Inv": lambda x, v: (-v * v,),
    "Ln": lambda x, v: (_inv(x),),
    "Sig": lambda x, v: (v * (1 - v) * (F.abs(x) < 50).cast("double"),),
}


def _rowwise(op: str, args: list[Dual]) -> Dual:
    value = ROWWISE[op](*(a.value for a in args))
    if op in PARTIALS:
        by = PARTIALS[op](*(a.value for a in args), value)
        return Dual(value, _mixed((b, a.parts) for b, a in zip(by, args, strict=True)))
    every = sorted({p for a in args for p in a.parts})
    if op == "IfElse":
        c, x, y = args
        return Dual(value, {p: F.when(c.value > 0, x.parts.get(p, F.lit(0.0))).otherwise(y.parts.get(p, F.lit(0.0))) for p in every if p in x.parts or p in y.parts})
    if op in ("NanMean", "Ribbon"):
        many = sum((a.value.isNotNull().cast("int") for a in args[1:]), args[0].value.isNotNull().cast("int"))
        mean = {p: F.try_divide(sum((_zero_if(a.parts[p]) for a in args if p in a.parts), F.lit(0.0)), many) for p in every}
        if op == "NanMean":
            return Dual(value, mean)
        middle = ROWWISE["NanMean"](*(a.value for a in args))

        def of(extreme: Column, p: int) -> Column:
            out = F.lit(0.0)
            for a in args:
                out = F.when(a.value == extreme, a.parts.get(p, F.lit(0.0))).otherwise(out)
            return out

        high, low = F.greatest(*(a.value for a in args)), F.least(*(a.value for a in args))
        return Dual(value, {p: F.try_divide(of(high, p) - of(low, p), F.abs(middle)) - value * F.try_divide(mean[p], middle) for p in every})
    return Dual(value, {})


def _frame(by: WindowSpec, n: int) -> WindowSpec:
    return by.rowsBetween(-(n - 1), 0)


def _extreme(sign: int):
    def rule(x: Dual, by: WindowSpec, n: int, v: Column) -> dict[int, Column]:
        at = F.when(x.value.isNotNull(), F.struct((sign * x.value).alias("v"), *(d.alias(f"d{p}") for p, d in x.parts.items())))
        best = F.max(at).over(_frame(by, n))
        return {p: F.when(v.isNotNull(), best[f"d{p}"]) for p in x.parts}

    return rule


def _std(x: Dual, by: WindowSpec, n: int, v: Column) -> dict[int, Column]:
    return {p: F.when(v.isNotNull(), _zero_if(F.try_divide(F.covar_samp(x.value, d).over(_frame(by, n)), F.when(v > 1e-12, v)))) for p, d in x.parts.items()}


def _moment(power: int):
    """Of skewness (3) and kurtosis (4): the moments' derivatives from means of powers times the derivative."""

    def rule(x: Dual, by: WindowSpec, n: int, v: Column) -> dict[int, Column]:
        over, u = _frame(by, n), x.value
        mean = lambda c: F.avg(c).over(over)
        m, m2 = mean(u), F.var_pop(u).over(over)
        m3 = F.skewness(u).over(over) * F.pow(m2, 1.5)
        out = {}
        for p, d in x.parts.items():
            d0, d1, d2 = mean(d), mean(u * d), mean(u * u * d)
            by2 = 2 * (d1 - m * d0)
            if power == 3:
                top = 3 * (d2 - 2 * m * d1 + m * m * d0 - m2 * d0)
                own = (top * F.pow(m2, -1.5) - 1.5 * m3 * by2 * F.pow(m2, -2.5)) * ((n * (n - 1)) ** 0.5 / (n - 2))
            else:
                d3 = mean(u * u * u * d)
                m4 = (F.kurtosis(u).over(over) + 3) * m2 * m2
                top = 4 * (d3 - 3 * m * d2 + 3 * m * m * d1 - m * m * m * d0 - m3 * d0)
                own = (top / (m2 * m2) - 2 * m4 * by2 / (m2 * m2 * m2)) * ((n - 1) * (n + 1) / ((n - 2) * (n - 3)))
            out[p] = F.when(v.isNotNull(), F.when(m2 > 1e-12, own).otherwise(0.0))
        return out

    return rule


def _roll_norm(x: Dual, by: WindowSpec, window: int, least: int, eps: float, clip: float, v: Column, m: Column, s: Column) -> dict[int, Column]:
    """m and s are the mean and deviation of the rows before, which all derivatives share."""
    over = by.rowsBetween(-window, -1)
    z = (x.value - m) / (s + eps)
    own = lambda d: (d - F.avg(d).over(over) - z * _zero_if(F.try_divide(F.covar_samp(x.value, d).over(over), F.when(s > 1e-12, s)))) / (s + eps)
    return {p: F.when(v.isNotNull(), F.when(F.abs(z) < clip, own(d)).otherwise(0.0)) for p, d in x.parts.items()}


def _linear(op: str):
    return lambda x, by, *rest: {p: WINDOW[op](d, by, *rest[:-1]) for p, d in x.parts.items()}


UNARY = {op: _linear(op) for op in ("Lag", "Pad", "TsMean", "TsSum", "TsTimeWeightedMean")} | {
    "TsMax": _extreme(1), "TsMin": _extreme(-1), "TsStd": _std, "TsSkew": _moment(3), "TsKurt": _moment(4),
}


def _pairwise(op: str, x: Dual, y: Dual, by: WindowSpec, n: int, v: Column) -> dict[int, Column]:
    over, known = _frame(by, n), x.value.isNotNull() & y.value.isNotNull()
    a, b = F.when(known, x.value), F.when(known, y.value)
    cov = lambda p, q: F.covar_samp(p, q).over(over)
    some = lambda c: F.when(v.isNotNull(), _zero_if(c))
    out = {}
    for p in sorted({*x.parts, *y.parts}):
        dx, dy = (F.when(known, d.parts[p]) if p in d.parts else None for d in (x, y))
        both = sum((cov(*c) for c in ((dx, b), (a, dy)) if c[0] is not None and c[1] is not None), F.lit(0.0))
        var = lambda c: F.when(F.var_samp(c).over(over) > 1e-24, F.var_samp(c).over(over))
        if op == "TsCov":
            out[p] = some(both)
        elif op == "TsCorr":
            rest = (F.try_divide(cov(a, dx), var(a)) if dx is not None else F.lit(0.0)) + (F.try_divide(cov(b, dy), var(b)) if dy is not None else F.lit(0.0))
            out[p] = some(F.try_divide(both, F.sqrt(var(a) * var(b))) - v * rest)
        else:
            beta = F.try_divide(cov(a, b), var(b))
            dbeta = F.try_divide(both - (2 * beta * cov(b, dy) if dy is not None else 0.0), var(b))
            if op == "TsBeta":
                out[p] = some(dbeta)
            else:  # TsResidual: x less the line on y
                mean = lambda c: F.avg(c).over(over)
                own_x = dx - mean(dx) if dx is not None else F.lit(0.0)
                own_y = beta * (dy - mean(dy)) if dy is not None else F.lit(0.0)
                out[p] = some(own_x - dbeta * (b - mean(b)) - own_y)
    return out


#: Operators of the language whose window can be mixed: what passes derivatives on.
DIFFERENTIABLE = {
    "TsMean", "TsSum", "TsMax", "TsMin", "TsStd", "TsTimeWeightedMean", "TsDelta", "TsDelay", "TsPctDelta", "Return", "LogReturn", "Volatility", "VolumeStd", "VolumeZScore", "TurnoverShock", "Bias", "RangePosition",
    "PriceAcceleration", "TrueAmplitude", "Ema", "TsDecayExp", "TsSkew", "TsKurt", "TsCorr", "TsCov", "TsBeta", "TsResidual", "VpDivergence", "Amihud", "TsRank", "TsEntropy", "TsRankCorr",
}


def _mix_weights(at: float, choices: tuple[int, ...], spread: float) -> tuple[list[float], list[float]]:
    """The choices' weights in a mix around at, and these weights' derivatives by it."""
    raw = [-((c - at) / spread) ** 2 for c in choices]
    top = max(raw)
    e = [math.exp(x - top) for x in raw]
    w = [x / sum(e) for x in e]
    slope = [2 * (c - at) / spread**2 for c in choices]
    mean = sum(a * s for a, s in zip(w, slope, strict=True))
    return w, [a * (s - mean) for a, s in zip(w, slope, strict=True)]


def duals(df: DataFrame, trees: Mapping[str, object], theta: list[float], spread: float) -> tuple[DataFrame, dict[str, Dual]]:
    """df (a clean panel) with further columns, over which each soft tree is a value with its derivatives.

    Windowed subtrees are staged by depth as in evaluating formulas: each is computed once, and all share one sort."""
    by, made, level = compiler.by_time(), {}, {}
    plain = {"Weighted", "Mixed", "Trained", *ROWWISE}

    def windowed(node) -> list[Node]:
        if not isinstance(node, Node):
            return []
        below = [n for c in node.children for n in windowed(c)]
        return below if node.op in plain else [*below, node]

    def dual(node) -> Dual:
        if isinstance(node, Const):
            return Dual(F.lit(node.value), {})
        if isinstance(node, Field):
            return Dual(F.col(node.name), {})
        if node in made:
            return made[node]
        if node.op == "Trained":
            return Dual(F.lit(theta[node.params[0]]), {node.params[0]: F.lit(1.0)})
        args = [dual(c) for c in node.children]
        if node.op == "Weighted":
            (x,), p = args, node.params[0]
            return Dual(theta[p] * x.value, _mixed([(theta[p], x.parts), (1.0, {p: x.value})]))
        if node.op == "Mixed":
            p, *choices = node.params
            w, slope = _mix_weights(theta[p], tuple(choices), spread)
            value = sum((a * x.value for a, x in zip(w[1:], args[1:], strict=True)), w[0] * args[0].value)
            own = sum((s * x.value for s, x in zip(slope[1:], args[1:], strict=True)), slope[0] * args[0].value)
            return Dual(value, _mixed([*((a, x.parts) for a, x in zip(w, args, strict=True)), (1.0, {p: own})]))
        return _rowwise(node.op, args)

    for tree in trees.values():
        for n in windowed(tree):
            level.setdefault(n, 1 + max((level[m] for c in n.children for m in windowed(c)), default=0))
    if any(n.op in ("TsArgmax", "TsArgmin") for n in level):
        df = df.withColumn("_row", F.row_number().over(by))
    count = 0
    for depth in range(1, max(level.values(), default=0) + 1):
        now = [n for n, d in level.items() if d == depth]
        staged: dict[object, Dual] = {}
        columns: dict[str, Column] = {}
        for node in dict.fromkeys(c for n in now for c in n.children):  # operands become columns, once each
            x = dual(node)
            name = f"_x{count}"
            count += 1
            # where the value is missing its derivatives are too, or windows would take in more rows of them
            columns |= {name: x.value, **{f"{name}_{p}": F.when(x.value.isNotNull(), d) for p, d in x.parts.items()}}
            staged[node] = Dual(F.col(name), {p: F.col(f"{name}_{p}") for p in x.parts})
        df = df.withColumns(columns)
        values, slopes, means = {}, {}, {}
        for n in now:
            args, name = [staged[c] for c in n.children], f"_y{count}"
            count += 1
            parts: dict[int, Column] = {}
            if n.op == "Ema":
                means[name] = (args[0].value, n.params[0])
                means |= {f"{name}_{p}": (d, n.params[0]) for p, d in args[0].parts.items()}
                parts = args[0].parts
            elif n.op in PAIR:
                values[name] = PAIR[n.op](args[0].value, args[1].value, by, *n.params)
                parts = _pairwise(n.op, *args, by, *n.params, F.col(name)) if n.op in ("TsCov", "TsCorr", "TsBeta", "TsResidual") else {}
            elif n.op == "RollNorm":
                rows = by.rowsBetween(-n.params[0], -1)
                values |= {name: WINDOW[n.op](args[0].value, by, *n.params), f"{name}_m": F.avg(args[0].value).over(rows), f"{name}_s": F.stddev_samp(args[0].value).over(rows)}
                parts = _roll_norm(args[0], by, *n.params, F.col(name), F.col(f"{name}_m"), F.col(f"{name}_s"))
            else:
                values[name] = WINDOW[n.op](args[0].value, by, *n.params)
                parts = UNARY[n.op](args[0], by, *n.params, F.col(name)) if n.op in UNARY else {}
            if n.op != "Ema":
                slopes |= {f"{name}_{p}": d for p, d in parts.items()}
            made[n] = Dual(F.col(name), {p: F.col(f"{name}_{p}") for p in parts})
        df = df.withColumns(values) if values else df
        df = df.withColumns(slopes) if slopes else df
        df = compiler.with_means(df, means) if means else df
    return df, {name: dual(tree) for name, tree in trees.items()}


# --- the score and its gradient


def _labelled(panel: DataFrame, options: Options) -> DataFrame:
    names = [c for c, t in panel.dtypes if c not in compiler.KEYS and t in ("double", "float", "int", "bigint")]
    panel = future_return(panel, options.method)
    aliases = {"oi": "position"} if "oi" not in names else {"position": "oi"} if "position" not in names else {}
    df = compiler.clean(panel, names)
    return df.withColumns({a: F.col(b) for a, b in aliases.items() if b in names})


def _series(df: DataFrame, models: Mapping[str, Parametric], theta: list[float], how: Refine, search) -> DataFrame:
    """(instrument_id, time, tree, place, y, f, d): for each row, tree and parameter (place -1: none) the factor and its derivative."""
    df, made = duals(df, {k: Node("RollNorm", (m.soft,), (60, 20, 1e-6, 3.0)) for k, m in models.items()}, theta, how.spread)
    limit = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(-20.0), F.least(F.lit(20.0), c)))
    cells = []
    for k, (_, x) in enumerate(made.items()):
        inside = F.abs(x.value) < 20
        cells.append(F.struct(F.lit(k).alias("tree"), F.lit(-1).alias("place"), limit(x.value).alias("f"), F.lit(0.0).alias("d")))
        cells += [F.struct(F.lit(k).alias("tree"), F.lit(p).alias("place"), limit(x.value).alias("f"), F.when(inside, d).otherwise(0.0).alias("d")) for p, d in sorted(x.parts.items())]
    long = df.where("future_ret is not null").select("instrument_id", "time", clipped(F.col("future_ret"), 1.0).alias("y"), F.explode(F.array(*cells)).alias("c")).select("instrument_id", "time", "y", "c.*")
    rows = Window.partitionBy("instrument_id", "tree", "place")
    return long.where("f is not null").withColumn("_rows", F.count(F.lit(1)).over(rows)).where(F.col("_rows") >= search.min_rows).drop("_rows")


def _over(x: Column, y: Column) -> Column:
    return F.when(y > 1e-12, x / y)


def score_gradients(series: DataFrame, fitness: Mapping[str, float], options: Options) -> DataFrame:
    """(tree, place, score, slope) of a frame of factors and derivatives: the weighted means of the metrics over
    instruments and years, and their derivatives."""
    unknown = [m for m in fitness if m not in SMOOTH]
    if unknown:
        raise ValueError(f"no gradient is defined for {', '.join(unknown)}")
    df, keys, days = series.withColumn("year", F.year("time")), ["tree", "place", "instrument_id"], float(metrics.DAYS)
    df = df.withColumns({"g": F.col("f") * F.col("y"), "dg": F.col("d") * F.col("y")})
    if any(m.startswith("Net") or m == "Turnover" for m in fitness):
        by = Window.partitionBy(*keys).orderBy("time")
        step = lambda c: F.col(c) - F.coalesce(F.lag(c).over(by), F.lit(0.0))
        df = df.withColumns({"_step": step("f"), "_dstep": step("d")}).withColumns({"t": F.abs("_step"), "dt": F.signum("_step") * F.col("_dstep")})
        fee = metrics.fee_of(options.fees)
        df = df.withColumns({"n": F.col("g") - fee * F.col("t"), "dn": F.col("dg") - fee * F.col("dt")})
    cov = lambda a, b: F.covar_samp(a, b)
    sums = {"cfy": cov("f", "y"), "sf": F.stddev_samp("f"), "sy": F.stddev_samp("y"), "cdy": cov("d", "y"), "cfd": cov("f", "d")}
    for k in ("g", "n"):
        if k in df.columns:
            sums |= {f"m_{k}": F.avg(k) * days, f"dm_{k}": F.avg(f"d{k}") * days, f"s_{k}": F.stddev_samp(k) * days**0.5, f"c_{k}": cov(k, f"d{k}") * days}
    if "t" in df.columns:
        sums |= {"m_t": F.avg("t"), "dm_t": F.avg("dt")}
    year = df.groupBy(*keys, "year").agg(*(c.alias(n) for n, c in sums.items()))
    c = F.col
    spread = F.when((c("sf") > 1e-12) & (c("sy") > 1e-12), c("sf") * c("sy"))
    year = year.withColumn("ic", c("cfy") / spread).withColumn("dic", c("cdy") / spread - c("ic") * c("cfd") / F.pow(c("sf"), 2.0))
    pairs: dict[str, tuple[Column, Column]] = {"TS IC": (c("ic"), c("dic"))}
    for k, name in (("g", "Gross"), ("n", "Net")):
        m, dm, s = c(f"m_{k}"), c(f"dm_{k}"), c(f"s_{k}")
        ds = _over(c(f"c_{k}"), s)
        pairs |= {f"{name} Return": (m, dm), f"{name} Volatility": (s, ds), f"{name} Sharpe": (_over(m, s), _over(dm, s) - _over(m, s) * _over(ds, s))}
    pairs["Turnover"] = (c("m_t"), c("dm_t"))
    yearly = [m for m in fitness if m != "TS ICIR"]
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    of = lambda k: sum((zero(pairs[m][k]) * fitness[m] for m in yearly), F.lit(0.0))
    year = year.withColumns({"_score": of(0), "_slope": of(1)})
    # the ratio of the coefficients is one of each instrument's years; other metrics are means over instruments and years
    one = year.groupBy(*keys).agg(F.sum("_score").alias("a"), F.sum("_slope").alias("b"), F.count(F.lit(1)).alias("years"), F.count("ic").alias("ics"), F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), F.avg("dic").alias("dm"), F.covar_samp("ic", "dic").alias("cd"))
    ratio = F.when(c("ics") >= 2, c("m") / (c("s") + 1e-6))
    dratio = F.when(c("ics") >= 2, c("dm") / (c("s") + 1e-6) - c("m") * zero(_over(c("cd"), c("s"))) / F.pow(c("s") + 1e-6, 2.0))
    w = float(fitness.get("TS ICIR", 0.0))
    return one.groupBy("tree", "place").agg((F.sum("a") / F.sum("years") + w * zero(F.avg(ratio))).alias("score"), (F.sum("b") / F.sum("years") + w * zero(F.avg(dratio))).alias("slope"))


def gradients(panel: DataFrame, models: Mapping[str, Parametric], search, how: Refine, options: Options = Options(), prepared: bool = False) -> DataFrame:
    """(tree, place, score, slope) of the models (in order) at their parameters' present values: one job."""
    theta = [p.value for m in models.values() for p in m.params]
    df = panel if prepared else _labelled(panel, options)
    return score_gradients(_series(df, models, theta, how, search), search.fitness, options)


class _Steps:
    """An optimiser's memory for one tree: upward steps from gradients of bounded length."""

    def __init__(self, model: Parametric, how: Refine):
        self.model, self.how, self.t = model, how, 0
        self.first, self.second = [0.0] * len(model.params), [0.0] * len(model.params)
        self.best, self.kept, self.still = -math.inf, [p.value for p in model.params], 0

    def seen(self, score: float) -> bool:
        """Keeps the best parameters; False once patience is over."""
        if score > self.best + 1e-9:
            self.best, self.kept, self.still = score, [p.value for p in self.model.params], 0
        else:
            self.still += 1
        return self.still < self.how.patience

    def move(self, slopes: list[float]) -> None:
        size = math.sqrt(sum(s * s for s in slopes))
        if size == 0 or not math.isfinite(size):
            return
        scale, self.t = min(1.0, self.how.clip / size), self.t + 1
        for k, (p, s) in enumerate(zip(self.model.params, slopes, strict=True)):
            g, rate = s * scale, self.how.window_rate if p.kind == "window" else self.how.rate
            match self.how.optimiser:
                case "sgd":
                    step = g
                case "adagrad":
                    self.second[k] += g * g
                    step = g / (math.sqrt(self.second[k]) + 1e-8)
                case "rmsprop":
                    self.second[k] = 0.99 * self.second[k] + 0.01 * g * g
                    step = g / (math.sqrt(self.second[k]) + 1e-8)
                case _:
                    self.first[k] = 0.9 * self.first[k] + 0.1 * g
                    self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
                    step = self.first[k] / (1 - 0.9**self.t) / (math.sqrt(self.second[k] / (1 - 0.999**self.t)) + 1e-8)
            p.value += rate * step
            if p.kind == "window":
                p.value = min(max(p.value, p.choices[0]), p.choices[-1])

    def settle(self) -> None:
        for p, v in zip(self.model.params, self.kept, strict=True):
            p.value = v


#: Parameters of the trees in one plan at most, for the size of generated code.
BATCH = 60


def climbed(panel: DataFrame, trees: Iterable, search, how: Refine, options: Options = Options()) -> dict[str, tuple[object, float, float]]:
    """formula -> (materialised tree, score at the start, best score on the way); trees move together, one job a step.

    Trees without parameters come back as they are."""
    df = _labelled(panel, options).persist()
    out: dict[str, tuple[object, float, float]] = {}
    batch: list = []
    todo = {str(t): t for t in trees}
    for k, (f, t) in enumerate(todo.items()):
        batch.append((f, t))
        if k + 1 < len(todo) and sum(len(Parametric(x, how).params) for _, x in batch) < BATCH:
            continue
        models, first = {}, 0
        for name, tree in batch:
            models[name] = Parametric(tree, how, first)
            first += len(models[name].params)
        out |= _climb(df, models, search, how, options)
        batch = []
    df.unpersist()
    return out


def _climb(df: DataFrame, models: dict[str, Parametric], search, how: Refine, options: Options) -> dict[str, tuple[object, float, float]]:
    states = {f: _Steps(m, how) for f, m in models.items()}
    starts: dict[str, float] = {}
    active = {f: m for f, m in models.items() if m.params}
    for _ in range(how.steps + 1):
        if not active:
            break
        # the parameters' places count from the first active tree
        first = 0
        for f, m in active.items():
            if m.first != first:
                fresh = Parametric(m.tree, how, first)
                for p, q in zip(fresh.params, m.params, strict=True):
                    p.value = q.value
                active[f] = models[f] = states[f].model = fresh
            first += len(m.params)
        found = {(r["tree"], r["place"]): r for r in gradients(df, active, search, how, options, prepared=True).collect()}
        going = {}
        for k, (f, m) in enumerate(active.items()):
            row = found.get((k, -1))
            if row is None:
                continue
            starts.setdefault(f, row["score"])
            if states[f].seen(row["score"]):
                slopes = [(found[k, m.first + j]["slope"] if (k, m.first + j) in found else 0.0) for j in range(len(m.params))]
                if any(slopes):
                    states[f].move(slopes)
                    going[f] = m
        active = going
    for s in states.values():
        s.settle()
    return {f: (models[f].materialised(), starts.get(f, 0.0), max(states[f].best, starts.get(f, 0.0))) for f in models}


def refined(panel: DataFrame, trees: Mapping[str, tuple[float, int]], search, how: Refine = Refine(), options: Options = Options()) -> dict[str, tuple[str, float, int]]:
    """formula -> (formula, fitness, sign) after refinement of scored formulas (fitness, sign): the refined one only where
    the search's fitness of it, windows rounded, is not below that of the original."""
    from .mining import fitness, valid

    signed = {f: parse(f) if sign > 0 else Node("Neg", (parse(f),)) for f, (_, sign) in trees.items()}
    found = climbed(panel, signed.values(), search, how, options)
    new = {}
    for f, t in signed.items():
        made = found[str(t)][0]
        made = made.children[0] if trees[f][1] < 0 and isinstance(made, Node) and made.op == "Neg" else made
        if isinstance(made, Node) and str(made) != f and valid(made, search, extra=2):
            new[f] = made
    scored = fitness(panel, new.values(), search, options) if new else {}
    out = {f: (f, *trees[f]) for f in trees}
    for f, made in new.items():
        value, sign = scored[str(made)]
        if value >= trees[f][0]:
            out[f] = (str(made), value, sign)
    return out
