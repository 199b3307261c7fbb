"""The formula language: nodes, whitelisted parsing, printing, semantic types, rewriting to core operators."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from enum import Enum

FIELDS = ("open", "high", "low", "close", "volume", "position")


class Kind(str, Enum):
    """Semantic types; values are stored as doubles whatever their type."""

    PRICE = "price"
    VOLUME = "volume"
    OI = "oi"
    RETURN = "return"
    VOLATILITY = "volatility"
    RATIO = "ratio"
    BOOLEAN = "boolean"
    GENERIC = "generic"


@dataclass(frozen=True)
class Node:
    """A call of an operator: its name, its operands, its literal parameters."""

    op: str
    children: tuple = ()
    params: tuple = ()

    def __str__(self) -> str:
        return f"{self.op}({', '.join([*map(str, self.children), *(f'{p:.6g}' if isinstance(p, float) else str(p) for p in self.params)])})"


@dataclass(frozen=True)
class Field:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    value: float

    def __str__(self) -> str:
        return f"{self.value:.6g}"


def field_kind(name: str) -> Kind:
    """The semantic type that a column's name stands for."""
    key = name.strip().lower()
    known = {"open": Kind.PRICE, "high": Kind.PRICE, "low": Kind.PRICE, "close": Kind.PRICE, "volume": Kind.VOLUME, "position": Kind.OI, "oi": Kind.OI}
    if key in known:
        return known[key]
    for kind, starts, ends in (
        (Kind.RETURN, ("ret_", "log_ret_", "oi_chg_"), ()),
        (Kind.VOLATILITY, ("volatility_", "volume_std_"), ()),
        (Kind.RATIO, ("volume_zscore_", "turnover_shock_"), ("_ratio",)),
    ):
        if key.startswith(starts) or ends and key.endswith(ends):
            return kind
    return Kind.GENERIC


# --- type rules: a rule takes the operands' types and gives the result's, or raises TypeError


def _same(out: Kind | None = None, allow_boolean: bool = True) -> Callable:
    def rule(*kinds: Kind) -> Kind:
        if len(set(kinds)) != 1:
            raise TypeError(f"operands must be of one type, not {[k.value for k in kinds]}")
        if kinds[0] is Kind.BOOLEAN and not allow_boolean:
            raise TypeError("boolean operands are not accepted")
        return out or kinds[0]

    return rule


def _any(out: Kind | None = None) -> Callable:
    return lambda *kinds: out or kinds[0]


def _of(out: Kind, *accepted: Iterable[Kind]) -> Callable:
    def rule(*kinds: Kind) -> Kind:
        for k, allowed in zip(kinds, accepted, strict=True):
            if k not in allowed:
                raise TypeError(f"expected {'/'.join(sorted(a.value for a in allowed))}, got {k.value}")
        return out

    return rule


def _mul(a: Kind, b: Kind) -> Kind:
    if Kind.RATIO not in (a, b):
        raise TypeError(f"one factor must be a ratio, not {a.value} * {b.value}")
    return b if a is Kind.RATIO else a


def _div(a: Kind, b: Kind) -> Kind:
    if b is Kind.RATIO:
        return a
    if a is not b:
        raise TypeError(f"cannot divide {a.value} by {b.value}")
    return Kind.RATIO


def _if(c: Kind, a: Kind, b: Kind) -> Kind:
    if c is not Kind.BOOLEAN:
        raise TypeError(f"the condition must be boolean, not {c.value}")
    return _same()(a, b)


_PRICE, _LOTS = {Kind.PRICE}, {Kind.VOLUME, Kind.OI}


@dataclass(frozen=True)
class Spec:
    """An operator: operands, integer windows, type rule."""

    name: str
    operands: int
    windows: int
    rule: Callable
    group: str


def _specs() -> dict[str, Spec]:
    # The language's operators with operands, windows and type rules.
    out: dict[str, Spec] = {}

    def add(group: str, operands: int, windows: int, **rules: Callable) -> None:
        out.update({n: Spec(n, operands, windows, r, group) for n, r in rules.items()})

    plain = _same(allow_boolean=False)
    add("binary", 2, 0, Add=plain, Sub=plain, Mul=_mul, Div=_div, Max=plain, Min=plain, Lt=_same(Kind.BOOLEAN), Gt=_same(Kind.BOOLEAN), OiTrendConviction=_of(Kind.RETURN, _PRICE, {Kind.OI}))
    candle = _of(Kind.RATIO, _PRICE)
    add("unary", 1, 0, SqrtAbs=_any(), Abs=_any(), Inv=_any(Kind.RATIO), Sig=_any(Kind.RATIO), Sign=_any(Kind.RATIO), Delta=_any(), BodyRatio=candle, UpperShadowRatio=candle, LowerShadowRatio=candle, StochasticK=candle, TypicalPrice=_of(Kind.PRICE, _PRICE), Neg=_any())
    add("unary_ts", 1, 1, **dict.fromkeys(("Ema", "TsDecayExp", "TsMean", "TsDelta", "TsDelay", "TsSum", "TsMax", "TsMin", "TsTimeWeightedMean"), _any()))
    add("unary_ts", 1, 1, **dict.fromkeys(("TsArgmax", "TsArgmin", "TsRank", "TsEntropy", "TsSkew", "TsKurt"), _any(Kind.RATIO)))
    add("unary_ts", 1, 1, TsStd=_any(Kind.VOLATILITY), TsPctDelta=_any(Kind.RETURN), Return=_of(Kind.RETURN, _PRICE), LogReturn=_of(Kind.RETURN, _PRICE), Volatility=_of(Kind.VOLATILITY, {Kind.PRICE, Kind.RETURN}))
    add("unary_ts", 1, 1, VolumeStd=_of(Kind.VOLATILITY, _LOTS), VolumeZScore=_of(Kind.RATIO, _LOTS), TurnoverShock=_of(Kind.RATIO, _LOTS))
    add("unary_ts", 1, 1, Bias=candle, RangePosition=candle, PriceAcceleration=_of(Kind.RETURN, _PRICE), TrueAmplitude=candle)
    add("binary_ts", 2, 1, TsCorr=_same(Kind.RATIO), TsRankCorr=_same(Kind.RATIO), TsCov=_same(Kind.GENERIC), TsBeta=_same(Kind.RATIO), TsResidual=_same())
    add("binary_ts", 2, 1, VpDivergence=_of(Kind.RATIO, {Kind.PRICE, Kind.RETURN, Kind.RATIO}, _LOTS), Amihud=_of(Kind.RATIO, _PRICE, {Kind.VOLUME}))
    add("windows", 1, 3, MaRibbon=candle)
    add("conditional", 3, 0, IfElse=_if)
    add("norm", 1, 2, RollNorm=_any(Kind.RATIO))
    add("mean", -1, 0, NanMean=plain)
    return out


SPECS = _specs()
_BY_ALIAS = {n.lower(): n for n in SPECS} | {"".join("_" + c.lower() if c.isupper() else c for c in n).strip("_"): n for n in SPECS} | {"oprollnorm": "RollNorm", "volume_zscore": "VolumeZScore"}


def operator(name: str) -> Spec:
    """An operator by its name or alias, in any case or as snake_case."""
    found = SPECS.get(name) or SPECS.get(_BY_ALIAS.get(name.lower(), ""))
    if found is None:
        raise ValueError(f"unsupported operator `{name}`")
    return found


def describe_operators() -> str:
    """The operators by group, for a prompt."""
    groups: dict[str, list[str]] = {}
    for s in SPECS.values():
        groups.setdefault(f"{s.group} ({s.operands if s.operands >= 0 else '2+'} operands, {s.windows} windows)", []).append(s.name)
    return "\n".join(f"{g}: {', '.join(names)}" for g, names in groups.items())


def _literal(node: ast.AST, what: str, whole: bool) -> float | int:
    if not (isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool)):
        raise ValueError(f"{what} must be a numeric literal")
    value = int(node.value) if whole else float(node.value)
    if value <= 0:
        raise ValueError(f"{what} must be positive, got {value}")
    return value


def parse(formula: str, fields: Iterable[str] = FIELDS):
    """The tree of a formula; ValueError where it isn't one or mixes types."""
    if not isinstance(formula, str) or not formula.strip():
        raise ValueError("a formula is a non-empty string")
    known = set(fields)
    if known & {"position", "oi"}:
        known |= {"position", "oi"}
    try:
        root = ast.parse(formula.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not a formula: {e}") from e

    def build(node: ast.AST):
        match node:
            case ast.Name(id=name):
                if name not in known:
                    raise ValueError(f"unknown field `{name}`")
                return Field(name)
            case ast.Constant(value=v) if isinstance(v, (int, float)) and not isinstance(v, bool):
                return Const(float(v))
            case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=v)) if isinstance(v, (int, float)):
                return Const(-float(v))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                spec = operator(name)
                if spec.name == "NanMean":
                    if len(args) < 2:
                        raise ValueError("NanMean takes at least 2 operands")
                    return Node("NanMean", tuple(map(build, args)))
                extra = 2 if spec.name == "RollNorm" else 0
                if len(args) != spec.operands + spec.windows + extra:
                    raise ValueError(f"{name} takes {spec.operands + spec.windows + extra} arguments, got {len(args)}")
                whole = [_literal(a, f"{name}'s window", True) for a in args[spec.operands : spec.operands + spec.windows]]
                more = [_literal(a, f"{name}'s parameter", False) for a in args[spec.operands + spec.windows :]]
                return Node(spec.name, tuple(build(a) for a in args[: spec.operands]), (*whole, *more))
        raise ValueError(f"unsupported in a formula: {ast.dump(node)}")

    tree = build(root)
    try:
        kind_of(tree)
    except TypeError as e:
        raise ValueError(f"types don't fit in {formula}: {e}") from e
    return tree


def kind_of(node) -> Kind:
    if isinstance(node, Field):
        return field_kind(node.name)
    if isinstance(node, Const):
        return Kind.RATIO
    return SPECS[node.op].rule(*map(kind_of, node.children))


def wrap_norm(formula: str, window: int = 243, min_periods: int = 60, eps: float = 1e-6, clip: float = 6.0) -> str:
    """The formula inside RollNorm, unless it is one already."""
    tree = parse(formula)
    return formula if isinstance(tree, Node) and tree.op == "RollNorm" else f"RollNorm({formula}, {window}, {min_periods}, {eps:g}, {clip:g})"


def fused(formulas: list[str]) -> str:
    """One formula for the equal-weight mean of several."""
    return formulas[0] if len(formulas) == 1 else f"NanMean({', '.join(formulas)})"


# --- rewriting: composed operators become core ones, so that equal parts are computed once


def _n(op: str, *children, **kw) -> Node:
    return Node(op, children, tuple(kw.get("p", ())))


def core(node):
    """The tree in core operators (those that operators/ compiles)."""
    if not isinstance(node, Node):
        return node
    kids = tuple(map(core, node.children))
    x, p = (kids[0] if kids else None), node.params
    w = {"p": p[:1]}
    high, low = Field("high"), Field("low")
    match node.op:
        case "Delta":
            return _n("Sub", x, _n("Lag", x, p=(1,)))
        case "TsDelta":
            return _n("Sub", x, _n("Lag", x, **w))
        case "TsDelay":
            return _n("Lag", x, **w)
        case "TsPctDelta" | "Return":
            return _n("Change", _n("Pad", x), _n("Lag", _n("Pad", x), **w))
        case "LogReturn":
            return _n("Sub", _n("Ln", x), _n("Lag", _n("Ln", x), **w))
        case "Volatility":
            if kind_of(node.children[0]) is Kind.PRICE:
                x = _n("Change", _n("Pad", x), _n("Lag", _n("Pad", x), p=(1,)))
            return _n("TsStd", x, **w)
        case "VolumeStd":
            return _n("TsStd", x, **w)
        case "Bias" | "TurnoverShock":
            return _n("Change", x, _n("TsMean", x, **w))
        case "VolumeZScore":
            return _n("Div", _n("Sub", x, _n("TsMean", x, **w)), _n("TsStd", x, **w))
        case "RangePosition":
            bottom = _n("TsMin", low, **w)
            return _n("Div", _n("Sub", x, bottom), _n("Add", _n("Sub", _n("TsMax", high, **w), bottom), Const(1e-8)))
        case "PriceAcceleration":
            d = _n("Sub", x, _n("Lag", x, **w))
            return _n("Sub", d, _n("Lag", d, **w))
        case "TrueAmplitude":
            return _n("Div", _n("Sub", high, low), _n("Lag", x, **w))
        case "TsDecayExp":
            return _n("Ema", x, **w)
        case "MaRibbon":
            return _n("Ribbon", *(_n("TsMean", x, p=(k,)) for k in p))
        case "OiTrendConviction":
            return _n("Mul", _n("Sign", _n("Sub", x, _n("Lag", x, p=(1,)))), _n("Sub", kids[1], _n("Lag", kids[1], p=(1,))))
        case "VpDivergence":
            return _n("TsCorr", *(_n("Sub", k, _n("Lag", k, p=(1,))) for k in kids), **w)
        case "Amihud":
            return _n("TsMean", _n("Div", _n("Div", _n("Abs", _n("Sub", x, _n("Lag", x, p=(1,)))), x), kids[1]), **w)
    return Node(node.op, kids, p)


def depth(node) -> int:
    return 1 + max(map(depth, node.children), default=0) if isinstance(node, Node) else 1
