"""Formula search: typed genetic programming, seeded; each generation is scored as one Spark job."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Mapping
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics

from ..functions.formula import FIELDS, SPECS, Const, Field, Kind, Node, depth, field_kind, kind_of, parse
from ..functions.scalars import root_symbol, sanitised
from ..operators.compiler import evaluate
from .backtest import Options, labelled
from .refine import Refine, refined
from .runs import Run


@dataclass(frozen=True)
class Search:
    population: int = 40
    generations: int = 4
    max_depth: int = 4
    windows: tuple[int, ...] = (3, 5, 10, 20, 30)
    tournament: int = 4
    crossover: float = 0.6
    mutation: float = 0.3
    constants: float = 0.1
    depth_penalty: float = 0.001
    related: float = 0.9
    elite: int = 10
    patience: int = 5
    refine: int = 0
    gradient: Refine | None = None
    depth_start: int = 0
    depth_linear: float = 0.0
    depth_quadratic: float = 0.0
    small_factor: float = 0.0
    capital: float = 1_000_000.0
    multipliers: Mapping[str, float] = field(default_factory=dict)
    consistency: float = 0.0
    min_rows: int = 50
    shock_after: int = 2
    shock_length: int = 2
    shock_fresh: float = 0.3
    seed: int = 1
    fitness: Mapping[str, float] = field(default_factory=lambda: {"TS IC": 1.0})


# How often a grown node is of each group of operators.
MIX = {"binary": 0.45, "unary": 0.25, "unary_ts": 0.17, "binary_ts": 0.08, "conditional": 0.05}


def random_tree(rng: random.Random, search: Search, want: Kind | None = None, level: int = 0):
    """A tree that passes the type rules (of the wanted type, if any); fields where no operator fits."""
    fields = [f for f in FIELDS if want in (None, field_kind(f))]
    if level >= search.max_depth - 1 or level and rng.random() < 0.25:
        if want is Kind.RATIO and rng.random() < search.constants:
            return Const(round(rng.uniform(-2, 2), 3))
        if fields:
            return Field(rng.choice(fields))
    groups: dict[str, list[str]] = {}
    for s in SPECS.values():
        groups.setdefault(s.group, []).append(s.name)
    mix = {g: w for g, w in MIX.items() if g in groups}
    for _ in range(60):
        spec = SPECS[rng.choice(groups[rng.choices(list(mix), list(mix.values()))[0]])]
        kids = tuple(random_tree(rng, search, None, level + 1) for _ in range(spec.operands))
        if any(isinstance(k, Const) for k in kids) and all(isinstance(k, Const) for k in kids):
            continue
        tree = Node(spec.name, kids, tuple(sorted(rng.sample(search.windows, spec.windows)) if spec.windows > 1 else (rng.choice(search.windows) for _ in range(spec.windows))))
        try:
            kind = kind_of(tree)
        except TypeError:
            continue
        if want in (None, kind):
            return tree
    return Field(rng.choice(fields or FIELDS))


def places(tree, path: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], object]]:
    """(path, subtree) of each node, from the root."""
    out = [(path, tree)]
    if isinstance(tree, Node):
        for k, c in enumerate(tree.children):
            out += places(c, (*path, k))
    return out


def replaced(tree, path: tuple[int, ...], new):
    if not path:
        return new
    kids = list(tree.children)
    kids[path[0]] = replaced(kids[path[0]], path[1:], new)
    return Node(tree.op, tuple(kids), tree.params)


def valid(tree, search: Search, extra: int = 0) -> bool:
    try:
        kind_of(tree)
    except TypeError:
        return False
    return isinstance(tree, Node) and depth(tree) <= search.max_depth + 1 + extra


def mutated(rng: random.Random, tree, search: Search):
    """A subtree grown anew, windows drawn anew, or a subtree in its parent's place; always of the same type."""
    path, old = rng.choice(places(tree))
    kind = rng.random()
    if kind < 0.4 and isinstance(old, Node) and old.params:
        new = Node(old.op, old.children, tuple(sorted(rng.sample(search.windows, len(old.params)))) if len(old.params) > 1 else (rng.choice(search.windows),))
    elif kind < 0.55 and isinstance(old, Node):
        new = rng.choice(old.children)
    else:
        new = random_tree(rng, search, kind_of(old), len(path))
    out = replaced(tree, path, new)
    return out if valid(out, search) else tree


def crossed(rng: random.Random, a, b, search: Search):
    path, old = rng.choice(places(a))
    fits = [t for _, t in places(b) if kind_of(t) is kind_of(old)]
    out = replaced(a, path, rng.choice(fits)) if fits else a
    return out if valid(out, search) else a


def scores(panel: DataFrame, formulas: Mapping[str, str], search: Search, options: Options = Options()) -> DataFrame:
    """(factor_name, score, tradable) of formulas in one plan.

    Rows without label or factor are left out, then instruments with fewer than min_rows; factors are clipped to 20 and
    returns to 1. The score adds up the metrics' weights times their means over instruments and years (missing ones count
    as 0; metrics of the whole period over instruments). With a consistency penalty it shrinks by the deviation of the
    years' weighted sums relative to their mean. tradable is the share of rows whose factor buys a lot, by capital and
    multiplier, where they are known."""
    lot = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in search.multipliers.items() for x in pair)), root_symbol(F.col("instrument_id"))), F.lit(None).cast("double")) if search.multipliers else F.lit(None).cast("double")
    frame = labelled(panel, formulas, options, check=False, more=("open",)).dropna(subset=["factor_value", "future_ret"])
    frame = frame.withColumn("_least", F.col("open") * lot / search.capital).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*metrics.SERIES)))
    tradable = frame.where("_least > 0").groupBy("factor_name").agg(F.avg((F.abs("factor_value") >= F.col("_least")).cast("double")).alias("tradable"))
    series = metrics.daily(sanitised(frame.where(F.col("_rows") >= search.min_rows).drop("_rows", "_least", "open")), options.fees, rollover_cost=False)
    summary = metrics.summary(series, options.interest, options.calmar)
    yearly = F.col("year") != "all"
    value = lambda m: F.coalesce(F.col(f"`{m}`"), F.lit(0.0))
    mean = {m: F.avg(F.when(~yearly, F.col(f"`{m}`")) if m.endswith("IR") else F.when(yearly, value(m))) for m in search.fitness}
    of_year = sum((value(m) * w for m, w in search.fitness.items() if not m.endswith("IR")), F.lit(0.0))
    of_years = F.when(yearly, of_year)
    total = sum((F.coalesce(mean[m], F.lit(0.0)) * w for m, w in search.fitness.items()), F.lit(0.0))
    shrunk = F.when(F.count(of_years) >= 2, F.greatest(F.lit(0.0), 1 - search.consistency * F.stddev_samp(of_years) / (F.abs(F.avg(of_years)) + 1e-8))).otherwise(1.0) if search.consistency else F.lit(1.0)
    return summary.groupBy("factor_name").agg((total * shrunk).alias("score")).join(tradable, "factor_name", "left")


def depth_penalty(levels: int, search: Search) -> float:
    """Linear in the depth, and beyond depth_start linear and quadratic in what exceeds it."""
    extra = max(levels - search.depth_start, 0)
    return search.depth_penalty * levels + search.depth_linear * extra + search.depth_quadratic * extra * extra


def fitness(panel: DataFrame, trees: Iterable, search: Search, options: Options = Options()) -> dict[str, tuple[float, int]]:
    """formula -> (penalised fitness, sign) of the normalised factor and the better of both signs, less the penalties for
    depth and for factors too small to trade. Both signs of all trees are rows of one job."""
    found = {str(t): t for t in trees}
    norm = "RollNorm({}, 60, 20, 1e-06, 3)".format
    formulas = {f"+{f}": norm(f) for f in found} | {f"-{f}": norm(f"Neg({f})") for f in found}
    scored = {r["factor_name"]: r for r in scores(panel, formulas, search, options).collect()}
    out: dict[str, tuple[float, int]] = {}
    for f, t in found.items():
        both = [((r["score"] if (r := scored.get(f"{s}{f}")) else 0.0), k, r) for s, k in (("+", 1), ("-", -1))]
        value, sign, row = max(both, key=lambda x: x[0])
        small = search.small_factor * (1 - row["tradable"]) if row and row["tradable"] is not None else 0.0
        out[f] = (value - depth_penalty(depth(t), search) - small, sign)
    return out


def correlations(panel: DataFrame, formulas: list[str], least: int = 10) -> dict[tuple[int, int], float]:
    """Absolute correlation of each pair of formulas over the rows that both have, 0 where these are fewer than least."""
    pairs = [(i, j) for i in range(len(formulas)) for j in range(i)]
    if not pairs:
        return {}
    wide = evaluate(panel, {f"c{k}": f for k, f in enumerate(formulas)})
    known = lambda i, j: F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull()

    def one(i: int, j: int):
        x, y = (F.when(known(i, j), F.col(f"c{k}")) for k in (i, j))
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.when((F.count(x) >= least) & (F.stddev_pop(x) >= 1e-12) & (F.stddev_pop(y) >= 1e-12), F.abs(F.covar_pop(x, y) / spread))

    out: dict[tuple[int, int], float] = {}
    for k in range(0, len(pairs), 500):
        row = wide.agg(*(one(i, j).alias(f"p{n}") for n, (i, j) in enumerate(pairs[k : k + 500]))).first()
        out |= {p: row[f"p{n}"] or 0.0 for n, p in enumerate(pairs[k : k + 500])}
    return out


@dataclass
class Archive:
    """The elite: formulas with their fitness, none of which correlates with another by more than the limit (a school).

    A newcomer that is better than all of its school takes their place, else it goes. One of a new school comes in
    while there is room, and then only by being better than the worst, which goes."""

    size: int
    related: float
    held: dict[str, float] = field(default_factory=dict)

    def admit(self, formula: str, value: float, near: Callable[[str, str], float]) -> bool:
        if formula in self.held:
            return False
        school = [f for f in self.held if near(formula, f) > self.related]
        if school:
            if value <= max(self.held[f] for f in school):
                return False
            gone = school
        elif len(self.held) < self.size:
            gone = []
        else:
            worst = min(self.held, key=lambda f: (self.held[f], f))
            if value <= self.held[worst]:
                return False
            gone = [worst]
        self.held = {f: v for f, v in self.held.items() if f not in gone} | {formula: value}
        return True

    def admit_all(self, panel: DataFrame, scored: Mapping[str, tuple[float, int]]) -> int:
        """Newcomers with a positive fitness, best first; the correlations of so many of them at a time are one job."""
        new = sorted((f for f in scored if scored[f][0] > 0 and f not in self.held), key=lambda f: (-scored[f][0], f))
        many = 0
        for at in range(0, len(new), 4 * self.size):
            part = new[at : at + 4 * self.size]
            names = [*self.held, *part]
            place = {f: k for k, f in enumerate(names)}
            found = correlations(panel, names)
            near = lambda a, b: found[max(place[a], place[b]), min(place[a], place[b])]  # noqa: E731, B023
            many += sum(self.admit(f, scored[f][0], near) for f in part)
        return many

    def best(self) -> list[str]:
        return sorted(self.held, key=lambda f: (-self.held[f], f))


def neighbours(tree, search: Search) -> list:
    """The tree with one window moved to the next choice or one constant scaled: steps of a coordinate search."""
    out = []
    for path, node in places(tree):
        if isinstance(node, Const):
            out += [replaced(tree, path, Const(node.value * s)) for s in (0.8, 1.25)]
        elif isinstance(node, Node):
            for k, w in enumerate(node.params):
                near = [c for c in search.windows if c != w]
                out += [replaced(tree, path, Node(node.op, node.children, (*node.params[:k], c, *node.params[k + 1 :]))) for c in sorted(near, key=lambda c: abs(c - w))[:2]]
    return [t for t in out if valid(t, search)]


def _climbed(panel: DataFrame, made: Mapping[str, tuple[float, int]], search: Search, options: Options, trees: dict | None = None) -> dict[str, tuple[float, int]]:
    """What the gradient finds better than the scored formulas, which it replaces in the generation (trees), if given."""
    out = {}
    for old, (new, value, sign) in refined(panel, made, search, search.gradient, options).items():
        if new != old:
            out[new] = (value, sign)
            if trees is not None and old in trees:
                trees.pop(old)
                trees[new] = parse(new)
    return out


def _stored(rng: random.Random, trees: Mapping[str, object], scored: Mapping[str, tuple[float, int]], elite: Archive, best: float, still: int, shaken: int) -> dict:
    return {"rng": rng.getstate(), "trees": list(trees), "scored": [[f, *v] for f, v in scored.items()], "held": elite.held, "best": best, "still": still, "shaken": shaken}


def mine(panel: DataFrame, search: Search = Search(), options: Options = Options(), run: Run | None = None) -> list[tuple[str, float]]:
    """(formula, fitness) of the archive, best first; the same for the same seed.

    A search that stands still for shock_after generations is shaken for shock_length: it mutates twice as often and a
    share of each generation is grown anew. It ends after patience generations without a better fitness.

    With a run each generation is stored: a stopped search returns what its archive has, and goes on from there when it is
    started again."""
    rng = random.Random(search.seed)
    panel = panel.persist()
    grown = lambda n: {str(t): t for t in (random_tree(rng, search) for _ in range(3 * n)) if isinstance(t, Node)}
    scored: dict[str, tuple[float, int]] = {}
    elite = Archive(search.elite, search.related)
    best, still, shaken, first = float("-inf"), 0, 0, 0
    held = run.latest() if run else None
    if held:
        version, words, gauss = held["rng"]
        rng.setstate((version, tuple(words), gauss))
        trees = {f: parse(f) for f in held["trees"]}
        scored = {f: (v, sign) for f, v, sign in held["scored"]}
        elite.held, best, still, shaken, first = held["held"], held["best"], held["still"], held["shaken"], held["next"]
    else:
        trees = dict(list(grown(search.population).items())[: search.population])

    def note(number: int, state: str) -> None:
        if run:
            run.log(number, search.generations, state, best, len(scored), len(elite.held))

    def result() -> list[tuple[str, float]]:
        panel.unpersist()
        return [(f if scored[f][1] > 0 else f"Neg({f})", scored[f][0]) for f in elite.best()]

    try:
        with run.tagged() if run else nullcontext():
            for number in range(first, search.generations):
                if run and run.stopping():
                    note(number, "stopped")
                    return result()
                fresh = [t for f, t in trees.items() if f not in scored]
                made = fitness(panel, fresh, search, options) if fresh else {}
                if search.gradient and search.gradient.every and (number + 1) % search.gradient.every == 0:
                    made |= _climbed(panel, made, search, options, trees)
                scored |= made
                elite.admit_all(panel, made)
                top = max(scored[f][0] for f in trees)
                still = 0 if top > best + 1e-12 else still + 1
                best = max(best, top)
                last = still >= search.patience
                if not last:
                    shaken = search.shock_length if still >= search.shock_after and not shaken else max(0, shaken - 1)
                    trees = _next(rng, trees, scored, search, bool(shaken), grown)
                if run:
                    run.save(number, _stored(rng, trees, scored, elite, best, still, shaken) | {"next": search.generations if last else number + 1})
                note(number, "running")
                if last:
                    break
            for _ in range(search.refine):
                steps = {str(n): n for f in elite.best() for n in neighbours(parse(f), search)}
                fresh = [t for f, t in steps.items() if f not in scored]
                if not fresh:
                    break
                made = fitness(panel, fresh, search, options)
                scored |= made
                elite.admit_all(panel, made)
            if search.gradient and not search.gradient.every and elite.held:
                made = _climbed(panel, {f: scored[f] for f in elite.best()}, search, options)
                scored |= made
                elite.admit_all(panel, made)
    except Exception:
        # cancelled jobs raise: what has been stored stands, and the search says that it was stopped
        if not (run and run.stopping()):
            note(first, "failed")
            raise
        note(first, "stopped")
        return result()
    note(search.generations, "done")
    return result()


def _next(rng: random.Random, trees: Mapping[str, object], scored: Mapping[str, tuple[float, int]], search: Search, shaken: bool, grown: Callable[[int], dict]) -> dict:
    """The next generation: the best as they are, when shaken new ones, and children of tournaments' winners."""
    ranked = sorted(trees, key=lambda f: (-scored[f][0], f))
    pick = lambda: trees[min(rng.sample(ranked, min(search.tournament, len(ranked))), key=ranked.index)]
    rate = min(1.0, search.mutation * (2 if shaken else 1))
    new = {f: trees[f] for f in ranked[: max(1, search.population // 10)]}
    if shaken:
        new |= dict(list(grown(search.population).items())[: int(search.population * search.shock_fresh)])
    for _ in range(20 * search.population):
        if len(new) >= search.population:
            break
        child = crossed(rng, pick(), pick(), search) if rng.random() < search.crossover else pick()
        child = mutated(rng, child, search) if rng.random() < rate else child
        new[str(child)] = child
    return new


def named(found: list[tuple[str, float]]) -> dict[str, str]:
    """Names by fitness: fac_gp_0001 is the best."""
    return {f"fac_gp_{k:04d}": f for k, (f, _) in enumerate(sorted(found, key=lambda x: (-x[1], x[0])), 1)}
