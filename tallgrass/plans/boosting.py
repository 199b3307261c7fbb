"""Second-order histogram boosting: trees on quantile bins, grown by the best gain from sums of gradients and Hessians.

A table of bin numbers is made once. A tree takes one job a level: each partition adds up the gradients and Hessians of its
rows by node, feature and bin, and a grouped sum of these, whose size depends on nodes, features and bins only, goes to
the driver. All nodes of a level are looked at, so that the leaves can be chosen best gain first afterwards, exactly as if
they had been split one by one. Rows carry their prediction; it is written back once in a few trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOSSES = ("squared", "huber")
#: Bin of a missing value; the others count from 1.
MISSING = 0


@dataclass
class Tree:
    """Nodes by number: node k has the children 2k + 1 and 2k + 2. A row goes left where its bin is at most the split's, a
    missing value where the split sends it."""

    splits: dict[int, tuple[int, int, bool]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def places(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after so many levels; what has come to a leaf stays there."""
        at = np.zeros(len(bins), np.int64)
        if not self.splits:
            return at
        size = max(self.splits) + 1
        feature, limit, left = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, bool)
        for k, (f, b, missing_left) in self.splits.items():
            feature[k], limit[k], left[k] = f, b, missing_left
        for _ in range(depth):
            open_ = np.flatnonzero(at < size)
            open_ = open_[limit[at[open_]] >= 0]
            if not len(open_):
                break
            k = at[open_]
            b = bins[open_, feature[k]]
            go_left = np.where(b == MISSING, left[k], b <= limit[k])
            at[open_] = 2 * k + 2 - go_left
        return at

    def predicted(self, bins: np.ndarray, depth: int) -> np.ndarray:
        at = self.places(bins, depth)
        nodes = np.array(sorted(self.values), np.int64)
        return np.array([self.values[k] for k in nodes.tolist()])[np.searchsorted(nodes, at)]


def slopes(prediction: np.ndarray, label: np.ndarray, loss: str, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the prediction; huber is the smooth form, with bends at delta."""
    r = prediction - label
    if loss == "squared":
        return r, np.ones_like(r)
    root = np.sqrt(1 + (r / delta) ** 2)
    return r / root, root**-3.0


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of a matrix: 1 + the number of edges below a value, MISSING where there is none."""
    out = np.empty(x.shape, np.int16)
    for k, e in enumerate(edges):
        out[:, k] = np.where(np.isnan(x[:, k]), MISSING, 1 + np.searchsorted(e, x[:, k], "left"))
    return out


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, l2: float, least_gain: float, least_rows: int) -> tuple[float, int, int, bool] | None:
    """(gain, feature, bin, missing goes left) of a node from its sums by feature and bin; None where nothing gains.

    Of equal gains the first feature, the lowest bin, and missing values on the right win."""
    total_g, total_h, total_n = g[0].sum(), h[0].sum(), n[0].sum()
    best = None
    for f in range(len(g)):
        for missing_left in (False, True):
            if missing_left and not n[f, MISSING]:
                continue
            lg, lh, ln = (np.cumsum(a[f, 1:]) + (a[f, MISSING] if missing_left else 0) for a in (g, h, n))
            rg, rh, rn = total_g - lg, total_h - lh, total_n - ln
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = 0.5 * (lg * lg / (lh + l2) + rg * rg / (rh + l2) - total_g * total_g / (total_h + l2))
            gain = np.where((ln >= least_rows) & (rn >= least_rows), gain, -np.inf)
            b = int(np.argmax(gain))
            if gain[b] > max(least_gain, 1e-12) and (best is None or gain[b] > best[0] * (1 + 1e-12)):
                best = (float(gain[b]), f, b + 1, missing_left)
    return best


def chosen_leaves(splits: dict[int, tuple[float, int, int, bool]], leaves: int) -> dict[int, tuple[int, int, bool]]:
    """Of all splits found (by node) those of the tree that is grown best gain first to so many leaves."""
    out, open_ = {}, [0] if 0 in splits else []
    while open_ and len(out) + 1 < leaves:
        k = max(open_, key=lambda j: (splits[j][0], -j))
        open_.remove(k)
        out[k] = splits[k][1:]
        open_ += [c for c in (2 * k + 1, 2 * k + 2) if c in splits]
    return out


def _read(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column("_bins").to_pylist()), np.int16).reshape(-1, features)
    return bins, batch.column("_y").to_numpy(), batch.column("_pred").to_numpy(), batch.column("_hash").to_numpy()


def _kept(hashes: np.ndarray, number: int, share: float) -> np.ndarray:
    """The rows that a tree learns from: a share by a hash of row and tree."""
    if share >= 1:
        return np.ones(len(hashes), bool)
    x = hashes.view(np.uint64) ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53 < share


def _sums(pending: list[Tree], tree: Tree, level: int, number: int, features: int, bins_a_feature: int, how: dict):
    """Per partition the sums of gradients, Hessians and rows by the level's open nodes, features and bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, width = (1 << level) - 1, features * bins_a_feature
        sums = np.zeros((3, (1 << level) * width))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, y, pred, hashes = _read(batch, features)
            pred = pred + sum(t.predicted(bins, how["depth"]) for t in pending)
            node = tree.places(bins, level) - first
            use = (node >= 0) & _kept(hashes, number, how["share"])
            g, h = slopes(pred[use], y[use], how["loss"], how["delta"])
            at = (node[use, None] * width + np.arange(features) * bins_a_feature + bins[use]).ravel()
            for k, v in enumerate((np.repeat(g, features), np.repeat(h, features), np.ones(len(at)))):
                sums[k] += np.bincount(at, v, minlength=sums.shape[1])
        some = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(s[some]) for s in sums)], names=["place", "g", "h", "n"])

    return run


def _moved(pending: list[Tree], features: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins, _, pred, _ = _read(batch, features)
                pred = pred + sum(t.predicted(bins, depth) for t in pending)
                yield pa.RecordBatch.from_arrays([batch.column("_bins"), batch.column("_y"), pa.array(pred), batch.column("_hash")], names=["_bins", "_y", "_pred", "_hash"])

    return run


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), features)


@dataclass
class BoostedModel:
    featuresCol: str
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    depth: int

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the column prediction."""
        features, edges, base, trees, depth, name = len(self.edges), self.edges, self.base, self.trees, self.depth, "_array"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = binned(_matrix(batch.column(name), features), edges)
                out = np.full(len(bins), base)
                for t in trees:
                    out += t.predicted(bins, depth)
                keep = [k for k, c in enumerate(batch.schema.names) if c != name]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out)], names=[*(batch.schema.names[k] for k in keep), "prediction"])

        # vectors do not travel in Arrow batches, and return as what they came from
        vector = dict(df.dtypes)[self.featuresCol] == "vector"
        sent = df.withColumn(name, vector_to_array(self.featuresCol) if vector else F.col(self.featuresCol).cast("array<double>"))
        sent = sent.drop(self.featuresCol) if vector else sent
        rest = [f for f in sent.schema.fields if f.name != name]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "prediction double"])
        return sent.mapInArrow(run, schema)


@dataclass
class HistogramBoosting:
    """fit(df) takes a vector (or array) column of features, in which NaN is missing, and a label.

    l2 is added to a leaf's Hessians, a split must gain least_gain and leave least_rows on either side; share is the share of
    rows, columns that of the features that a tree sees; a tree has leaves leaves and depth levels at most."""

    featuresCol: str = "_x"
    labelCol: str = "future_ret"
    trees: int = 50
    rate: float = 0.1
    depth: int = 5
    leaves: int = 16
    bins: int = 64
    l2: float = 1.0
    least_gain: float = 0.0
    least_rows: int = 20
    loss: str = "squared"
    delta: float = 1.0
    share: float = 1.0
    columns: float = 1.0
    seed: int = 1
    #: Trees after which the rows' predictions are written back.
    hold: int = 10

    def __post_init__(self) -> None:
        if self.loss not in LOSSES:
            raise ValueError(f"unknown loss {self.loss}; there are {', '.join(LOSSES)}")
        if self.depth < 1 or self.leaves < 2 or not 2 <= self.bins <= 1024 or self.trees < 0:
            raise ValueError("depth is 1 at least, leaves 2, bins 2 to 1,024")

    def _edges(self, df: DataFrame, features: int) -> list[np.ndarray]:
        """Inner quantiles of each feature from a sketch, without repetition: a bin each side of every edge."""
        shares = [k / self.bins for k in range(1, self.bins)]
        known = lambda k: F.when(~F.isnan(F.get("_a", k)), F.get("_a", k))
        row = df.agg(*(F.percentile_approx(known(k), shares, 10_000).alias(f"q{k}") for k in range(features))).first()
        return [np.unique(np.array(row[f"q{k}"] or [], float)) for k in range(features)]

    def fit(self, df: DataFrame) -> BoostedModel:
        vector = dict(df.dtypes)[self.featuresCol] == "vector"
        array = vector_to_array(self.featuresCol) if vector else F.col(self.featuresCol).cast("array<double>")
        rows = df.select(array.alias("_a"), F.col(self.labelCol).cast("double").alias("_y")).where("_y is not null and not isnan(_y)")
        head = rows.agg(F.max(F.size("_a")), F.avg("_y")).first()
        if head[1] is None:
            raise ValueError("there is no labelled row to learn from")
        features, base = head[0], float(head[1])
        edges = self._edges(rows, features)
        width = max(len(e) for e in edges) + 2

        def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    made = binned(_matrix(batch.column("_a"), features), edges)
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in made], pa.binary()), batch.column("_y"), pa.array(np.full(len(made), base)), batch.column("_hash")], names=["_bins", "_y", "_pred", "_hash"])

        schema = "_bins binary, _y double, _pred double, _hash long"
        state = _held(rows.withColumn("_hash", F.xxhash64("_a", "_y", F.lit(self.seed))).mapInArrow(bins, schema))
        how = {"depth": self.depth, "share": self.share, "loss": self.loss, "delta": self.delta}
        done, pending, rng = [], [], np.random.default_rng(self.seed)
        for number in range(self.trees):
            seen = np.sort(rng.permutation(features)[: max(1, round(self.columns * features))])
            tree = self._grown(state, pending, number, features, width, seen, how)
            if not tree.splits:
                break
            done.append(tree)
            pending.append(tree)
            if len(pending) == self.hold:
                new = _held(state.mapInArrow(_moved(pending, features, self.depth), schema))
                state.unpersist()
                state, pending = new, []
        state.unpersist()
        return BoostedModel(self.featuresCol, edges, base, done, self.depth)

    def _grown(self, state: DataFrame, pending: list[Tree], number: int, features: int, width: int, seen: np.ndarray, how: dict) -> Tree:
        whole, found, totals = Tree(), {}, {}
        for level in range(self.depth + 1):
            # the level's nodes are those below a split; at the last level only their sums are wanted
            nodes = [0] if level == 0 else [c for k in found if (1 << (level - 1)) - 1 <= k < (1 << level) - 1 for c in (2 * k + 1, 2 * k + 2)]
            if not nodes:
                break
            part = state.mapInArrow(_sums(list(pending), whole, level, number, features, width, how), "place long, g double, h double, n double")
            sums = np.zeros((3, 1 << level, features, width))
            for r in part.groupBy("place").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect():
                sums.reshape(3, -1)[:, r[0]] = r[1:]
            for k in nodes:
                g, h, n = sums[:, k - (1 << level) + 1]
                totals[k] = (g[0].sum(), h[0].sum())
                split = best_split(g[seen], h[seen], n[seen], self.l2, self.least_gain, self.least_rows) if level < self.depth else None
                if split:
                    found[k] = (split[0], int(seen[split[1]]), *split[2:])
                    whole.splits[k] = found[k][1:]
        tree = Tree(chosen_leaves(found, self.leaves))
        ends = [0] if not tree.splits else [c for k in tree.splits for c in (2 * k + 1, 2 * k + 2) if c not in tree.splits]
        tree.values = {k: float(-self.rate * totals[k][0] / (totals[k][1] + self.l2)) for k in ends}
        return tree


def _held(df: DataFrame) -> DataFrame:
    """df kept for reading often: in the session's checkpoint folder, which cuts its lineage, or in memory without one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()
