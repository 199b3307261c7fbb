"""Centroid clustering of integer vectors with Elkan's bounds.

Each vector carries an upper bound of the distance to its centroid and a lower bound of the distance to every centroid.
After an update the bounds move by the centroids' shifts. A distance is only computed where the bounds and half the
distance between two centroids cannot exclude it. Bounds are floats rounded away from what they bound, and only what is
strictly farther is excluded, so that ties are always compared; comparisons are between exact integer squares. The result
therefore equals that of comparing all distances.

The table of vectors and bounds is written once a round; only the centroids (a fixed number) pass through the driver.

Defined cases. Vectors that are null, of another number of components, or hold null, NaN or infinite components are left
out. Components are held at +-LIMIT, within which all distances and sums are exact in 64 bits. Repeated ids are vectors of
their own, equal starting ids are taken by their components. A null vec_id is hashed as the empty text. With fewer vectors
than centroids there is a centroid for each; an empty table gives no rows. Further columns of the input are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: The largest component: 64 squares of differences stay below 2 ** 63.
LIMIT = (1 << 27) - 1
#: Relative slack of a bound: far beyond the rounding of a square root and of 32-bit storage.
SLACK = 2.0**-18


def _up(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.float64) * (1 + SLACK)


def _down(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.float64) * (1 - SLACK)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(kind)


def assigned(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of vectors with valid bounds the cluster, the exact square, both bounds, and how many distances were computed."""
    k, rows = len(centroids), np.arange(len(x))
    between = np.sqrt(np.array([[float(v) for v in squares(np.broadcast_to(c, centroids.shape), centroids)] for c in centroids]).reshape(k, k))
    half = _down(between) / 2
    np.fill_diagonal(half, np.inf)
    computed = np.zeros(len(x), np.int64)
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    best = np.full(len(x), -1, np.int64)
    # a vector nearer than half the way to the next centroid stays where it is
    open_ = rows[upper >= half[cluster].min(axis=1)]
    for c in range(k):
        at = open_[(cluster[open_] != c) & (upper[open_] >= lower[open_, c]) & (upper[open_] >= half[cluster[open_], c])]
        fresh = at[best[at] < 0]
        if len(fresh):  # the own distance first: it may exclude the rest
            best[fresh] = squares(x[fresh], centroids[cluster[fresh]])
            root = np.sqrt(best[fresh].astype(np.float64))
            upper[fresh], lower[fresh, cluster[fresh]] = _up(root), _down(root)
            computed[fresh] += 1
            at = at[(upper[at] >= lower[at, c]) & (upper[at] >= half[cluster[at], c])]
        if not len(at):
            continue
        other = squares(x[at], centroids[c])
        computed[at] += 1
        root = np.sqrt(other.astype(np.float64))
        lower[at, c] = _down(root)
        nearer = (other < best[at]) | ((other == best[at]) & (c < cluster[at]))
        won = at[nearer]
        cluster[won], best[won], upper[won] = c, other[nearer], _up(root[nearer])
    rest = rows[best < 0]
    best[rest] = squares(x[rest], centroids[cluster[rest]])
    return cluster, best, upper, lower, computed


def _round(centroids: np.ndarray, moved: np.ndarray | None, width: int, first: bool):
    """Assigns all vectors; in the first round nothing is known of them but that the first centroid is as good as any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column("x"), width, np.int64)
            if first:
                cluster, upper, lower, computed = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k)), np.zeros(n, np.int64)
            else:
                cluster, upper, lower = batch.column("cluster").to_numpy().astype(np.int64), batch.column("upper").to_numpy().astype(np.float64), _matrix(batch.column("lower"), k, np.float64)
                computed = batch.column("n_distances").to_numpy()
                upper, lower = _up(upper + moved[cluster]), _down(np.maximum(lower - moved, 0))
            cluster, best, upper, lower, more = assigned(x, centroids, cluster, upper, lower)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("x"), pa.array(cluster.astype(np.int32)), pa.array(best), pa.array(_up(upper).astype(np.float32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.array(_down(lower).astype(np.float32).ravel())), pa.array(computed + more),
                ],
                names=["vec_id", "x", "cluster", "distance", "upper", "lower", "n_distances"],
            )

    return run


def kept(vectors: DataFrame, width: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, x): the whole vectors, each component scaled and rounded down to an integer."""
    known = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    numbers = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("_e")).where((F.size("_e") == width) & F.forall("_e", known))
    return numbers.select("vec_id", F.transform("_e", lambda v: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), v * scale)))).alias("x"))


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_distances (computed for it in all rounds)."""
    spark = vectors.sparkSession
    table = written(kept(vectors, width, scale), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = table.select(order.alias("_h"), "x").orderBy("_h", "x").limit(k).collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_distances long"
    if not starts:
        return spark.createDataFrame([], out)
    centroids = np.array([r["x"] for r in starts], np.int64)
    schema = "vec_id long, x array<long>, cluster int, distance long, upper float, lower array<float>, n_distances long"
    moved = None
    for step in range(rounds + 1):
        held = table
        table = written(table.mapInArrow(_round(centroids, moved, width, step == 0), schema), "round")
        discard(held)
        if step == rounds:
            break
        # a row per cluster and component, whatever the table's size
        sums = table.select("cluster", F.posexplode("x").alias("place", "v")).groupBy("cluster", "place").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n")).collect()
        before = centroids.copy()
        for r in sums:
            centroids[r["cluster"], r["place"]] = r["total"] // r["n"]
        moved = _up(np.sqrt(squares(before, centroids).astype(np.float64)))
    digests = [(c, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(centroids)]
    # one row a cluster
    totals = table.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster").collect()
    inertia = sum(r["cluster_inertia"] for r in totals)
    of_cluster = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], inertia, r["centroid_sha256"]) for r in totals], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_distances")
