"""Centroid clustering with bounds against comparing all distances."""

import hashlib
import random

import numpy as np

from tallgrass.llm import elkan


def plain(vectors, k, rounds, width, scale=64):
    kept = []
    for i, (vec_id, x) in enumerate(vectors):
        if x is not None and len(x) == width and all(v is not None and np.isfinite(v) for v in x):
            kept.append((i, vec_id, [max(-elkan.LIMIT, min(elkan.LIMIT, int(np.floor(scale * float(np.float32(v)))))) for v in x]))
    starts = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[1] is None else r[1]}".encode()).hexdigest(), r[2]))[:k]
    centroids = [r[2] for r in starts]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for step in range(rounds + 1):
        got = [min((far(x, c), j) for j, c in enumerate(centroids)) for _, _, x in kept]
        if step < rounds:
            for j in range(len(centroids)):
                mine = [x for (_, _, x), (_, c) in zip(kept, got, strict=True) if c == j]
                if mine:
                    centroids[j] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = sum(d for d, _ in got)
    of = {j: sum(d for d, c in got if c == j) for j in range(len(centroids))}
    return sorted((str(i), c, d, of[c], inertia, digests[c]) for (_, i, _), (d, c) in zip(kept, got, strict=True))


def found(spark, vectors, **how):
    df = spark.createDataFrame([(i, x, "x", 1) for i, x in vectors], "vec_id long, embedding array<float>, cluster string, distance int")
    rows = elkan.cluster(df, **how).collect()
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in rows), rows


def test_same_as_all_distances(spark):
    rng = random.Random(3)
    for width, spread in ((4, 0.05), (6, 2.0)):
        centres = [[rng.uniform(-spread, spread) for _ in range(width)] for _ in range(9)]
        vectors = [(k, [c + rng.gauss(0, 0.02 + spread / 20) for c in rng.choice(centres)]) for k in range(400)]
        vectors += [(1000 + k, vectors[k][1]) for k in range(60)]  # equal vectors, and ties on a coarse grid
        vectors += [(2000 + k, [rng.randrange(-1, 2) / 64 for _ in range(width)]) for k in range(200)]
        got, rows = found(spark, vectors, k=7, width=width)
        assert got == plain(vectors, 7, 3, width)
        assert sum(r["n_distances"] for r in rows) < 0.8 * len(rows) * 4 * 7  # bounds exclude some


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 0.0]), (7, [0.5, -0.5]), (7, [0.5, -0.5]), (7, [9.0, 9.0]), (None, [3e30, -3e30]), (8, [-1e-9, 0.0]), (9, [1.0, 2.0, 3.0])]
    got, _ = found(spark, vectors, k=3, width=2)
    assert got == plain(vectors, 3, 3, 2)
    assert len(got) == 5
    assert found(spark, vectors[:6], k=3, width=2)[0] == []
    got, _ = found(spark, vectors, k=16, width=2)  # fewer vectors than centroids
    assert got == plain(vectors, 16, 3, 2)


def test_bounds_are_safe_near_the_limit(spark):
    rng = random.Random(5)
    vectors = [(k, [rng.choice((-1, 1)) * (2.0**20 + rng.randrange(3) / 64) for _ in range(3)]) for k in range(150)]
    assert found(spark, vectors, k=5, width=3)[0] == plain(vectors, 5, 3, 3)
