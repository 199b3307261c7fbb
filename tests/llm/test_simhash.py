"""Fingerprints and their classes against plain computations, entries compared whole and taken apart by points."""

import random
import re

import numpy as np
import xxhash

from tallgrass.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows):
    """rows of (doc_id, fingerprint) to their components' least ids."""
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 3:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted((str(i), f"{f:016x}", str(least.get(top(k)))) for k, (i, f) in enumerate(rows))


def found(spark, docs, **how):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, fp int, least string")
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(df, **how).collect())


def copies(seed, many):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") * rng.randrange(1, 5) + str(rng.randrange(40)) for _ in range(rng.randrange(30, 120))] for _ in range(6)]
    docs = []
    for k in range(many):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"W{rng.randrange(1000)}"
        docs.append((k, rng.choice((" ", "\n", "\t  ")).join(words)))
    return docs + [(many + k, t) for k, t in enumerate((None, "", " \x0b\x0c ", "one", "One", "two words", "TWO  words", "a b c", "nb sp x", "É é", "x" * 50))]


def test_classes_by_brute_force(spark):
    docs = copies(1, 220)
    want = plain_classes([(i, plain_fingerprint(t)) for i, t in docs])
    assert found(spark, docs) == want
    assert found(spark, docs, most=1) == want  # every shared half is taken apart by points
    assert len({c for _, _, c in want}) < len(want)


def test_links_of_close_fingerprints(spark):
    rng = random.Random(4)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(40):
            values.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
    values = sorted(values)
    nodes = simhash.written(spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in enumerate(values)], "fp long, least long"), "nodes")
    want = [c for _, _, c in sorted(plain_classes(list(enumerate(values))), key=lambda r: int(r[0]))]
    for most in (None, 1, 3):
        labels = {r["node"]: r["label"] for r in simhash.components(simhash.links(nodes, most)).collect()}
        got = {}
        for k, v in enumerate(values):
            got.setdefault(labels.get(v - (1 << 64) if v >> 63 else v, v), []).append(k)
        parts = {}
        for k, c in enumerate(want):
            parts.setdefault(c, []).append(k)
        assert sorted(got.values()) == sorted(parts.values())


def test_reached():
    rng = random.Random(6)
    fps = np.array([rng.choice((0, 1 << 40)) ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(0, 8))) for _ in range(200)], np.uint64)
    root = simhash.reached(fps)
    want = [c for _, _, c in sorted(plain_classes([(k, int(f)) for k, f in enumerate(fps)]), key=lambda r: int(r[0]))]
    assert [str(r) for r in root] == want


def test_rows_of_one_id_missing_ids_and_no_rows(spark):
    docs = [(1, "same words here and more"), (1, "quite other words in this row of it"), (None, "same words here and more"), (None, None), (None, "alone with no id at all"), (3, "")]
    want = plain_classes([(i, plain_fingerprint(t)) for i, t in docs])
    assert found(spark, docs) == want
    assert found(spark, []) == []


def test_long_text_in_pieces(spark):
    rng = random.Random(9)
    text = " ".join(rng.choice(("Alpha", "beta", "GAMMA", "delta")) + str(rng.randrange(500)) for _ in range(300_000))
    assert len(text) > 2 * simhash.PIECE
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(b"x" * (3 * simhash.PIECE) + b" y z w") == plain_fingerprint("x" * (3 * simhash.PIECE) + " y z w")
