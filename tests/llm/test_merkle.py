"""The manifest against a plain tree, with repeated and missing ids, and proofs that tell tampering."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallgrass.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, _rank int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, k):
    out = []
    for nodes in levels[:-1]:
        run = nodes[k & ~7 : (k & ~7) + 8]
        out.append((run[: k & 7], run[(k & 7) + 1 :]))
        k >>= 3
    return out


def plain(docs):
    by = {}
    for d in docs:
        by.setdefault(d[2], []).append((-(1 << 63) if d[0] is None else d[0], leaf(d, d[1]), d))
    langs = sorted(by, key=lambda x: b"" if x is None else b"=" + x.encode())
    trees = {}
    for g in langs:
        by[g].sort(key=lambda r: r[:2])
        trees[g] = grown([r[1] for r in by[g]])
    top = grown([trees[g][-1][0] for g in langs])
    out = []
    for j, g in enumerate(langs):
        for k, (_, own, d) in enumerate(by[g]):
            path = way(trees[g], k) + way(top, j)
            proof, fold = "".join("".join(a + z) for a, z in path), own
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 and d[1] is not None:
                fold = leaf(d, "".join(c.lower() if "A" <= c <= "Z" else c for c in d[1]))
            for a, z in path:
                fold = sha("".join(a) + fold + "".join(z))
            out.append(tuple(map(str, (d[0], own, trees[g][-1][0], top[-1][0], sha(proof), fold, fold == top[-1][0]))))
    return sorted(out)


def found(spark, docs, **how):
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], SCHEMA)
    return sorted(tuple(map(str, r)) for r in merkle.manifest(df, **how).collect())


def some(seed, many, ids, langs=("en", "de", None, "", "fr-éß")):
    rng = random.Random(seed)
    return [(ids(rng, k), rng.choice((None, "", "Some Text", "lower text", f"Ünïcode {k} \U0001f600 ABC")), rng.choice(langs), rng.choice((None, "", "web")), rng.choice((None, k, -k))) for k in range(many)]


def test_same_as_a_plain_tree(spark):
    for docs in (some(1, 400, lambda r, k: 3 * k - 200), some(2, 90, lambda r, k: r.randrange(-(1 << 63), 1 << 63)), some(3, 1, lambda r, k: 5), some(4, 9, lambda r, k: k, ("a",)), some(5, 60, lambda r, k: k, tuple(f"l{k}" for k in range(30)))):
        assert found(spark, docs) == plain(docs)
    assert found(spark, []) == []


def test_repeated_and_missing_ids_are_ranked_apart(spark):
    docs = some(6, 300, lambda r, k: r.choice((None, 7, 7, 7, r.randrange(600))), ("en", "de"))
    docs += [docs[0]] * 40 + [(7, "Same", "en", "s", 4)] * 60
    assert found(spark, docs, hot=16) == plain(docs) == found(spark, docs)


def test_storeys(spark):
    docs = [(k, "T", "en", "s", 1) for k in range(4500)] + [(9, "t", "xx", "s", 1)]
    assert found(spark, docs) == plain(docs)


def test_ranks_by_digits(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice((rng.randrange(-(1 << 62), 1 << 62), rng.randrange(-3000, 3000)))) for _ in range(700)]
    df = merkle.written(spark.createDataFrame(rows, "g string, k long").withColumn("row", F.monotonically_increasing_id()), "rows")
    got = merkle.ranked(df, ["g"], ["k", "row"]).collect()
    for g in "ab":
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["_rank"])
        assert [r["_rank"] for r in own] == list(range(len(own)))
        assert [r["k"] for r in own] == sorted(r["k"] for r in own)


def test_very_long_text(spark):
    docs = [(1, "Long " * 1_000_000, "en", "s", 5_000_000), (2, "x", "en", "s", 1)]
    assert found(spark, docs) == plain(docs)


@pytest.mark.parametrize("place", [0, 3, 7])
def test_fold(place):
    nodes = [sha(str(k)) for k in range(8)]
    path = [f"{place}{''.join(n for k, n in enumerate(nodes) if k != place)}"]
    assert merkle.folded(nodes[place], path) == sha("".join(nodes))
