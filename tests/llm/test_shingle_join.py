import random
import re
from itertools import combinations

import pytest

from tallgrass.llm import shingle_join

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, size, percent):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        i, u = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if u and 100 * i >= percent * u:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") + str(rng.randrange(400))
    passage = [word() for _ in range(60)]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "Two one")]
    for base in range(12):
        text = [word() for _ in range(rng.randrange(40, 400))]
        if base % 3 == 0:
            text[10:10] = passage
        for _ in range(rng.randrange(1, 9)):  # chains: each copy edits the one before
            docs.append((len(docs), " ".join(text)))
            if rng.random() < 0.7:
                for _ in range(rng.randrange(1, 5)):
                    text[rng.randrange(len(text))] = word()
    for _ in range(150):  # one template, edited anew each time
        text = (["x" + str(i) for i in range(300)])[: rng.randrange(280, 300)]
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(len(text))] = word()
        docs.append((len(docs), " ".join(text)))
    for _ in range(40):  # the passage and little else
        docs.append((len(docs), " ".join(passage + [word() for _ in range(rng.randrange(3, 60))])))
    return docs


@pytest.mark.parametrize("seed,size,percent,heavy", [(1, 3, 90, 100), (2, 5, 80, 5), (3, 3, 90, 2)])
def test_against_brute_force(spark, monkeypatch, seed, size, percent, heavy):
    monkeypatch.setattr(shingle_join, "HEAVY", heavy)
    monkeypatch.setattr(shingle_join, "MAX_HOME", 512 if seed == 1 else 30)
    docs = corpus(seed)
    rows = shingle_join.join(spark.createDataFrame(docs, "doc_id long, text string"), size, percent).collect()
    want = brute(docs, size, percent)
    assert len(rows) == len(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert len({c for _, c in want.values()}) < len(want) - 50


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_growing_chains(spark, size, percent):
    """Each text adds one to three words to the one before: neighbours are alike, the ends are not."""
    docs = []
    for seed in range(60):
        rng = random.Random(seed)
        text = [f"c{seed}w{k}" for k in range(rng.randrange(6, 60))]
        for _ in range(rng.randrange(2, 9)):
            docs.append((len(docs), " ".join(text)))
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.choice([0, len(text)]), f"c{seed}n{rng.randrange(1 << 30)}")
    docs += [(len(docs) + k, " ".join(f"chain{w}" for w in range(22 + more))) for k, more in enumerate((0, 2, 3))]
    rows = shingle_join.join(spark.createDataFrame(docs, "doc_id long, text string"), size, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(docs, size, percent)


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, a int")
    assert shingle_join.join(empty).count() == 0
    twice = spark.createDataFrame([(7, "a b c d", 1), (7, "a b c d", 1), (9, "A b\nc d", None)], "doc_id long, text string, component_id int")
    assert sorted((r["doc_id"], r["component_id"]) for r in shingle_join.join(twice).collect()) == [(7, 7), (7, 7), (9, 7)]


def test_leaves_count_like_sets():
    import numpy as np

    rng = np.random.default_rng(6)
    base = np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(150, 200)], rng.integers(0, 1 << 60, rng.integers(0, 20)).astype(np.uint64)])) for _ in range(150)] + [base, base, base[:3]]
    leaves = shingle_join.Leaves(sets)
    for s in sets[::7]:
        want = {k for k, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))}
        assert set(leaves.probe(s, 80).tolist()) == want
    for small in (0, 1000):
        up = list(range(len(sets)))
        for a, b in shingle_join.joined(list(range(len(sets))), sets, 80, small):
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
        if small == 0:
            first = up
    assert first == up and len(set(up)) < len(up)


def test_trie_prunes_but_finds():
    import numpy as np

    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 60, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(200, 300)], rng.integers(0, 1 << 60, rng.integers(0, 20)).astype(np.uint64)])) for _ in range(60)]
    trie = shingle_join.Trie()
    for k, s in enumerate(sets):
        trie.insert(s, k)
    for s in sets:
        want = {k for k, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))}
        assert set(trie.probe(s, 80)) == want


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_large_homes_by_differences(spark, monkeypatch, size, percent):
    """Edited copies of one text, alike or not, in homes that are too large for one task."""
    monkeypatch.setattr(shingle_join, "MAX_HOME", 20)
    rng = random.Random(9)
    docs = []
    for base in range(3):
        root = [f"w{base}x{rng.randrange(5000)}" for _ in range(70)]
        passage = [f"p{base}x{k}" for k in range(25)]
        for _ in range(110):
            text = list(root)
            if rng.random() < 0.4:
                text[5:5] = passage  # a second text within the home
            for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9))):
                k = rng.randrange(len(text))
                text[k : k + rng.randrange(0, 2)] = [f"n{rng.randrange(60)}"] * rng.randrange(0, 2)
            docs.append((len(docs), " ".join(text)))
            if rng.random() < 0.3:  # a chain that leaves the root
                for _ in range(3):
                    text[rng.randrange(len(text))] = f"n{rng.randrange(60)}"
                docs.append((len(docs), " ".join(text)))
    rows = shingle_join.join(spark.createDataFrame(docs, "doc_id long, text string"), size, percent).collect()
    want = brute(docs, size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert 10 < len({c for _, c in want.values()}) < len(want) - 100


def test_rows_without_an_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = [(None, text), (None, "only here and nowhere else"), (None, None), (3, text), (5, text + " more"), (8, "one two"), (5, "one two")]
    rows = shingle_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] is None, r["component_id"] or 0) for r in rows)
    assert got == [(False, 3, 38, False, 3), (False, 5, 1, False, 3), (False, 5, 39, False, 3), (False, 8, 1, False, 3), (True, 0, 0, True, 0), (True, 0, 3, True, 0), (True, 0, 38, False, 3)]
    kept = shingle_join.stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, -1, -1, 3]


def test_python_workers_get_batches_bounded_by_bytes(spark):
    """Texts of 200 kB come a few at a time, not by thousands of rows."""
    from pyspark.sql import functions as F

    from tallgrass.llm.common import BATCH_BYTES

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(100, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id"), F.repeat(F.lit("word "), 40_000)).alias("text"))
    assert shingle_join.join(docs.limit(3)).count() == 3

    def sizes(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [batch.nbytes]})

    found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 19_000_000 and max(found) < 2 * BATCH_BYTES


def test_sizes_are_the_joins_and_take_one_pass(spark, sf, capsys):
    from tallgrass.llm import oracles

    docs = spark.createDataFrame([(1, "a b c d e f a b c d e"), (2, None), (3, " "), (4, "x y"), (4, "A b c d e f"), (None, "a b c d e")], "doc_id long, text string")
    rows = lambda df: sorted(map(str, df.select("doc_id", "n_shingles").collect()))
    assert rows(shingle_join.sizes(docs, 5)) == rows(shingle_join.join(docs, 5, 80))
    found = oracles.shingle_sizes(spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    found.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan
