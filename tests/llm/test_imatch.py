"""I-Match against a plain computation: lexicon band, fingerprints, likeness, next documents under odd ids."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallgrass.llm import imatch


def made(seed, many, ids):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(many):
        text = " ".join(rng.choice(words) if rng.random() < 0.9 else f"only{k}" for _ in range(rng.randrange(0, 90)))
        docs.append((ids(k), rng.choice((text, text.upper(), text.replace(" ", ", "))) if rng.random() < 0.9 else docs[-1][1] if docs else text))
    return docs


def terms(text):
    return set(re.split(r"[\W_]+", text.lower())) - {""}


def test_fingerprints_by_brute_force(spark):
    docs = made(1, 300, lambda k: k)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in imatch.fingerprints(df, min_share=0.02, max_share=0.3).collect()}
    counts = collections.Counter(t for _, x in docs for t in terms(x))
    band = {t for t, c in counts.items() if 0.02 * 300 <= c <= 0.3 * 300}
    assert 20 < len(band) < len(counts)
    names = sorted(counts)
    hashes = dict(zip(names, (r["h"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(names)], "k int, t string").select("k", F.xxhash64("t").alias("h")).orderBy("k").collect()), strict=True))

    def subsets(text):
        kept = sorted(hashes[t] for t in terms(text) & band)
        out = [tuple(kept)]
        for level, many in imatch.LEVELS:
            bits = level.bit_length() - 1
            out += [tuple(h for h in kept if ((h % (1 << 64)) >> (k * bits)) & (level - 1) == level - 1) for k in range(many)]
        return out

    def likeness(a, b, x, y):
        if not a[0] and not b[0]:
            return float(x == y)
        if a[0] == b[0]:
            return 1.0
        shares, at = [], 1
        for _, many in imatch.LEVELS:
            pairs = [(p, q) for p, q in zip(a[at : at + many], b[at : at + many], strict=True) if p or q]
            at += many
            if len(pairs) >= 3:
                shares.append(sum(p == q for p, q in pairs) / len(pairs))
        return max(shares, default=0.0)

    ordered = sorted(docs, reverse=True)
    for k, (d, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        cut = len(text) // 3
        edit = text[: len(text) - cut] + following[:cut]
        assert rows[d]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert rows[d]["near_edited"] == pytest.approx(likeness(subsets(text), subsets(edit), text, edit))
        assert rows[d]["near_next"] == pytest.approx(likeness(subsets(text), subsets(following), text, following))
    same = collections.defaultdict(set)
    for d, text in docs:
        key = tuple(subsets(text)) if subsets(text)[0] else text
        same[key].add(rows[d]["fingerprint"])
    assert all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)


@pytest.mark.parametrize("ids", [lambda k: k if k else 1 << 60, lambda k: 7 if k % 3 else k, lambda k: -(1 << 62) + k * k, lambda k: None if k == 5 else k // 2])
def test_next_documents_of_odd_ids(spark, ids):
    docs = made(2, 200, ids)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    rows = imatch.with_next(df).where("own = 1").collect()
    assert len(rows) == 200
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashed[d[1]]))
    want = collections.Counter((d, t, order[k - 1][1]) for k, (d, t) in enumerate(order))
    got = collections.Counter((r["doc_id"], r["text"], r["next"]) for r in rows)
    assert got == want
    if ids(1) == ids(2) == 7:
        assert len({r["bucket"] for r in rows if r["doc_id"] == 7}) > 4  # the heavy id has several buckets

