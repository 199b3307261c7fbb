"""Codewords, bit classifiers and decoding by plain sums."""

import math
import random

import numpy as np
import pytest

from tallgrass.llm import langid

WORDS = {"aa": "the and of with house river", "bb": "der und das mit haus fluss", "cc": "les et avec maison rivière été", "dd": "los y con casa río señor"}


def made(seed, many):
    rng = random.Random(seed)
    docs = []
    for k in range(many):
        lang = rng.choice(sorted(WORDS))
        docs.append((k, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 30))), lang))
    return docs


def grams(text):
    """Buckets of a text's byte trigrams, one by one."""
    b = [int(langid._FOLD[x]) for x in text.encode()]
    out = []
    for x, y, z in zip(b, b[1:], b[2:]):
        if (x, y) != (32, 32):
            h = ((x * 0x9E3779B1) & 0xFFFFFFFF) ^ y
            h = ((h * 0x85EBCA77) & 0xFFFFFFFF) ^ z
            out.append(((h * 0xC2B2AE3D) & 0xFFFFFFFF) >> 17)
    return out


def test_weights_and_decoding_by_plain_sums(spark):
    docs = made(1, 160)
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    langs = sorted(WORDS)
    assert model["langs"] == langs
    counts = {lang: np.zeros(langid.BUCKETS) for lang in langs}
    for _, text, lang in docs:
        for g in grams(text):
            counts[lang][g] += 1
    share = {lang: (c + 0.5) / (c.sum() + 0.5 * langid.BUCKETS) for lang, c in counts.items()}
    code = model["code"]
    for k in range(code.shape[1]):
        one = np.mean([share[lang] for lang, c in zip(langs, code[:, k], strict=True) if c > 0], axis=0)
        two = np.mean([share[lang] for lang, c in zip(langs, code[:, k], strict=True) if c < 0], axis=0)
        np.testing.assert_allclose(model["weights"][:, k], np.log(one) - np.log(two), rtol=1e-4, atol=1e-5)
    trust = model["scale"] / model["scale"].sum()
    other = made(2, 40) + [(900, "the and der und les et", None), (901, "12 34", None), (902, None, None), (903, "x", None)]
    rows = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(other, "doc_id long, text string, lang string"), model).collect()}
    for d, text, _ in other:
        r = rows[d]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, True)
            continue
        g = grams(text)
        mean = [sum(float(model["weights"][x, k]) for x in g) / len(g) if g else 0.0 for k in range(code.shape[1])]
        loss = [sum(trust[k] * math.log1p(math.exp(-3 * c[k] * mean[k] / model["scale"][k])) for k in range(len(mean))) for c in code]
        near = [math.exp(-4 * (x - min(loss))) for x in loss]
        assert r["lang_pred"] == langs[int(np.argmin(loss))] and r["score"] == pytest.approx(max(near) / sum(near), rel=1e-4)
        assert r["ambiguous"] == (sorted(loss)[1] - sorted(loss)[0] < model["margin"])


def test_held_out_by_crc(spark):
    import zlib

    rows = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", langid.held_out().alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows.collect())


def test_every_labelled_row_counts(spark, monkeypatch):
    """Counts and margin are those of all rows, however many; repeated rows count as often as they are there."""
    docs = made(3, 80) * 300
    docs = [(k, text, lang) for k, (_, text, lang) in enumerate(docs)]  # 24,000 rows
    few = langid.fit(spark.createDataFrame(docs[:80], "doc_id long, text string, lang string"))
    many = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4))
    totals = {lang: sum(len(grams(t)) for _, t, x in docs if x == lang) for lang in WORDS}
    assert few["langs"] == many["langs"] == sorted(totals)
    code = many["code"]
    counts = {lang: np.zeros(langid.BUCKETS) for lang in WORDS}
    for _, text, lang in docs[:80]:
        np.add.at(counts[lang], grams(text), 300)
    share = {lang: (c + 0.5) / (totals[lang] + 0.5 * langid.BUCKETS) for lang, c in counts.items()}
    for k in range(code.shape[1]):
        one = np.mean([share[lang] for lang, c in zip(many["langs"], code[:, k], strict=True) if c > 0], axis=0)
        two = np.mean([share[lang] for lang, c in zip(many["langs"], code[:, k], strict=True) if c < 0], axis=0)
        np.testing.assert_allclose(many["weights"][:, k], np.log(one) - np.log(two), rtol=1e-4, atol=1e-5)

    def margin(model, rows):
        _, _, least = langid.decode(langid._means(langid.pa.array([t for _, t, _ in rows]), model["weights"]), model)
        return langid.SLACK * np.sort(least)[int(langid.QUANTILE * (len(rows) - 1))]

    monkeypatch.setattr(langid, "MOST", 4.0)  # so that the quantile decides
    many = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4))
    assert many["margin"] == pytest.approx(margin(many, docs), rel=1e-3)
