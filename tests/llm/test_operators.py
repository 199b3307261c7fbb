"""Each operator against a plain computation, and on the edge cases of its docstring."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallgrass.llm import chroma, imatch, langid, licenses, packing, pages, pii, quality, queries, unigram

TOKENIZER, PIECES = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("piece_bpe_32k.model")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
LONG = "Lorem ipsum 12345 a@b.co " * 9000
EDGES = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", None, "s", None), (4, "12.5 !!", "en", None, 7), (5, "The cat's <|endoftext|> \x1c it's n°5 x²_y", "en", "s", 1),
    (6, LONG, "en", "s", 2), (7, "x" * 60_000, "en", "s", 2), (8, "9" * 30_000, "en", "s", 2), (9, "日本語 \U0001f600 ñandú été İΣ", "en", "s", 2), (10, "twice the same", "en", "s", 3), (10, "twice the same", "en", "s", 3),
    (11, "CC-BY, cc\nby. GNU General Public License; all  rights reserved", "en", "s", 3), (12, "mail x.y@z.example.com, call +1 (743) 555-3824, 10.0.0.255 or 10.0.0.256, card 4111 1111 1111 1111", "en", "s", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, score int"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return sorted((m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if len(m.group()) < 4000 and ok(m.group()))


def test_pii_base_spans(spark, docs, texts):
    extra = [(-1, "a@b.c_d@e.f 1.2.3.4.5 00000000000000000000255.1.1.1 300.1.1.1 +1 2 3 4 5 6 7 8 9 x"), (-2, LONG), (-3, "x" * 60_000 + "@"), (-4, "9" * 30_000), (-5, "+" * 5000 + "1" * 12), (-6, "a@b" * 3000), (-7, "é\U0001f600 a@b.c"), (-8, None), (-9, "4111-1111 11111111" * 3)]
    rows = pii.find(docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))).collect()
    all_texts = texts | {d: t or "" for d, t in extra}
    assert len(rows) == len(all_texts)
    for r in rows:
        want = base_spans(all_texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{z}" for a, _, k, z in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), r
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(w[2] == k for w in want) for k in pii.BASE]
        assert {f"{k}:{a}:{z}" for a, _, k, z in want} <= set(r["spans"].split(",") if r["spans"] else [])


def test_pii_redacts_and_keeps_columns(spark, edges):
    out = {r["doc_id"]: r for r in pii.stage(spark, edges, "").collect()}
    assert out[12]["text"] == "mail [EMAIL], call [PHONE], [IP] or 10.0.0.256, card [CARD]"
    assert out[1]["text"] is None and out[2]["text"] == "" and out[10]["text"] == "twice the same" and out[12]["score"] == 3
    secret = spark.createDataFrame([(1, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and thereafterwardsnotwithstanding')], "doc_id long, text string")
    assert pii.stage(spark, secret, "").first()["text"] == 'token = "[SECRET]" and thereafterwardsnotwithstanding'


def edited(ordered, k):
    t, n = ordered[k][1], ordered[(k + 1) % len(ordered)][1]
    cut = len(t) // 3
    return t[: len(t) - cut] + n[:cut]


def test_imatch(spark, docs, texts):
    rows = {r["doc_id"]: r for r in imatch.fingerprints(docs).collect()}
    ordered = sorted(texts.items(), reverse=True)
    for k, (d, t) in enumerate(ordered):
        assert rows[d]["n_chars"] == len(t)
        assert rows[d]["edited_sha256"] == hashlib.sha256(edited(ordered, k).encode()).hexdigest()
    by_text = collections.defaultdict(set)
    for d, t in texts.items():
        by_text[t].add(rows[d]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    mean = lambda c: np.mean([r[c] for r in rows.values()])
    assert mean("near_edited") > 0.25 and mean("near_next") < 0.05


def test_imatch_edges(spark, edges):
    rows = imatch.fingerprints(edges).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 10}) == 1 and {r["n_chars"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert imatch.fingerprints(edges.limit(0)).count() == 0
    one = imatch.fingerprints(spark.createDataFrame([(None, "abc def")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


PAGE = """<!doctype html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>A<li>B</ul></nav>
<div class="ad-banner">Buy</div><article><h1>Title &amp; more</h1><p>One  two<br>three <b>bold</b> <i>x</i>yz<p>Second<aside>Side</aside><form>Name <input></form><div id="comments"><p>Nice!</p></div><ul><li>item</li></ul></article><footer>&copy; me</footer></body>"""


def test_pages_structure(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "", ""), (4, "no url", "plain &lt;text&gt;"), (5, "http://a.example/y", "<p>unclosed <b>bold"), (1, "http://a.example/x", PAGE), (6, "http://b.example", "<article>" + "<p>w x</p>" * 20_000)]
    out = collections.defaultdict(list)
    for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect():
        assert r["n_chars"] == len(r["text"])
        out[r["page_id"]].append(r["text"])
    assert out[1] == ["Title & more\nOne two three bold xyz\nSecond\nitem"] * 2
    assert out[2] == out[3] == [""] and out[4] == ["plain <text>"] and out[5] == ["unclosed bold"] and out[6][0].count("\n") == 19_999
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("attributes,seen", [('style="overflow:hidden"', True), ('class="hidden-xs"', True), ('data-hidden="1"', True), ('title="a hidden gem"', True), ("href=/hidden/x", True), ('data-style="display:none"', True), ("hidden", False), ('HIDDEN=""', False), ('aria-hidden="true"', False), ('aria-hidden="false"', True), ("style='color:red; display : none'", False)])
def test_pages_hidden_attributes(attributes, seen):
    assert pages.blocks(f"<article><p>before</p><p {attributes}>text</p></article>") == [(2, "before")] + [(2, "text")] * seen


def test_pages_head_without_end_tag():
    title = "<html><head><title>t</title><meta charset=utf-8><style>p {}</style>"
    for body in ("<body><article><p>text</p></article>", "<article><p>text</p></article>", "</head><body><article>text</article>"):
        assert pages.blocks(title + body) == [(2, "text")]
    assert pages.blocks(title + "plain") == [(1, "plain")]


def test_pages_boilerplate_without_article(spark):
    rng = random.Random(3)
    menu = "<div>" + " ".join(f"menu{k}" for k in range(30)) + "</div>"
    rows = [(k, f"https://h.example/{k}", f"{menu}<div><p>" + " ".join(str(rng.random()) for _ in range(40)) + "</p></div>") for k in range(40)]
    out = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("menu" not in r["text"] and r["n_chars"] > 200 for r in out)


def test_packing_round_trip(spark, docs, texts, edges):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    extra = {-d: x or "" for d, x, *_ in EDGES if d != 10}
    both = docs.select("doc_id", "text").unionByName(edges.where("doc_id <> 10").select((-F.col("doc_id")).alias("doc_id"), "text"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(both, TOKENIZER).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    everything = texts | extra
    assert pieces.keys() == everything.keys()
    for d, own in pieces.items():
        ids, at = np.array(t.encode(everything[d], add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(edges.limit(0), TOKENIZER).count() == 0
    assert packing.pack(edges.where("doc_id = 10"), TOKENIZER).count() == 2


def test_hilbert_is_a_walk():
    for dims, order in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << order)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert(cells, order)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_quality(spark, sf, docs, edges):
    out = {r["doc_id"]: r for r in quality.classify(docs).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good, bad = ([out[r["doc_id"]]["quality_pred"] for r in labels if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    kept = quality.stage(spark, edges, "")
    assert kept.columns == edges.columns and kept.where("text is null or doc_id = 2").isEmpty()
    assert quality.classify(edges).count() == len(EDGES) and quality.classify(edges.limit(0)).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7])
    votes = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, table, prior = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.05
    found = table[:, 1, 2] / table[:, 1, 1:].sum(1)
    assert np.abs(found - right).max() < 0.06


def test_language(spark, docs, edges):
    rows = langid.identify(docs).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    out = {r["doc_id"]: r for r in langid.identify(edges).collect()}
    assert {out[d]["lang_pred"] for d in (1, 2, 3, 4, 8)} == {"und"} and out[6]["lang_pred"] == "en"
    assert langid.identify(edges.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.stage(spark, edges, "").columns == edges.columns


def test_filter_stages_leave_columns_alone(spark, docs):
    clash = docs.select("*", F.col("doc_id").cast("int").alias("score"), *(F.concat(F.lit(c), "doc_id").alias(c) for c in ("quality_score", "quality_pred", "lang_pred", "ambiguous")))
    rows = {r["doc_id"]: r for r in clash.collect()}
    for stage in (quality.stage, langid.stage):
        kept = stage(spark, clash, "").collect()
        assert kept and all(r == rows[r["doc_id"]] for r in kept)


def test_ambiguous_languages_are_rejected(spark):
    """Clean texts stay; texts half in one and half in another language, or in a language not learned, go."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and lang is not null and length(text) > 600")
    by = collections.defaultdict(list)
    for r in docs.orderBy("doc_id").collect():
        by[r["lang"]].append((r["doc_id"], r["text"]))
    rng, langs = random.Random(8), sorted(by)
    mixed = []
    for k in range(200):
        a, b = rng.sample(langs, 2)
        mixed.append((-1 - k, rng.choice(by[a])[1][:500] + " " + rng.choice(by[b])[1][:500]))
    learned = docs.where(~langid.held_out())
    schema = "doc_id long, text string"

    def rejected(rows, model):
        return np.mean([r["ambiguous"] for r in langid.predict(spark.createDataFrame(rows, schema), model).collect()])

    model = langid.fit(learned)
    held = {r["doc_id"] for r in docs.where(langid.held_out()).select("doc_id").collect()}
    assert rejected([row for lang in langs for row in by[lang] if row[0] in held], model) < 0.01
    assert rejected(mixed, model) > 0.7
    for out in langs[:2]:
        assert rejected(by[out], langid.fit(learned.where(F.col("lang") != out))) > 0.8


def test_codewords_are_apart():
    for n in (2, 4, 9):
        c = langid.codewords(n)
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= 3


def best_score(text, scores, low):
    """Score of the best segmentation by plain dynamic programming over characters."""
    best = [0.0] + [float("-inf")] * len(text)
    for z in range(1, len(text) + 1):
        best[z] = best[z - 1] + low
        for a in range(max(0, z - 64), z):
            if text[a:z] in scores:
                best[z] = max(best[z], best[a] + scores[text[a:z]])
                if z - a == 1:
                    best[z] = max(b for b in (best[a] + scores[text[a:z]], *(best[k] + scores[text[k:z]] for k in range(max(0, z - 64), z) if text[k:z] in scores)))
    return best[-1]


def test_unigram(spark, docs, edges, texts):
    rows = unigram.tokenise(docs, PIECES).collect()
    assert all(r["round_trip"] for r in rows)
    full = {r["doc_id"]: r for r in unigram.tokenise(edges.select("doc_id", "text"), PIECES, digest=False).collect()}
    for d, t, *_ in EDGES:
        assert full[d]["decoded"] == (t or "")
    assert full[1]["ids"] == [] and unigram.tokenise(edges.limit(0), PIECES).count() == 0
    pieces, scores, fallback = unigram.load(PIECES)
    table = {p.decode(): s for p, s in zip(pieces, scores, strict=True) if p}
    low = min(scores) - 10.0
    by_id = dict(enumerate(scores))
    for t in [*list(texts.values())[:3], "a  b 日本 \U0001f600\n\tx"]:
        t = t[:150]
        ids = unigram.Unigram(unigram.double_array(pieces), pieces, scores, fallback).viterbi((" " + t).replace(" ", unigram.MARK).encode())
        got, k = 0.0, 0
        while k < len(ids):
            if ids[k] in fallback:  # the bytes of one character cost low together
                lead = fallback.index(ids[k])
                k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                got += low
            else:
                got, k = got + by_id[ids[k]], k + 1
        assert abs(got - best_score((" " + t).replace(" ", unigram.MARK), table, low)) < 1e-6


def test_unigram_many_words_at_once(texts, monkeypatch):
    pieces, scores, fallback = unigram.load(PIECES)
    tables = unigram.double_array(pieces)
    model, plain = unigram.Unigram(tables, pieces, scores, fallback), unigram.Unigram(tables, pieces, scores, fallback)
    marked = lambda w: w.replace(" ", unigram.MARK).encode()
    # 20,000 words that occur once each take less than half of what one by one takes
    rng = np.random.default_rng(9)
    known = sorted({w for t in texts.values() for w in t.split()})
    words = list(dict.fromkeys("".join(known[i] for i in pick) for pick in rng.integers(0, len(known), (20_000, 2))))
    plain.viterbi(b"x")
    begun = time.thread_time()
    one_by_one = [plain.viterbi(marked(" " + w)) for w in words]
    between = time.thread_time()
    ids = np.frombuffer(model.encode(" ".join(words)), "<u4")
    took = time.thread_time() - between
    assert ids.tolist() == [i for x in one_by_one for i in x]
    assert took < 0.5 * (between - begun)
    # odd texts, slices, and words that are forgotten in between
    odd = [t for _, t, *_ in EDGES if len(t or "") < 1000 or t == LONG] + ["\n", " ", "a\n\n  b \n", "\na", "  ", " a", "x\u2581y \u2581 z", "\u2581", "é" * 300, "日本" * 90, "\U0001f600 \U0001f601\ud7ff\u0301 \x00\x7f", "\ufffd", "\tq\r\n"]
    odd += ["".join(rng.choice(list("ab \nñ日\U0001f600\u2581."), n)) for n in rng.integers(1, 60, 400)] + [None, ""]
    expected = [[i for u in re.findall("\n| *[^ \n]+| +", " " + t) for i in plain.viterbi(marked(u))] if t else [] for t in odd]
    for few, cells, cache, at_once in ((24, 1 << 18, 80 << 20, 4 << 20), (1, 64, 0, 5000), (1, 1 << 20, 80 << 20, 4 << 20), (1 << 30, 1 << 18, 100, 1000)):
        for name, value in (("FEW", few), ("CELLS", cells), ("CACHE_BYTES", cache), ("TEXT_BYTES", at_once)):
            monkeypatch.setattr(unigram, name, value)
        for part in (slice(0, None), slice(3, 9), slice(len(odd) - 2, None)):
            ids, ends, text, heads = model.encode_all(pa.array(odd, pa.string())[part])
            assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == expected[part]
            back, marks = model.spell(ids)
            assert [bytes(back[marks[a] : marks[b]]) for a, b in zip(ends, ends[1:], strict=False)] == [(" " + t).replace(unigram.MARK, " ").encode() if t else b"" for t in odd[part]]
            assert [bytes(text[a:b]) for a, b in zip(heads, heads[1:], strict=False)] == [(" " + t).encode() if t else b"" for t in odd[part]]


def test_licenses(spark, docs, edges, texts):
    both = docs.select("doc_id", "text").unionByName(edges.where("doc_id <> 10").select((-F.col("doc_id")).alias("doc_id"), "text"))
    everything = texts | {-d: t or "" for d, t, *_ in EDGES if d != 10}
    for r in licenses.scan(both).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", everything[r["doc_id"]].translate(LOWER))
        at, found = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += own
            found |= {label} if own else set()
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(at), ",".join(sorted(found)))
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
        assert found <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(edges.limit(0)).count() == 0 and licenses.scan(edges.where("doc_id = 10")).count() == 2


def test_license_suppression():
    assert len(licenses.rules()) > 200
    text = "licensed under the apache license version 2 0 spdx license identifier mit released under the mit license"
    labels = [d[2] for d in licenses.detect(text)]
    assert labels == ["apache-2.0", "mit", "mit"]
    assert [d[2] for d in licenses.detect("this is under the gnu lesser general public license v 2 1 or any later version")] == ["lgpl-2.1"]
    assert licenses.detect("nothing to see") == []


def tune(rng, n):
    time = np.arange(250) / chroma.RATE
    return np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (rng.integers(0, 24) / 12) * time) * 9000 for _ in range(n)])


def test_chroma_alignment(spark):
    rng = np.random.default_rng(4)
    a, b = tune(rng, 80), tune(rng, 80)
    noisy = a + rng.normal(0, 200, len(a))
    late = np.concatenate([tune(rng, 30)[: 40 * chroma.HOP], a])
    pcm = lambda x: x.astype("<i2").tobytes()
    rows = [(100, pcm(a)), (1, pcm(noisy)), (2, pcm(late)), (3, pcm(b)), (4, None), (5, b""), (6, b"\0\0\0"), (7, pcm(a)), (7, pcm(a)), (8, b"\0" * 8000)]
    out = collections.defaultdict(list)
    for r in chroma.matches(spark.createDataFrame(rows, "id long, audio binary")).collect():
        out[r["id"]].append(r)
    assert sum(map(len, out.values())) == len(rows)
    assert out[7][0]["class_id"] == out[100][0]["class_id"] == 7 and out[7][0]["best_query"] == 100 and out[7][0]["bit_errors"] == 0
    assert out[1][0]["best_query"] == 100 and out[1][0]["best_offset"] == 0
    assert out[2][0]["best_query"] == 100 and out[2][0]["best_offset"] == 40
    assert out[3][0]["n_matches"] == out[8][0]["n_matches"] == 0
    assert all(out[k][0]["fingerprint"] is None and out[k][0]["n_matches"] == 0 for k in (4, 5, 6))
    assert chroma.matches(spark.createDataFrame([], "id long, audio binary")).count() == 0


def test_encoder_against_the_tokenizer():
    from tokenizers import Tokenizer

    rng, plain = random.Random(7), Tokenizer.from_file(TOKENIZER)
    latin = [chr(c) for c in range(0, 128) if chr(c) not in "'<" and not 0x1C <= c <= 0x1F] + [chr(c) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7, 0x130)]
    other = list("abcXYZ019 \n\t.,;'’\"<|>­‍日本Σσς²½Ⅷﬁ\U0001f600İı́")
    usual = [chr(c) for c in range(97, 123)] * 6 + list(" .,!_-019") * 4
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))) for pool in (latin, other, usual) for _ in range(1500)] + ["", "<|endoftext|>", "It's we'll"]
    got = packing._encoder(TOKENIZER).encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids + [packing.END] for t in texts]
    assert {bool(packing.ODD.search(t)) for t in texts} == {True, False}


def test_encoder_memory_is_bounded_by_bytes():
    """New words without end, in plain and in odd texts: what a worker keeps stays small and the ids are the tokenizer's."""
    import tracemalloc

    from tokenizers import Tokenizer

    def name(k):
        return "".join(chr(97 + k // 26**p % 26) for p in range(5))

    def texts(k):
        return [" ".join(name(n) for n in range(k, k + 5000)), "\u03b1" + " ".join(f"{name(n)}\u03b2" for n in range(k, k + 2500))]

    encoder, plain = packing._Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    first = encoder.encode(texts(0))
    tracemalloc.start()
    for k in range(5000, 250_000, 5000):
        got = encoder.encode(texts(k))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 40 << 20
    assert encoder.encode(texts(0)) == first
    for own, text in zip(first + got, texts(0) + texts(245_000), strict=True):
        assert np.frombuffer(own, "<u2").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1]
