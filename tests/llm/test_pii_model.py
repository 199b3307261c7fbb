"""The added kinds of personal data: recall and precision on planted spans, overlaps, long texts, redaction."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tallgrass.llm import pii

PLANTED = {
    "secret": (['my api key is {}', "export SECRET={}", "auth token: {} ok", "password={} for the vpn", 'bearer "{}" again'], lambda r: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 48))))),
    "number": (["call us at {} today", "her phone is {}.", "fax {} works", "the mobile {} was lost", "reach them on {}, please"], lambda r: r.choice(("{}-{}-{}", "({}) {}-{}", "{} {} {}")).format(r.randrange(200, 999), r.randrange(200, 999), r.randrange(1000, 9999))),
    "iban": (["IBAN {} please", "pay to bank account {} now", "transfer it to {} soon", "iban: {}", "account {} is closed"], lambda r: "DE" + str(r.randrange(10, 99)) + "".join(f" {r.randrange(1000, 9999)}" for _ in range(4))),
}
HARMLESS = ["commit {h} fixed it", "order {n} shipped", "version {n} of it", "the checksum is {h} now", "between {y} years", "ISBN {n} in print", "section-alpha-beta-gamma-part-12 begins"]


def planted(seed, many):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(6))
    docs, want = [], {}
    for _ in range(many):
        kind = r.choice(list(PLANTED))
        forms, make = PLANTED[kind]
        value, form = make(r), r.choice(forms)
        head = " ".join(word() for _ in range(r.randrange(0, 12))) + " "
        text = head + form.format(value) + " " + " ".join(word() for _ in range(5))
        at = text.index(value)
        want[len(docs)] = (kind, at, at + len(value))
        docs.append((len(docs), text))
    clean = []
    for _ in range(many // 3):
        text = " ".join(word() for _ in range(4)) + " " + r.choice(HARMLESS).format(h="".join(r.choice("0123456789abcdef") for _ in range(40)), n=f"{r.randrange(100, 999)}-{r.randrange(100, 999)}-{r.randrange(1000, 9999)}", y="1990-1991-1992") + " " + word()
        clean.append(len(docs))
        docs.append((len(docs), text))
    return docs, want, clean


def test_recall_of_each_kind_and_thresholds(spark):
    docs, want, clean = planted(3, 600)
    rows = {r["doc_id"]: r["spans"].split(",") for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for kind in PLANTED:
        own = [d for d, w in want.items() if w[0] == kind]
        assert sum(f"{kind}:{want[d][1]}:{want[d][2]}" in rows[d] for d in own) / len(own) >= 0.9, kind
    assert sum(rows[d] == [""] for d in clean) / len(clean) >= 0.9
    _, thresholds = pii.fit(spark)
    assert len({round(thresholds[k], 6) for k in pii.MORE}) == len(pii.MORE) and all(abs(thresholds[k]) > 1e-3 for k in pii.MORE)


def test_threshold_keeps_the_precision():
    assert pii.threshold([(3, 1), (2, 1), (1, 0), (0, 1)], 0.7) == -1e-9
    assert pii.threshold([(3, 1), (2, 1), (1, 0), (0, 0)], 0.9) == 2 - 1e-9
    assert pii.threshold([(1, 1), (1, 0)], 0.9) == 1e9 and pii.threshold([], 0.9) == 1e9


def test_further_kinds_do_not_repeat_base_spans(spark):
    texts = ["ip 152.143.123.131 and +1 (521) 555-6210, call 521-555-6210 now", "card 4111 1111 1111 1111 phone (212) 555-6210", "x@y.example.com token 0123456789abcdef0123456789abcdef"]
    for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        spans = [(int(a), int(z), k) for k, a, z in (s.split(":") for s in r["spans"].split(","))]
        base = [s for s in spans if s[2] in pii.BASE]
        assert base and any(s[2] not in pii.BASE for s in spans)
        assert not any(a < y and x < z for a, z, k in spans if k not in pii.BASE for x, y, _ in base)
        assert r["n_spans"] == len(spans) == sum(r[f"n_{k}"] for k in pii.KINDS)


def test_running_folds(spark):
    rng = random.Random(2)
    for n in (1, 2, 63, 64, 65, 200, 5000):
        v = [rng.randrange(9) for _ in range(n)]
        row = spark.createDataFrame([(v,)], "v array<int>").select(pii.running(F.col("v"), F.lit(0), lambda x, y: x + y).alias("s"), pii.running(F.col("v"), F.lit(0), lambda x, y: F.greatest(x, y)).alias("m")).first()
        assert row["s"] == [sum(v[:k]) for k in range(n)] and row["m"] == [max([0, *v[:k]]) for k in range(n)]


def test_many_matches_in_one_text(spark):
    text = "é mail a1@b.example.com or 10.2.3.4, and " * 20_000
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string").repartition(1)
    pii.fit(spark)
    began = time.time()
    r = {x["doc_id"]: x for x in pii.find(docs).collect()}[1]
    assert (r["n_email"], r["n_ip"]) == (20_000, 20_000)
    assert r["spans"].endswith(f"ip:{len(text) - 41 + 27}:{len(text) - 41 + 35}")
    out = {x["doc_id"]: x["text"] for x in pii.stage(spark, docs, "").collect()}
    assert out[1] == "é mail [EMAIL] or [IP], and " * 20_000 and out[2] == "x"
    assert time.time() - began < 60


def test_redaction_against_plain_code(spark):
    rng = random.Random(4)
    parts = ["a@b.example.com", "10.20.30.40", "\U0001f600é", "word ", " +1 (743) 555-3824 ", "phone 743-555-3824 ", "x" * 5000, "\n"]
    docs = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    for r in pii.stage(spark, df, "").collect():
        text, out, at = dict(docs)[r["doc_id"]], "", 0
        for kind, a, z in (s.split(":") for s in spans[r["doc_id"]].split(",") if s):
            if int(a) >= at:
                out += text[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(z))
        assert r["text"] == out + text[at:]


def test_stage_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.example.com", 5, 6, "f", [1])], "doc_id long, text string, _spans int, found int, kind string, x array<int>")
    row = pii.stage(spark, df, "").first()
    assert row.asDict() == {"doc_id": 1, "text": "[EMAIL]", "_spans": 5, "found": 6, "kind": "f", "x": [1]}
    assert not re.search("Python|Arrow", pii.find(df)._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("text", [None, "", "no data"])
def test_nothing_found(spark, text):
    r = pii.find(spark.createDataFrame([(None, text)], "doc_id long, text string")).first()
    assert (r["spans"], r["n_spans"], r["doc_id"]) == ("", 0, None)
