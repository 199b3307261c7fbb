"""The pipeline's stages, each against a plain computation on what its predecessor kept."""

import re

import numpy as np

import corpus_pipeline
from tallgrass.llm import langid, quality, queries
from tallgrass.llm.common import written

from .test_operators import base_spans
from .test_shingle_join import brute


def test_stages(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], sf), re.sub(r"\W", "", name)))
    assert all(k.columns == columns for k in kept[:-1])
    rows = [{r["doc_id"]: r for r in k.collect()} for k in kept[:-1]]
    good = {r["doc_id"] for r in quality.classify(kept[0]).collect() if r["quality_pred"] == 1}
    assert rows[1].keys() == good
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert np.mean([d in good for d, q in labels.items() if q == 1]) > 0.97
    spoken = {r["doc_id"] for r in langid.predict(kept[1].select("doc_id", "text"), langid.fit(kept[1].where(~langid.held_out()))).collect() if r["lang_pred"] != "und" and not r["ambiguous"]}
    assert rows[2].keys() == spoken
    components = brute([(d, r["text"]) for d, r in rows[2].items()], 5, 80)
    assert rows[3].keys() == {d for d, (_, c) in components.items() if c == d} and len(rows[3]) < len(rows[2])
    for d, r in rows[4].items():
        before, spans = rows[3][d]["text"], base_spans(rows[3][d]["text"])
        assert not spans or (r["text"] != before and all(before[a:z] not in r["text"] for a, _, _, z in spans))
        assert r["n_chars"] == len(r["text"])
        if not re.search("[0-9@]", before):
            assert r["text"] == before
    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    total = {}
    for p in kept[5].collect():
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total == {d: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for d, r in rows[4].items()}


def test_empty_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
