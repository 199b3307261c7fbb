"""Signature rules against a plain scan without gates or trees."""

import random
import re
import time

from tallgrass.llm import licenses

PHRASES = [
    "licensed under the apache license version 2 0", "the mit license", "permission is hereby granted free of charge to any person obtaining a copy", "released under the gnu general public license v3 or later",
    "gnu lesser general public license", "redistribute it and or modify it under the terms of the gnu general public license", "cc by sa 4 0", "creative commons attribution 4 0", "all rights reserved", "spdx license identifier isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0", "altered source versions must be plainly marked as such", "bsd 3 clause license", "public domain", "released into the public domain", "copyright 2019",
]


def plain(words):
    found = sorted(((m.start(), m.end(), label, priority) for label, priority, _, pattern in licenses.rules() for m in pattern.finditer(words)), key=lambda d: (d[3], d[0] - d[1], d[0], d[2]))
    kept = []
    for d in found:
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    return sorted(kept)


def test_detections_by_brute_force():
    rng = random.Random(1)
    labels = set()
    for _ in range(150):
        words = " ".join(rng.choice(PHRASES) if rng.random() < 0.6 else rng.choice(("the", "license", "of", "w7", "under", "cc", "general")) for _ in range(rng.randrange(0, 14)))
        assert licenses.detect(words) == plain(words)
        labels |= {d[2] for d in plain(words)}
    assert len(labels) > 12


def test_keywords_are_in_what_the_rules_match():
    """A gate never hides a detection: each rule's keyword is a part of its own pattern's text."""
    for _, _, keyword, pattern in licenses.rules():
        assert keyword in pattern.pattern.replace(" ?", "").replace("[cs]", "s")
        if len(keyword) <= licenses.SHORT and keyword in licenses.keywords():
            assert re.search(rf"(?<![a-z0-9]){keyword}(?![a-z0-9])", pattern.pattern)
    assert len(licenses.rules()) > 450


def test_scan_by_brute_force(spark):
    rng = random.Random(2)
    docs = [(k, rng.choice(("\n", ", ", " -- ")).join(rng.choice(PHRASES).title() if rng.random() < 0.5 else f"word{k}" for _ in range(rng.randrange(0, 9)))) for k in range(120)]
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, text in docs:
        words = " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split())
        labels = {d[2] for d in plain(words)} | {label for phrase, label in licenses.BASE if f" {phrase} " in f" {words} "}
        assert rows[k]["labels"] == ",".join(sorted(labels)) and rows[k]["n_detections"] == len(plain(words))


def test_many_detections_in_one_text():
    words = " ".join(PHRASES[k % len(PHRASES)] for k in range(20_000))
    began = time.time()
    assert len(licenses.detect(words)) >= 20_000
    assert time.time() - began < 15
