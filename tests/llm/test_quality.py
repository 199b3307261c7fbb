"""Votes of the labellers, the posterior by plain sums, the scorer by its own weights."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tallgrass.llm import quality


def stats(*texts):
    return quality._text_stats(pa.RecordBatch.from_pydict({"text": list(texts)}))


def test_other_scripts_get_no_votes_against_words():
    votes = quality.votes(stats("Это длинный русский текст о погоде и реках " * 12, "日本語の文章" * 80, "zzz qqq xxx " * 40, None, "", "The cat sat. It was the cat of the house."))
    by = {n: votes[:, k] for k, n in enumerate(quality.LABELLERS)}
    for name in ("lengths", "frequent", "sentences"):
        assert by[name][0] == by[name][1] == -1
    assert by["frequent"][2] == by["sentences"][2] == 0
    assert (votes[3:5] == -1).all() and by["frequent"][5] == 1


def test_posterior_is_that_of_its_tables():
    rng = np.random.default_rng(2)
    patterns = np.unique(rng.integers(-1, 2, (40, 4)), axis=0)
    weight = rng.integers(1, 50, len(patterns)).astype(float)
    post, table, prior = quality.expectation_maximisation(patterns, weight, rounds=400)
    for row, p in zip(patterns, post, strict=True):
        odds = math.log(prior / (1 - prior)) + sum(math.log(table[k, 1, v + 1] / table[k, 0, v + 1]) for k, v in enumerate(row) if v >= 0)
        assert p == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6)
    for k in range(4):  # the tables are those of the posterior, at rest
        for c, q in ((0, 1 - post), (1, post)):
            want = np.array([(weight * q)[patterns[:, k] == v].sum() + 0.5 for v in (-1, 0, 1)])
            np.testing.assert_allclose(table[k, c], want / want.sum(), atol=1e-3)


def test_scores_by_plain_sums(spark):
    rng = random.Random(1)
    docs = [(k, " ".join(rng.choice(("the", "of", "cat.", "$$$", "A1", "été")) for _ in range(rng.randrange(0, 40)))) for k in range(80)] + [(80, None), (None, "the cat")]
    weights = np.random.default_rng(1).normal(size=quality.BUCKETS + quality.SHAPES + 16).astype(np.float32)
    model = {"weights": weights, "bias": -0.3}
    rows = quality.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = stats(r["text"])
        doc, bucket, value = quality.features(s)
        z = float(sum(v * weights[b] for b, v in zip(bucket, value, strict=True))) - 0.3
        assert r["quality_score"] == pytest.approx(1 / (1 + math.exp(-z)) if s["n"][0] else 0.0, rel=1e-4)
        assert r["quality_pred"] == int(r["quality_score"] >= quality.THRESHOLD)


def test_words_said_twice_table_lines_and_accented_capitals():
    # as in sf0.1: documents 2667, 514 and the like of 7270
    twice, table = "Tación Tación dota dota que que del del ñra, ñra, jaja jaja raes raes que que", "The and attion to thanedble the, anea. Eriner thanea.\nthbleatly | thstnd. |\nTheand thble reingwh thorin."
    french = "Être le bleu. École et ciel vert pour dix. À la mer de vent. " * 3
    s = stats(twice, table, french, "Smith & Sons was the best of the shops. " * 3, "a | b\nthe cat sat on the mat and went to sleep in it", None, "", "ПРИВЕТ МИР ЭТО ОЧЕНЬ ГРОМКО", "那 那 那 那", "that that")
    by = dict(zip(quality.LABELLERS, quality.votes(s).T, strict=True))
    assert by["repeats"].tolist() == [0, -1, -1, -1, -1, -1, -1, -1, -1, -1]
    assert by["tables"].tolist() == [-1, 0, -1, -1, -1, -1, -1, -1, -1, -1]  # an ampersand in prose is no table, nor three words of fifteen
    assert by["shouting"].tolist() == [-1, -1, -1, -1, -1, -1, -1, 0, -1, -1]
    assert by["sentences"][2] == 1
    assert s["capital"][2] == 6 and s["again"][0] == 8 and s["rows"][1] == 4  # "À" alone is one letter


def test_lines_end_with_their_text():
    """A table's line and a repeated word do not reach into the next text of the slice."""
    s = stats("one | |", "two | | two", "two three", "| |\n| four five six seven eight nine", "* ten\n# ten\n> ten ten")
    assert s["rows"].tolist() == [3, 4, 0, 2, 0] and s["again"].tolist() == [1, 1, 0, 2, 1]


def test_texts_that_all_find_good_stay_good():
    """The counts of check_h: most of the bad texts have frequent words or sentences."""
    patterns = np.array([[-1, -1, -1, -1, -1, 1, 1], [-1, -1, -1, 0, -1, 1, 1], [0, -1, -1, 0, -1, 0, 0], [-1, -1, 0, -1, -1, 0, 1], [-1, -1, 0, -1, -1, -1, 1], [-1, 0, -1, -1, -1, 0, 0], [-1, -1, -1, 0, -1, 1, 0], [-1, -1, -1, -1, -1, -1, 1], [-1, 0, -1, -1, -1, -1, 1], [-1, 0, -1, -1, -1, 0, 1], [0, -1, -1, -1, -1, -1, 1]])
    weight = np.array([43324, 1897, 987, 719, 659, 552, 523, 479, 474, 418, 250], float)
    for rounds in (60, 600):
        post, _, prior = quality.expectation_maximisation(patterns, weight, rounds)
        assert prior == pytest.approx(weight[[0, 7]].sum() / weight.sum())
        assert (post[[0, 7]] > prior).all()


def test_plain_prose_is_kept_beside_faults_with_good_words(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice(("ri", "sto", "clou", "pa", "gre", "sev", "mar", "win")) for _ in range(3)) for _ in range(400)]
    prose = lambda n: " ".join(f"The {rng.choice(words)} of the {rng.choice(words)} is {rng.choice(words)}." for _ in range(n))
    good = [prose(rng.randrange(1, 12)) for _ in range(300)]
    # tables without frequent words and runs of a word without sentences, so that the votes beside the detectors' split
    bad = [" | ".join(rng.choice(words).title() + "." for _ in range(30)) + " |" for _ in range(60)] + [" ".join(w for w in rng.sample(("the", "of", "and", "in", *words), 6) for _ in range(12)) for _ in range(60)]
    bad += [prose(2) + "\n" + " ".join([f"Is {rng.choice(words)}."] * 90) for _ in range(30)] + [" ".join(w for w in prose(2).split() for _ in range(2)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    found = {r["doc_id"]: r["quality_pred"] for r in quality.classify(docs).collect()}
    assert [found[k] for k in range(len(good))] == [1] * len(good)
    assert [found[len(good) + k] for k in range(len(bad))] == [0] * len(bad)
