"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on each document. The counts of vote patterns over all
documents (a table of at most 3**m rows) feed expectation-maximisation, which estimates each labeller's
accuracies and the share of good documents; the posteriors of the patterns label a bounded sample of
documents (MAX_TRAIN rows as expected, by a hash of doc_id and text), on which a logistic regression over hashed
features is fitted. The scorer sees words and word shapes, not the votes, and scores every document.

Defined results: null and empty texts get every labeller's abstention and the scorer's bias; they have no
words, so nothing speaks against them or for them, and they are rejected (quality 0). Where all votes
abstain or there is nothing to fit on, every text with words is kept. In texts most of whose bytes are of other than
Latin letters, the labellers that look at words and sentences do not vote against. What a detector speaks against is bad
to the scorer's fit, whatever the other labellers vote. Repeated rows each get a row.
An empty table gives no rows. A very long text is taken whole, with its words' hashes in one task's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, flat_text, mixed, slices, small_batches, text_slices, word_bounds, word_hashes

MAX_TRAIN = 4_000
BUCKETS = 1 << 13
SHAPES = 1 << 11
THRESHOLD = 0.5
# Frequent short words of four languages.
FREQUENT = "the of and to in is it that for on with as are der die das und des den ein mit von zu le la les de et un une des du en que el los las y por con para se su".split()
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = _CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[[ord(c) for c in "!"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
# capitals beyond ASCII, by the two bytes of their UTF-8
_CAPITAL = np.zeros(1 << 16, bool)
_CAPITAL[[int.from_bytes(chr(c).encode()) for c in range(128, 2048) if chr(c).isupper()]] = True
LABELLERS = ("shouting", "symbols", "tables", "repeats", "lengths", "frequent", "sentences")
DETECTORS = 5  # the first labellers, which vote bad or abstain
SURE = 0.01  # at most the posterior of a text that a detector speaks against


def _text_stats(batch: pa.RecordBatch) -> dict:
    """Word and byte statistics of each text of a slice."""
    data, offsets = flat_text(batch.column("text"))
    starts, ends = word_bounds(~SPACE[data], offsets)
    bounds = np.searchsorted(starts, offsets)
    n = np.diff(bounds)
    hashes = word_hashes(LOWER[data], starts, ends)
    doc = np.repeat(np.arange(len(n)), n)
    kinds = _CLASS[data]
    pairs = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
    pairs = pairs[_CAPITAL[data[pairs].astype(np.int64) * 256 + data[pairs + 1]]]
    kinds[pairs] = kinds[pairs + 1] = 2
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    last, first = kinds[ends - 1] if len(ends) else kinds[:0], kinds[starts] if len(starts) else kinds[:0]
    lead = data[starts]
    second = kinds[np.minimum(starts + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), ends - 1)] if len(starts) else kinds[:0]
    frequent = np.isin(hashes, _frequent())
    sums = lambda mask: np.bincount(doc, mask, len(n))
    lone = ((ends - starts) == 1) & (first == 6)
    again = np.zeros(len(doc), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    # words of lines in which lone symbols after the first word (no bullets, quotes or headings) are more than a fifth of the words
    line = np.searchsorted(np.flatnonzero(data == ord("\n")), starts)
    new_line = np.ones(len(doc), bool)
    new_line[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    line = np.cumsum(new_line) - 1
    rows = np.bincount(line, lone & ~new_line) > 0.2 * np.bincount(line) if len(line) else np.zeros(0, bool)
    return {"n": n, "doc": doc, "hashes": hashes, "first": first, "last": last, "second": second, "length": ends - starts, "bytes": np.diff(offsets),
            "wide": per(data >= 128), "lower": per(kinds == 1), "upper": per(kinds == 2), "symbols": per(kinds == 6), "bangs": per(kinds == 5), "distinct": np.bincount(doc[order][new], minlength=len(n)),
            "frequent": sums(frequent), "lone": sums(lone), "rows": sums(rows[line]), "again": sums(again), "capital": sums((first == 2) & (second == 1)), "stops": sums(data[ends - 1] == ord(".")) if len(ends) else np.zeros(len(n))}


_CACHE: dict = {}


def _frequent() -> np.ndarray:
    if "f" not in _CACHE:
        data, offsets = flat_text(pa.array([" ".join(FREQUENT)]))
        _CACHE["f"] = np.unique(word_hashes(data, *word_bounds(~SPACE[data], offsets)))
    return _CACHE["f"]


def votes(s: dict) -> np.ndarray:
    """(texts, labellers) of 1 good, 0 bad, -1 abstain."""
    n = np.maximum(s["n"], 1)
    letters = np.maximum(s["lower"] + s["upper"], 1)
    caps, symbols = s["upper"] / letters, (s["symbols"] - s["lone"]) / n
    some = s["n"] > 0
    share = s["distinct"] / n
    bad = lambda mask: np.where(mask, 0, -1)  # noqa: E731  detectors speak up only where they see something
    other = 2 * s["wide"] > s["bytes"]  # scripts whose words the labellers do not know: they abstain
    out = [
        bad((caps > 0.5) & (s["n"] >= 5) | (s["bangs"] / n > 0.3)),
        bad(symbols > 0.3),
        bad((s["lone"] / n > 0.2) | (s["rows"] / n > 0.2)),
        bad((s["n"] >= 12) & (share < 0.25 * np.minimum(1.0, 1000 / n) ** 1.16) | (s["n"] >= 6) & (s["again"] / n > 0.25)),  # long texts repeat their words more
        bad(~other & ((s["bytes"] / n < 3) | (s["bytes"] / n > 16))),
        np.where(s["frequent"] / n > 0.08, 1, np.where(~other & (s["n"] >= 40) & (s["frequent"] / n < 0.01), 0, -1)),
        np.where((s["stops"] / n > 0.02) & (s["capital"] / n > 0.02), 1, np.where(~other & (s["n"] >= 60), 0, -1)),
    ]
    return np.where(some[:, None], np.stack(out, 1), -1).astype(np.int64)


def features(s: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value): hashed words and word shapes, each family of unit length per text, repetition bins, and the shares
    of words that repeat the one before and of words in table lines."""
    size = BUCKETS + SHAPES + 16
    shape = s["first"] * 512 + s["second"] * 64 + s["last"] * 8 + np.minimum(s["length"] // 3, 7)
    shape = mixed(shape.astype(np.uint64)) % np.uint64(SHAPES)
    key = np.concatenate([s["doc"] * size + (s["hashes"] % np.uint64(BUCKETS)).astype(np.int64), s["doc"] * size + BUCKETS + shape.astype(np.int64)])
    cells, counts = np.unique(key, return_counts=True)
    doc, bucket = np.divmod(cells, size)
    value = np.log1p(counts) * np.where(bucket < BUCKETS, 0.5, 1.0)
    value[bucket >= BUCKETS] = (counts / np.maximum(s["n"][doc], 1))[bucket >= BUCKETS] * 3
    norm = np.sqrt(np.bincount(doc[bucket < BUCKETS], value[bucket < BUCKETS] ** 2, len(s["n"])))
    value = np.where(bucket < BUCKETS, value / np.maximum(norm, 1e-9)[doc], value)
    share = s["distinct"] / np.maximum(s["n"], 1)
    bin_ = np.where(s["n"] >= 12, np.minimum((share * 8).astype(int), 7), 8)
    # words said twice over are all that repetition can be
    text, shares = np.arange(len(s["n"])), [3.0 * np.minimum(by * s[k] / np.maximum(s["n"], 1), 1.0) for k, by in (("again", 2), ("rows", 1))]
    return np.concatenate([doc, text, text, text]), np.concatenate([bucket, BUCKETS + SHAPES + bin_, *(np.full(len(text), BUCKETS + SHAPES + 9 + k) for k in range(2))]), np.concatenate([value, np.full(len(text), 3.0), *shares])


def expectation_maximisation(patterns: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good per pattern; P(abstain, bad, good | class) as (labellers, class, 3); prior.

    The prior never falls below the share of texts that no labeller speaks against: as abstentions say nothing, votes alone need
    not settle the size of the bad class, which could swallow the texts that all find good."""
    m = patterns.shape[1]
    against = (patterns == 0).any(1)
    post = np.where(against, 0.1, 0.95)
    table = np.zeros((m, 2, 3))
    total = max(weight.sum(), 1e-9)
    unopposed, prior = weight[~against].sum() / total, 0.5
    for _ in range(rounds):
        for k in range(m):
            for c, p in ((0, 1 - post), (1, post)):
                table[k, c] = [(weight * p)[patterns[:, k] == v].sum() + 0.5 for v in (-1, 0, 1)]
                table[k, c] /= table[k, c].sum()
        prior = float(np.clip(max((weight * post).sum() / total, unopposed), 0.01, 0.99))
        # a vote counts by how often each class gets it; an abstention says nothing
        odds = np.full(len(patterns), np.log(prior / (1 - prior)))
        for k in range(m):
            vote, lean = patterns[:, k], np.log(table[k, 1, 1:]) - np.log(table[k, 0, 1:])
            odds += np.where(vote >= 0, lean[np.maximum(vote, 0)], 0.0)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, table, prior


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """Labeller accuracies from all documents' votes, then the scorer's weights from the bounded sample."""
    small_batches(docs.sparkSession)
    m = len(LABELLERS)
    radix = 3 ** np.arange(m)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(3**m, np.int64)
        for batch in slices(batches):
            held += np.bincount((votes(_text_stats(batch)) + 1) @ radix, minlength=3**m)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["pattern", "n"])

    counts = docs.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counts.sort()
    ids = np.array([r["pattern"] for r in counts], np.int64)
    weight = np.array([r["n"] for r in counts], float)
    empty = {"weights": np.zeros(BUCKETS + SHAPES + 16, np.float32), "bias": 1.0, "accuracies": None, "prior": 1.0}
    if not len(ids):
        return empty
    held = ids[:, None] // radix % 3 - 1
    post, table, prior = expectation_maximisation(held, weight)
    # a detector speaks of a fault it sees, which votes for frequent words and sentences do not undo
    post = np.where((held[:, :DETECTORS] == 0).any(1), np.minimum(post, SURE), post)
    part = min(1.0, max_train / weight.sum())

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = _text_stats(batch)
            doc, bucket, value = features(s)
            where = np.minimum(np.searchsorted(ids, (votes(s) + 1) @ radix), len(ids) - 1)
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x[order], t)) for x, t in ((bucket, pa.int32()), (value, pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(post[where], pa.float64()), *lists], names=["doc_id", "p", "bucket", "value"])

    # by id and text, so that rows without ids or of one id are not all in or all out; equal rows count once
    picked = docs.select("doc_id", "text").where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(7)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).dropDuplicates()
    rows = picked.where("length(text) > 0").mapInArrow(sample, "doc_id long, p double, bucket array<int>, value array<float>").toArrow()
    if not rows.num_rows:
        return empty | {"accuracies": table, "prior": prior}
    rows = rows.sort_by("doc_id")
    target = rows.column("p").to_numpy()
    cut = np.concatenate([[0], np.cumsum(rows.column("bucket").combine_chunks().value_lengths().to_numpy())])
    doc = np.repeat(np.arange(rows.num_rows), np.diff(cut))
    bucket, value = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("bucket", "value"))
    # both classes count alike, or the rarer would drown
    share = np.clip([(1 - target).sum(), target.sum()], 1e-3, None)
    cost = target / share[1] + (1 - target) / share[0]
    cost /= cost.mean()
    w, bias, step = np.zeros(BUCKETS + SHAPES + 16), 0.0, np.full(BUCKETS + SHAPES + 17, 1e-8)
    for _ in range(250):
        z = np.bincount(doc, value * w[bucket], rows.num_rows) + bias
        slope = cost * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / rows.num_rows
        g = np.append(np.bincount(bucket, slope[doc] * value, len(w)) + 2e-5 * w, slope.sum())
        step += g * g
        move = 0.5 * g / np.sqrt(step)
        w, bias = w - move[:-1], bias - move[-1]
    return {"weights": w.astype(np.float32), "bias": float(bias), "accuracies": table, "prior": prior}


def probability(docs: DataFrame, model: dict) -> Callable[[Column], Column]:
    """The scorer as a function of a text column; only texts go to Python and only numbers come back."""
    weights, bias = docs.sparkSession.sparkContext.broadcast(model["weights"]), model["bias"]

    def of(batch: pa.RecordBatch) -> np.ndarray:
        s = _text_stats(batch)
        doc, bucket, value = features(s)
        z = np.bincount(doc, value * weights.value[bucket], batch.num_rows) + bias
        return np.where(s["n"] > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batches in text_slices(texts):
            yield pa.array(np.concatenate([np.zeros(0), *map(of, batches)]), pa.float64())

    return F.arrow_udf(run, "double")


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """docs with quality_score (probability of good) and quality_pred (1 kept, 0 rejected); columns of those names are replaced."""
    scored = docs.drop("quality_score", "quality_pred").withColumn("quality_score", probability(docs, model)(F.col("text")))
    return scored.withColumn("quality_pred", (F.col("quality_score") >= threshold).cast("int"))


def classify(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"), fit(docs)).select("doc_id", "quality_score", "quality_pred")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of documents that the scorer accepts, with all their columns as they are. Null and empty texts go; null and
    repeated ids are rows like others; an empty table stays empty."""
    return docs.where(probability(docs, fit(docs))(F.col("text")) >= THRESHOLD)
