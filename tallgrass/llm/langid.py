"""Language identification by error-correcting output codes.

Each language gets a codeword of bits; for each bit a binary classifier over hashed byte trigrams tells
the languages whose bit is 1 from the others (naive Bayes log odds, from counts over the training rows).
A text's mean log odds per bit are scaled and weighed by the margin that the bit is expected to give its weakest
language, and the codeword of the least logistic loss wins. The score is the winner's share of exp(-loss). A text is ambiguous if the second codeword's
loss is less than a margin above the winner's; the margin is fitted on the training rows, so that clean texts stay
(with one language there is no second codeword, and nothing with a letter is ambiguous).

Training counts the trigrams and the margins of all labelled rows, repeated ones as often as they are there; what comes to
the driver is bounded by languages, buckets and bins. Prediction sees the text only.

Defined results: null texts and texts without a letter are `und` with score 0, as is everything where no
row can be learned from. Ties go to the first language in alphabetical order. Repeated rows each get a row. An empty table
gives no rows. Of a very long text the weights of all trigrams are in one task's memory, about 64 bytes for each of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_text, slices, small_batches, text_slices

BUCKETS = 1 << 15
BITS = 12
#: The ambiguity margin: this quantile of the training rows' margins times the slack, and at most this share of the
#: margin that a typical text has between the two closest codewords (what matters where few rows are learned from).
QUANTILE, SLACK, MOST = 0.001, 0.75, 1 / 3
#: Margins are counted in so many bins up to where the quantile no longer matters.
BINS = 1 << 16
_LETTER = regex.compile(r"\p{L}")
#: Bytes as the trigrams see them: lower case, letters of any script, one mark for all the rest.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams (text by text) and each text's n+1 bounds among them."""
    b = _FOLD[data]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    codes = (((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1]) * np.uint32(0x85EBCA77) ^ b[2:]) * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    keep = ~((b[:-2] == 32) & (b[1:-1] == 32))
    inner = offsets[1:-1]
    for back in (1, 2):
        cut = inner - back
        keep[cut[(cut >= 0) & (cut < len(keep))]] = False
    sums = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep].astype(np.int64), sums[np.minimum(offsets, len(keep))]


def codewords(n: int, bits: int = BITS, seed: int = 11) -> np.ndarray:
    """n rows of +-1, far apart: of many seeded draws, the one whose least distance is largest."""
    rng = np.random.default_rng(seed)
    bits = max(bits, int(np.ceil(2 * np.log2(max(n, 2)))) + 8)
    best, far = None, -1
    for _ in range(400):
        c = np.where(rng.random((n, bits)) < 0.5, -1, 1)
        mixed_bits = np.abs(c.sum(0)) < n if n > 1 else np.ones(bits, bool)
        d = min(((c[i] != c[j]) & mixed_bits).sum() for i in range(n) for j in range(i)) if n > 1 else 0
        if d > far:
            best, far = c[:, mixed_bits] if mixed_bits.any() else c, d
    return best


def _means(text: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Mean log odds per bit of each text; zeros for one without trigrams."""
    codes, bounds = trigrams(*flat_text(text))
    n = np.diff(bounds)
    mean = np.zeros((len(n), weights.shape[1]))
    full = n > 0
    if full.any():
        mean[full] = np.add.reduceat(weights[codes], bounds[:-1][full], axis=0) / n[full, None]
    return mean


def _known(text: pa.Array) -> np.ndarray:
    return np.array([bool(t and _LETTER.search(t)) for t in text.to_pylist()])


def _margin(train: DataFrame, model: dict) -> float:
    """The least margin of a text that is not ambiguous, from all training rows that are decoded to their own language."""
    langs, code, scale = np.array(model["langs"], object), model["code"], model["scale"]
    if len(langs) < 2:
        return 0.0
    shared = train.sparkSession.sparkContext.broadcast(model["weights"])
    small = {k: v for k, v in model.items() if k != "weights"}
    typical = 3.0 * min(((scale / scale.sum()) * (code[i] != code[j])).sum() for i in range(len(code)) for j in range(i))
    width = MOST * typical / SLACK / BINS

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BINS + 1, np.int64)
        for batch in slices(batches, limit=1 << 18):
            which, _, margin = decode(_means(batch.column("text"), shared.value), small)
            own = _known(batch.column("text")) & (langs[which] == np.array(batch.column("lang").to_pylist(), object))
            held += np.bincount(np.minimum(margin[own] / width, BINS).astype(np.int64), minlength=BINS + 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], names=["bin", "n"])

    rows = train.select("lang", "text").mapInArrow(margins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS + 1 rows at most
    if not rows:
        return float(MOST * typical)
    bins, n = np.array(sorted((r["bin"], r["n"]) for r in rows), np.int64).T
    # the last bin holds all margins that the share of the typical one bounds
    rank = int(QUANTILE * (n.sum() - 1))
    return float(min(MOST * typical, SLACK * width * bins[np.searchsorted(np.cumsum(n), rank, "right")]))


def fit(train: DataFrame) -> dict:
    """Codewords and weights from (text, lang) rows; a dict of a fixed size per language."""
    small_batches(train.sparkSession)
    train = train.where("lang is not null and text is not null").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            codes, bounds = trigrams(*flat_text(batch.column("text")))
            langs, which = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            for k, lang in enumerate(langs):
                own = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(codes[np.repeat(which == k, np.diff(bounds))], minlength=BUCKETS)
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = train.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c")).collect()
    langs = sorted(r["lang"] for r in rows)
    if not langs:
        return {"langs": [], "code": np.zeros((0, 1)), "weights": np.zeros((BUCKETS, 1), np.float32), "scale": np.ones(1), "margin": 0.0}
    counts = np.zeros((len(langs), BUCKETS))
    for r in rows:
        for bucket, n in r["c"]:
            counts[langs.index(r["lang"]), bucket] = n
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    code = codewords(len(langs))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for k in range(code.shape[1]):
        one, two = share[code[:, k] > 0], share[code[:, k] < 0]
        if len(one) and len(two):
            weights[:, k] = np.log(one.mean(0)) - np.log(two.mean(0))
    # expected margin of each bit for its own languages: the weakest language sets the bit's scale and its weight
    mean = share @ weights
    margin = np.maximum((mean * code).min(0), 1e-3) if len(langs) > 1 else np.ones(code.shape[1])
    model = {"langs": langs, "code": code, "weights": weights, "scale": margin}
    return model | {"margin": _margin(train, model)}


def decode(mean: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the winning language, its score and its margin to the second, from mean log odds (texts x bits)."""
    code, scale = model["code"], model["scale"]
    trust = scale / scale.sum()
    loss = np.stack([(np.log1p(np.exp(np.clip(-3.0 * c * mean / scale, -60, 60))) * trust).sum(1) for c in code], 1)
    near = np.exp(-4.0 * (loss - loss.min(1, keepdims=True)))
    if len(code) < 2:
        return loss.argmin(1), np.ones(len(mean)), np.full(len(mean), np.inf)
    least = np.partition(loss, 1, axis=1)
    return loss.argmin(1), near.max(1) / near.sum(1), least[:, 1] - least[:, 0]


def language(docs: DataFrame, model: dict, returns: str) -> Callable[[Column], Column]:
    """lang_pred, score and ambiguous as functions of a text column: a struct of those named in returns, or one of them."""
    langs, weights = np.array([*model["langs"], "und"], object), model["weights"]
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS x bits floats
    small = {k: v for k, v in model.items() if k != "weights"}

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        mean = _means(batch.column("text"), shared.value)
        known = _known(batch.column("text")) & bool(small["langs"])
        which, score, margin = decode(mean, small) if small["langs"] else (np.zeros(batch.num_rows, int), *np.zeros((2, batch.num_rows)))
        return langs[np.where(known, which, len(langs) - 1)], np.where(known, score, 0.0), ~known | (margin < small["margin"])

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batches in text_slices(texts, limit=1 << 18):
            found = [of(b) for b in batches]
            lang, score, ambiguous = (np.concatenate([np.zeros(0, t), *(f[k] for f in found)]) for k, t in enumerate((object, float, bool)))
            columns = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "ambiguous": pa.array(ambiguous, pa.bool_())}
            yield pa.StructArray.from_arrays(columns.values(), columns.keys()) if returns == ALL else columns["ambiguous"]

    return F.arrow_udf(run, returns)


ALL = "struct<lang_pred:string,score:double,ambiguous:boolean>"


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred, score and ambiguous added; columns of those names are replaced."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    return docs.select(*kept, language(docs, model, ALL)(F.col("text")).alias("_language")).select(*kept, "_language.*")


def held_out() -> F.Column:
    """Rows whose crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, ambiguous; learned from rows not held out."""
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of documents with a language, with all their columns as they are: those without a letter and those flagged as ambiguous go.

    Null and repeated ids are rows like others; an empty table stays empty."""
    return docs.where(~language(docs, fit(docs.where(~held_out())), "boolean")(F.col("text")))
