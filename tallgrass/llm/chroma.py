"""Chroma fingerprints of audio columns and their alignment.

A recording (16-bit PCM) is cut into overlapping frames; the magnitudes of their spectra are summed into
twelve pitch classes and normalised. An integral image over (frames, classes) lets each of the filters
compare areas of a window of WIDE frames with a few sums; a filter's value, quantised to two bits by fixed
bounds, goes Gray-coded into a packed integer, one per frame.

Alignment: every recording whose id is divisible by 100 is a query against all recordings. Recordings of
equal fingerprints are one class; a class is compared once. Noise flips first the bits whose values lie next to a
bound, so a query's code is indexed with its WEAK weakest bits either way. Queries go in blocks of about BLOCK
recordings, one after the other, each a broadcast of bounded size that is given up before the next; a task finds a
recording's codes in the block's index, counts them by query and offset, and takes the bit errors over the overlap
of the offsets with VOTES codes or more. Of a run of equal codes, such as silence, only the first is indexed and
looked up. The index is approximate: a test measures its recall against all offsets of all pairs.

Defined results: null, empty and too short recordings have no codes, a null fingerprint and no matches;
silence has codes of its own. A match overlaps by LEAST codes or by the whole of the shorter recording. Of equal bit
errors the smaller offset wins. A class with a query matches that query at offset 0 in any case. Repeated rows each
get a row. An empty table gives no rows. A recording is in one task's memory as a whole, with its frames.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

RATE = 4_000
FRAME, HOP = 512, 128
WIDE = 8
#: Queries of a block, and their codes: about 32 index entries of 12 bytes each, besides those of a longest recording.
BLOCK, BLOCK_CODES = 512, 1 << 17
#: Bits of a query's code that are tried either way.
WEAK = 5
#: Equal codes that an offset needs, the share of wrong bits that a match may have, and the codes that it overlaps by.
VOTES, ERRORS, LEAST = 2, 0.2, 24
#: Hits of codes that a task counts at once.
HITS = 2_000_000
# Filters as (kind, first class, classes, frames); kinds: 0 whole, 1 upper - lower, 2 later - earlier, 3 checker, 4 middle in class, 5 middle in time.
FILTERS = ((0, 4, 3, 8), (4, 4, 6, 8), (1, 0, 4, 8), (3, 8, 2, 8), (3, 4, 4, 6), (4, 0, 3, 5), (1, 2, 2, 8), (2, 7, 3, 4), (2, 6, 2, 8), (2, 1, 3, 8), (5, 10, 1, 8), (3, 6, 4, 8), (1, 9, 2, 8), (3, 3, 4, 4), (2, 2, 1, 8), (5, 5, 5, 8))
BOUNDS = np.array([-0.12, 0.0, 0.12])
GRAY = np.array([0, 1, 3, 2], np.uint32)


def _classes(rate: int, frame: int) -> np.ndarray:
    """Weights of spectrum bins in the twelve pitch classes, between 60 Hz and half the rate."""
    freq = np.fft.rfftfreq(frame, 1 / rate)
    use = (freq >= 60) & (freq < rate / 2)
    note = np.zeros(len(freq), int)
    note[use] = np.round(12 * np.log2(freq[use] / 440.0)).astype(int) % 12
    out = np.zeros((len(freq), 12))
    out[np.flatnonzero(use), note[use]] = 1.0
    return out


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """(frames, 12) of unit length each, or zero where silent."""
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    if not n:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    out = np.abs(np.fft.rfft(frames, axis=1)) @ _classes(rate, FRAME)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 1.0, out / np.maximum(size, 1e-9), 0.0)


def values(image: np.ndarray) -> np.ndarray:
    """The filters' values for each window of WIDE frames: (windows, filters)."""
    n = len(image) - WIDE + 1
    if n <= 0:
        return np.zeros((0, len(FILTERS)))
    sums = np.zeros((len(image) + 1, 13))
    sums[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0, t1, c0, c1):
        c0, c1 = min(c0, 12), min(c1, 12)
        return sums[at + t1, c1] - sums[at + t0, c1] - sums[at + t1, c0] + sums[at + t0, c0]

    out = []
    for kind, c, h, w in FILTERS:
        h = min(h, 12 - c)
        mid, half, third, part = c + (h + 1) // 2, w // 2, w // 3, max(h // 3, 1)
        whole = area(0, w, c, c + h)
        if kind == 0:
            a, b = whole, area(0, w, 0, 12) - whole
        elif kind == 1:
            a, b = area(0, w, mid, c + h), area(0, w, c, mid)
        elif kind == 2:
            a, b = area(half, w, c, c + h), area(0, half, c, c + h)
        elif kind == 3:
            a = area(0, half, mid, c + h) + area(half, w, c, mid)
            b = whole - a
        elif kind == 4:
            a = area(0, w, c + part, c + h - part) if h > 2 * part else whole / 2
            b = whole - a
        else:
            a = area(third, w - third, c, c + h)
            b = whole - a
        out.append(np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0)))
    return np.stack(out, 1)


_SHIFTS = np.arange(2 * len(FILTERS) - 2, -1, -2).astype(np.uint32)


def codes(found: np.ndarray) -> np.ndarray:
    """One packed 32-bit integer per row of values."""
    return np.bitwise_or.reduce(GRAY[np.searchsorted(BOUNDS, found)] << _SHIFTS, axis=1) if len(found) else np.zeros(0, np.uint32)


def weak_bits(found: np.ndarray, many: int = WEAK) -> np.ndarray:
    """The bits that flip where a value passes the bound next to it, of the filters nearest to one: (rows, many)."""
    level = np.searchsorted(BOUNDS, found)
    near = np.abs(found[:, :, None] - BOUNDS).argmin(2)
    flip = (GRAY[level] ^ GRAY[np.where(level == near, near + 1, near)]) << _SHIFTS
    order = np.argsort(np.abs(found - BOUNDS[near]), axis=1, kind="stable")[:, :many]
    return np.take_along_axis(flip, order, 1)


def run_starts(own: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)


def fingerprints(recordings: DataFrame, audio: str = "audio", key: str = "id") -> DataFrame:
    """id, n_frames, n_codes, codes (little-endian unsigned 32-bit), fingerprint (hash of the codes; null for none), and
    weak: the weak bits of the codes of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part, rows = batch.slice(k, 512), []
                for i, pcm in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    raw = pcm.as_py() or b""
                    image = chroma(np.frombuffer(raw[: len(raw) // 2 * 2], "<i2"))
                    found = values(image)
                    own = codes(found)
                    weak = weak_bits(found).astype("<u4").tobytes() if len(own) and i is not None and i % 100 == 0 else None
                    rows.append((i, len(image), len(own), own.astype("<u4").tobytes(), hashlib.sha256(own.tobytes()).hexdigest()[:32] if len(own) else None, weak))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary()), strict=True)], names=["id", "n_frames", "n_codes", "codes", "fingerprint", "weak"])

    return recordings.select(F.col(key).alias("id"), F.col(audio)).mapInArrow(run, "id long, n_frames long, n_codes long, codes binary, fingerprint string, weak binary")


class Index:
    """Codes of a block of queries, with their weak bits either way, sorted."""

    def __init__(self, ids: np.ndarray, each: list[np.ndarray], weak: list[np.ndarray]):
        self.ids, self.each = ids, each
        flat, owner, place = [], [], []
        self.starts = []
        for q, (own, bits) in enumerate(zip(each, weak, strict=True)):
            at = run_starts(own)
            tried = own[at][:, None]
            for k in range(bits.shape[1]):
                tried = np.concatenate([tried, tried ^ bits[at, k : k + 1]], axis=1)
            flat.append(tried.ravel())
            place.append(np.repeat(at, tried.shape[1]))
            owner.append(np.full(tried.size, q))
            self.starts.append(len(at))
        flat, owner, place = (np.concatenate(x) for x in (flat, owner, place))
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.place = flat[order], owner[order].astype(np.int32), place[order].astype(np.int32)

    def candidates(self, own: np.ndarray) -> list[tuple[int, int]]:
        """(query, offset) with the votes that they need; a query's code lies offset codes earlier than the recording's."""
        at = run_starts(own)
        low, high = np.searchsorted(self.flat, own[at], "left"), np.searchsorted(self.flat, own[at], "right")
        n, held = high - low, {}
        ends = np.searchsorted(np.cumsum(n), np.arange(HITS, n.sum() + HITS, HITS)) + 1 if n.sum() else []
        first = 0
        for end in ends:
            m = n[first:end]
            hit = np.repeat(low[first:end] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            shift = np.repeat(at[first:end], m) - self.place[hit]
            cell, votes = np.unique((self.owner[hit].astype(np.int64) << 33) + shift + (1 << 32), return_counts=True)
            if len(ends) == 1:
                need = np.minimum(VOTES, np.minimum(len(at), np.array(self.starts)))[cell >> 33]
                cell = cell[votes >= need]
                return list(zip((cell >> 33).tolist(), ((cell & ((1 << 33) - 1)) - (1 << 32)).tolist(), strict=True))
            for c, v in zip(cell.tolist(), votes.tolist(), strict=True):
                held[c] = held.get(c, 0) + v
            first = end
        return [(c >> 33, (c & ((1 << 33) - 1)) - (1 << 32)) for c, v in held.items() if v >= min(VOTES, len(at), self.starts[c >> 33])]

    def matches(self, own: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(query id, offset, share of wrong bits, overlap) of the best offset of each query that the recording aligns with."""
        best: dict[int, tuple] = {}
        for q, s in self.candidates(own):
            other = self.each[q]
            a, b = max(0, s), min(len(own), len(other) + s)
            if b - a < min(LEAST, len(own), len(other)):
                continue
            wrong = np.bitwise_count(own[a:b] ^ other[a - s : b - s]).sum() / (32.0 * (b - a))
            if wrong <= ERRORS and (wrong, abs(s), s) < best.get(q, (9.0,))[:3]:
                best[q] = (wrong, abs(s), s, b - a)
        return [(int(self.ids[q]), s, float(w), k) for q, (w, _, s, k) in best.items()]


FOUND = "query long, rep long, frame_offset long, errors double, overlap long"


def align(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """FOUND of classes (rep, codes) that a query (query, codes, weak) aligns with."""
    spark = classes.sparkSession
    path = f"{shared_dir(spark)}/tables/alignments-{uuid.uuid4().hex}"
    spark.createDataFrame([], FOUND).write.parquet(path)
    many, codes = queries.agg(F.count(F.lit(1)), F.sum(F.floor(F.length("codes") / 4))).first()
    blocks = max(1, -(-many // BLOCK), -(-(codes or 0) // BLOCK_CODES))  # long recordings make more blocks of fewer
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toArrow()  # about BLOCK recordings and BLOCK_CODES codes
        if not rows.num_rows:
            continue
        each = [np.frombuffer(c, "<u4") for c in rows.column("codes").to_pylist()]
        weak = [np.frombuffer(c, "<u4").reshape(-1, WEAK) for c in rows.column("weak").to_pylist()]
        shared = spark.sparkContext.broadcast(Index(rows.column("query").to_numpy(), each, weak))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                out = []
                for rep, raw in zip(batch.column("rep").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                    out += [(q, rep, s, w, k) for q, s, w, k in index.matches(np.frombuffer(raw, "<u4"))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])

        classes.select("rep", "codes").mapInArrow(run, FOUND).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(FOUND).parquet(path)


def matches(recordings: DataFrame, audio: str = "audio", key: str = "id") -> DataFrame:
    """One row per recording: id, n_frames, n_codes, fingerprint, class_id, n_matches, best query, offset, errors, pairs.

    pairs lists query:offset:errors of the query classes that the recording's class aligns with, nearest first."""
    made = written(fingerprints(recordings, audio, key), "fingerprints")
    query = F.when(F.col("id") % 100 == 0, F.col("id"))
    known = made.where("n_codes > 0").groupBy("fingerprint").agg(F.min("id").alias("rep"), F.first("codes").alias("codes"), F.min(query).alias("query"), F.min_by("weak", query).alias("weak"))
    classes = written(known.where("rep is not null").repartition("fingerprint"), "classes")
    asked = classes.where("query is not null")
    itself = asked.select("query", "rep", F.lit(0).cast("long").alias("frame_offset"), F.lit(0.0).alias("errors"), F.floor(F.length("codes") / 4).alias("overlap"))
    found = align(classes, asked.select("query", "codes", "weak")).unionByName(itself)
    found = found.groupBy("query", "rep").agg(F.min(F.struct("errors", F.abs("frame_offset").alias("by"), "frame_offset")).alias("m")).select("query", "rep", "m.errors", "m.frame_offset")
    lists = found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("errors", "query", "frame_offset"))).alias("m"))
    by_class = classes.select("fingerprint", "rep").join(lists, "rep", "left")
    near = F.get("m", F.lit(0))
    return made.drop("codes", "weak").join(by_class, "fingerprint", "left").select(
        "id", "n_frames", "n_codes", "fingerprint", F.col("rep").alias("class_id"), F.coalesce(F.size("m"), F.lit(0)).alias("n_matches"),
        near["query"].alias("best_query"), near["frame_offset"].alias("best_offset"), F.round(near["errors"], 6).alias("bit_errors"),
        F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["query"].cast("string"), x["frame_offset"].cast("string"), F.round(x["errors"], 4).cast("string"))), ",").alias("pairs"),
    )


def rendered(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A recording for each vector (id, audio), for tables without audio: its numbers choose the notes of a tune of as
    many sixteenths of a second. Null vectors have null audio.

    Of each hundred ids, those that end in 01 to 04 are renditions of the one that ends in 00, if that has a tune: cut at
    both ends; after some notes of their own; with noise; cut off the beat and with more noise. The rest are tunes of
    their own."""
    length = RATE // 16
    part = F.pmod(F.col(key), F.lit(100))
    source = F.when(part.between(1, 4), F.col(key) - part)
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("own"), source.cast("long").alias("source"))
    models = vectors.where(part == 0).groupBy(F.col(key).cast("long").alias("source")).agg(F.min(column).alias("model"))
    alone = own.where("source is null").select("id", "own", F.lit(None).cast(dict(vectors.dtypes)[column]).alias("model"))  # most rows, which stay where they are
    both = alone.unionByName(own.where("source is not null").join(models, "source", "left").select("id", "own", "model"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        time = np.arange(length) / RATE
        envelope = np.minimum(1, np.minimum(time, time[::-1]) * 100)
        notes = np.stack([(np.sin(2 * np.pi * 220 * 2 ** (k / 12) * time) + 0.4 * np.sin(4 * np.pi * 220 * 2 ** (k / 12) * time)) * envelope for k in range(24)])

        def tune(v: list) -> np.ndarray:
            x = np.nan_to_num(np.array([0.0 if y is None else y for y in v], np.float64))
            level = (np.argsort(np.argsort(x, kind="stable"), kind="stable") * 7 + np.floor(np.abs(x) * 40).astype(int)) % 24
            return notes[level].ravel() * 9000

        def rendition(i: int, v: list, model: list) -> np.ndarray:
            sound, kind = tune(model), i % 100
            noise = np.random.default_rng(i & 0xFFFFFFFF)
            if kind == 1:
                return sound[9 * length : len(sound) - 5 * length]
            if kind == 2:
                return np.concatenate([tune(v)[: 7 * length], sound])
            if kind == 3:
                return sound + noise.normal(0, 1500, len(sound))
            sound = sound[6 * length + 40 :]
            return sound + noise.normal(0, 2500, len(sound))

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, audio = batch.slice(k, 256), []
                for i, v, model in zip(part.column("id").to_pylist(), part.column("own").to_pylist(), part.column("model").to_pylist(), strict=True):
                    sound = None if v is None else tune(v) if model is None else rendition(i, v, model)
                    audio.append(None if sound is None else np.clip(sound, -32768, 32767).astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(audio, pa.binary())], names=["id", "audio"])

    return both.mapInArrow(run, "id long, audio binary")
