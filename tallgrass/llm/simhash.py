"""SimHash near duplicates by multi-index hashing: classes of documents whose fingerprints differ in three bits or fewer.

A fingerprint's bit is set where over half of the document's shingles have it set in their 64-bit hash. Equal fingerprints
are one node. Two fingerprints with three differing bits agree in one of their two halves but for one bit at most, so a
table per half holds each fingerprint by that half, and each looks there for its half and for the ball of radius 1 around
it. Of two halves that differ in one bit only the one that has the bit looks: clearing each set bit in turn, it meets the
other's. What meets is compared whole. A task walks through a table entry's fingerprints breadth first: what is reached
is never compared again, so that dense entries (many near copies) cost little more than their size.

An entry that may hold more than a bounded number of fingerprints is not compared within one task. There the ball goes on
into the other half: members give every point within two bits of theirs, lookers every point within one. At one point all
members within one bit, all further members, and all lookers are within three bits of each of the first, so the
least of those links to the others: linear, exact, and a point has 1,600 rows at most.

Defined cases. Null or empty texts, or such without words, have the fingerprint zero and are linked like any other. Very
long texts are hashed in pieces. Rows with equal doc_ids keep their own fingerprints; a null doc_id is never the least, a
component of such rows only has a null id. An empty table gives no rows. Further columns of the input are ignored."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .graph import components

WORDS = 3
SEED = 42
BITS = 3
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Fingerprints with one half in common from which on the half's entries are taken apart by points. It grows with the table,
#: so that there are MAX_DENSE such halves at most; an entry that is compared holds 33 times as many.
DENSE, MAX_DENSE = 4096, 20_000
_SPACE = re.compile(rb"[ \t-\r]")
_HALF = (1 << 32) - 1
_ONES = [np.uint64(1 << k) for k in range(32)]


def fingerprint(text: bytes, n: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text, over pieces of it that are cut at blanks."""
    text_size, at, words, counts, many = len(text), 0, [], np.zeros(64, np.int64), 0
    hashed = xxhash.xxh64_intdigest

    def add(hashes: list[int]) -> None:
        nonlocal many
        for k in range(0, len(hashes), 4096):
            part = np.array(hashes[k : k + 4096], "<u8")
            counts[:] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        many += len(hashes)

    while at < text_size:
        end = min(at + PIECE, text_size)
        if end < text_size:
            gap = _SPACE.search(text, end)
            end = gap.start() if gap else text_size
        words += text[at:end].lower().split()  # bytes: A-Z only, and blanks of ASCII only
        at = end
        if len(words) >= n:
            flat = b" ".join(words)
            edges = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
            add([hashed(flat[a : z - 1], SEED) for a, z in zip(edges, edges[n:])])  # noqa: B905
            words = words[len(words) - n + 1 :]
    if not many and words:
        add([hashed(b" ".join(words), SEED)])
    return int.from_bytes(np.packbits(2 * counts > many, bitorder="little").tobytes(), "little") if many else 0


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        made = np.array([fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    return docs.select("doc_id", "text").mapInArrow(_hashed, "doc_id long, fp long")


# --- links


def _half(fp: Column, side: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if side == 0 else fp.bitwiseAND(_HALF)


def dense_halves(nodes: DataFrame, most: int) -> DataFrame:
    """(side, key): halves that more than most fingerprints have, and those that are one bit short of them."""
    sides = F.array(*(F.struct(F.lit(s).alias("side"), _half(F.col("fp"), s).alias("key")) for s in (0, 1)))
    counts = nodes.select(F.explode(sides).alias("h")).groupBy("h.side", "h.key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    near = F.array(*(F.col("key").bitwiseAND(F.lit(~(1 << b))) for b in range(32)))
    return counts.select("side", F.explode(F.array_union(F.array("key"), near)).alias("key")).distinct()


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, key, fp, own): each fingerprint under both halves, and under each half with one of its set bits cleared."""
    for batch in batches:
        for part in range(0, batch.num_rows, 4096):
            fp = batch.column("fp")[part : part + 4096].to_numpy().view(np.uint64)
            for side in (0, 1):
                half = fp >> np.uint64(32) if side == 0 else fp & np.uint64(_HALF)
                keys, fps, own = [half], [fp], [np.ones(len(fp), bool)]
                for bit in _ONES:
                    has = (half & bit) != 0
                    keys.append(half[has] ^ bit)
                    fps.append(fp[has])
                    own.append(np.zeros(int(has.sum()), bool))
                key = np.concatenate(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), side, np.int32)), pa.array(key.view(np.int64)), pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(own))], names=["side", "key", "fp", "own"])


def reached(fps: np.ndarray) -> np.ndarray:
    """For each of the fingerprints (unsigned) the index of the first one that it reaches by links among them."""
    root = np.arange(len(fps))
    left = np.arange(len(fps))
    while len(left):
        start, left = left[0], left[1:]
        front = [start]
        while front and len(left):
            near = np.bitwise_count(fps[left] ^ fps[front.pop()]) <= BITS
            if near.any():
                found = left[near]
                root[found] = start
                left = left[~near]
                front += found.tolist()
    return root


def _entry(fps: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, first reached) of an entry; lookers alone have nothing to meet."""
    if len(fps) < 2 or not own.any():
        return fps[:0], fps[:0]
    root = reached(fps)
    linked = root != np.arange(len(fps))
    return fps[linked], fps[root[linked]]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the entries of rows that come sorted by side and key; an open entry is carried into the next batch."""
    carried: list[tuple[np.ndarray, ...]] = []

    def links(rows: tuple[np.ndarray, ...], edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, _, fp, own = rows
        made = [_entry(fp[a:z], own[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True) if z - a > 1]
        if made:
            a, b = (np.concatenate([m[k] for m in made]).view(np.int64) for k in (0, 1))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def table() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate([c[k] for c in carried]) for k in range(4))

    for batch in batches:
        if not batch.num_rows:
            continue
        side, key, fp = (batch.column(c).to_numpy() for c in ("side", "key", "fp"))
        own = batch.column("own").to_numpy(zero_copy_only=False)
        now = (side, key, fp.view(np.uint64), own)
        if carried and carried[-1][0][-1] == side[-1] and carried[-1][1][-1] == key[-1] and side[0] == side[-1] and key[0] == key[-1]:
            carried.append(now)  # the entry goes on through the whole batch
            continue
        carried.append(now)
        rows = table()
        edges = np.flatnonzero(np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]))
        yield from links(rows, edges)
        carried = [tuple(c[edges[-1] :] for c in rows)]
    if carried:
        rows = table()
        yield from links(rows, np.array([0, len(rows[0])]))


_MASKS = {
    0: np.zeros(1, np.uint64),
    1: np.array(_ONES),
    2: np.array([a | b for k, a in enumerate(_ONES) for b in _ONES[:k]]),
}


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, key, point, fp, near): the points of the other half around a fingerprint; near are members within one bit."""
    for batch in batches:
        for part in range(0, batch.num_rows, 256):
            rows = batch.slice(part, 256)
            side, key, own = rows.column("side").to_numpy(), rows.column("key").to_numpy(), rows.column("own").to_numpy(zero_copy_only=False)
            fp = rows.column("fp").to_numpy().view(np.uint64)
            other = np.where(side == 0, fp & np.uint64(_HALF), fp >> np.uint64(32))
            for bits, masks in _MASKS.items():
                at = np.flatnonzero(own) if bits == 2 else np.arange(len(fp))
                point = (other[at, None] ^ masks[None, :]).ravel()
                at = np.repeat(at, len(masks))
                near = own[at] & (bits < 2)
                yield pa.RecordBatch.from_arrays([pa.array(side[at]), pa.array(key[at]), pa.array(point.view(np.int64)), pa.array(fp[at].view(np.int64)), pa.array(near)], names=["side", "key", "point", "fp", "near"])


def links(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b) of distinct fingerprints (a written table, fp): enough links to connect what pairs within BITS bits connect."""
    most = most or max(DENSE, nodes.count() // MAX_DENSE)
    dense = written(dense_halves(nodes, most), "dense")
    probes = nodes.select("fp").mapInArrow(_probes, "side int, key long, fp long, own boolean")
    met = lambda rows: rows.repartition("side", "key").sortWithinPartitions("side", "key").mapInArrow(_met, "a long, b long")
    if dense.limit(1).isEmpty():
        return met(probes)
    some = F.broadcast(dense)  # 33 * MAX_DENSE rows a side at most
    plain = met(probes.join(some, ["side", "key"], "left_anti"))
    points = probes.join(some, ["side", "key"], "left_semi").mapInArrow(_points, "side int, key long, point long, fp long, near boolean")
    at = Window.partitionBy("side", "key", "point")
    hubs = points.withColumn("b", F.min(F.when(F.col("near"), F.col("fp"))).over(at)).where("b is not null and b <> fp")
    return plain.unionByName(hubs.select(F.col("fp").alias("a"), "b"))


def near_duplicates(docs: DataFrame, most: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each document; most replaces the bound DENSE in tests."""
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes, most))
    linked = found.withColumnRenamed("node", "fp").join(nodes, "fp")
    tops = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = nodes.join(linked.join(tops, "label").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    made = rows.join(classes, "fp")
    return made.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
