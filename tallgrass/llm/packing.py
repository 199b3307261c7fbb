"""Packing along a space-filling curve.

A document's token counts, hashed with signs into DIMS projections and scaled to unit length, give a point
of few dimensions; its cell on a 2**ORDER grid has a Hilbert key. Documents are range-partitioned and
sorted by (key, doc_id) and laid end to end along the curve; a sequence takes LENGTH tokens, documents
are cut where one is full. Each partition's last, partial sequence is cut into powers of two, which need
no padding. Token ids travel as 16-bit integers, so that a vocabulary has 65,536 ids at most (a larger one raises); the tokenised table is written once to the shared folder
so that neither the range sampling nor a lost executor tokenises again.

Defined results: a null or empty text is the one end token. Equal texts share a key and are told apart by
doc_id, so a large group of copies is split like any other. Repeated rows are packed each. Further columns
are dropped. An empty table gives no pieces. A very long text is encoded whole, within one task's memory.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_text, mixed, partitions_for, slices, small_batches, word_hashes, written

LENGTH = 2048
DIMS = 4
ORDER = 8
#: Parts whose ids a worker keeps, in arrays of about 25 bytes a part, and bytes of chunks: then it begins anew.
MAX_PARTS = 800_000
CHUNK_BYTES = 32 << 20
END = 1
_WORKER: dict = {}


#: Runs of letters, of digits and of the rest: the tokenizer joins none of them to another, but for an apostrophe's suffix.
PARTS = re.compile(r"[^\W\d_]+|\d+|(?:_|[^\w\s])+")
#: Texts with these are encoded as they are: suffixes, special tokens, letters whose lower case depends on more than themselves.
PLAIN = re.compile("['<\u0130\u03a3\x1c-\x1f]")


#: Texts with other than ASCII and Latin letters, or with what PLAIN names, go by chunks.
ODD = re.compile("['<\u0130\x1c-\x1f]|[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
#: Bytes of lower-cased text: white space, letters (and all of Latin), digits, the rest.
_KINDS = np.full(256, 3, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = 0
_KINDS[97:123] = _KINDS[128:] = 1
_KINDS[48:58] = 2


class _Parts:
    """Ids of parts by their hashes, sorted: objects of Python's would take some 180 bytes a part."""

    def __init__(self):
        self.keys, self.begin, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u2")

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of keys are not held, as places."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """keys ascend and are new."""
        size = np.array([len(x) // 2 for x in ids], np.int32)
        at = np.searchsorted(self.keys, keys)
        self.begin = np.insert(self.begin, at, len(self.ids) + np.cumsum(size, dtype=np.int64) - size)
        self.keys, self.size = np.insert(self.keys, at, keys), np.insert(self.size, at, size)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u2")])


class _Encoder:
    """Ids (16-bit, as bytes) of chunks without a space or line feed between, and of parts; bounded in bytes.

    A new chunk is put together from its parts; new words (runs of letters) are encoded many at a time and
    told apart by the tokens that end a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}  # of one slice
        self.chunks: dict[str, bytes] = {}
        self.chunk_bytes, self.parts = 0, _Parts()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("a vocabulary of more than 65,536 ids")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def learn_words(self, new: list[str]) -> None:
        for k in range(0, len(new), 2000):
            part = new[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u2")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(part):
                raw = ids.tobytes()
                self.words.update((w, raw[2 * a : 2 * b]) for w, a, b in zip(part, [0, *last[:-1].tolist()], last.tolist(), strict=True))
            else:
                self.words.update((w, self.alone(w)) for w in part)

    def learn_parts(self, new: set[str]) -> None:
        self.learn_words([w for w in new if w.isalpha()])
        self.words.update((w, self.alone(w)) for w in new if not w.isalpha())

    def learn(self, chunks: set[str]) -> None:
        split, other = {}, []
        for c in chunks:
            if PLAIN.search(c) or not (c.isascii() or unicodedata.is_normalized("NFC", c)):
                other.append(c)
            else:
                split[c] = PARTS.findall(c.lower())
        self.learn_parts(set().union(*split.values()) - self.words.keys())
        self.chunks.update((c, b"".join(map(self.words.__getitem__, parts))) for c, parts in split.items())
        self.chunks.update((c, self.alone(c)) for c in other)
        self.chunk_bytes += sum(len(c) + len(self.chunks[c]) + 180 for c in chunks)
        self.words.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with the end token: by its parts, or by its chunks where some cannot be split."""
        end = np.array([END], "<u2").tobytes()
        odd = [k for k, t in enumerate(texts) if ODD.search(t)]
        out = self.by_parts([t.lower() for t in texts]) if len(odd) < len(texts) else [b""] * len(texts)
        split = [texts[k].replace("\n", " ").split(" ") for k in odd]  # the tokenizer never joins across white space
        if self.chunk_bytes > CHUNK_BYTES:
            self.chunks.clear()
            self.chunk_bytes = 0
        if new := set(filterfalse(self.chunks.__contains__, chain.from_iterable(split))):
            self.learn(new)
        for k, own in zip(odd, split, strict=True):
            out[k] = self.alone(texts[k]) if "<|" in texts[k] else b"".join(map(self.chunks.__getitem__, own))
        return [x + end for x in out]

    def by_parts(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of ASCII and Latin letters: each different part of a slice is looked up once, by its bytes."""
        data, offsets = flat_text(pa.array(texts, pa.large_string()))
        kinds = _KINDS[data]
        first = np.concatenate([kinds[:1] > 0, (kinds[1:] != kinds[:-1])])
        inner = offsets[1:-1]
        first[inner[inner < len(data)]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        starts, ends = (x[kinds[starts] > 0] for x in (starts, ends))
        if not len(starts):
            return [b""] * len(texts)
        keys, at, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.parts.keys) > MAX_PARTS:
            self.parts = _Parts()
        if len(new := self.parts.missing(keys)):
            raw = data.tobytes()
            words = [raw[a:z].decode() for a, z in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            self.learn_parts(set(words))
            self.parts.add(keys[new], [self.words[w] for w in words])
            self.words.clear()
        place, flat = np.searchsorted(self.parts.keys, keys), self.parts.ids
        size, begin = self.parts.size[place], self.parts.begin[place]
        long = size[which]
        done = np.concatenate([[0], np.cumsum(long)])
        found = flat[np.repeat(begin[which] - done[:-1], long) + np.arange(done[-1])]
        cut = done[np.searchsorted(starts, offsets)]
        return [found[a:z].tobytes() for a, z in pairwise(cut.tolist())]


def _encoder(path: str) -> _Encoder:
    if path not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _WORKER.clear()
        _WORKER[path] = _Encoder(path)
    return _WORKER[path]


def projection(ids: int = 1 << 16, dims: int = DIMS) -> np.ndarray:
    """A sign for each id and dimension: the hashed vector and its random projection in one."""
    h = mixed(np.arange(ids * dims, dtype=np.uint64)).reshape(dims, ids)
    return np.where(h >> np.uint64(63), 1.0, -1.0).astype(np.float32)


def hilbert(cells: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Key along the Hilbert curve of each row of integer cells: (n, dims) in [0, 2**order).

    Skilling's transform: undo the excess rotations from the highest bit down, Gray-encode, interleave."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (order - 1)
    q = bit
    while q > 1:
        low = q - 1
        for i in range(n):
            swap = (x[0] ^ x[i]) & low
            hit = (x[i] & q) != 0
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(hit, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = bit
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(order - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, curve (Hilbert key), n_ids, ids (16-bit little-endian) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, signs = _encoder(path), projection()
        for batch in slices(batches):
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            flat = np.frombuffer(b"".join(ids), "<u2")
            n = np.array([len(x) // 2 for x in ids])
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            points = np.stack([np.add.reduceat(sign[flat], first) for sign in signs], 1)
            points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
            cells = np.clip(((points + 1) / 2 * (1 << ORDER)).astype(np.int64), 0, (1 << ORDER) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(hilbert(cells), pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "curve", "n_ids", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, curve long, n_ids long, ids binary")


def tail_sizes(rest: int) -> list[int]:
    """Powers of two that add up to rest, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long, padding long"


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    spark = docs.sparkSession
    small_batches(spark)
    table = written(tokenised(docs, path), "packing")
    parts = partitions_for(spark, 2 * (table.agg(F.sum("n_ids")).first()[0] or 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        full, used, held = 0, 0, []  # sequences done, tokens in the open one, its pieces

        def rows(pieces: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            out = []
            for doc, n, ids, curve in zip(batch.column("doc_id").to_pylist(), batch.column("n_ids").to_pylist(), batch.column("ids"), batch.column("curve").to_pylist(), strict=True):
                wide, start = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4"), 0
                while start < n:
                    take = min(length - used, n - start)
                    piece = wide[start : start + take]
                    held.append((doc, start, take, piece, n, used, curve))
                    start, used = start + take, used + take
                    if used == length:
                        out += [(d, s, k, zlib.crc32(p.tobytes()), m, first + full, o, c, 0) for d, s, k, p, m, o, c in held]
                        full, used, held = full + 1, 0, []
            if out:
                yield rows(out)
        out, sizes, at = [], tail_sizes(used), 0
        for d, s, k, p, m, _, c in held:
            while k:
                take = min(sizes[0] - at, k)
                out.append((d, s, take, zlib.crc32(p[:take].tobytes()), m, first + full, at, c, 0))
                s, k, p, at = s + take, k - take, p[take:], at + take
                if at == sizes[0]:
                    sizes, at, full = sizes[1:], 0, full + 1
        if out:
            yield rows(out)

    ordered = table.repartitionByRange(parts, "curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    return ordered.mapInArrow(run, SCHEMA)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left, with the public word tokenizer. Null and repeated ids are documents of their own; an empty table
    gives no pieces."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))
