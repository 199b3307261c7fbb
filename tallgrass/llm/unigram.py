"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary is read from a SentencePiece model file (its path is a parameter). A piece's log score
is -log(rank + 1), rank being its place in the vocabulary's order: the file holds merge ranks, and pieces
are as likely as their rank says by Zipf's rule. Characters without a piece fall back to byte pieces.
White space: each space becomes the marker U+2581 and one marker is put before a text; decoding turns
markers into spaces and drops the first. No piece holds a marker after another character, and line feeds
are bytes of their own, so the best path of a text is that of its marked words one by one. The distinct new
words of a slice are walked together, one array step for all that have a character there; known words are
kept, bounded in bytes.

Defined results: a null text has no tokens and decodes to the empty text; so has an empty one. Of paths
with equal scores the one whose last piece is longest wins. A text that holds the marker itself decodes
to a space there (round_trip is then false). Repeated rows each get a row. An
empty table gives no rows. A very long word is walked in one piece, with about 140 bytes for each of its own in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import flat_text, slices

MARK = "▁"
#: Bytes that a worker's known words may take; beyond, they are forgotten before the next slice.
CACHE_BYTES = 80 << 20
#: Bytes of text whose words are looked up at once (a longer text goes alone).
TEXT_BYTES = 4 << 20
#: Bytes of words, padded to the longest, that are walked at once; fewer words than FEW are walked one by one.
CELLS, FEW = 1 << 18, 24


def load(path: str) -> tuple[list[bytes], list[float], list[int]]:
    """Pieces as UTF-8 (b"" where none), log scores, ids of the 256 byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, scores, fallback = [b""] * n, [0.0] * n, [0] * 256
    order = 0
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            fallback[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            order += 1
            pieces[i] = piece.encode()
            scores[i] = -float(np.log(order + 1))
    return pieces, scores, fallback


def double_array(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and the piece id at each state (-1 for none); state 0 is the root, a byte's code is byte + 1."""
    tree: dict = {}
    for i, piece in enumerate(pieces):
        if piece:
            at = tree
            for byte in piece:
                at = at.setdefault(byte, {})
            at[-1] = i
    size = 1 << 18
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    check[0], free, queue = 0, 1, [(0, tree)]
    while queue:
        state, node = queue.pop()
        value[state] = node.get(-1, -1)
        codes = np.array([b + 1 for b in node if b >= 0], np.int64)
        if not len(codes):
            continue
        while check[free] >= 0:
            free += 1
        at = max(1, free - int(codes.min()))
        while True:  # blocks of places at once
            if at + 4096 + 258 > size:
                base, check, value = (np.concatenate([x, np.full(size, f, np.int64)]) for x, f in ((base, 0), (check, -1), (value, -1)))
                size *= 2
            fits = check[at + codes[0] : at + codes[0] + 4096] < 0
            for c in codes[1:]:
                fits &= check[at + c : at + c + 4096] < 0
            if fits.any():
                at += int(fits.argmax())
                break
            at += 4096
        base[state] = at
        check[at + codes] = state
        queue += [(at + b + 1, child) for b, child in node.items() if b >= 0]
    return base, check, value


def flat_binary(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a column without nulls."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8), offsets - offsets[0]


class Unigram:
    """Best segmentation of marked words; made once per task from the broadcast arrays."""

    def __init__(self, tables: tuple, pieces: list[bytes], scores: list[float], fallback: list[int]):
        base, check, value = tables
        # a state's base plus a byte is always a place: a byte's code is one more, and the end is padded with free places
        more = max(0, int(base.max()) + 258 - len(check))
        self.tables = base + 1, np.concatenate([check, np.full(more, -1)]), value
        # what reaching a state adds, if a piece ends there
        self.gains = np.where(value >= 0, np.array(scores)[value], -np.inf)
        self.fallback = fallback
        self.low = min(scores) - 10.0
        self.raw = [p.replace(MARK.encode(), b" ") for p in pieces]
        for byte, i in enumerate(fallback):
            self.raw[i] = bytes([byte])
        self.spelled = pa.array(self.raw, pa.large_binary())
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends, self.held = np.zeros(0, np.uint32), np.zeros(1, np.int64), 0

    @cached_property
    def lists(self) -> tuple:
        """The tables for single steps."""
        base, check, value = self.tables
        return base.tolist(), check.tolist(), value.tolist(), [None if g == -np.inf else g for g in self.gains.tolist()]

    def learn(self, words: list[bytes]) -> None:
        """Adds the ids of words that are not known yet, walked many at once."""
        marked = [w.replace(b" ", MARK.encode()) for w in words]
        order = np.argsort([len(w) for w in marked], kind="stable")
        words, marked = [words[i] for i in order], [marked[i] for i in order]
        size, at, ids, counts = np.array([len(w) for w in marked], np.int64), 0, [], []
        while at < len(words):
            left = size[at : at + CELLS]  # a block holds as many as fit in CELLS when padded to the longest
            n = max(1, int((left * np.arange(1, len(left) + 1) <= CELLS).sum()))
            if n < FEW:
                found = [np.array(self.viterbi(w), np.uint32) for w in marked[at : at + n]]
                some, each = np.concatenate(found), np.array([len(x) for x in found])
            else:
                some, each = self.block(b"".join(marked[at : at + n]), size[at : at + n])
            ids.append(some)
            counts.append(each)
            at += n
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.held += int(size.sum()) + 150 * len(words)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])
        self.ids = np.concatenate([self.ids, *ids])

    def block(self, data: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """viterbi of several words that follow each other in data: all ids, and how many each word has.

        Words are columns, bytes rows; a step takes all words that have a character there, in the order of viterbi."""
        base, check, value = self.tables
        gains, n, long = self.gains, len(size), int(size.max())
        place = np.arange(long)[:, None]
        inside = place < size
        text = np.full((long, n), 255, np.uint8)  # no piece holds this byte
        text.T[inside.T] = np.frombuffer(data, np.uint8)
        inner = (text & 0xC0) == 0x80
        lead = inside & ~inner
        best, start, last = np.full((long + 1, n), -np.inf), np.zeros((long + 1, n), np.int32), np.full((long + 1, n), -1, np.int32)
        best[0] = 0.0
        for i in range(long):
            at = first = np.flatnonzero(lead[i])
            if not len(at):
                continue
            here = score = best[i].take(at)
            state = np.zeros(len(at), np.int64)
            for j in range(i, long):
                to = base.take(state)
                to += text[j].take(at)
                on = np.flatnonzero(check.take(to) == state)
                if not len(on):
                    break
                if len(on) < len(at):
                    at, to, score = at.take(on), to.take(on), score.take(on)
                state = to
                total = gains.take(state)
                total += score
                up = np.flatnonzero(total > best[j + 1].take(at))
                if len(up):
                    where = at.take(up)
                    best[j + 1][where], start[j + 1][where], last[j + 1][where] = total.take(up), i, value.take(state.take(up))
            end = i + 1
            while len(first):  # a piece that is this very character always beats its bytes
                more = inner[end].take(first) if end < long else np.zeros(len(first), bool)
                at, score = (first[~more], here[~more] + self.low) if more.any() else (first, here + self.low)
                up = np.flatnonzero(score > best[end].take(at))
                if len(up):
                    where = at.take(up)
                    best[end][where], start[end][where], last[end][where] = score.take(up), i, -1
                first, here, end = first[more], here[more], end + 1
        ids, fallback = np.full((long, n), -1, np.int32), np.array(self.fallback, np.int32)
        word, end = np.arange(n), size
        while len(word):
            begin, piece = start[end, word].astype(np.int64), last[end, word]
            ids[begin, word] = piece
            bytewise = np.flatnonzero(piece < 0)
            at, to, of = begin[bytewise], end[bytewise], word[bytewise]
            while len(at):
                ids[at, of] = fallback[text[at, of]]
                on = at + 1 < to
                at, to, of = at[on] + 1, to[on], of[on]
            on = np.flatnonzero(begin)
            word, end = word[on], begin[on]
        found = ids.T >= 0
        return ids.T[found].astype(np.uint32), found.sum(axis=1)

    def viterbi(self, data: bytes) -> list[int]:
        base, check, value, gain = self.lists
        n, none = len(data), float("-inf")
        best, start, last = [0.0] + [none] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            if data[i] & 0xC0 == 0x80:
                continue
            here, state, end = best[i], 0, i + 1
            while end < n and data[end] & 0xC0 == 0x80:
                end += 1
            whole = False
            for j in range(i, n):
                to = base[state] + data[j]
                if check[to] != state:
                    break
                state = to
                score = gain[to]
                if score is not None:
                    j += 1
                    if j == end:
                        whole = True
                    score += here
                    if score > best[j]:
                        best[j], start[j], last[j] = score, i, value[to]
            if not whole and here + self.low > best[end]:
                best[end], start[end], last[end] = here + self.low, i, -1
        ids, at = [], n
        while at:
            i, piece = start[at], last[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.fallback[b] for b in reversed(data[i:at])]
            at = i
        ids.reverse()
        return ids

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts and each text's n+1 offsets there; the texts' bytes, a space before each that is not empty, and their offsets."""
        data, offsets = flat_text(texts)
        some = np.diff(offsets) > 0
        heads = offsets + np.concatenate([[0], np.cumsum(some)])
        first = heads[:-1][some]
        text, own = np.full(heads[-1], 32, np.uint8), np.ones(heads[-1], bool)
        own[first] = False
        text[own] = data
        line, starts = text == 10, text == 32
        starts[1:] &= text[:-1] != 32  # a word has the spaces before it; a line feed stands alone
        starts |= line
        starts[1:] |= line[:-1]
        starts[first] = True
        cuts = np.append(np.flatnonzero(starts), len(text))
        parts, at = [], 0
        while at < len(cuts) - 1:  # one part, but for a text that is longer
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + TEXT_BYTES, "right")) - 1)
            parts.append(self.look_up(text, cuts[at : to + 1]))
            at = to
        ids = np.concatenate([np.zeros(0, "<u4"), *(x for x, _ in parts)])
        ends = np.cumsum(np.concatenate([[0], *(n for _, n in parts)]))
        return ids, ends[np.searchsorted(cuts, heads)], text, heads

    def look_up(self, text: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the words between the cuts, and how many each has."""
        units = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(text)]).dictionary_encode()
        distinct, bounds = flat_binary(units.dictionary)
        distinct = distinct.tobytes()
        words = [distinct[a:b] for a, b in pairwise(bounds.tolist())]
        if self.held > CACHE_BYTES:
            self.forget()
        new = [w for w in words if w not in self.known]
        if new:
            self.learn(new)
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        store = pa.Array.from_buffers(pa.large_binary(), len(self.known), [None, pa.py_buffer(self.ends * 4), pa.py_buffer(self.ids)])
        ids, ends = flat_binary(store.take(pa.array(rows.take(units.indices.to_numpy()))))
        return ids.view("<u4"), np.diff(ends) // 4

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the ids stand for, one after the other, and the n+1 offsets of each."""
        return flat_binary(self.spelled.take(pa.array(ids)))

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return data[1:] if data[:1] == " " else data


SCHEMA = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean"


def tokenise(docs: DataFrame, path: str, digest: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): counts and a checksum of the ids and whether they decode to the text.

    With digest=False: doc_id, ids (array of int) and decoded text, the operator's own output."""
    pieces, scores, fallback = load(path)
    shared = docs.sparkSession.sparkContext.broadcast((double_array(pieces), pieces, scores, fallback))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _held(shared)
        byte = np.zeros(len(shared.value[1]), bool)
        byte[shared.value[3]] = True
        for batch in slices(batches, limit=TEXT_BYTES):
            ids, ends, text, heads = model.encode_all(batch.column("text"))
            doc = batch.column("doc_id").cast(pa.int64())
            if not digest:
                each = [ids[a:b] for a, b in pairwise(ends.tolist())]
                columns = [doc, pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32())), pa.array([model.decode(x) for x in each], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])
                continue
            back, marks = model.spell(ids)
            back, text, whole = back.tobytes(), text.tobytes(), ids.tobytes()
            same = [back[a:b] == text[c:d] for (a, b), (c, d) in zip(pairwise(marks[ends].tolist()), pairwise(heads.tolist()), strict=True)]
            crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in pairwise(ends.tolist())]
            bytewise = np.concatenate([[0], np.cumsum(byte[ids])])[ends]
            columns = [doc, pa.array(np.diff(ends)), pa.array(np.diff(bytewise)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA if digest else "doc_id long, ids array<int>, decoded string")


_HELD: dict[int, Unigram] = {}


def _held(shared) -> Unigram:
    """The worker's model: kept over tasks that share the broadcast."""
    key = hash((tuple(shared.value[1]), tuple(shared.value[2])))
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Unigram(*shared.value)
    return _HELD[key]
