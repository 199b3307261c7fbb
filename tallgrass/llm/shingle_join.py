"""N-gram Jaccard join by prefix trees.

A document's distinct word shingles are 64-bit hashes in one global order: shingles found in many prefixes
go last, the others by value. Two sets of Jaccard similarity 0.9 or more share a shingle among the first
n - ceil(0.9 n) + 1 of each. Sets that are equal are one class from the start, so copies cost nothing.

Round 1: within each prefix shingle's group, members of like size are paired with a hub; following the hub with
which it shares most of its prefix leads each set to its home. Small homes (MAX_HOME
sets, HOME_BYTES) meet in a task and are joined there: their sets are stored in a trie, which is walked adding up
the overlap along shared paths and leaving a subtree as soon as the shingles that remain cannot reach the
similarity; homes beyond a few dozen sets are probed by adding a shingle's nodes to the ranges of leaves below
them, all at once.

Large homes never meet in a task. Their root is the member nearest to the shingles that most members have. Each
member keeps its difference from the root (the shingles that only one of both has); similar sets have like differences: of sizes d and e, they have (d + e - s) / 2 in common at least, s
being the largest symmetric difference that the similarity allows. Where that is nothing or less, both sets are
similar to the root itself, a link that is found on the way. All others share one of their first
d - (d + e - s) / 2 + 1 shingles in an order that puts last what many differences of the home have; members are
looked up by (classes of both sizes, shingle). Edited copies of one text, however many, differ from the root in
shingles of their own, so that candidates grow with the links and not with the square of the home.

Round 2 takes the pairs of like size with different homes and components that share a prefix shingle, and counts
what they share there: with n - a + k shingles of each, a being the least overlap of sets of their sizes, two
similar sets share k at least, so the pairs with fewer are done without moving their sets. These and the
candidates of large homes are tested in tries by their first member. No link between components is lost.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a text of fewer
than the shingle's words is one shingle. Equal sets are linked. Repeated rows each get a row. A component's
id is its smallest doc_id. A row without a doc_id links nothing; it has the component of the rows of an equal set,
or null. Other columns are dropped. An empty table gives no rows. Of a very long text the hashes of all shingles are in one
task's memory.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, flat_text, mixed, slices, small_batches, word_bounds, word_hashes, written
from .graph import components, roots

#: A shingle in more prefixes than this goes last in the order; doubled until at most MAX_HEAVY are left to broadcast.
HEAVY = 4
MAX_HEAVY = 1 << 19
#: Broadcast of the ids whose sets are needed: up to this many, beyond it a shuffled join.
MAX_BROADCAST = 500_000
#: Percent of a set, in the order of values, in which the shingles that go last are looked for (two needed prefixes at least).
LOOK = 30
#: Sets of a home that meet in one task, at most, and their bytes; what is larger is joined by differences from its root.
MAX_HOME = 512
HOME_BYTES = 16 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted, as unsigned 64-bit hashes."""
    data, offsets = flat_text(batch.column("text"))
    starts, ends = word_bounds(~SPACE[data], offsets)
    words = word_hashes(LOWER[data], starts, ends)
    bounds = np.searchsorted(starts, offsets)
    n = len(words)
    factor = np.concatenate([_MIX] * (size // len(_MIX) + 1))[:size] + np.arange(size, dtype=np.uint64) * np.uint64(2)
    rolled = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        rolled += words[k : n - size + 1 + k] * factor[k] if n >= size else 0
    rolled = mixed(rolled)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            yield mixed(np.array([(words[a:b] * factor[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield rolled[:0]


def set_id(own: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return b"".join(int(mixed(own ^ salt).sum(dtype=np.uint64)).to_bytes(8, "little") for salt in _MIX[:2]) if len(own) else b""


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _signatures(docs: DataFrame, size: int, percent: int, heavy: np.ndarray, stretch: int) -> DataFrame:
    """doc_id, n, sid and the prefix (stretch times as long) of each document in the global order."""
    rare_last = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = rare_last.value
        for batch in slices(batches):
            rows = []
            for own in shingle_sets(batch, size):
                n = len(own)
                take = stretch * prefix_length(n, percent) if n else 0
                order = own
                if len(last) and n:
                    known = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                    order = np.concatenate([own[~known], own[known]])
                rows.append((n, set_id(own), order[:take].view(np.int64)))
            cut = np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([r[2] for r in rows])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), tokens], names=["doc_id", "n", "sid", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sid binary, prefix array<long>")


def _classes(signatures: DataFrame) -> DataFrame:
    """One row per distinct set: its smallest doc_id stands for it."""
    return signatures.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))


def _heavy(signatures: DataFrame) -> np.ndarray:
    """Shingles in more than HEAVY prefixes, or in more than as many as leave MAX_HEAVY of them."""
    counts = written(signatures.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HEAVY), "heavy")
    least = HEAVY
    while counts.where(F.col("c") > least).count() > MAX_HEAVY:
        least *= 2
    rows = counts.where(F.col("c") > least).select("token").toArrow()
    return np.sort(rows.column("token").to_numpy().astype(np.int64).view(np.uint64))


class Trie:
    """Sorted sets by their common beginnings: a node holds a run of shingles, children by first shingle, ids that end there."""

    def __init__(self):
        self.root = [np.zeros(0, np.uint64), {}, [], 1 << 60, 0]

    def insert(self, own: np.ndarray, key: int) -> None:
        node, at, n = self.root, 0, len(own)
        while True:
            node[3], node[4] = min(node[3], n), max(node[4], n)
            if at == n:
                node[2].append((key, n))
                return
            child = node[1].get(own[at])
            if child is None:
                node[1][own[at]] = [own[at:], {}, [(key, n)], n, n]
                return
            run = child[0]
            m = min(len(run), n - at)
            differ = np.flatnonzero(run[:m] != own[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(run):  # split the run
                upper = [run[:same], {run[same]: child}, [], child[3], child[4]]
                node[1][own[at]] = upper
                child[0] = run[same:]
                child = upper
            node, at = child, at + same

    def probe(self, own: np.ndarray, percent: int) -> list[int]:
        """Keys whose sets have the similarity with own."""
        n, found = len(own), []
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            run, alive = node[0], True
            need = percent * (n + max(node[3], 0))
            for k in range(0, len(run), 64):
                part = run[k : k + 64]
                at = np.searchsorted(own, part)
                overlap += int((own[np.minimum(at, n - 1)] == part).sum())
                depth += len(part)
                left = min(n - int(np.searchsorted(own, part[-1], "right")), node[4] - depth)
                if (overlap + left) * (100 + percent) < need:  # I / (n + m - I) stays below percent / 100
                    alive = False
                    break
            if alive:
                found += [key for key, m in node[2] if 100 * overlap >= percent * (n + m - overlap)]
                stack += [(child, overlap, depth) for child in node[1].values()]
        return found


class Leaves:
    """The same trie with its sets as leaves in order: a node is a run of shingles over a range of leaves."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        ordered = [sets[k] for k in self.order]
        self.sizes = np.array([len(s) for s in ordered])
        runs, stack = [], []  # (first depth, last depth, first leaf) that are still open

        def close(depth: int, leaf: int) -> None:
            while stack and stack[-1][1] > depth:
                a, z, low = stack.pop()
                runs.append((max(a, depth), z, low, leaf))
                if a < depth:
                    stack.append((a, depth, low))

        for leaf, own in enumerate(ordered):
            common = 0
            if leaf:
                m = min(len(own), len(ordered[leaf - 1]))
                differ = np.flatnonzero(own[:m] != ordered[leaf - 1][:m])
                common = int(differ[0]) if len(differ) else m
            close(common, leaf)
            stack.append((common, len(own), leaf))
        close(0, len(ordered))
        runs = [r for r in runs if r[1] > r[0]]
        tokens = np.concatenate([ordered[low][a:z] for a, z, low, _ in runs])
        width = [z - a for a, z, _, _ in runs]
        by = np.argsort(tokens, kind="stable")
        self.tokens, self.low, self.high = tokens[by], np.repeat([r[2] for r in runs], width)[by], np.repeat([r[3] for r in runs], width)[by]

    def probe(self, own: np.ndarray, percent: int) -> np.ndarray:
        """Which sets have the similarity with own, by their places in the list."""
        a, z = np.searchsorted(self.tokens, own, "left"), np.searchsorted(self.tokens, own, "right")
        n = z - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        leaves = len(self.sizes)
        change = np.bincount(self.low[at], minlength=leaves + 1) - np.bincount(self.high[at], minlength=leaves + 1)
        overlap = np.cumsum(change)[:leaves]
        return np.array(self.order)[100 * overlap >= percent * (len(own) + self.sizes - overlap)]


def joined(keys: list[int], sets: list[np.ndarray], percent: int, small: int = 64) -> list[tuple[int, int]]:
    """Links that connect what the pairs of sets with the similarity connect."""
    up = list(range(len(keys)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    links = []

    def unite(i: int, others) -> None:
        for j in others:
            x, y = find(i), find(int(j))
            if x != y:
                up[max(x, y)] = min(x, y)
                links.append((min(keys[i], keys[j]), max(keys[i], keys[j])))

    if len(keys) <= small:
        trie = Trie()
        for i, own in enumerate(sets):
            unite(i, trie.probe(own, percent) if i else ())
            trie.insert(own, i)
        return links
    leaves = Leaves(sets)
    first = set(range(0, len(keys), max(1, len(keys) // 16)))
    for i in first:
        unite(i, leaves.probe(sets[i], percent))
    members = [find(i) for i in range(len(keys))]
    anchor = max(set(members), key=collections.Counter(members).get)
    for i in range(len(keys)):
        if i not in first and find(i) != find(anchor):  # a link out of the anchor's component is found from its other end
            unite(i, leaves.probe(sets[i], percent))
    return links


def _by_token(rows: DataFrame, work, ordered: bool, carry=None) -> DataFrame:
    """Candidate pairs (a, b, na, nb, shared) that work finds in groups of (token, rep, n, label, home), sorted by n and rep.

    A task reads its groups in their order and holds the open one and a batch, or what carry keeps of the open one.
    shared counts the tokens that give the pair. If ordered, a is the smaller id; else it is the hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 5
        seen, found = 0, []
        for batch in chain(batches, [None]):
            if batch is not None:
                held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, ("token", "rep", "n", "label", "home"), strict=True)]
            if not len(held[0]):
                continue
            cut = len(held[0])
            if batch is not None and carry is None:
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            whole, held = [x[:cut] for x in held], [x[cut:] for x in held]
            if cut:
                for at, to, shared in work(*whole, seen):
                    found.append((whole[1][at], whole[1][to], whole[2][at], whole[2][to], shared))
                    if sum(len(f[0]) for f in found) > 100_000:
                        yield _counted(found)
                        found = []
                if carry is not None:
                    keep = carry(whole[0], whole[2])
                    held, seen = [x[keep] for x in whole], len(keep)
                    if batch is None:
                        break
        if found:
            yield _counted(found)

    def _counted(found: list[tuple]) -> pa.RecordBatch:
        a, b, na, nb, shared = (np.concatenate(x) for x in zip(*found, strict=True))
        if ordered:
            swap = a > b
            a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
        table = pa.table({"a": a, "b": b, "na": na, "nb": nb, "shared": shared}).group_by(["a", "b", "na", "nb"]).aggregate([("shared", "sum")]).rename_columns(["a", "b", "na", "nb", "shared"])
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], names=table.column_names)

    dealt = rows.select("token", "rep", "n", "label", "home").repartition("token").sortWithinPartitions("token", "n", "rep")
    return dealt.mapInArrow(run, "a long, b long, na long, nb long, shared long").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))


def _runs(token: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """The hub of each row: the first of its token's run of like sizes."""
    new = np.concatenate([[True], token[1:] != token[:-1]])
    hub = np.flatnonzero(new)[np.cumsum(new) - 1]
    while len(late := np.flatnonzero(100 * n[hub] < percent * n)):
        first = late[np.concatenate([[True], hub[late][1:] != hub[late][:-1]])]  # the next hub of each run that is still too wide
        hub[late] = first[np.searchsorted(hub[first], hub[late])]
    return hub


def _hubs(rows: DataFrame, percent: int) -> DataFrame:
    """Each member with the hub of its run, and each later hub with the set before it if their sizes are alike; those
    pairs count 0, they only tell that both sets have a neighbour. Of an open group, the last hub and the last row are kept."""

    def work(token, rep, n, label, home, seen):
        hub = _runs(token, n, percent)
        at = np.flatnonzero(rep[hub] != rep)
        at = at[at >= seen]
        yield hub[at], at, np.ones(len(at), np.int64)
        after = np.flatnonzero((np.concatenate([[False], token[1:] == token[:-1]])) & (hub == np.arange(len(hub))))
        after = after[(percent * n[after] <= 100 * n[after - 1]) & (after >= seen)]  # the longest set before it is near enough
        yield after - 1, after, np.zeros(len(after), np.int64)

    def last(token, n):
        return np.unique([_runs(token, n, percent)[-1], len(token) - 1])

    return _by_token(rows, work, False, last)


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """All members of like sizes with different labels and homes."""

    def work(token, rep, n, label, home, _):
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(edges, len(token)))
        mixed_labels = np.minimum.reduceat(label, edges) != np.maximum.reduceat(label, edges)
        wide = mixed_labels & (sizes > 64)
        for a, m in zip(edges[wide].tolist(), sizes[wide].tolist(), strict=True):
            yield from _wide(n[a : a + m], label[a : a + m], home[a : a + m], a)
        at, step = np.flatnonzero(np.repeat(mixed_labels & (sizes <= 64), sizes)), 1
        while len(at):  # each row with the step-th after it, as long as token and size allow
            at = at[at + step < len(token)]
            to = at + step
            near = (token[at] == token[to]) & (percent * n[to] <= 100 * n[at])
            at, to = at[near], to[near]
            other = (label[at] != label[to]) & (home[at] != home[to])
            yield at[other], to[other], np.ones(int(other.sum()), np.int64)
            step += 1

    def _wide(n, label, home, first):
        """Pairs of a large group: most of it is one component, whose members need no pairs among themselves."""
        names, counts = np.unique(label, return_counts=True)
        main = label == names[counts.argmax()]
        for i in np.flatnonzero(~main):
            low, high = np.searchsorted(n * 100, percent * n[i], "left"), np.searchsorted(n * percent, 100 * n[i], "right")
            j = np.arange(low, high)
            j = j[(label[j] != label[i]) & (home[j] != home[i]) & (main[j] | (j > i))]
            yield np.minimum(i, j) + first, np.maximum(i, j) + first, np.ones(len(j), np.int64)

    return _by_token(rows, work, True)


def _pairs(pairs) -> pa.RecordBatch:
    both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _home_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links within each of the small homes of sets (id, home, own)."""
    members = sets.select("home", "id", "own").repartition("home").sortWithinPartitions("home", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, own = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(keys) > 1 and (links := joined(keys, own, percent)):
                yield _pairs(links)

        for batch in batches:
            for home, key, raw in zip(*(batch.column(c).to_pylist() for c in ("home", "id", "own")), strict=True):
                if home != now:
                    yield from done()
                    now, keys, own = home, [], []
                if not keys or keys[-1] != key or own[-1].tobytes() != raw:  # repeated rows have one place
                    keys.append(key)
                    own.append(np.frombuffer(raw, np.uint64))
        yield from done()

    return members.mapInArrow(run, "a long, b long")


def _differences(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """id, home, root, n, root_n (sizes), near (similar to the root) and prefix: the differences of the members of sets (id, home, salt,
    own) from the roots (home, root, parts, own), as shingles that are the home's own. A root goes to each of its parts."""
    spread = roots.select("home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("late"), F.col("root").alias("id"), "own")
    members = spread.unionByName(sets.select("home", "salt", F.lit(1).alias("late"), "id", "own"))
    dealt = members.repartition("home", "salt").sortWithinPartitions("home", "salt", "late", "id", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, root, root_id, own_of_home, last = None, None, None, None, None
        for batch in batches:
            rows = []
            for home, salt, late, key, raw in zip(*(batch.column(c).to_pylist() for c in ("home", "salt", "late", "id", "own")), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if not late:
                    now, root, root_id, own_of_home = (home, salt), own, key, mixed(np.array([home], np.int64).view(np.uint64))[0]
                elif (home, salt) == now and (key, raw) != last:  # repeated rows have one place
                    last = (key, raw)
                    delta = np.setxor1d(own, root, assume_unique=True)
                    near = (100 + percent) * len(delta) <= (100 - percent) * (len(own) + len(root))
                    rows.append((key, home, root_id, len(own), len(root), near, np.sort(mixed(delta ^ own_of_home)).view(np.int64)))
            if rows:
                cut = np.concatenate([[0], np.cumsum([len(r[6]) for r in rows])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([r[6] for r in rows])))
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], t) for k, t in enumerate((*[pa.int64()] * 5, pa.bool_()))), lists], names=["id", "home", "root", "n", "root_n", "near", "prefix"])

    return dealt.mapInArrow(run, "id long, home long, root long, n long, root_n long, near boolean, prefix array<long>")


def _centers(sets: DataFrame, percent: int) -> DataFrame:
    """The member of each home of sets (id, home, salt, parts, own) that is nearest to the shingles that most of them have:
    (home, root, parts, own). Those shingles are twice a mean set at most."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "own"):
            raw = [x.as_buffer() for x in batch.column("own")]
            home = np.repeat(batch.column("home").to_numpy(), [len(x) // 8 for x in raw])
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(np.frombuffer(b"".join(raw), np.int64))], names=["home", "token"])

    def packed(lists: pa.Array) -> pa.Array:
        return pa.array([np.sort(x.values.to_numpy().view(np.uint64)).tobytes() for x in lists], pa.binary())

    counts = sets.select("home", "own").mapInArrow(flat, "home long, token long").groupBy("home", "token").agg(F.count(F.lit(1)).alias("c"))
    members = sets.groupBy("home").agg(F.count(F.lit(1)).alias("m"), F.first("parts").alias("parts"))
    common = counts.join(members, "home").where("2 * c > m").groupBy("home").agg(F.collect_list("token").alias("own"))
    common = members.join(common, "home", "left").withColumn("own", F.coalesce("own", F.expr("cast(array() as array<bigint>)")))
    common = written(common.select("home", F.lit(None).cast("long").alias("root"), "parts", F.arrow_udf(packed, "binary")("own").alias("own")), "common")
    nearest = _differences(sets, common, percent).groupBy("home").agg(F.min(F.struct(F.size("prefix").alias("d"), "id")).alias("m")).select("home", F.col("m.id").alias("id"))
    return written(sets.join(written(nearest, "nearest"), ["home", "id"]).groupBy("home", F.col("id").alias("root"), "parts").agg(F.min("own").alias("own")), "centers")


def _size_levels(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(level, width of a class of difference sizes, largest symmetric difference) of a set of n shingles: by doublings of
    the larger set's size, those that a partner may have."""
    most = (100 - percent) * (n + 100 * n // percent) // (100 + percent)
    levels = range(n.bit_length(), (100 * n // percent).bit_length() + 1)
    return [(v, max(1, (100 - percent) * (1 << v) // (4 * (100 + percent))), most) for v in levels]


def _difference_tokens(differences: DataFrame, percent: int, heavy: np.ndarray) -> DataFrame:
    """token, rep, n, label, home of the prefixes of differences: one prefix for each class of sizes that a partner may have.

    A token names the shingle, the level and both classes; home keeps members of one class apart from pairs of two.
    Two members that are both similar to the root are linked already, so such a member looks only for others."""
    rare_last = differences.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = rare_last.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, tokens, rows = batch.slice(k, 256), [], []
                for key, n, root_n, near, label, delta in zip(*(part.column(c).to_pylist() for c in ("id", "n", "root_n", "near", "label")), part.column("prefix"), strict=True):
                    own = delta.values.to_numpy().view(np.uint64)
                    d = len(own)
                    if len(last):
                        known = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                        own = np.concatenate([own[~known], own[known]])
                    far = (100 - percent) * (-(-n * percent // 100) + root_n) // (100 + percent) if near else 0  # a partner that is not near has more
                    for level, width, most in _size_levels(n, percent):
                        mine = d // width
                        for c in range(max(1, d - most, far + 1) // width, (d + most) // width + 1):
                            # what both have in common at least, of sizes d and c * width or more
                            take = d - max(1, -((most - d - max(1, c * width)) // 2)) + 1
                            if take > 0:
                                name = mixed(np.array([level << 56 | min(c, mine) << 28 | max(c, mine)], np.uint64))[0]
                                tokens.append(mixed(own[:take] ^ name).view(np.int64))
                                rows.append((key, n, label, key if c == mine else -1 - mine))
                count = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)])), *(pa.array(np.repeat(np.array([r[x] for r in rows], np.int64), count)) for x in range(4))], names=["token", "rep", "n", "label", "home"])

    return differences.where("size(prefix) > 0").select("id", "n", "root_n", "near", "label", "prefix").mapInArrow(run, "token long, rep long, n long, label long, home long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the candidate pairs by exact similarity, in tries by (a, salt)."""
    sets, salts = sets.select("id", "own"), max(1, pairs.count() // 20_000)
    pairs = pairs.select("a", "b").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    members = pairs.join(sets, F.col("b") == F.col("id")).select("a", "salt", F.lit(1).alias("member"), "id", "own")
    hubs = pairs.select("a", "salt").distinct().join(sets, F.col("a") == F.col("id")).select("a", "salt", F.lit(0).alias("member"), "id", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, None
        for batch in batches:
            found = []
            for a, salt, member, key, own in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "member", "id", "own")), strict=True):
                own = np.frombuffer(own, np.uint64)
                if (a, salt) != now:
                    now, trie = (a, salt), Trie()
                if not member:
                    trie.insert(own, key)
                else:
                    found += [(min(k, key), max(k, key)) for k in trie.probe(own, percent)]
            if found:
                yield _pairs(found)

    return members.unionByName(hubs).repartition("a", "salt").sortWithinPartitions("a", "salt", "member", "id").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The rows of ids (id, home, salt, parts) with own, the sorted shingles of the documents with these ids; written."""
    few = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.drop_columns("text").append_column("own", pa.array([own.tobytes() for own in shingle_sets(batch, size)], pa.binary()))

    found = docs.select("text", F.col("doc_id").cast("long").alias("id")).join(few, "id").select("text", "id", "home", "salt", "parts")
    return written(found.mapInArrow(run, "id long, home long, salt long, parts long, own binary").where("length(own) > 0"), "sets")


def join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, class_id (smallest doc_id of the equal sets)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    heavy = _heavy(_signatures(docs, size, percent, np.zeros(0, np.uint64), max(2, round(LOOK / (100 - percent)))))
    signatures = written(_signatures(docs, size, percent, heavy, 1), "signatures")
    classes = written(_classes(signatures), "classes")
    placed = classes.select("rep", "n", F.explode("prefix").alias("token"), F.col("rep").alias("label"), F.col("rep").alias("home"))
    stars = written(_hubs(placed, percent), "stars")
    nearest = stars.where("shared > 0").groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("h"))).alias("m")).select((-F.col("m.h")).alias("a"), "b")
    homes = roots(nearest).select(F.col("node").alias("id"), F.col("label").alias("home"))
    homes = homes.join(classes.groupBy(F.col("rep").alias("id")).agg(F.sum("n").alias("n")), "id")
    held = homes.groupBy("home").agg(F.count(F.lit(1)).alias("c"), (8 * F.sum("n")).alias("bytes")).where((F.col("c") > MAX_HOME) | (F.col("bytes") > HOME_BYTES))
    large = held.select("home", F.ceil(F.greatest(F.col("bytes") / HOME_BYTES, F.col("c") / MAX_HOME)).cast("long").alias("parts"))
    homes = written(homes.join(large, "home", "left").select("id", "home", F.pmod(F.xxhash64("id"), "parts").alias("salt"), "parts"), "homes")
    sets = _sets(docs, homes, size)
    found, differences = _home_links(sets.where("salt is null"), percent), None
    if not homes.where("salt is not null").limit(1).isEmpty():
        dense = sets.where("salt is not null")
        differences = written(_differences(dense, _centers(dense, percent), percent), "differences")
        found = found.unionByName(differences.where("near").select(F.col("root").alias("a"), F.col("id").alias("b")))
    links = written(found, "links")
    labels = components(links).select(F.col("node").alias("rep"), "label")
    known = homes.select(F.col("id").alias("rep"), "home")
    # only what shares a shingle with another set of like size can still be linked; what shares a home is done
    ids = stars.select(F.col("a").alias("rep")).union(stars.select("b")).distinct()
    rows = classes.join(ids, "rep", "left_semi").join(labels, "rep", "left").join(known, "rep", "left")
    rows = rows.select("rep", "n", F.explode("prefix").alias("token"), F.coalesce("label", "rep").alias("label"), F.coalesce("home", "rep").alias("home"))
    total = F.col("na") + F.col("nb")
    least = F.ceil(total * percent / (100 + percent))
    kept = lambda n: least + 1 - F.ceil(F.col(n) * percent / 100)
    rest = _across(rows, percent).where(F.col("shared") >= F.greatest(F.lit(1), F.least(kept("na"), kept("nb")))).select("a", "b")
    if differences is not None:
        labelled = differences.join(labels.withColumnRenamed("rep", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        own = _difference_tokens(labelled, percent, _heavy(differences))
        rest = rest.unionByName(_across(own, percent).select("a", "b"))
    rest = written(rest, "rest")
    if not rest.limit(1).isEmpty():
        further = rest.select(F.col("a").alias("id")).union(rest.select("b")).distinct().join(homes, "id", "left_anti")
        none = F.lit(None).cast("long")
        sets = sets.unionByName(_sets(docs, further.select("id", F.col("id").alias("home"), none.alias("salt"), none.alias("parts")), size))
        links = written(links.unionByName(_verified(rest, sets, percent)), "links")
        labels = components(links).select(F.col("node").alias("rep"), "label")
    reps = classes.select("sid", "rep").join(labels, "rep", "left").select("sid", F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("component_id"))
    return signatures.select("doc_id", "n", "sid").join(reps, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def sizes(docs: DataFrame, size: int = 3) -> DataFrame:
    """Per row: doc_id and n_shingles as the join has them. Its first step alone: whole texts, one pass, no shuffle."""
    small_batches(docs.sparkSession)
    return _signatures(docs, size, 100, np.zeros(0, np.uint64), 1).select("doc_id", F.col("n").alias("n_shingles"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component, that with the smallest doc_id: five-word shingles, similarity 0.8.

    Rows that repeat a kept doc_id, and rows without one, stay."""
    drop = written(join(docs, size=5, percent=80).where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    drop = F.broadcast(drop) if drop.count() <= MAX_BROADCAST else drop
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
