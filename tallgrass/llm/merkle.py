"""Merkle manifest of a document table: a root, and a proof for each row that the root covers it.

A row's leaf is the digest of its columns. Within a language leaves ascend by doc_id, and runs of eight nodes become one
until one remains, the subroot; subroots become the root likewise. A leaf's place is its exact rank, which no sort of all
rows gives: doc_ids are counted by digits of 8 bits, from the finest digit up, and a digit's first rank is its parent's
plus the counts of its smaller siblings, so that a task never sees more than one parent's children. The rank in base 8
then is the leaf's path in the trie: rows that share the rank but for its last four digits are one group, whose four
levels are hashed at once, longest prefix first; the groups' nodes are the next storey's leaves.

Defined cases. Null doc_id: hashed as `-`, ranks like the smallest possible id. Repeated ids rank by leaf; equal rows rank
by their place in the written table, and their proofs differ by it only. Null, empty and very long texts are values like
others (hashed in one pass, natively). Null language: a language of its own, the first. An empty table gives no rows.
Further columns of the input are ignored."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FANOUT_BITS = 3
#: Levels that one group hashes: 8 ** 4 nodes.
LEVELS = 4
DIGIT = 8
#: Rows of one key from which they are ranked by the next key among themselves. It grows with the table, so that there are
#: MAX_HOT such keys at most, which are broadcast.
HOT, MAX_HOT = 4096, 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = FANOUT_BITS * LEVELS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(values: list[Column]) -> Column:
    """The digest of values that are null, strings or integers: `-`, or the UTF-8 length, a colon and the value."""
    parts = (F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values)
    return F.sha2(F.concat(*parts), 256)


# --- exact ranks by digits


def first_ranks(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group, _bucket, _base, _count): of each bucket of 256 neighbouring keys how many rows of its group come before it."""
    level = written(rows.groupBy(*group, F.shiftright(key, DIGIT).alias("_bucket")).agg(F.count(F.lit(1)).alias("_count")), "digits")
    low, high = level.agg(F.min("_bucket"), F.max("_bucket")).first()
    levels, shift = [level], 0
    while low is not None and (high >> shift) - (low >> shift) >= 1 << DIGIT:
        shift += DIGIT
        levels.append(levels[-1].groupBy(*group, F.shiftright("_bucket", DIGIT).alias("_bucket")).agg(F.sum("_count").alias("_count")))
    before = lambda *by: F.coalesce(F.sum("_count").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = levels[-1].withColumn("_base", before(*group))
    for level in reversed(levels[:-1]):
        up = base.select(*group, F.col("_bucket").alias("_parent"), F.col("_base").alias("_above"))
        base = level.withColumn("_parent", F.shiftright("_bucket", DIGIT)).join(up, [*group, "_parent"]).withColumn("_base", F.col("_above") + before(*group, "_parent")).drop("_parent", "_above")
    return base.select(*group, "_bucket", "_base", "_count")


def ranked(rows: DataFrame, group: list[str], keys: list[str], order: list[str] | None = None, hot: int | None = None) -> DataFrame:
    """rows (a written table, group never null) with _rank: their place from 0 among their group's rows by the keys (long
    integers, never null), and by order among rows that agree in all of them."""
    many = hot or max(HOT, rows.count() // MAX_HOT)
    key, order = keys[0], order or []
    base = written(first_ranks(rows, group, key), "bases")
    crowded = base.where(F.col("_count") > many).select(*group, "_bucket")
    bucket = F.shiftright(key, DIGIT)
    held = rows.withColumn("_bucket", bucket)
    frequent = None
    if len(keys) > 1 and not crowded.limit(1).isEmpty():
        # a bucket holds 256 keys, so one with so many rows has repeated ones: theirs are ranked by the next key
        counts = held.join(F.broadcast(crowded), [*group, "_bucket"], "left_semi").groupBy(*group, key).agg(F.count(F.lit(1)).alias("_many"))
        frequent = written(counts.where(F.col("_many") > many), "frequent")
    at = Window.partitionBy(*group, "_bucket").orderBy(*keys, *order)
    if frequent is None:
        return held.join(base.drop("_count"), [*group, "_bucket"]).withColumn("_rank", F.col("_base") + F.row_number().over(at) - 1).drop("_bucket", "_base")
    few = held.join(F.broadcast(frequent), [*group, key], "left_anti").withColumn("_many", F.lit(1).cast("long")).withColumn("_own", F.lit(True))
    marks = frequent.withColumn("_bucket", bucket).withColumn("_own", F.lit(False))
    both = few.unionByName(marks, allowMissingColumns=True).join(base.drop("_count"), [*group, "_bucket"])
    # a frequent key stands as one row that counts for all of its own
    both = both.withColumn("_rank", F.col("_base") + F.coalesce(F.sum("_many").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_bucket", "_base", "_many")
    both = written(both, "ranked")
    own = both.where("_own").drop("_own")
    tops = both.where("not _own").select(*group, key, F.col("_rank").alias("_first"))
    rest = written(rows.join(F.broadcast(tops.drop("_first")), [*group, key], "left_semi"), "repeated")
    more = ranked(rest, [*group, key], keys[1:], order, hot)
    more = more.join(F.broadcast(tops), [*group, key]).withColumn("_rank", F.col("_rank") + F.col("_first")).drop("_first")
    return own.unionByName(more.select(own.columns))


# --- the trie over base-8 digits of the rank


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def _storey(table: pa.Table) -> tuple[list[int], list[list[str]]]:
    """The order of a group's nodes by place, and their digests level by level up to what remains of them.

    A group of a storey that has further groups is hashed through all its levels, even where one node remains early."""
    order = table.column("_rank").to_numpy().argsort(kind="stable")
    levels = [table.column("node").take(pa.array(order)).to_pylist()]
    total = table.column("_total")[0].as_py()
    for _ in range(LEVELS):
        if total == 1:
            break
        total, now = -(-total // 8), levels[-1]
        levels.append([_sha("".join(now[k : k + 8])) for k in range(0, len(now), 8)])
    return order, levels


def _tops(table: pa.Table) -> pa.Table:
    _, levels = _storey(table)
    first, total = table.column("_rank")[0].as_py(), table.column("_total")[0].as_py()
    return pa.table({"_group": table.column("_group")[:1], "_rank": pa.array([first >> _STEP], pa.int64()), "_total": pa.array([-(-total >> _STEP)], pa.int64()), "node": levels[-1]})


def _siblings(levels: list[list[str]], k: int) -> list[str]:
    """Of node k the digit and the other nodes of its run, level by level: the path to the group's top."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[k & ~7 : (k & ~7) + 8]
        out.append(f"{k & 7}{''.join(run[: k & 7])}{''.join(run[(k & 7) + 1 :])}")
        k >>= 3
    return out


def folded(node: str, path: list[str]) -> str:
    """The root that a node and the siblings on its path give."""
    for step in path:
        at = 1 + 64 * int(step[0])
        node = _sha(step[1:at] + node + step[at:])
    return node


def proof_digest(path: list[str]) -> str:
    h = hashlib.sha256()
    for step in path:
        h.update(step[1:].encode())
    return h.hexdigest()


def _down(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Paths of a group's nodes: their siblings within it, and then its own path."""
    order, levels = _storey(nodes)
    upper = above.column("path")[0].as_py()
    path = [_siblings(levels, k) + upper for k in range(len(order))]
    return pa.table({"_group": nodes.column("_group"), "_rank": nodes.column("_rank").take(pa.array(order)), "path": pa.array(path, pa.list_(pa.string()))})


def _proofs(leaves: pa.Table, above: pa.Table) -> pa.Table:
    order, levels = _storey(leaves)
    upper, root = above.column("path")[0].as_py(), above.column("root")[0].as_py()
    leaves = leaves.take(pa.array(order))
    proofs, folds = [], []
    for k, (leaf, other) in enumerate(zip(levels[0], leaves.column("tampered").to_pylist(), strict=True)):
        path = _siblings(levels, k) + upper
        proofs.append(proof_digest(path))
        folds.append(folded(other or leaf, path))
    return pa.table(
        {
            "doc_id": leaves.column("doc_id"), "leaf": leaves.column("node"), "subroot": above.column("subroot").take(pa.array([0] * len(proofs))), "root": pa.array([root] * len(proofs)),
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folds, pa.string()), "verified": pa.array([f == root for f in folds], pa.bool_()),
        }
    )


_NODE = "_group string, _rank long, _total long, node string"


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """The storeys over nodes (_group, _rank, _total, node), themselves included; in the last each group has one node."""
    storeys = [nodes]
    while (most := storeys[-1].agg(F.max("_total")).first()[0]) is not None and most > 1:
        up = storeys[-1].select("_group", "_rank", "_total", "node").groupBy("_group", F.shiftright("_rank", _STEP).alias("_high")).applyInArrow(_tops, _NODE)
        storeys.append(written(up, "storey"))
    return storeys


def descended(storeys: list[DataFrame], tops: DataFrame, last: int = 0) -> DataFrame:
    """(_group, _rank, path) of the nodes of storey last, from the paths of the groups' only nodes (_group, path)."""
    paths = tops.select("_group", F.lit(0).cast("long").alias("_rank"), "path")
    for nodes in reversed(storeys[last:-1]):
        by = ["_group", F.shiftright("_rank", _STEP).alias("_high")]
        made = nodes.select("_group", "_rank", "_total", "node").groupBy(*by).cogroup(paths.withColumnRenamed("_rank", "_high").groupBy("_group", "_high")).applyInArrow(_down, "_group string, _rank long, path array<string>")
        paths = written(made, "paths")
    return paths


def _totals(ranks: DataFrame) -> DataFrame:
    """Rows with the number of their group's: groups are languages, the largest rank tells it, so this is small."""
    return ranks.groupBy("_group").agg((F.max("_rank") + 1).alias("_total"))


def manifest(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row; hot replaces the bound HOT in tests."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    altered = digest([F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in FIELDS])
    hashed = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("_group"), digest([F.col(c) for c in FIELDS]).alias("node"),
        F.when(third & F.col("text").isNotNull(), altered).alias("tampered"),
    )
    hashed = hashed.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("_leaf", F.conv(F.substring("node", 1, 15), 16, 10).cast("long")).withColumn("_row", F.monotonically_increasing_id())
    leaves = written(hashed, "leaves")
    placed = ranked(leaves, ["_group"], ["_id", "_leaf", "_row"], hot=hot).drop("_id", "_leaf", "_row")
    placed = written(placed, "placed")
    totals = _totals(placed)
    # groups are few beside rows but may be many in all; their counts are joined, a row a group
    leaves = written(placed.join(totals, "_group"), "nodes") if _many(totals) else placed.join(F.broadcast(totals), "_group")
    storeys = climbed(leaves)
    subroots = storeys[-1].select(F.col("_group").alias("lang_key"), F.col("node").alias("subroot"))
    by_lang = written(_by_lang(subroots), "languages")
    by_lang = ranked(by_lang, ["_group"], ["_k0", "_k1", "_k2"], ["lang_key"], hot).select("_group", "_rank", F.col("subroot").alias("node"), "lang_key")
    by_lang = written(by_lang, "languages")
    by_lang = by_lang.join(F.broadcast(_totals(by_lang)), "_group")  # one group
    upper = climbed(by_lang)
    top = upper[-1].first()
    paths = descended(upper, upper[-1].select("_group", F.array().cast("array<string>").alias("path")))
    tops = by_lang.join(paths, ["_group", "_rank"]).select(F.col("lang_key").alias("_group"), "path")
    if len(storeys) == 1:  # every language has one row: its leaf is the subroot, and the whole path is the languages'
        chunks = tops.withColumn("_high", F.lit(0).cast("long"))
    else:
        chunks = descended(storeys, tops, last=1).withColumnRenamed("_rank", "_high")
    chunks = chunks.join(subroots.withColumnRenamed("lang_key", "_group"), "_group").withColumn("root", F.lit(top["node"] if top else None).cast("string"))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return leaves.groupBy("_group", F.shiftright("_rank", _STEP).alias("_high")).cogroup(chunks.groupBy("_group", "_high")).applyInArrow(_proofs, schema)


def _many(groups: DataFrame, bound: int = 100_000) -> bool:
    return groups.limit(bound + 1).count() > bound


def _by_lang(subroots: DataFrame) -> DataFrame:
    """Subroots with the first 21 bytes of their language as three numbers, for their rank; what agrees in all of them is ordered by the name."""
    name = F.hex(F.encode("lang_key", "utf-8"))
    number = lambda k: F.conv(F.rpad(F.substring(name, 14 * k + 1, 14), 14, "0"), 16, 10).cast("long").alias(f"_k{k}")
    return subroots.select(F.lit("").alias("_group"), "lang_key", "subroot", *(number(k) for k in range(3)))
