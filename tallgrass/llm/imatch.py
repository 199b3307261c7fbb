"""I-Match document fingerprints over randomised lexicon subsets, in DataFrame operations only.

The lexicon is the terms whose document frequency lies in a band, relative to the number of documents;
since a document has about a few hundred terms, a band from MIN_SHARE bounds the lexicon's size by
(mean distinct terms) / MIN_SHARE rows whatever the corpus. It is broadcast up to MAX_BROADCAST rows and
joined by shuffle beyond. A document's kept terms, sorted by hash, are filtered by each subset and hashed;
subset 0 is the whole lexicon, the others keep one term in 4, 16, 64 or 256 by a seeded hash, so that long
and short documents alike have subsets with few terms, which survive small edits.

Likeness: among the levels of thinning with three filled subsets or more (in either text), the largest
share of equal ones; 1 for equal fingerprints; where no level has so many, 1 or 0 by subset 0.

Defined results: null is empty; a text without kept terms has the fingerprint of no terms, followed by a
hash of the whole text so that it equals its copies only. The next document goes by descending doc_id,
after the last comes the first; rows of one doc_id are ordered by their text's hash; with a single row, it
is its own next. A null doc_id counts as the smallest. Further columns are dropped.
An empty table gives no rows; a very long text is a row like any other, its distinct terms in memory at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, written

MIN_SHARE = 0.0005
MAX_SHARE = 0.2
MAX_BROADCAST = 2_000_000
#: Buckets of documents at most: so many edges are broadcast to find the next document.
MAX_BUCKETS = 1 << 16
LEVELS = ((4, 6), (16, 6), (64, 8), (256, 8))
TERMS = "[^\\p{L}\\p{N}]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased terms."""
    return F.transform(F.array_remove(F.array_distinct(F.split(F.lower(text), TERMS)), ""), lambda t: F.xxhash64(t))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """term (hash) of the band; document frequencies count every row of docs."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    low = max(2.0, min_share * n)
    return counts.where((F.col("df") >= low) & (F.col("df") <= max(max_share * n, low))).select("term")


def _below(edges: list[int], value: Column, least: bool) -> Column:
    """How many of the sorted edges are below a value (or, without least, not above it): a search by halves."""
    steps = [1 << k for k in range(len(edges).bit_length() - 1, -1, -1)]
    table = F.array(*map(F.lit, edges))

    def step(at: Column, half: Column) -> Column:
        edge = F.get(table, at + half - 1)
        return F.when(edge < value if least else edge <= value, at + half).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next text (by descending doc_id, cyclic), bucket and a row number within the bucket.

    Buckets are ranges between quantiles of doc_id; an id with so many rows that several quantiles fall on it has as many
    buckets, by ranges of the text's hash. Texts are shuffled once; only the last text of each bucket goes to the next
    one too, as a row with own = 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = partitions_for(spark, size, 32 << 20)
    many = min(MAX_BUCKETS, 8 * parts)
    edges = docs.agg(F.percentile_approx("doc_id", [k / many for k in range(1, many)], 4 * many)).first()[0] or [0]
    hashed = F.xxhash64("text")
    low, high = _below(edges, F.col("doc_id"), True), _below(edges, F.col("doc_id"), False)
    docs = docs.select("doc_id", "text", hashed.alias("h"), low.alias("low"), high.alias("high"))
    share = (F.col("h") / F.lit(2.0**64) + 0.5) * (F.col("high") - F.col("low"))
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("low") + F.least(F.floor(share).cast("int"), F.greatest(F.col("high") - F.col("low") - 1, F.lit(0))))
    docs = docs.select("doc_id", "text", "h", bucket.alias("bucket"))
    # at most MAX_BUCKETS + 1 rows: the last document of each bucket, and the bucket above (the lowest one for the highest)
    tops = docs.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("top"))
    up = F.lead("bucket").over(Window.orderBy("bucket"))
    lowest = F.min("bucket").over(Window.partitionBy(F.lit(1)))
    edge_rows = tops.select("bucket", "top.*", F.coalesce(up, lowest).alias("to"))
    given = docs.alias("d").join(F.broadcast(edge_rows.alias("e")), F.expr("d.bucket = e.bucket and d.doc_id <=> e.doc_id and d.h = e.h")).select("d.doc_id", "d.text", F.col("e.to").alias("bucket"))
    given = given.groupBy("bucket").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).withColumn("own", F.lit(0))
    rows = docs.select("doc_id", "text", "bucket", F.lit(1).alias("own")).unionByName(given)
    inside = Window.partitionBy("bucket").orderBy("own", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return rows.repartition(parts, "bucket").select("bucket", F.row_number().over(inside).alias("row"), "own", "doc_id", "text", F.lag("text").over(inside).alias("next"))


def edited(text: Column, following: Column) -> Column:
    """text with its last third (in code points, rounded down) replaced by the beginning of the following one."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def _keeps(shift: int, mask: int):
    """The subset of terms whose hash has all the bits of mask set at shift."""
    return lambda t: F.shiftrightunsigned(t, shift).bitwiseAND(F.lit(mask)) == mask


def fingerprint(kept: Column) -> Column:
    """Hashes, one per subset, of the sorted terms that it keeps; null where it keeps none."""
    out = [F.when(F.size(kept) > 0, F.xxhash64(kept))]
    for level, many in LEVELS:
        bits = level.bit_length() - 1
        for k in range(many):
            picked = F.filter(kept, _keeps(k * bits, level - 1))
            out.append(F.when(F.size(picked) > 0, F.xxhash64(picked)))
    return F.array(*out)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two fingerprint arrays."""
    whole = F.when(F.get(a, F.lit(0)).eqNullSafe(F.get(b, F.lit(0))), 1.0).otherwise(0.0)
    shares, at = [], 1
    for _, many in LEVELS:
        pair = F.slice(F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), 0).otherwise(F.when(x.eqNullSafe(y), 101).otherwise(1))), at + 1, many)
        found = F.aggregate(pair, F.lit(0), lambda s, x: s + x)  # 101 for an equal pair, 1 for another that is filled
        filled, equal = found % 100, F.floor(found / 100)
        shares.append(F.when(filled >= 3, equal / filled))
        at += many
    return F.when(whole == 1.0, whole).otherwise(F.coalesce(F.greatest(*shares), whole)).cast("double")


def _text(fp: Column, text_hash: Column) -> Column:
    """The fingerprint as a string of hexadecimal parts; a text without kept terms is named by its own hash."""
    parts = F.array_join(F.transform(fp, lambda x: F.coalesce(F.lower(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8))), F.lit("-"))), ".")
    return F.when(F.get(fp, F.lit(0)).isNull(), F.concat(F.lit("none."), F.lower(F.hex(text_hash)))).otherwise(parts)


def fingerprints(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """One row per row of docs; see the module's head."""
    words = written(lexicon(docs, min_share, max_share), "lexicon").withColumnRenamed("term", "known")
    words = F.broadcast(words) if words.count() <= MAX_BROADCAST else words
    base = with_next(docs).withColumn("edit", edited(F.col("text"), F.coalesce("next", F.lit(""))))
    base = base.withColumn("mine", terms(F.col("text"))).withColumn("theirs", terms(F.col("edit")))
    none = "cast(null as {0})".format
    head = F.struct(F.expr(none("bigint")).alias("term"), F.lit(0).alias("of"), "own", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("sha"), F.xxhash64("text").alias("h"), F.xxhash64("edit").alias("eh"))
    entry = lambda of: lambda t: F.struct(t.alias("term"), F.lit(of).alias("of"), *(F.expr(none(k)).alias(n) for n, k in (("own", "int"), ("doc_id", "bigint"), ("n_chars", "bigint"), ("sha", "string"), ("h", "bigint"), ("eh", "bigint"))))
    tagged = F.concat(F.array(head), F.transform(F.array_intersect("mine", "theirs"), entry(3)), F.transform(F.array_except("mine", "theirs"), entry(1)), F.transform(F.array_except("theirs", "mine"), entry(2)))
    rows = base.select("bucket", "row", F.inline(tagged)).join(words, F.col("term") == F.col("known"), "left").where("of = 0 or known is not null")
    # the rows of a range lie in one partition already: no shuffle here
    grouped = rows.groupBy("bucket", "row").agg(
        *(F.max(c).alias(c) for c in ("own", "doc_id", "n_chars", "sha", "h", "eh")),
        F.sort_array(F.collect_list(F.when(F.col("of").bitwiseAND(F.lit(1)) > 0, F.col("term")))).alias("kept"),
        F.sort_array(F.collect_list(F.when(F.col("of") >= 2, F.col("term")))).alias("edit_kept"),
    )
    inside = Window.partitionBy("bucket").orderBy("row")
    made = grouped.select("bucket", "row", "own", "doc_id", "n_chars", "sha", "h", "eh", fingerprint(F.col("kept")).alias("fp"), fingerprint(F.col("edit_kept")).alias("edit_fp"))
    made = made.withColumn("next_fp", F.lag("fp").over(inside)).withColumn("next_h", F.lag("h").over(inside)).where("own = 1")
    same = lambda fp, h: F.when(F.get(fp, F.lit(0)).isNull() & F.get("fp", F.lit(0)).isNull(), F.when(F.col("h") == F.col(h), 1.0).otherwise(0.0)).otherwise(likeness(F.col("fp"), F.col(fp)))
    return made.select(
        "doc_id",
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        _text(F.col("fp"), F.col("h")).alias("fingerprint"),
        _text(F.col("edit_fp"), F.col("eh")).alias("edited_fingerprint"),
        same("edit_fp", "eh").alias("near_edited"),
        same("next_fp", "next_h").alias("near_next"),
    )
