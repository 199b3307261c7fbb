"""Personal data by gradient-boosted candidates, in DataFrame operations only.

Regular expressions with high recall propose overlapping spans; each gets format and context features (from the
text before and after it); boosted trees, trained on TRAIN_ROWS rows made by rule, score it; a threshold per kind,
calibrated on rows held out from training, selects what is redacted. Spans of the base kinds that pass their checks
stay in any case; a span of another kind that overlaps one of them is left out. The trees become column expressions,
so that a document's spans are found, scored and redacted within its row, without a shuffle.

Positions of matches: the text is split by the pattern; the running sums of the pieces' and matches' lengths are
their places. Running folds go by blocks, so that a text with many thousand matches stays near linear.
Patterns use possessive quantifiers and look-behinds where these match the same: they keep long runs of one
kind of character linear and off the JVM's stack.

Defined results: null is empty; no span gives empty strings and counts of 0. Repeated rows each get a row.
Redaction replaces each span by its kind in brackets; of overlapping spans the one that starts first (then
the one listed first) is written and the others' remainders vanish with it. Other columns, whatever their names,
stay as they are. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows made by rule for training and calibration.
TRAIN_ROWS = 4_000
TREES, DEPTH = 12, 4
#: Precision that a kind's threshold must have on the calibration rows.
PRECISION = 0.95
CONTEXT = 24
#: Elements of a block of a running fold.
BLOCK = 64

# The base kinds and their patterns, as given but for possessive quantifiers.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# The further generators; their spans are kept by score alone.
MORE = {
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{20,}+={0,2}",
    "number": r"(?<![0-9A-Za-z.+(-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
}
KINDS = (*BASE, *MORE)
# Words near a span that speak for it, and against it.
CUES = r"(?i)token|secret|passw|api|key|bearer|auth|mail|contact|phone|tel|call|fax|mobile|cell|reach|card|visa|iban|account|bank|transfer|ssn|\bip\b|addr|host|login|credential"
AGAINST = r"(?i)version|isbn|order|page|figure|section|invoice|part|model|sku|build|commit|revision|digest|checksum|sha-?[0-9]|md5|serial|ticket|between|years|total"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, step, levels: int = 2) -> Column:
    """For each of the values (one at least) the fold of those before it.

    Blocks are folded one by one; their starts are the running fold of the blocks' own folds."""

    def blocked(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / F.lit(BLOCK)).cast("int")
        return _let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))), joined)

    def joined(blocks: Column) -> Column:
        starts = _let(F.transform(blocks, lambda b: F.aggregate(b, zero, step)), before)
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(b, lambda _, j: F.aggregate(F.slice(b, F.lit(1), j), s, step))))

    def before(totals: Column) -> Column:
        if levels > 1:
            return running(totals, zero, step, levels - 1)
        return F.transform(totals, lambda _, i: F.aggregate(F.slice(totals, F.lit(1), i), zero, step))

    return _let(values, blocked)


SPAN = "struct<start:int,ord:int,kind:string,end:int,s:string,before:string,after:string>"


def spans_of(text: Column, kind: str) -> Column:
    """array<SPAN> of a pattern's leftmost non-overlapping matches, in code points.

    before and after are the CONTEXT characters next to it, as far as the neighbouring matches of the kind."""
    pattern = (BASE | MORE)[kind]

    def placed(v: Column) -> Column:
        found, pieces = v["found"], v["pieces"]
        n = F.size(found)
        gaps = F.slice(pieces, F.lit(1), n)
        starts = running(F.zip_with(gaps, found, lambda p, m: F.length(p) + F.length(m)), F.lit(0), lambda x, y: x + y)
        sides = F.zip_with(gaps, F.slice(pieces, F.lit(2), n), lambda p, q: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("before"), F.left(q, F.lit(CONTEXT)).alias("after")))
        with_start = F.zip_with(sides, starts, lambda x, at: F.struct((at + x["gap"]).alias("start"), x["before"].alias("before"), x["after"].alias("after")))
        return F.zip_with(with_start, found, lambda x, m: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), (x["start"] + F.length(m)).alias("end"), m.alias("s"), x["before"].alias("before"), x["after"].alias("after")))

    matches = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return _let(matches, lambda v: F.when(F.size(v["found"]) > 0, placed(v)).otherwise(none))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(F.coalesce(c.try_cast("int"), F.lit(0)).alias("d"), (i % 2).alias("odd")))
    total = F.aggregate(numbers, F.lit(0), lambda t, x: t + F.when(x["odd"] == 0, x["d"]).when(x["d"] * 2 > 9, x["d"] * 2 - 9).otherwise(x["d"] * 2))
    return total % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """The base kinds' checks."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(s, r"\."), lambda p: F.when(F.length(bare(p)) <= 3, F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255).otherwise(False))
    n = F.length(_digits(s))
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(s))
    return n.between(9, 15)


FEATURES = ("ord", "length", "digits", "letters", "upper", "separators", "runs", "distinct", "hex", "luhn", "cue", "against", "at", "dots", "checked", "switches", "cue_after", "against_after")


def features(kind: Column, s: Column, before: Column, after: Column) -> list[Column]:
    """Format and context features of a candidate, in the order of FEATURES, as doubles."""
    count = lambda pattern: (F.length(s) - F.length(F.regexp_replace(s, pattern, ""))).cast("double")
    order = reduce(lambda c, k: c.when(kind == k, F.lit(float(KINDS.index(k)))), KINDS[1:], F.when(kind == KINDS[0], F.lit(0.0)))
    digits = _digits(s)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    checked = reduce(lambda c, k: c.when(kind == k, flag(valid(k, s))), list(BASE)[1:], F.when(kind == "email", F.lit(1.0))).otherwise(0.0)
    return [
        order,
        F.length(s).cast("double"),
        count("[0-9]") / F.length(s),
        count("[A-Za-z]") / F.length(s),
        count("[A-Z]") / F.length(s),
        count("[ ().-]"),
        F.size(F.split(s, "[ ().-]+")).cast("double"),
        F.size(F.array_distinct(F.split(s, ""))).cast("double"),
        flag(s.rlike("^[0-9a-fA-F]+$")),
        flag(F.length(digits).between(12, 19) & luhn(digits)),
        flag(before.rlike(CUES)),
        flag(before.rlike(AGAINST)),
        flag(s.contains("@")),
        count("[.]"),
        checked,
        count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"),
        flag(after.rlike(CUES)),
        flag(after.rlike(AGAINST)),
    ]


# What stands around a made candidate: (before, after, share of personal ones among them, kinds or all).
CONTEXTS = (
    ("{w} token = \"", "\" {w}", 0.99, "secret"),
    ("api key: ", " {w}", 0.99, "secret"),
    ("{w} secret ", ", {w}", 0.98, "secret"),
    ("password=", " {w} {w}", 0.98, "secret"),
    ("{w} commit ", " {w}", 0.03, "secret"),
    ("checksum sha1 ", " {w} {w}", 0.02, "secret"),
    ("{w} {w} ", " {w} {w}", 0.75, "secret"),
    ("{w} call me at ", " {w}", 0.99, "number"),
    ("phone: ", ", {w}", 0.99, "number"),
    ("contact {w} ", ". {w}", 0.98, "number"),
    ("{w} ", " is my mobile", 0.98, "number"),
    ("order {w} ", " {w}", 0.03, "number"),
    ("ISBN ", " {w}", 0.02, "number"),
    ("between ", " years {w}", 0.03, "number"),
    ("{w} {w} ", " {w} {w}", 0.5, "number"),
    ("IBAN ", " {w}", 0.99, "iban"),
    ("{w} bank account ", ", {w}", 0.98, "iban"),
    ("{w} ", " {w} transfer", 0.98, "iban"),
    ("{w} {w} ", " {w} {w}", 0.9, "iban"),
    ("model ", " {w}", 0.05, "iban"),
    ("serial {w} ", " {w}", 0.04, "iban"),
    ("{w} {w} ", " {w} {w}", 1.0, "base"),
    ("version {w} ", " {w}", 1.0, "base"),
    ("contact ", " {w}", 1.0, "base"),
)


def training_rows(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """Candidates made by rule: kind, s, before, after, label. The same rows wherever it runs.

    A candidate's form is right for its kind or only looks like it; its context says with what chance the former is
    personal, so that equal rows have different labels and thresholds have something to choose."""
    h = F.sha2(F.col("id").cast("string"), 512)
    draw = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    pick = lambda k, items: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in items)), draw(k, len(items)) + 1)
    number = F.concat(*(F.lpad(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**8)).cast("string"), 8, "0") for k in range(4)))
    d = lambda a, n: F.substring(number, a, n)
    words = "the report total about value called with notes under house garden river morning letter".split()
    letters, length = F.translate(h, "0123456789", "ghijklmnop"), draw(7, 44) + 20
    mixed_case = F.concat(F.substring(F.translate(h, "0123456789", "XyZkQrTuVw"), F.lit(3), F.lit(12)), d(1, 6), F.substring(h, F.lit(40), length))
    right = {
        "secret": [F.substring(h, F.lit(1), length), mixed_case, F.concat(F.lit("sk_"), mixed_case)],
        "number": [F.concat(F.lit("("), d(1, 3), F.lit(") "), d(4, 3), F.lit("-"), d(7, 4)), F.concat_ws("-", d(1, 3), d(4, 3), d(7, 4)), F.concat_ws(" ", d(1, 3), d(4, 3), d(7, 4)), F.concat_ws(".", d(1, 3), d(4, 3), d(7, 4))],
        "iban": [F.concat(F.upper(F.substring(letters, F.lit(1), F.lit(2))), d(1, 2), *(x for k in range(4) for x in (F.lit(" "), d(3 + 4 * k, 4)))), F.concat(F.upper(F.substring(letters, F.lit(1), F.lit(2))), d(1, 20))],
        "email": [F.concat(F.substring(letters, F.lit(1), F.lit(7)), F.lit("."), d(1, 2), F.lit("@mail"), d(3, 1), F.lit(".example.com"))],
        "ip": [F.concat_ws(".", F.lit("1"), *((d(2 * k + 1, 2)) for k in range(3)))],
        "card": [F.concat(F.lit("4"), d(1, 15)), F.concat(F.lit("4"), d(1, 3), *(x for k in range(3) for x in (F.lit(" "), d(4 + 4 * k, 4))))],
        "phone": [F.concat(F.lit("+1 ("), d(1, 3), F.lit(") 555-"), d(4, 4))],
    }
    wrong = {
        "secret": [F.concat(F.substring(letters, F.lit(1), length), d(1, 1)), F.concat(F.lit("section-"), F.substring(letters, F.lit(1), F.lit(12)), F.lit("-part-"), d(1, 2)), F.concat(F.lit("/"), F.substring(letters, F.lit(1), F.lit(9)), F.lit("/"), F.substring(letters, F.lit(20), F.lit(12)), d(1, 2))],
        "number": [F.concat_ws(".", d(1, 2), d(3, 2), d(5, 4)), F.concat_ws(" ", d(1, 2), d(3, 2), d(5, 3)), F.concat_ws("-", d(1, 4), d(5, 2), d(7, 3))],
        "iban": [F.concat(F.lit("AB12"), F.upper(F.substring(letters, F.lit(1), F.lit(16))))],
        "email": [F.concat(F.substring(letters, F.lit(1), F.lit(1)), F.lit("@"), d(1, 1), F.lit("."), d(2, 1))],
        "ip": [F.concat_ws(".", d(1, 4), d(5, 1), d(6, 1), d(7, 3)), F.concat_ws(".", F.lit("1"), d(2, 2), d(4, 1), F.concat(F.lit("9"), d(5, 2)))],
        "card": [F.concat_ws("-", d(1, 4), d(5, 2), d(7, 2)), F.concat_ws(" ", d(1, 3), d(4, 3), d(7, 4)), d(1, 16)],
        "phone": [F.concat(F.lit("+"), d(1, 2), F.lit("-"), d(4, 1))],
    }
    chosen = F.element_at(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(z).alias("z"), F.lit(p).alias("p"), F.lit(k).alias("k")) for a, z, p, k in CONTEXTS)), draw(20, len(CONTEXTS)) + 1)
    made = spark.range(rows).withColumn("c", chosen).withColumn("kind", F.when(F.col("c.k") == "base", pick(21, list(BASE))).otherwise(F.col("c.k")))
    good = draw(22, 4) > 0
    of = lambda forms, k: reduce(lambda c, kind: c.when(F.col("kind") == kind, pick(k, forms[kind])), KINDS[1:], F.when(F.col("kind") == KINDS[0], pick(k, forms[KINDS[0]])))
    filled = lambda t, k: F.replace(t, F.lit("{w}"), pick(k, words))
    made = made.withColumn("s", F.when(good, of(right, 23)).otherwise(of(wrong, 24)))
    ok = F.when(F.col("kind") == "card", luhn(_digits(F.col("s"))) & F.length(_digits(F.col("s"))).between(12, 19)).otherwise(good)
    return made.select("id", "kind", "s", filled(F.col("c.a"), 25).alias("before"), filled(F.col("c.z"), 26).alias("after"), (ok & (draw(27, 1000) < F.col("c.p") * 1000)).cast("double").alias("label"))


def _tree(node, names: list[str]) -> str:
    """A regression tree as an SQL expression."""
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{float(node.prediction())!r}D"
    split = node.split()
    return f"if({names[split.featureIndex()]} <= {float(split.threshold())!r}D, {_tree(node.leftChild(), names)}, {_tree(node.rightChild(), names)})"


_FITTED: dict[int, tuple[list[tuple[float, str]], dict[str, float]]] = {}


def fit(spark: SparkSession) -> tuple[list[tuple[float, str]], dict[str, float]]:
    """(weight, tree over x.f0, x.f1, ..) of the boosted trees, and each kind's threshold on their sum.

    The rows are made by rule, so that the model is the same every time: it is fitted once and kept."""
    if TRAIN_ROWS in _FITTED:
        return _FITTED[TRAIN_ROWS]
    made = training_rows(spark)
    rows = made.select("id", "kind", "label", *(f.alias(n) for f, n in zip(features(F.col("kind"), F.col("s"), F.col("before"), F.col("after")), FEATURES, strict=True)))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.repartition(2, "id"))
    train = rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) != 0).select("features", "label").coalesce(2).persist()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(train)
    train.unpersist()
    trees = [(float(w), _tree(t._call_java("rootNode"), [f"x.{n}" for n in FEATURES])) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    held = rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == 0).select("kind", "label", F.struct(*FEATURES).alias("x")).select("kind", "label", F.expr(_sum(trees)).alias("z")).collect()  # a third of TRAIN_ROWS
    _FITTED[TRAIN_ROWS] = trees, {kind: threshold([(r["z"], r["label"]) for r in held if r["kind"] == kind]) for kind in KINDS}
    return _FITTED[TRAIN_ROWS]


def threshold(scored: list[tuple[float, float]], precision: float = PRECISION) -> float:
    """The lowest score at and above which the share of personal ones is the precision; equal scores go together."""
    best, hit = float("inf"), 0.0
    scored = sorted(scored, reverse=True)
    for k, (z, label) in enumerate(scored, 1):
        hit += label
        if (k == len(scored) or scored[k][0] < z) and hit / k >= precision:
            best = z - 1e-9
    return min(best, 1e9)


def _sum(trees: list[tuple[float, str]]) -> str:
    return " + ".join(f"{w!r}D * {t}" for w, t in trees)


FOUND = "struct<start:int,ord:int,kind:string,end:int,base:boolean>"


def _fresh(name: str, taken: list[str]) -> str:
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def with_spans(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """docs with a new column: array<FOUND> of what is to be redacted, in order. name must not be taken."""
    trees, thresholds = fit(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    gates = {"email": body.contains("@"), "phone": body.contains("+"), "secret": body.rlike("[A-Za-z0-9_/+=-]{20}")}
    candidates = F.concat(*(F.when(gates.get(k, F.lit(True)), spans_of(body, k)).otherwise(none) for k in KINDS))
    # without a digit or an @ no pattern matches
    docs = docs.select(*columns, F.when(body.rlike("[0-9@]"), candidates).otherwise(none).alias(name))

    def scored(c: Column) -> Column:
        x = F.struct(*(f.alias(n) for f, n in zip(features(c["kind"], c["s"], c["before"], c["after"]), FEATURES, strict=True)))
        return F.struct(*(c[n].alias(n) for n in ("start", "ord", "kind", "end")), x.alias("x"))

    docs = docs.select(*columns, F.transform(name, scored).alias(name))
    limit = "case " + " ".join(f"when x.kind = '{k}' then {v!r}D" for k, v in thresholds.items()) + " end"
    total = _sum(trees).replace("x.", "x.x.")
    base = f"x.ord < {len(BASE)} and x.x.checked = 1D"
    kept = F.expr(f"filter(transform({name}, x -> named_struct('start', x.start, 'ord', x.ord, 'kind', x.kind, 'end', x.end, 'base', {base}, 'keep', ({base}) or ({total}) >= {limit})), y -> y.keep)")
    kept = F.transform(F.sort_array(kept), lambda s: s.dropFields("keep"))
    return docs.select(*columns, kept.alias(name)).select(*columns, F.when(F.size(name) > 1, _apart(F.col(name))).otherwise(F.col(name)).alias(name))


def _apart(spans: Column) -> Column:
    """The spans (in order) without those of further kinds that overlap one of a base kind."""
    far = F.lit(2**31 - 1)

    def marked(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda s: F.when(s["base"], s["end"]).otherwise(0)), F.lit(0), lambda x, y: F.greatest(x, y))
        back = F.transform(F.reverse(all_), lambda s: F.when(s["base"], s["start"]).otherwise(far))
        starts = F.reverse(running(back, far, lambda x, y: F.least(x, y)))
        bounded = F.zip_with(F.zip_with(all_, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), starts, lambda x, n: F.struct(x["s"].alias("s"), (x["s"]["base"] | (x["e"] <= x["s"]["start"]) & (n >= x["s"]["end"])).alias("ok")))
        return F.transform(F.filter(bounded, lambda x: x["ok"]), lambda x: x["s"])

    return _let(spans, marked)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): counts of the base kinds, digest of the base spans, all spans, counts of the others."""
    found = with_spans(docs.select("doc_id", "text"), "found")
    base = F.filter("found", lambda s: s["base"])
    counts = {k: F.expr(f"size(filter(found, s -> {'s.base and' if k in BASE else ''} s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS}
    return found.select(
        "doc_id", *(counts[k] for k in BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), *(counts[k] for k in MORE), F.size("found").cast("long").alias("n_spans")
    )


def redacted(text: Column, spans: Column) -> Column:
    """text with each of its spans (one at least, in order) replaced by [KIND]."""
    part = 4096

    def between(blocks: Column, a: Column, z: Column) -> Column:
        """Code points a to z of the text that the blocks of part code points make up."""
        i, j = F.floor(a / part).cast("int"), F.floor(z / part).cast("int")
        first, last = F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, j), F.lit(""))
        apart = F.concat(F.substring(first, a % part + 1, F.lit(part)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(last, F.lit(1), z % part))
        return F.when(z <= a, "").when(i == j, F.substring(first, a % part + 1, z - a)).otherwise(apart)

    def written(v: Column) -> Column:
        blocks, s, at = v["blocks"], v["spans"], v["at"]
        pieces = F.zip_with(s, at, lambda x, e: F.when(x["start"] >= e, F.concat(between(blocks, e, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(""))
        n = F.size(s)
        end = F.greatest(F.get(at, n - 1), F.get(s, n - 1)["end"])
        return F.concat(F.array_join(pieces, ""), between(blocks, end, v["n"]))

    reach = running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
    return _let(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{part}}}"), F.lit(0)).alias("blocks"), spans.alias("spans"), reach.alias("at"), F.length(text).alias("n")), written)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with their texts redacted and n_chars set anew; null texts stay null."""
    name = _fresh("found", docs.columns)
    found = with_spans(docs, name)
    some = F.size(f"`{name}`") > 0
    text = F.when(some, redacted(F.col("text"), F.col(f"`{name}`"))).otherwise(F.col("text")).alias("text")
    out = found.select(*(text if c == "text" else F.col(f"`{c}`") for c in docs.columns), some.alias(name))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"`{name}`"), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
