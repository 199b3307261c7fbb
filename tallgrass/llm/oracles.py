"""SQL of what the operators' contracts fix, for queries that return just those columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import imatch, licenses, packing, pii, quality, shingle_join
from .common import tables

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '')"

#: The whole join: sets of shingles, links by an inverted list, components by spreading the least doc_id.
SHINGLE_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
 sets AS MATERIALIZED (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM s), flat AS (SELECT doc_id, n, unnest(s) AS t FROM sets),
 links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 reach AS (SELECT doc_id AS node, doc_id AS top FROM sets UNION SELECT l.b, r.top FROM reach r JOIN links l ON l.a = r.node WHERE r.top < l.b),
 tops AS (SELECT node, min(top) AS component_id FROM reach GROUP BY 1), classes AS (SELECT s, min(doc_id) AS class_id FROM sets WHERE n > 0 GROUP BY 1)
 SELECT sets.doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, coalesce(class_id, sets.doc_id) AS class_id FROM sets JOIN tops ON sets.doc_id = node LEFT JOIN classes ON classes.s = sets.s AND n > 0"""


def shingle_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_shingles of the join with five-word shingles; neither depends on its links, which are not made."""
    return shingle_join.sizes(tables(spark, sf_dir, "documents"), 5)


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed columns of the I-Match query."""
    return imatch.fingerprints(tables(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed columns of the license scan."""
    return licenses.scan(tables(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed columns of the search for personal data."""
    return pii.find(tables(spark, sf_dir, "documents")).select("doc_id", *(f"n_{k}" for k in pii.BASE), "base_sha256")


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document where its pieces begin, and whether they make up the whole of it."""
    from .queries import tokenizer_path

    pieces = packing.pack(tables(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.groupBy("doc_id").agg(F.min("start").alias("first_start"), (F.sum("length") == F.max("doc_tokens")).alias("whole"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents with the classifier's verdict, made without the labels: it departs from two of sf0.1's."""
    found = quality.classify(tables(spark, sf_dir, "documents")).select("doc_id", "quality_pred")
    return tables(spark, sf_dir, "labels").where("quality is not null").join(found, "doc_id").select("doc_id", "quality_pred")


_NEXT = "o AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS f FROM documents)"
_TOKENS = "regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_PHRASE = "list_filter(generate_series(0, len(w) - {n}), lambda i: {test})"
_AT = {"cc-by": (2, "w[i + 1] = 'cc' AND w[i + 2] = 'by'"), "gpl": (3, "w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license'"), "reserved": (3, "w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved'")}
_PLACES = {k: _PHRASE.format(n=n, test=test) for k, (n, test) in _AT.items()}


def _spans(kind: str, pattern: str, digits: str | None) -> str:
    """(doc_id, a, ord, kind, z) of a base kind's valid matches: pieces between them and their lengths are their places."""
    order = ("email", "ip", "card", "phone").index(kind)
    piece, found = f"regexp_split_to_array(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}')"
    return f"""{kind}s AS (SELECT doc_id, k, f[k] AS s, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM (SELECT doc_id, {piece} AS p, {found} AS f FROM d) q, unnest(generate_series(1, len(f))) AS u(k)),
 {kind}_ok AS (SELECT doc_id, a, {order} AS ord, '{kind}' AS kind, a + length(s) AS z FROM {kind}s WHERE {digits or 'true'})"""


_DIGITS = "regexp_replace(s, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(generate_series(1, length({_DIGITS})), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST({_DIGITS}[i] AS INT) WHEN CAST({_DIGITS}[i] AS INT) > 4 THEN CAST({_DIGITS}[i] AS INT) * 2 - 9 ELSE CAST({_DIGITS}[i] AS INT) * 2 END)) % 10 = 0"
_PII = ",\n ".join(
    [
        "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        _spans("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", None),
        _spans("ip", "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS BIGINT), 0) > 255)) = 0"),
        _spans("card", "[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
        _spans("phone", "\\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
        "spans AS (SELECT * FROM email_ok UNION ALL SELECT * FROM ip_ok UNION ALL SELECT * FROM card_ok UNION ALL SELECT * FROM phone_ok)",
    ]
)

def _page_blocks(html: str) -> str:
    """Blocks of a piece of the tables' pages, whose block elements are few and well-formed."""
    bare = "replace(x, '<br>', ' ')"
    bare = f"regexp_replace({bare}, '<[^>]*>', '', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("#x27", "''"), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("amp", "&")):
        bare = f"replace({bare}, '&{name};', '{char}')"
    clean = f"trim(regexp_replace({bare}, '[\\s\u00a0]+', ' ', 'g'))"
    return f"list_filter(list_transform(regexp_split_to_array({html}, '</?(?:nav|ul|li|div|article|h1|p|footer|body|html)(?: [^>]*)?>|<!--[^>]*-->'), lambda x: {clean}), lambda x: x <> '')"


PAGES = f"""WITH h AS MATERIALIZED (SELECT page_id, url, md5(html) AS page, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)', 1)), '') AS site, coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '') AS article, coalesce(regexp_extract(html, '(?s)</head>(.*)', 1), '') AS body FROM pages),
 b AS MATERIALIZED (SELECT page_id, url, page, site, {_page_blocks('article')} AS kept, {_page_blocks('body')} AS found, {_page_blocks("regexp_replace(body, '(?s)<article>.*</article>', '<p>')")} AS outside FROM h),
 o AS (SELECT site, page, b, outside[b] AS t FROM (SELECT DISTINCT site, page, outside, unnest(generate_series(1, len(outside))) AS b FROM b)),
 tok AS MATERIALIZED (SELECT site, page, b, w, row_number() OVER (PARTITION BY site, page ORDER BY b, k) AS i FROM (SELECT site, page, b, k, string_split(t, ' ')[k] AS w FROM (SELECT *, unnest(generate_series(1, len(string_split(t, ' ')))) AS k FROM o))),
 win AS (SELECT site, page, i, array_to_string(list(w) OVER nxt, ' ') AS s, count(*) OVER nxt AS c FROM tok WINDOW nxt AS (PARTITION BY site, page ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
 rep AS (SELECT site, s FROM win WHERE c = 8 GROUP BY 1, 2 HAVING min(page) < max(page)),
 cov AS (SELECT DISTINCT site, page, i + j AS i FROM (SELECT win.*, unnest(range(8)) AS j FROM win SEMI JOIN rep ON rep.site = win.site AND rep.s = win.s WHERE c = 8)),
 blk AS (SELECT tok.site, tok.page, b, count(*) AS n, count(cov.i) AS hit FROM tok LEFT JOIN cov ON cov.site = tok.site AND cov.page = tok.page AND cov.i = tok.i GROUP BY 1, 2, 3),
 decided AS (SELECT site, page, count(*) FILTER (2 * hit > n) AS n FROM blk GROUP BY 1, 2)
 SELECT page_id, url, array_to_string(kept, chr(10)) AS text, CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS n_chars, CAST(len(found) AS BIGINT) AS n_blocks, CAST(len(found) - len(kept) AS BIGINT) AS n_dropped, CAST(coalesce(n, 0) AS BIGINT) AS n_settled FROM b LEFT JOIN decided ON decided.site = b.site AND decided.page = b.page"""

QUERIES = {"shingle_sizes": shingle_sizes, "edited_texts": edited_texts, "license_phrases": license_phrases, "personal_data": personal_data, "packed_documents": packed_documents, "judged_documents": judged}
ORACLES = {
    "op4_pages": PAGES,
    "op5_shingle_join": SHINGLE_JOIN,
    "shingle_sizes": f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, CAST(len(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN ['x'] ELSE [] END)) AS BIGINT) AS n_shingles FROM w",
    "edited_texts": f"WITH {_NEXT} SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 3) || left(f, length(t) // 3)) AS edited_sha256 FROM o",
    "license_phrases": f"""WITH w AS (SELECT doc_id, list_filter({_TOKENS}, lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, len(w) AS n, {', '.join(f'{sql} AS "{k}"' for k, sql in _PLACES.items())} FROM w), q AS (SELECT *, list_concat("cc-by", gpl, reserved) AS places FROM p)
 SELECT doc_id, n AS n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word, concat_ws(',', CASE WHEN len("cc-by") > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(reserved) > 0 THEN 'reserved' END) AS base_labels FROM q""",
    "personal_data": f"""WITH {_PII} SELECT d.doc_id, {', '.join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in pii.BASE)}, sha256(coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, ord), '')) AS base_sha256 FROM d LEFT JOIN spans ON d.doc_id = spans.doc_id GROUP BY d.doc_id""",
    "packed_documents": "SELECT doc_id, CAST(0 AS BIGINT) AS first_start, true AS whole FROM documents",
    "judged_documents": "SELECT doc_id, quality AS quality_pred FROM labels WHERE quality IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents)",
}
