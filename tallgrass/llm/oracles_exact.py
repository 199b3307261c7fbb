"""SQL of the operators whose whole results are exact: centroid clustering and the Merkle manifest."""

from __future__ import annotations

_D = "list_sum(list_transform(generate_series(1, 64), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"


def _rounds(rounds: int) -> str:
    """Assignments a0.. and centroids c1.. : a means vectors by (distance, centroid), a centroid without vectors stays."""
    out = []
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT r, vec_id, x, b.d AS distance, b.c AS cluster FROM (SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min({{'d': CAST({_D} AS BIGINT), 'c': c.c}}) AS b FROM v, c{r} c GROUP BY v.r))")
        if r < rounds:
            out.append(f"m{r} AS (SELECT cluster AS c, i, sum(y) AS s, count(*) AS n FROM (SELECT cluster, unnest(generate_series(1, 64)) AS i, unnest(x) AS y FROM a{r}) GROUP BY 1, 2)")
            out.append(f"w{r} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM m{r} GROUP BY 1)")
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(w{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN w{r} ON c{r}.c = w{r}.c)")
    return ",\n ".join(out)


CLUSTER = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
 c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) - 1 AS INT) AS c, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT 16)),
 {_rounds(3)}
 SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON cluster = c3.c"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(text: str) -> str:
    part = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    return f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _tree(name: str, levels: int) -> str:
    """From nodes {name}0 (g, i, node, total) the levels above, and the runs that each level's nodes are siblings in."""
    out = []
    for k in range(levels):
        out.append(f"{name}_run{k} AS MATERIALIZED (SELECT g, i // 8 AS i, list(node ORDER BY i) AS nodes, any_value(total) AS total FROM {name}{k} GROUP BY 1, 2)")
        out.append(f"{name}{k + 1} AS (SELECT g, i, CASE WHEN total = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node, (total + 7) // 8 AS total FROM {name}_run{k})")
    return ",\n ".join(out)


def _walk(name: str, start: str, levels: int, out: str) -> str:
    """From start (r, g, i, proof, fold) up the levels: siblings join the proof and the fold."""
    steps, last = [], start
    for k in range(levels):
        now = f"{out}{k}"
        left, right = "array_to_string(nodes[1:p.i % 8], '')", "array_to_string(nodes[p.i % 8 + 2:], '')"
        steps.append(f"{now} AS (SELECT p.r, p.g, p.i // 8 AS i, CASE WHEN total = 1 THEN proof ELSE proof || {left} || {right} END AS proof, CASE WHEN total = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold FROM {last} p JOIN {name}_run{k} n ON n.g = p.g AND n.i = p.i // 8)")
        last = now
    return ",\n ".join(steps)


def manifest(levels: int = 7) -> str:
    """SQL for tables of up to 8 ** levels rows a language, and as many languages."""
    return f"""WITH t AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) q(n))),
 h AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, {_digest('text')} AS leaf, {_digest(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS other,
  coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 3 = 0, false) AS third FROM documents, t),
 o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, count(*) OVER (PARTITION BY g) AS total FROM h),
 d0 AS (SELECT g, i, leaf AS node, total FROM o), {_tree('d', levels)},
 l0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, g AS name, node, count(*) OVER () AS total FROM d{levels}), {_tree('l', levels)},
 p AS (SELECT r, g, i, '' AS proof, CASE WHEN third THEN other ELSE leaf END AS fold FROM o), {_walk('d', 'p', levels, 'pd')},
 q AS (SELECT p.r, l0.g, l0.i, proof, fold FROM pd{levels - 1} p JOIN l0 ON l0.name = p.g), {_walk('l', 'q', levels, 'pl')}
 SELECT doc_id, leaf, l0.node AS subroot, top.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = top.node AS verified
 FROM o JOIN pl{levels - 1} w ON w.r = o.r JOIN l0 ON l0.name = o.g CROSS JOIN l{levels} top"""
