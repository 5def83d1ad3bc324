"""The same results in DuckDB's SQL, where it can express them."""

from __future__ import annotations

from .license_scan import PHRASES, TEMPLATES, WINDOW

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


def _words(text: str) -> str:
    return f"regexp_extract_all({_lower(text)}, '{_WORD}')"


OP8 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_words("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g, least(13, len(w)) AS n
        FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
      FROM (SELECT d.r, d.w, sizes.n, unnest(range(1, len(d.w) - sizes.n + 2)) AS s FROM d, sizes WHERE len(d.w) >= sizes.n)),
hit AS (SELECT g.r, g.s, g.n, win.item FROM g JOIN win ON g.g = win.g AND g.n = win.n),
pos AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""

OP2 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_lower("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, r, count(g) AS n FROM d LEFT JOIN s USING (r) GROUP BY ALL),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.r < y.r GROUP BY ALL),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(id, least) AS (SELECT doc_id, doc_id FROM d WHERE doc_id IS NOT NULL UNION SELECT c.id, e.b FROM c JOIN e ON c.least = e.a),
m AS (SELECT id, min(least) AS component_id FROM c GROUP BY id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept FROM n LEFT JOIN m ON doc_id = id
"""

OP10 = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
       AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN m ON e.vec_id = m.id LEFT JOIN n ON e.vec_id = n.a
"""

_DOCS = rf"SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, {_words('text')} AS w FROM documents"


def _op1() -> str:
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES.items())
    return rf"""
WITH d AS ({_DOCS}),
p(phrase, label) AS (VALUES {phrases}),
places AS (SELECT r, label, s - 1 AS place FROM (SELECT d.r, d.w, p.label, p.phrase, len(string_split(p.phrase, ' ')) AS n, unnest(range(1, len(d.w) + 1)) AS s FROM d, p)
           WHERE array_to_string(w[s:s + n - 1], ' ') = phrase),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
lines AS (SELECT r, {_words("line")} AS lw FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) UNION ALL SELECT r, w FROM d WHERE contains(text, chr(10))),
blocks AS (SELECT r, list_distinct(lw[s + 1:s + {WINDOW}]) AS bw FROM (SELECT r, lw, unnest(range(0, greatest(1, len(lw) - {WINDOW // 2}), {WINDOW // 2})) AS s FROM lines)),
t AS (SELECT label, list_distinct({_words("text")}) AS tw FROM (VALUES {templates}) AS v(label, text)),
met AS (SELECT r, label, max(len(list_intersect(bw, tw)) / len(tw)) AS share FROM blocks, t
        WHERE len(list_intersect(bw, tw)) >= greatest(1, ceil(0.8 * len(tw) - 1e-9)) GROUP BY r, label),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM met UNION SELECT r, label FROM places) GROUP BY r),
best AS (SELECT r, max(share) AS share FROM met GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN base_labels IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)
"""


ORACLES = {
    "op1_license_scan": _op1(),
    "op2_minhash_near_dedup": OP2,
    "op8_benchmark_decontamination": OP8,
    "op10_embedding_near_dedup": OP10,
}
