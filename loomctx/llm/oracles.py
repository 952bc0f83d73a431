"""DuckDB twins of the operators that SQL can express, by plain definitions: all windows, all pairs."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_REACH = "reach(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b)"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, 2))) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
edges AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
ids AS (SELECT doc_id AS id FROM documents), {_REACH},
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

REPEATED_WORDS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
keys AS (SELECT doc_id, [md5(array_to_string(ws[i:i + 19], ' ')) FOR i IN range(1, len(ws) - 18)] AS ks FROM w),
win AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM (SELECT doc_id, unnest(ks) AS k, generate_subscripts(ks, 1) AS i FROM keys)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM win WHERE nth > 1),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN g USING (doc_id)
"""

REPEATED_BYTES = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
keys AS (SELECT doc_id, [md5(substr(hx, 2 * i + 1, 800)) FOR i IN range(0, len(hx) // 2 - 399)] AS ks FROM h),
win AS (SELECT doc_id, i - 1 AS i, k FROM (SELECT doc_id, unnest(ks) AS k, generate_subscripts(ks, 1) AS i FROM keys)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win SEMI JOIN twice USING (k)),
runs AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY doc_id, r),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM spans UNION ALL SELECT doc_id, max(b), 1000000000 FROM spans GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(hx, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS hx FROM gaps JOIN h USING (doc_id) GROUP BY 1),
n AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM spans GROUP BY 1)
SELECT h.doc_id, len(h.hx) // 2 AS n_bytes, coalesce(n.removed, 0) AS n_removed, coalesce(n.spans, 0) AS n_spans, sha256(unhex(coalesce(kept.hx, h.hx))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
edges AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
ids AS (SELECT vec_id AS id FROM v), {_REACH},
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1), l AS (SELECT x AS vec_id, count(*) AS n FROM edges GROUP BY 1)
SELECT vec_id, coalesce(l.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN l USING (vec_id)
"""

TOP_PRODUCTS = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
d AS (SELECT r, vec_id, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM v),
s AS (SELECT q.r AS q, q.vec_id AS query_id, d.r, d.vec_id, sum(q.c * d.c) AS score FROM d q JOIN d ON q.i = d.i WHERE q.vec_id % 20 = 0 AND q.r <> d.r GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) AS rank FROM s) WHERE rank <= 20
"""
