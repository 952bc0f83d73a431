"""SQL twin of whole packs: candidates by name and search, the walk, scores, selection under budgets, order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.operators import search
from loomctx.plans import adapters as A

_WORD = r"[\p{L}\p{N}_]+"
_FOLD = f"translate(lower({{}}), '{search.ACCENTED}', '{search.PLAIN}')"
_COLUMNS = ["mode", "w_text", "w_hop", "w_edge_prior", "w_centrality", "w_role", "anchor", "doc", "other", "role_test", "role_code", "bonus"]


def _profiles() -> str:
    row = lambda p: ", ".join(f"'{p[c]}'" if c == "mode" else f"{p[c]}::DOUBLE" for c in _COLUMNS) + ", [" + ", ".join(f"'{w}'" for w in p["keywords"]) + "]::VARCHAR[]"
    return f"profiles({', '.join(_COLUMNS)}, keywords) AS (VALUES {', '.join('(' + row(S.profile(m)) + ')' for m in S.MODES)})"


def _hop(n: int, before: str, known: str) -> str:
    return f"""h{n} AS (SELECT item, id, source FROM (
    SELECT f.item, s.id, s.source, row_number() OVER (PARTITION BY f.item, s.id ORDER BY s.reverse, s.source) AS k
    FROM (SELECT *, count(*) OVER (PARTITION BY item) AS n FROM {before}) f JOIN steps s ON s.source = f.id WHERE f.n < {S.FRONTIER} AND NOT EXISTS (SELECT 1 FROM {known} x WHERE x.item = f.item AND x.id = s.id)) WHERE k = 1)"""


def packs(budgets: tuple[int, ...]) -> str:
    """CTEs up to ``packed`` (budget, request_id, mode, ord, type, path, symbol, first_line, last_line, tokens, node, reason, score, detail, stable)."""
    modes = ", ".join(f"'{m}'" for m in S.MODES)
    return rf"""WITH RECURSIVE {A.DOC_NODES_SQL}, {_profiles()},
  nodes AS (
    SELECT id, hash, kind, path, symbol, role, 9 AS last_line, tokens, content, centrality FROM chunks
    UNION ALL SELECT 's' || substr(id, 2), sha256('sig' || hash), 3, path, symbol, role, 9, 12, '...', centrality FROM chunks
    UNION ALL SELECT 'i' || item_id, sha256(text), 4, 'benchmark/' || item_id || '.txt', 'item_' || item_id, '', 1, (strlen(text) + 3) // 4, text, 0.0::DOUBLE FROM benchmark WHERE text IS NOT NULL),
  asked AS (SELECT item_id AS item, text AS query, [{modes}][item_id % 7 + 1] AS mode, [t FOR t IN regexp_extract_all(text, '{_WORD}') IF strlen(t) >= 2] AS terms,
    [regexp_replace(t, '^[^\p{{L}}\p{{N}}/._]+|[^\p{{L}}\p{{N}}/._]+$', '', 'g') FOR t IN string_split_regex(text, '[ \t\n,;()`"'']')] AS toks FROM benchmark),
  docterms AS (SELECT id, unnest(regexp_extract_all({_FOLD.format("concat_ws(' ', coalesce(symbol, ''), coalesce(path, ''), coalesce(content, ''))")}, '{_WORD}')) AS term FROM nodes),
  tf AS (SELECT term, id, count(*) AS tf FROM docterms GROUP BY ALL), dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  qt AS (SELECT item, term, count(*) AS mult FROM (SELECT item, {_FOLD.format("t")} AS term FROM (SELECT item, unnest(terms) AS t FROM asked)) GROUP BY ALL),
  w AS (SELECT item, term, mult, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf, avgdl FROM qt JOIN df USING (term), st),
  ranked AS (SELECT item, id, round(sum(mult * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM w JOIN tf USING (term) JOIN dl USING (id) GROUP BY ALL),
  hits AS (SELECT *, 1 - (k - 1) / count(*) OVER (PARTITION BY item) AS position FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS k FROM ranked) WHERE k <= {S.SEARCH_HITS}),
  found AS (
    SELECT h.item, CASE WHEN n.kind = 3 THEN c.id ELSE h.id END AS id, 'search_hit' AS reason,
      'query term ''' || coalesce([t FOR t IN a.terms IF contains(n.content, t) OR coalesce(contains(n.symbol, t), false)][1], a.terms[1]) || '''' AS detail, round(h.position, 2) AS text_score, 3 AS priority
    FROM hits h JOIN nodes n USING (id) JOIN asked a USING (item) LEFT JOIN chunks c ON n.kind = 3 AND c.path = n.path AND c.symbol = n.symbol
    UNION ALL
    SELECT item, id, 'anchor', 'file referenced in query: ' || path, 1.0, 1 FROM (SELECT DISTINCT item, regexp_extract(t, '[^/]*$') AS suffix FROM (SELECT item, unnest([t FOR t IN toks IF strlen(t) >= 3 AND (contains(t, '/') OR (contains(t, '.') AND strlen(regexp_extract(t, '[^.]*$')) <= 4))]) AS t FROM asked))
      JOIN (SELECT id, path, regexp_extract(path, '[^/]*$') AS suffix, row_number() OVER (PARTITION BY regexp_extract(path, '[^/]*$') ORDER BY length(path), path) AS k FROM chunks) USING (suffix) WHERE suffix <> '' AND k <= {S.ANCHOR_HITS}
    UNION ALL
    SELECT item, id, 'anchor', 'symbol named in query: ' || name, 1.0, 2 FROM (SELECT DISTINCT item, unnest([t FOR t IN toks IF strlen(t) >= 3 AND regexp_full_match(t, '{_WORD}') AND regexp_matches(t, '\p{{L}}')]) AS name FROM asked)
      JOIN (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY centrality DESC, id) AS k FROM (SELECT id, centrality, symbol AS name FROM chunks UNION SELECT id, centrality, regexp_extract(symbol, '[^.]*$') FROM chunks)) USING (name) WHERE k <= {S.ANCHOR_HITS}),
  seeds AS (SELECT item, id, reason, detail, text_score FROM (SELECT *, row_number() OVER (PARTITION BY item, id ORDER BY priority, text_score DESC, detail) AS k FROM found WHERE id IS NOT NULL) WHERE k = 1),
  named AS (SELECT name, min(id) AS id FROM (SELECT 'i' || item_id AS id, unnest(regexp_extract_all(text, '{_WORD}')) AS name FROM benchmark) WHERE strlen(name) >= 4 GROUP BY name),
  mentions AS (SELECT n.id AS src, t.id AS dst FROM (SELECT *, row_number() OVER (PARTITION BY t.id ORDER BY name) AS k FROM (SELECT DISTINCT id, unnest(regexp_extract_all(content, '{_WORD}')) AS name FROM chunks) t JOIN named USING (name)) t JOIN named n USING (name) WHERE k <= {S.MENTIONS_PER_DOC}),
  steps AS (SELECT DISTINCT src AS source, dst AS id, false AS reverse FROM mentions UNION SELECT DISTINCT dst, src, true FROM mentions),
  {_hop(1, "seeds", "seeds")}, seen AS (SELECT item, id FROM seeds UNION SELECT item, id FROM h1), {_hop(2, "h1", "seen")},
  everything AS (
    SELECT item, id, reason, detail, text_score, 0 AS hops FROM seeds
    UNION ALL SELECT item, h.id, 'doc_mention', 'doc_mention edge from ' || coalesce(n.symbol, n.path), 0.0, hops FROM (SELECT *, 1 AS hops FROM h1 UNION ALL SELECT *, 2 FROM h2) h LEFT JOIN nodes n ON n.id = h.source),
  keyed AS (SELECT e.*, n.* EXCLUDE (id), p.*, [k FOR k IN keywords IF contains(lower(coalesce(path, '')), k) OR contains(lower(coalesce(symbol, '')), k)][1] AS keyword FROM everything e JOIN nodes n USING (id) JOIN asked a USING (item) JOIN profiles p ON p.mode = a.mode),
  scored AS (SELECT item, mode, id, kind, path, symbol, tokens, reason, CASE WHEN keyword IS NULL THEN detail ELSE detail || ' · ' || mode || ' mode: matches ''' || keyword || '''' END AS detail,
    round(w_text * CASE reason WHEN 'search_hit' THEN text_score WHEN 'anchor' THEN 1.0 ELSE 0.0 END + w_hop * CASE hops WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.35 END + w_edge_prior * CASE reason WHEN 'anchor' THEN anchor WHEN 'doc_mention' THEN doc ELSE other END
      + w_centrality * centrality + w_role * CASE role WHEN 'test' THEN role_test ELSE role_code END + CASE WHEN keyword IS NULL THEN 0.0 ELSE bonus END, 9) AS score FROM keyed),
  candidates AS (SELECT c.*, s.id AS sig_id, s.tokens AS sig_tokens FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, id) <= {S.MAX_CANDIDATES}) c LEFT JOIN nodes s ON s.kind = 3 AND s.path = c.path AND s.symbol = c.symbol),
  ordered AS (SELECT b.budget, c.*, row_number() OVER (PARTITION BY budget, item ORDER BY -round(score / greatest(tokens, 1), 12), id) AS k FROM candidates c CROSS JOIN (SELECT unnest({list(budgets)}) AS budget) b),
  fold AS (
    SELECT DISTINCT budget, item, 0::BIGINT AS k, 0::BIGINT AS used, NULL::VARCHAR AS id, false AS substituted, NULL::VARCHAR AS reason, NULL::VARCHAR AS detail, NULL::DOUBLE AS score, NULL::VARCHAR AS mode FROM ordered
    UNION ALL
    SELECT f.budget, f.item, o.k, CASE WHEN fits THEN f.used + o.tokens WHEN small THEN f.used + o.sig_tokens ELSE f.used END, CASE WHEN fits THEN o.id WHEN small THEN o.sig_id END, NOT fits AND small, o.reason, o.detail, o.score, o.mode
    FROM fold f JOIN ordered o ON o.budget = f.budget AND o.item = f.item AND o.k = f.k + 1,
      LATERAL (SELECT f.used + o.tokens <= f.budget AS fits, o.reason <> 'anchor' AND o.kind = 2 AND o.sig_id IS NOT NULL AND f.used + coalesce(o.sig_tokens, 0) <= f.budget AS small)),
  hot AS (SELECT id, row_number() OVER (ORDER BY id) AS position FROM (SELECT 's' || substr(id, 2) AS id FROM (SELECT * FROM chunks WHERE centrality > 0 ORDER BY centrality DESC, tokens, id LIMIT {S.HOT_MEMBERS}))),
  packed AS (SELECT f.budget, CAST(f.item AS VARCHAR) AS request_id, f.mode, row_number() OVER (PARTITION BY f.budget, f.item ORDER BY position NULLS LAST, hash, id) AS ord,
    CASE WHEN substituted THEN 'signature' WHEN role = 'test' THEN 'test' WHEN kind = 2 THEN 'ast_chunk' WHEN kind = 3 THEN 'signature' WHEN kind = 4 THEN 'doc_chunk' ELSE 'file' END AS type, path, symbol, 1 AS first_line, last_line, tokens, id AS node,
    f.reason, round(CAST(f.score AS DECIMAL(18, 9)), 2)::DOUBLE AS score, f.detail, position IS NOT NULL AS stable FROM fold f JOIN nodes USING (id) LEFT JOIN hot USING (id))"""


ITEMS = "request_id, ord, type, path, symbol, first_line, last_line, tokens, node, reason, score, detail, stable"
CONTEXT_PACK = f"{packs((2000,))} SELECT {ITEMS} FROM packed"
_TOTALS = """, by_path AS (SELECT p.budget, p.request_id, p.path, sum(p.tokens) AS t, max(c.tokens) + 3 AS whole FROM packed p LEFT JOIN chunks c ON c.path = p.path GROUP BY ALL),
  totals AS (SELECT *, round(greatest(raw - selected, 0) * 10000.0 / raw) / 100 AS saved_pct FROM (SELECT budget, request_id, sum(t)::BIGINT AS selected, sum(coalesce(whole, t))::BIGINT AS raw FROM by_path GROUP BY ALL))"""
TOKEN_SAVINGS = f"{packs((2000,))}{_TOTALS} SELECT count(*) AS packs, list_sort(list(saved_pct))[count(*) // 2 + 1] AS median_saved_pct, round(avg(saved_pct), 2) AS mean_saved_pct, least(100.0, min(saved_pct)) AS min_saved_pct FROM totals"
BY_BUDGET = f"{packs((2000, 6000, 12000))}{_TOTALS} SELECT budget, count(*) AS n, round(median(selected), 4) AS median_selected_tokens, round(median(raw), 4) AS median_raw_tokens, round(median(saved_pct), 4) AS median_saved_pct FROM totals GROUP BY budget"


def flat(items: DataFrame) -> DataFrame:
    """Items of packs with the twin's columns: without their content, lines as two numbers."""
    return items.withColumns({"first_line": F.get("lines", 0), "last_line": F.get("lines", 1)}).select(*(c.strip() for c in ITEMS.split(",")))
