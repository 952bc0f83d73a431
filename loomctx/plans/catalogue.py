"""Every operator as a query over the benchmark tables, with its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.functions import sections, tokens
from loomctx.functions import text as T
from loomctx.functions.parse import declarations
from loomctx.operators import graph as G
from loomctx.operators import hotset, index, lookup, maintain, pack, postings, ranks, render, report, search
from loomctx.plans import adapters as A
from loomctx.plans import pack_twin
from loomctx.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _long(*columns: str):
    return [F.col(c).cast("long").alias(c) for c in columns]


# --- scalar functions ---------------------------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n+$', '') || chr(10)) AS digest
    FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(65279) || text || chr(13) || chr(10) WHEN 1 THEN replace(text, chr(10), ' ' || chr(9) || chr(13) || chr(10)) || ' ' WHEN 2 THEN replace(text, ' ', chr(13)) || repeat(chr(10), 3) ELSE '' END AS v FROM documents)"""
)
def fn_normalize(spark, sf):
    d = A.table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    v = F.when(k == 0, F.concat(F.lit("\ufeff"), "text", F.lit("\r\n"))).when(k == 1, F.concat(F.replace("text", F.lit("\n"), F.lit(" \t\r\n")), F.lit(" "))).when(k == 2, F.concat(F.replace("text", F.lit(" "), F.lit("\r")), F.lit("\n\n\n"))).otherwise("")
    return d.select("doc_id", F.sha2(T.normalize(v), 256).alias("digest"))


@query(
    r"""SELECT hash, substr(hash, 1, 32) AS id, count(*) AS copies, max(doc_id) AS last_doc FROM (
      SELECT doc_id, sha256(encode('loom1') || '\x00'::BLOB || '\x02'::BLOB || '\x00'::BLOB || encode(lang) || '\x00'::BLOB || encode(text)) AS hash FROM documents) GROUP BY hash"""
)
def fn_content_hash(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", T.content_hash(S.CHUNK, "lang", "text").alias("hash"))
    return d.groupBy("hash").agg(F.count("*").alias("copies"), F.max("doc_id").alias("last_doc")).withColumn("id", T.node_id("hash"))


@query("SELECT lang, sum((strlen(text) + 3) // 4)::BIGINT AS tokens, max((strlen(text) + 3) // 4)::BIGINT AS most FROM documents GROUP BY lang")
def fn_token_estimate(spark, sf):
    return A.table(spark, sf, "documents").groupBy("lang").agg(F.sum(T.token_estimate("text")).alias("tokens"), F.max(T.token_estimate("text")).alias("most"))


#: Ranks of a public encoding, the same file on the driver and in tests.
RANKS = "file:///opt/tokenizers/byte_bpe_50k.tiktoken"


@query(None)
def fn_token_exact(spark, sf, ranks=RANKS):
    """Tokens of every whole text by a table of ranks; byte-pair merges have no SQL twin (``tests/test_tokens.py`` holds the counts against an independent tokenizer)."""
    return A.table(spark, sf, "documents").select("doc_id", tokens.exact_tokens(spark, "text", tokens.read_ranks(spark, ranks)).alias("tokens"))


_PATHS = ["src/app.py", "latest/x.py", "test_a.py", "a_test.py", "web/a.test.ts", "web/__tests__/b.js", "web/c.spec.tsx", "src/test/java/FooTest.java", "src/main/FooIT.java", "src/main/Foo.java", "README.md", "A.MD", "x.PY", "notes.markdown", "Makefile", ".hidden", "d.mjs"]


@query(
    "SELECT path, regexp_extract(path, '[^/]*$') AS name, lang, CASE lang WHEN 'python' THEN starts_with(n, 'test_') OR ends_with(n, '_test.py') OR contains(path, 'tests/') OR contains(path, 'test/') WHEN 'typescript' THEN contains(n, '.test.') OR contains(n, '.spec.') OR contains(path, '__tests__/') WHEN 'tsx' THEN contains(n, '.test.') OR contains(n, '.spec.') OR contains(path, '__tests__/') WHEN 'java' THEN contains(path, 'src/test/') OR regexp_matches(n, '(Test|Tests|IT)\\.java$') ELSE false END AS is_test FROM (SELECT *, CASE WHEN lower(e) = 'py' THEN 'python' WHEN lower(e) IN ('ts', 'mts', 'cts') THEN 'typescript' WHEN lower(e) IN ('tsx', 'jsx', 'js', 'mjs', 'cjs') THEN 'tsx' WHEN lower(e) = 'java' THEN 'java' WHEN e IN ('md', 'markdown') THEN 'markdown' ELSE 'text' END AS lang FROM (SELECT path, regexp_extract(path, '[^/]*$') AS n, regexp_extract(regexp_extract(path, '[^/]*$'), '[^.]\\.([^.]+)$', 1) AS e FROM (SELECT unnest(["
    + ", ".join(f"'{p}'" for p in _PATHS)
    + "]) AS path UNION ALL SELECT url FROM pages)))"
)
def fn_classify_path(spark, sf):
    paths = spark.createDataFrame([(p,) for p in _PATHS], "path string").union(A.table(spark, sf, "pages").select("url"))
    lang = T.language("path")
    return paths.select("path", T.basename("path").alias("name"), lang.alias("lang"), T.is_test_path("path", lang).alias("is_test"))


_QTOK = r"""SELECT item_id, [regexp_replace(t, '^[^\p{L}\p{N}/._]+|[^\p{L}\p{N}/._]+$', '', 'g') FOR t IN string_split_regex(text || ' see src/app.py, `Foo_bar` e.g. ok', '[ \t\n,;()`"'']')] AS toks FROM benchmark"""


@query(
    rf"""SELECT item_id, array_to_string([t FOR t IN toks IF strlen(t) >= 3 AND (contains(t, '/') OR (contains(t, '.') AND strlen(regexp_extract(t, '[^.]*$')) <= 4))], '|') AS paths,
    array_to_string([t FOR t IN toks IF strlen(t) >= 3 AND regexp_full_match(t, '[\p{{L}}\p{{N}}_]+') AND regexp_matches(t, '\p{{L}}')], '|') AS symbols FROM ({_QTOK})"""
)
def fn_query_tokens(spark, sf):
    q = A.table(spark, sf, "benchmark").withColumn("q", F.concat("text", F.lit(" see src/app.py, `Foo_bar` e.g. ok")))
    paths, symbols = T.query_tokens("q")
    return q.select("item_id", F.array_join(paths, "|").alias("paths"), F.array_join(symbols, "|").alias("symbols"))


@query(r"SELECT item_id, array_to_string([t FOR t IN regexp_extract_all(text, '[\p{L}\p{N}_]+') IF strlen(t) >= 2], '|') AS terms FROM benchmark")
def fn_search_terms(spark, sf):
    return A.table(spark, sf, "benchmark").select("item_id", F.array_join(T.search_terms("text"), "|").alias("terms"))


@query(
    r"SELECT doc_id, list_contains(regexp_extract_all(text, '[\p{L}\p{N}_]+'), w) AS found FROM documents, LATERAL (SELECT CASE lang WHEN 'en' THEN 'the' WHEN 'de' THEN 'die' WHEN 'fr' THEN 'les' ELSE 'que' END AS w)"
)
def fn_contains_word(spark, sf):
    w = F.when(F.col("lang") == "en", "the").when(F.col("lang") == "de", "die").when(F.col("lang") == "fr", "les").otherwise("que")
    return A.table(spark, sf, "documents").select("doc_id", T.contains_word("text", w).alias("found"))


@query(r"SELECT page_id, trim(regexp_replace(html, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS flat, array_to_string(string_split(html, chr(10))[1:4], chr(10)) AS head FROM pages")
def fn_snippets(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", T.collapse("html").alias("flat"), T.first_lines("html", 4).alias("head"))


@query(
    """WITH s AS (SELECT DISTINCT source || '/' || lang AS dir, CASE doc_id % 5 WHEN 0 THEN './d' WHEN 1 THEN '../d' WHEN 2 THEN '../../d' WHEN 3 THEN '../../../d' ELSE './x/../d' END || doc_id % 97 AS spec FROM documents)
    SELECT dir, spec, CASE WHEN starts_with(spec, '../../') THEN '' WHEN starts_with(spec, '../') THEN regexp_extract(dir, '^[^/]*') || '/' ELSE dir || '/' END || regexp_extract(spec, '[^/]*$') AS joined FROM s WHERE dir IS NOT NULL"""
)
def fn_join_relative(spark, sf):
    """Relative specifiers from every document's directory, up to beyond its top."""
    k = F.col("doc_id") % 5
    up = F.when(k == 0, "./d").when(k == 1, "../d").when(k == 2, "../../d").when(k == 3, "../../../d").otherwise("./x/../d")
    rows = A.table(spark, sf, "documents").select(F.concat("source", F.lit("/"), "lang").alias("dir"), F.concat(up, (F.col("doc_id") % 97).cast("string")).alias("spec")).where("dir is not null").distinct()
    return rows.withColumn("joined", T.join_relative(F.col("dir"), F.col("spec")))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') || ' UTC' AS minute, round(value, 2) AS value2 FROM events")
def fn_utc_minute(spark, sf):
    return A.table(spark, sf, "events").select("event_id", T.utc_minute(F.unix_timestamp("ts")).alias("minute"), F.round("value", 2).alias("value2"))


# --- markdown -----------------------------------------------------------------------------------------------------

_MD = "SELECT conv_id, string_agg('# ' || role || chr(10) || text, chr(10) ORDER BY turn) || chr(10) AS md FROM conversations GROUP BY conv_id"


def _markdown(spark, sf):
    c = A.table(spark, sf, "conversations")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("# "), "role", F.lit("\n"), "text").alias("t")))).alias("x"))
    return rows.select("conv_id", F.concat(F.array_join(F.transform("x", lambda i: i["t"]), "\n"), F.lit("\n")).alias("md"))


@query(
    rf"""WITH l AS (SELECT conv_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS pos, len(string_split(md, chr(10))) AS n FROM ({_MD})),
    k AS (SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS sec FROM l WHERE pos < n)
    SELECT conv_id, coalesce(trim(ltrim(any_value(line) FILTER (starts_with(line, '#')), '#'), ' '), '') AS heading, min(pos)::BIGINT AS line_start, max(pos)::BIGINT AS line_end, string_agg(line, chr(10) ORDER BY pos) || chr(10) AS body
    FROM k GROUP BY conv_id, sec HAVING strlen(string_agg(line, chr(10) ORDER BY pos)) + 1 >= 30"""
)
def tg_markdown_sections(spark, sf):
    return sections.markdown_sections(_markdown(spark, sf), "conv_id", "md").drop("section")


# --- lookups ------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {A.EDGES_SQL}, {A.NODES_SQL}, deg AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
    m AS (SELECT n.id, n.symbol, coalesce(d.n, 0)::DOUBLE AS c FROM nodes n LEFT JOIN deg d USING (id) WHERE starts_with(n.id, 'p')),
    w AS (SELECT 'Part#' || p_partkey AS name FROM part UNION SELECT p_brand || '.Part#' || p_partkey FROM part)
    SELECT name, id, nth FROM (SELECT w.name, m.id, row_number() OVER (PARTITION BY w.name ORDER BY m.c DESC, m.id) AS nth FROM w JOIN m ON m.symbol = w.name OR split_part(m.symbol, '.', 2) = w.name) WHERE nth <= 3"""
)
def fl_symbol_lookup(spark, sf):
    deg = G.degrees(G.max_weight(A.graph_edges(spark, sf)))
    chunks = A.graph_nodes(spark, sf).where(F.col("id").startswith("p")).join(deg, "id", "left").withColumn("centrality", F.coalesce("degree", F.lit(0)).cast("double"))
    p = A.table(spark, sf, "part")
    names = p.select(F.concat(F.lit("Part#"), "p_partkey").alias("name")).union(p.select(F.concat("p_brand", F.lit(".Part#"), "p_partkey").alias("name"))).distinct()
    return pack.symbol_hits(chunks, names, 3).select("name", "id", *_long("nth"))


@query(
    """WITH f AS (SELECT source || '/' || lang || '/' || (doc_id % 50) || '.txt' AS path FROM documents GROUP BY 1), s AS (SELECT DISTINCT lang || '/' || (doc_id % 50) || '.txt' AS suffix FROM documents WHERE doc_id IS NOT NULL)
    SELECT suffix, path, nth FROM (SELECT suffix, path, row_number() OVER (PARTITION BY suffix ORDER BY length(path), path) AS nth FROM s JOIN f ON path = suffix OR ends_with(path, '/' || suffix)) WHERE nth <= 3"""
)
def fl_path_suffix(spark, sf):
    d = A.table(spark, sf, "documents")
    tail = F.concat("lang", F.lit("/"), (F.col("doc_id") % 50).cast("string"), F.lit(".txt"))
    files = d.select(F.concat("source", F.lit("/"), tail).alias("path")).distinct()
    return G.paths_matching(files, d.where("doc_id is not null").select(tail.alias("suffix")), 3).select("suffix", "path", *_long("nth"))


@query(
    """WITH w AS (SELECT event_id AS pos, 'd' || lpad(CAST(user_id * 7 % 1500 AS VARCHAR), 12, '0') AS id FROM events)
    SELECT pos, w.id, sha256(text) AS content_sha FROM w JOIN documents ON 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0') = w.id"""
)
def get_content(spark, sf):
    """Contents by id in the order asked, an id for every event; some ask for what isn't there, many for the same."""
    wanted = A.table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("d"), F.lpad((F.col("user_id") * 7 % 1500).cast("string"), 12, "0")).alias("id"))
    return wanted.join(A.doc_nodes(spark, sf).where("kind = 2").select("id", F.sha2("content", 256).alias("content_sha")), "id").select("pos", "id", "content_sha")


# --- edges --------------------------------------------------------------------------------------------------------


@query(f"WITH {A.EDGES_SQL} SELECT src, kind, dst, weight FROM edges")
def jn_edges_build(spark, sf):
    return G.max_weight(A.graph_edges(spark, sf))


_ENTRIES = "entries AS (SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS path, 'Mod.name' || (c_custkey % 400) AS symbol FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'Mod.name' || (s_suppkey * 7 % 1000) FROM supplier)"
_REFS = "refs AS (SELECT DISTINCT 'o' || o_orderkey AS chunk, 'n' || (o_orderkey % 25) AS path, 'name' || (o_custkey % 1000) AS name, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 4 END AS kind, o_orderkey % 2 = 0 AS is_test FROM orders)"
_RESOLVED = f"""{_ENTRIES}, {_REFS}, local AS (SELECT split_part(symbol, '.', 2) AS name, path, min(id) AS lid FROM entries GROUP BY ALL), alone AS (SELECT split_part(symbol, '.', 2) AS name, min(id) AS oid FROM entries GROUP BY 1 HAVING count(*) = 1),
  found AS (SELECT refs.*, coalesce(lid, oid) AS target, CASE WHEN lid IS NOT NULL THEN 1.0 ELSE 0.6 END AS weight FROM refs LEFT JOIN local USING (name, path) LEFT JOIN alone USING (name) WHERE coalesce(lid, oid) IS NOT NULL)"""


def _names(spark, sf):
    c, s, o = (A.table(spark, sf, t) for t in ("customer", "supplier", "orders"))
    entries = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("path"), F.concat(F.lit("Mod.name"), F.col("c_custkey") % 400).alias("symbol")).union(
        s.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("Mod.name"), F.col("s_suppkey") * 7 % 1000))
    )
    k = F.col("o_orderkey") % 3
    refs = o.select(F.concat(F.lit("o"), "o_orderkey").alias("chunk"), F.concat(F.lit("n"), F.col("o_orderkey") % 25).alias("path"), F.concat(F.lit("name"), F.col("o_custkey") % 1000).alias("name"), F.when(k == 0, 2).when(k == 1, 3).otherwise(4).alias("kind"), (F.col("o_orderkey") % 2 == 0).alias("is_test")).distinct()
    return refs, entries


@query(f"WITH {_RESOLVED} SELECT chunk, name, target, weight FROM found")
def jn_symbol_resolution(spark, sf):
    return G.resolve_names(*_names(spark, sf)).select("chunk", "name", "target", F.col("weight"))


@query(f"WITH {_RESOLVED} SELECT src, kind, dst, max(weight) AS weight FROM (SELECT chunk AS src, kind, target AS dst, weight FROM found UNION ALL SELECT target, 5, chunk, 0.8 FROM found WHERE is_test AND kind = 2) GROUP BY ALL")
def jn_tested_by(spark, sf):
    return G.reference_edges(*_names(spark, sf))


_TREE = """files AS (
      SELECT 'py/b' || p_size || '/m' || p_partkey || '.py' AS path FROM part UNION SELECT 'py/pkg' || p_size || '/__init__.py' FROM part
      UNION SELECT 'web/s' || p_size || '/c' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.js' END FROM part UNION SELECT 'j/com/a' || p_size || '/K' || (p_partkey // 2) || '.java' FROM part),
    asks AS (SELECT DISTINCT l_partkey AS k, p_size AS z, l_linenumber AS n FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(
    f"""WITH {_TREE}, asked AS (
      SELECT 'py/b' || z || '/from' || n || '.py' AS path, CASE n % 3 WHEN 0 THEN 'b' || z || '.m' || k WHEN 1 THEN '.m' || k ELSE 'pkg' || z END AS module, CASE n % 3 WHEN 2 THEN 'py/pkg' || z || '/__init__.py' ELSE 'py/b' || z || '/m' || k || '.py' END AS target FROM asks
      UNION SELECT 'web/s' || z || '/from' || n || '.ts', './c' || k, 'web/s' || z || '/c' || k || CASE k % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.js' END FROM asks
      UNION SELECT 'j/from' || n || '.java', 'com.a' || z || '.K' || (k // 2), 'j/com/a' || z || '/K' || (k // 2) || '.java' FROM asks
      UNION SELECT 'j/other' || n || '.java', 'org.x.K' || (k // 2), f.path FROM asks JOIN files f ON regexp_extract(f.path, '[^/]*$') = 'K' || (k // 2) || '.java' WHERE (SELECT count(*) FROM files g WHERE regexp_extract(g.path, '[^/]*$') = 'K' || (k // 2) || '.java') = 1)
    SELECT path, module, target FROM asked"""
)
def jn_import_resolution(spark, sf):
    """Imports of every part that orders name, in three languages, from a tree with a file or two for each part; nothing is found for a Java class of two packages by its name alone."""
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("string").alias("z"))
    k, z = F.col("k"), F.col("z")
    klass = F.concat(F.lit("K"), F.floor(k / 2).cast("string"))
    end = F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".tsx").otherwise("/index.js")
    paths = (F.concat(F.lit("py/b"), z, F.lit("/m"), k, F.lit(".py")), F.concat(F.lit("py/pkg"), z, F.lit("/__init__.py")), F.concat(F.lit("web/s"), z, F.lit("/c"), k, end), F.concat(F.lit("j/com/a"), z, F.lit("/"), klass, F.lit(".java")))
    files = p.select(F.explode(F.array(*paths)).alias("path")).distinct()
    asks = A.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("n")).distinct().join(p.hint("merge"), "k")
    n = F.col("n").cast("string")
    ask = lambda path, module, lang: F.struct(path.alias("path"), module.alias("module"), F.lit(lang).alias("lang"))
    module = F.when(F.col("n") % 3 == 0, F.concat(F.lit("b"), z, F.lit(".m"), k)).when(F.col("n") % 3 == 1, F.concat(F.lit(".m"), k)).otherwise(F.concat(F.lit("pkg"), z))
    each = F.array(
        ask(F.concat(F.lit("py/b"), z, F.lit("/from"), n, F.lit(".py")), module, "python"), ask(F.concat(F.lit("web/s"), z, F.lit("/from"), n, F.lit(".ts")), F.concat(F.lit("./c"), k), "typescript"),
        ask(F.concat(F.lit("j/from"), n, F.lit(".java")), F.concat(F.lit("com.a"), z, F.lit("."), klass), "java"), ask(F.concat(F.lit("j/other"), n, F.lit(".java")), F.concat(F.lit("org.x."), klass), "java"),
    )
    return G.resolve_imports(asks.select(F.explode(each).alias("i")).select("i.*"), files)


_NAMED = r"named AS (SELECT name, min(id) AS id FROM (SELECT 'i' || item_id AS id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS name FROM benchmark) WHERE strlen(name) >= 4 GROUP BY name)"


@query(
    rf"""WITH {_NAMED}, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS name FROM documents)
    SELECT id AS src, 6 AS kind, 'd' || doc_id AS dst, 0.7::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS k FROM t JOIN named USING (name)) WHERE k <= 8"""
)
def jn_doc_mentions(spark, sf):
    b = A.table(spark, sf, "benchmark").select(F.concat(F.lit("i"), "item_id").alias("id"), F.explode(T.words("text")).alias("symbol"))
    docs = A.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("content"))
    return G.doc_mentions(docs, b)


@query(
    r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM benchmark),
    named AS (SELECT name, min(id) AS id FROM (SELECT 'i' || item_id AS id, '$' || w AS name FROM w UNION ALL SELECT 'j' || item_id, '-> ' || w FROM w) WHERE strlen(name) >= 4 GROUP BY name),
    t AS (SELECT DISTINCT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN regexp_extract_all(replace(text, ' ', ' $'), '\$[\p{L}\p{N}_]+') ELSE regexp_extract_all(replace(text, ' ', ' -> '), '-> [\p{L}\p{N}_]+') END) AS name FROM documents)
    SELECT id AS src, 6 AS kind, 'd' || doc_id AS dst, 0.7::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS k FROM t JOIN named USING (name)) WHERE k <= 8"""
)
def jn_doc_mentions_any_name(spark, sf):
    """Names with signs in them: every word of the items as $word and as -> word."""
    w = A.table(spark, sf, "benchmark").select("item_id", F.explode(T.words("text")).alias("w"))
    names = w.select(F.concat(F.lit("i"), "item_id").alias("id"), F.concat(F.lit("$"), "w").alias("symbol")).union(w.select(F.concat(F.lit("j"), "item_id"), F.concat(F.lit("-> "), "w")))
    content = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit(" $"))).otherwise(F.replace("text", F.lit(" "), F.lit(" -> ")))
    return G.doc_mentions(A.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), content.alias("content")), names)


# --- degree, hot set ----------------------------------------------------------------------------------------------

_DEG = f"WITH {A.EDGES_SQL}, deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"


@query(f"{_DEG} SELECT id, degree FROM deg")
def ag_degree(spark, sf):
    return G.degrees(G.max_weight(A.graph_edges(spark, sf)))


@query(f"{_DEG} SELECT id, degree, round(degree / (SELECT max(degree) FROM deg), 6) AS centrality FROM deg")
def ag_centrality(spark, sf):
    return G.centrality(G.max_weight(A.graph_edges(spark, sf))).withColumn("centrality", F.round("centrality", 6))


def _kept_ranks(spark, sf):
    """Ranks of calls and of imports that point the wrong way round, then changed: those imports go, all other edges come."""
    edges = G.stored(G.max_weight(A.graph_edges(spark, sf)))
    ends = lambda e: e.select("src", "dst")
    wrong = edges.where(F.col("kind") == S.IMPORTS).select(F.col("dst").alias("src"), F.concat(F.lit("old:"), "src").alias("dst"))
    calls = F.col("kind") == S.CALLS
    return ranks.changed(ranks.from_edges(ends(edges.where(calls)).unionByName(wrong)), ends(edges.where(~calls)), wrong)


@query(f"{_DEG} SELECT id, degree, round(degree / (SELECT max(degree) FROM deg), 6) AS centrality FROM deg")
def ag_centrality_kept(spark, sf):
    return ranks.centrality(_kept_ranks(spark, sf)).withColumn("centrality", F.round("centrality", 6))


@query(f"{_DEG} SELECT id, degree, round(degree / (SELECT max(degree) FROM deg), 6) AS centrality FROM deg ORDER BY degree DESC, id LIMIT 200")
def so_most_central(spark, sf):
    return ranks.most_central(_kept_ranks(spark, sf)).withColumn("centrality", F.round("centrality", 6))


@query(
    f"""WITH RECURSIVE {A.DOC_NODES_SQL}, top AS (SELECT id, row_number() OVER (ORDER BY centrality DESC, tokens, id) AS k, 's' || substr(id, 2) AS member FROM chunks WHERE centrality > 0 QUALIFY k <= 200),
    fold(k, used, ids) AS (SELECT 0::BIGINT, 0::BIGINT, []::VARCHAR[] UNION ALL SELECT t.k, CASE WHEN used + 12 <= 600 AND len(ids) < 64 THEN used + 12 ELSE used END, CASE WHEN used + 12 <= 600 AND len(ids) < 64 THEN list_append(ids, t.member) ELSE ids END FROM fold f JOIN top t ON t.k = f.k + 1)
    SELECT node_id, row_number() OVER (ORDER BY node_id) AS position FROM (SELECT unnest(ids) AS node_id FROM (SELECT ids FROM fold ORDER BY k DESC LIMIT 1))"""
)
def hot_set(spark, sf):
    return hotset.hot_members(A.doc_nodes(spark, sf), cap=600)


# --- search -------------------------------------------------------------------------------------------------------

FOLD = f"translate(lower({{}}), '{search.ACCENTED}', '{search.PLAIN}')"
_BM25 = rf"""docterms AS (SELECT doc_id, unnest(regexp_extract_all({FOLD.format("text")}, '[\p{{L}}\p{{N}}_]+')) AS term FROM documents WHERE text IS NOT NULL),
  tf AS (SELECT term, doc_id, count(*) AS tf FROM docterms GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
  q AS (SELECT item_id, text AS query FROM benchmark),
  qt AS (SELECT item_id, term, count(*) AS mult FROM (SELECT item_id, {FOLD.format("t")} AS term FROM (SELECT item_id, unnest([t FOR t IN regexp_extract_all(query, '[\p{{L}}\p{{N}}_]+') IF strlen(t) >= 2]) AS t FROM q)) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  w AS (SELECT item_id, term, mult, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf, avgdl FROM qt JOIN df USING (term), st),
  ranked AS (SELECT item_id, doc_id, round(sum(mult * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM w JOIN tf USING (term) JOIN dl USING (doc_id) GROUP BY ALL),
  top AS (SELECT item_id, doc_id, score, k - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM ranked) WHERE k <= 32)"""


def _ranked(spark, sf):
    docs = A.table(spark, sf, "documents").where("text is not null")
    queries = A.query_requests(spark, sf).select(F.col("request_id").cast("long").alias("query_id"), "query")
    return search.positional(postings.top_hits(postings.build(docs, "doc_id", "text"), queries, S.SEARCH_HITS), S.SEARCH_HITS)


@query(f"WITH {_BM25} SELECT item_id AS query_id, doc_id AS id, score FROM top")
def search_bm25(spark, sf):
    return _ranked(spark, sf).select("query_id", "id", "score")


@query(f"WITH {_BM25} SELECT item_id AS query_id, doc_id AS id, rank, round(1 - rank / count(*) OVER (PARTITION BY item_id), 6) AS position_score FROM top")
def search_positional(spark, sf):
    return _ranked(spark, sf).select("query_id", "id", *_long("rank"), F.round("position_score", 6).alias("position_score"))


# --- candidates, walk, scores -------------------------------------------------------------------------------------

_HITS = "hits AS (SELECT o_custkey % 20 AS request_id, 'p' || (o_orderkey % 200) AS id, CASE o_orderkey % 4 WHEN 3 THEN 'search_hit' ELSE 'anchor' END AS reason, 'via ' || (o_orderkey % 11) AS detail, round((o_orderkey % 100) / 100, 2) AS text_score, o_orderkey % 4 AS priority FROM orders)"


@query(f"WITH {_HITS} SELECT request_id, id, reason, detail, text_score FROM (SELECT *, row_number() OVER (PARTITION BY request_id, id ORDER BY priority, text_score DESC, detail) AS k FROM hits) WHERE k = 1")
def gather_candidates(spark, sf):
    k = F.col("o_orderkey")
    hits = A.table(spark, sf, "orders").select((F.col("o_custkey") % 20).alias("request_id"), F.concat(F.lit("p"), k % 200).alias("id"), F.when(k % 4 == 3, "search_hit").otherwise("anchor").alias("reason"), F.concat(F.lit("via "), k % 11).alias("detail"), F.round(k % 100 / 100, 2).alias("text_score"), (k % 4).alias("priority"), F.lit(0).alias("hops"))
    return pack.precedence(hits).drop("hops")


_PRIOR = "CASE WHEN reason IN ('calls', 'called_by', 'tested_by') THEN 0.8 WHEN reason IN ('inherits', 'imports', 'imported_by') THEN 0.6 WHEN reason = 'doc_mention' THEN 0.4 ELSE 0.5 END"
_STEP = "(SELECT src AS source, dst AS id, kind, false AS reverse, CASE kind WHEN 1 THEN 'imports' WHEN 2 THEN 'calls' ELSE 'inherits' END AS reason FROM edges UNION ALL SELECT dst, src, kind, true, CASE kind WHEN 1 THEN 'imported_by' WHEN 2 THEN 'called_by' ELSE 'inherits' END FROM edges)"


def _hop(n: int, frontier: str, known: str) -> str:
    return f"""h{n} AS (SELECT id, {n} AS hops, reason, source FROM (SELECT s.*, row_number() OVER (PARTITION BY s.id ORDER BY -({_PRIOR.replace('reason', 's.reason')}), kind, reverse, s.source) AS k FROM steps s JOIN {frontier} f ON f.id = s.source JOIN nodes v ON v.id = s.id AND v.valid WHERE s.id NOT IN (SELECT id FROM {known})) WHERE k = 1)"""


@query(
    f"""WITH {A.EDGES_SQL}, {A.NODES_SQL}, steps AS (SELECT * FROM {_STEP}), seeds AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_partkey % 100 = 0), {_hop(1, "seeds", "seeds")}, seen AS (SELECT id FROM seeds UNION SELECT id FROM h1), {_hop(2, "h1", "seen")}
    SELECT id, hops, reason, source FROM h1 UNION ALL SELECT id, hops, reason, source FROM h2"""
)
def graph_walk_2hop(spark, sf):
    seeds = A.table(spark, sf, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return G.walk(seeds, A.graph_edges(spark, sf), A.graph_nodes(spark, sf).where("valid"), pack.default_prior)


def _profiles_sql() -> str:
    cols = ["mode", "w_text", "w_hop", "w_edge_prior", "w_centrality", "w_role", "anchor", "calls", "tested_by", "structure", "doc", "other", "role_test", "role_code", "bonus"]
    rows = ", ".join("(" + ", ".join(f"'{p[c]}'" if c == "mode" else f"{p[c]}::DOUBLE" for c in cols) + ")" for p in map(S.profile, S.MODES))
    return f"profiles({', '.join(cols)}) AS (VALUES {rows})"


_CANDS = "cands AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'anchor' WHEN 1 THEN 'calls' WHEN 2 THEN 'called_by' WHEN 3 THEN 'tested_by' WHEN 4 THEN 'inherits' WHEN 5 THEN 'imports' WHEN 6 THEN 'doc_mention' ELSE 'search_hit' END AS reason, doc_id % 3 AS hops, round((doc_id % 33) / 33, 2) AS text_score, (doc_id % 10) / 10 AS centrality, CASE WHEN doc_id % 7 = 0 THEN 'test' ELSE '' END AS role, CASE WHEN doc_id % 5 = 0 THEN 'src/auth/' || doc_id ELSE 'src/' || doc_id END AS path, CASE WHEN doc_id % 9 = 0 THEN 'ValidToken' ELSE NULL END AS symbol FROM documents)"
_SCORED = f"""{_CANDS}, {_profiles_sql()}, scored AS (SELECT mode, doc_id, reason, keyword, round(w_text * CASE reason WHEN 'search_hit' THEN text_score WHEN 'anchor' THEN 1 ELSE 0 END + w_hop * CASE hops WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.35 END
   + w_edge_prior * CASE WHEN reason = 'anchor' THEN anchor WHEN reason IN ('calls', 'called_by') THEN calls WHEN reason = 'tested_by' THEN tested_by WHEN reason IN ('inherits', 'imports') THEN structure WHEN reason = 'doc_mention' THEN doc ELSE other END
   + w_centrality * centrality + w_role * CASE role WHEN 'test' THEN role_test ELSE role_code END + CASE WHEN keyword IS NULL THEN 0 ELSE bonus END, 6) AS score
   FROM (SELECT c.*, p.*, CASE WHEN mode <> 'security' THEN NULL WHEN contains(path, 'auth') THEN 'auth' WHEN symbol IS NOT NULL THEN 'token' END AS keyword FROM cands c, profiles p))"""


def _scored(spark, sf, threshold=0.0):
    k = F.col("doc_id")
    reason = F.element_at(F.array(*map(F.lit, ["anchor", "calls", "called_by", "tested_by", "inherits", "imports", "doc_mention", "search_hit"])), (k % 8 + 1).cast("int"))
    c = A.table(spark, sf, "documents").select("doc_id", reason.alias("reason"), (k % 3).alias("hops"), F.round(k % 33 / 33, 2).alias("text_score"), (k % 10 / 10).alias("centrality"), F.when(k % 7 == 0, "test").otherwise("").alias("role"), F.concat(F.when(k % 5 == 0, "src/auth/").otherwise("src/"), k).alias("path"), F.when(k % 9 == 0, "ValidToken").alias("symbol"))
    return pack.scored(c.crossJoin(F.broadcast(pack.profiles(spark, threshold=threshold))))  # seven profiles


@query(f"WITH {_SCORED} SELECT mode, doc_id, reason, keyword, score FROM scored")
def score_modes(spark, sf):
    return _scored(spark, sf).select("mode", "doc_id", "reason", "keyword", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED} SELECT mode, doc_id, reason, score FROM scored WHERE reason = 'anchor' OR score >= 0.55")
def threshold_prune(spark, sf):
    return pack.pruned(_scored(spark, sf, 0.55)).select("mode", "doc_id", "reason", F.round("score", 6).alias("score"))


# --- selection ----------------------------------------------------------------------------------------------------

_PARTS = "parts AS (SELECT p_brand AS request_id, 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, p_size::BIGINT AS tokens, round(p_retailprice / 1000, 6) AS score, 'f' || (p_partkey % 97) AS path, (p_partkey % 5) * 10 AS byte_start, (p_partkey % 5) * 10 + p_size AS byte_end, CASE WHEN p_partkey % 11 = 0 THEN 'anchor' ELSE 'calls' END AS reason, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 's' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') END AS sig_id, 2::BIGINT AS sig_tokens FROM part)"


def _parts(spark, sf):
    """Parts as candidates; a request has all those of a brand."""
    k = F.col("p_partkey")
    pad = F.lpad(k.cast("string"), 9, "0")
    p = A.table(spark, sf, "part")
    return p.select(
        F.col("p_brand").alias("request_id"), F.concat(F.lit("p"), pad).alias("id"), F.lit(2).alias("kind"), F.col("p_size").cast("long").alias("tokens"), F.round(F.col("p_retailprice") / 1000, 6).alias("score"), F.concat(F.lit("f"), k % 97).alias("path"),
        (k % 5 * 10).alias("byte_start"), (k % 5 * 10 + F.col("p_size")).alias("byte_end"), F.when(k % 11 == 0, "anchor").otherwise("calls").alias("reason"), F.lit("").alias("detail"), F.when(k % 3 != 0, F.concat(F.lit("s"), pad)).alias("sig_id"), F.lit(2).cast("long").alias("sig_tokens"),
    )


def _fold_sql(overlap: bool, substitute: bool, budget: int) -> str:
    over = "len([r FOR r IN ranges IF r.path = p.path AND p.byte_start < r.e AND r.s < p.byte_end]) > 0" if overlap else "false"
    small = f"(p.reason <> 'anchor' AND p.sig_id IS NOT NULL AND used + p.sig_tokens <= {budget})" if substitute else "false"
    return f"""WITH RECURSIVE {_PARTS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY -round(score / greatest(tokens, 1), 12), id) AS k FROM parts),
    fold AS (SELECT DISTINCT request_id, 0::BIGINT AS k, 0::BIGINT AS used, []::STRUCT(path VARCHAR, s BIGINT, e BIGINT)[] AS ranges, NULL::VARCHAR AS id, false AS substituted FROM parts
      UNION ALL SELECT f.request_id, p.k,
        CASE WHEN {over} THEN used WHEN used + p.tokens <= {budget} THEN used + p.tokens WHEN {small} THEN used + p.sig_tokens ELSE used END,
        CASE WHEN {over} THEN ranges WHEN used + p.tokens <= {budget} THEN list_append(ranges, {{'path': p.path, 's': p.byte_start::BIGINT, 'e': p.byte_end::BIGINT}}) ELSE ranges END,
        CASE WHEN {over} THEN NULL WHEN used + p.tokens <= {budget} THEN p.id WHEN {small} THEN p.sig_id END,
        NOT ({over}) AND used + p.tokens > {budget} AND {small}
      FROM fold f JOIN ordered p ON p.request_id = f.request_id AND p.k = f.k + 1)
    SELECT request_id, id, substituted, used FROM fold WHERE id IS NOT NULL"""


def _selected(spark, sf, overlap: bool, substitute: bool, budget: int):
    c = _parts(spark, sf)
    if not overlap:
        c = c.withColumns({"path": F.lit(""), "byte_start": F.lit(0), "byte_end": F.lit(0)})  # empty ranges overlap nothing
    if not substitute:
        c = c.withColumn("sig_id", F.lit(None).cast("string"))
    budgets = c.select("request_id").distinct().withColumn("token_budget", F.lit(budget).cast("long"))
    return pack.select_budget(c, budgets).select("request_id", "id", "substituted", "used")


@query(_fold_sql(False, False, 60))
def select_budget(spark, sf):
    return _selected(spark, sf, False, False, 60)


@query(_fold_sql(False, True, 60))
def select_budget_substitution(spark, sf):
    return _selected(spark, sf, False, True, 60)


@query(_fold_sql(True, True, 90))
def select_overlap(spark, sf):
    return _selected(spark, sf, True, True, 90)


@query(
    f"WITH {A.DOC_NODES_SQL}, hot AS (SELECT id AS node_id, row_number() OVER (ORDER BY id) AS position FROM chunks WHERE right(id, 2) = '07' ORDER BY id LIMIT 40), x AS (SELECT lang AS request_id, id, hash, position FROM chunks LEFT JOIN hot ON id = node_id) SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY position NULLS LAST, hash, id) AS ord, position IS NOT NULL AS stable FROM x"
)
def stable_order(spark, sf):
    n = A.doc_nodes(spark, sf).where("kind = 2")
    hot = n.where(F.col("id").endswith("07")).orderBy("id").limit(40)
    hot = hot.select(F.col("id").alias("node_id"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")).alias("position"))  # 40 rows
    return pack.stable_order(n.select(F.col("lang").alias("request_id"), "id", "hash"), hot, ranges=64).select("request_id", "id", *_long("ord"), F.col("hot_position").isNotNull().alias("stable"))


_ITEMS = "items AS (SELECT least(o_custkey % 50, 48) AS request_id, 'src/' || (o_orderkey % 300) AS path, floor(o_totalprice / 100)::BIGINT AS tokens, CASE CASE WHEN o_custkey % 50 > 5 THEN o_orderkey % 5 ELSE 1 + o_orderkey % 2 END WHEN 0 THEN 'anchor' WHEN 1 THEN 'search_hit' WHEN 2 THEN 'calls' WHEN 3 THEN 'tested_by' ELSE 'doc_mention' END AS reason, CASE WHEN o_custkey % 50 < 20 THEN 'signature' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'ast_chunk' WHEN 1 THEN 'doc_chunk' WHEN 2 THEN 'test' ELSE 'file' END END AS type, round((o_orderkey % 89) / 89, 4) AS score FROM orders)"


def _items(spark, sf):
    k, r = F.col("o_orderkey"), F.least(F.col("o_custkey") % 50, F.lit(48))
    reason = F.element_at(F.array(*map(F.lit, ["anchor", "search_hit", "calls", "tested_by", "doc_mention"])), F.when(r > 5, k % 5 + 1).otherwise(k % 2 + 2).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ["ast_chunk", "doc_chunk", "test", "file"])), (k % 4 + 1).cast("int"))
    o = A.table(spark, sf, "orders")
    return o.select(r.alias("request_id"), F.concat(F.lit("src/"), k % 300).alias("path"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("tokens"), reason.alias("reason"), F.when(r < 20, "signature").otherwise(kind).alias("type"), F.round(k % 89 / 89, 4).alias("score"))


_FILES = "ft AS (SELECT 'src/' || p_partkey AS path, CASE WHEN p_size <> 7 THEN p_size::BIGINT * 10000 END AS file_tokens FROM part)"


@query(
    f"WITH {_ITEMS}, {_FILES}, b AS (SELECT request_id, path, sum(tokens) AS t, any_value(file_tokens) AS f FROM items LEFT JOIN ft USING (path) GROUP BY ALL), t AS (SELECT request_id, sum(t)::BIGINT AS selected_tokens, sum(coalesce(f, t))::BIGINT AS raw_tokens FROM b GROUP BY 1) SELECT *, greatest(raw_tokens - selected_tokens, 0) AS saved_tokens, CASE WHEN raw_tokens > 0 THEN round(greatest(raw_tokens - selected_tokens, 0) * 10000.0::DOUBLE / raw_tokens) / 100 ELSE 0 END AS saved_pct FROM t"
)
def pack_totals(spark, sf):
    files = A.table(spark, sf, "part").select(F.concat(F.lit("src/"), "p_partkey").alias("path"), F.when(F.col("p_size") != 7, F.col("p_size").cast("long") * 10000).alias("file_tokens"))
    return pack.totals(_items(spark, sf), files)


@query(f"WITH {_ITEMS} SELECT request_id, reason, count(*) AS items, sum(tokens)::BIGINT AS tokens, count(DISTINCT path) AS files FROM items GROUP BY ALL")
def pack_coverage(spark, sf):
    return report.coverage(_items(spark, sf))


@query(
    f"""WITH {_ITEMS}, r AS (SELECT i AS request_id, i % 4 AS stale_files FROM generate_series(0, 49) t(i)),
    f AS (SELECT request_id, bool_or(type = 'ast_chunk' AND reason IN ('anchor', 'search_hit')) AS has_direct, bool_or(type = 'test' OR reason = 'tested_by') AS has_tests, bool_or(reason IN ('calls', 'called_by')) AS has_callers, bool_or(type = 'doc_chunk') AS has_docs, count(*) FILTER (type = 'signature') AS substituted FROM items GROUP BY 1),
    x AS (SELECT request_id, stale_files, coalesce(has_direct, false) AS has_direct, coalesce(has_tests, false) AS has_tests, coalesce(has_callers, false) AS has_callers, coalesce(has_docs, false) AS has_docs, coalesce(substituted, 0) AS substituted FROM r LEFT JOIN f USING (request_id)),
    y AS (SELECT *, (stale_files > 0)::INT + (NOT has_direct)::INT + (NOT has_tests)::INT + (substituted > 0)::INT AS risks FROM x)
    SELECT *, CASE risks WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS level FROM y"""
)
def pack_risk(spark, sf):
    requests = spark.range(50).select(F.col("id").alias("request_id"), F.array_repeat(F.lit("x"), (F.col("id") % 4).cast("int")).alias("dirty_paths"))
    return report.risk(_items(spark, sf), requests).withColumn("stale_files", F.col("stale_files").cast("long"))


@query(
    f"""WITH {_ITEMS} SELECT request_id, count(*) AS items, count(DISTINCT path) AS paths, count(*) FILTER (type = 'ast_chunk') AS type_ast_chunk, count(*) FILTER (type = 'signature') AS type_signature, count(*) FILTER (type = 'doc_chunk') AS type_doc_chunk, count(*) FILTER (type = 'test') AS type_test,
    count(*) FILTER (reason = 'anchor') AS reason_anchor, count(*) FILTER (reason = 'search_hit') AS reason_search_hit, count(*) FILTER (reason NOT IN ('anchor', 'search_hit')) AS graph_items, round(avg(score), 4) AS avg_score, max(score) AS max_score FROM items GROUP BY 1"""
)
def pack_summary(spark, sf):
    return report.pack_summary(_items(spark, sf))


# --- rendering ----------------------------------------------------------------------------------------------------

_ENV = "'<loom:item id=\"' || substr(id, 1, 12) || '\" path=\"' || path || '\" kind=\"ast_chunk\" lines=\"1-9\" symbol=\"' || symbol || '\">' || chr(10) || content || '</loom:item>' || chr(10)"


@query(f"WITH {A.DOC_NODES_SQL} SELECT id, sha256({_ENV}) AS digest FROM chunks")
def render_envelope(spark, sf):
    n = A.doc_nodes(spark, sf).where("kind = 2")
    return n.select("id", F.sha2(T.envelope(F.col("id"), F.col("path"), F.lit("ast_chunk"), F.col("line_start"), F.col("line_end"), F.col("symbol"), F.col("content")), 256).alias("digest"))


_REND = f"""WITH {A.DOC_NODES_SQL}, i AS (SELECT lang || '/' || (id[2:]::BIGINT // 100) AS request_id, id, {_ENV} AS env, row_number() OVER (PARTITION BY request_id ORDER BY id) AS ord, right(id, 1) = '3' AS stable, tokens FROM chunks),
  b AS (SELECT request_id, coalesce(string_agg(env, '' ORDER BY ord) FILTER (stable), '') AS prefix, coalesce(string_agg(env, '' ORDER BY ord) FILTER (NOT stable), '') AS rest, coalesce(string_agg(id, '' ORDER BY ord) FILTER (stable), '') AS ids, sum(tokens)::BIGINT AS t FROM i GROUP BY 1)"""


def _rendered(spark, sf):
    n = A.doc_nodes(spark, sf).where("kind = 2")
    # packs of the documents of a language among 100 numbers: more documents are more packs, not longer ones
    n = n.withColumn("request_id", F.concat("lang", F.lit("/"), F.floor(F.substring("id", 2, 12).cast("long") / 100)))
    items = n.select("request_id", F.row_number().over(Window.partitionBy("request_id").orderBy("id")).alias("ord"), F.lit("ast_chunk").alias("type"), "path", "symbol", F.array("line_start", "line_end").alias("lines"), "tokens", F.col("id").alias("node"), "content", F.col("id").endswith("3").alias("stable"))
    totals = items.groupBy("request_id").agg(F.sum("tokens").alias("selected_tokens")).withColumns({"saved_pct": F.lit(12.5), "hot_set_version": F.lit(3)})
    return items, totals


@query(f"{_REND} SELECT request_id, '<!-- context pack ' || request_id || ' (' || t || ' tokens, saved 12.5%) -->' || chr(10) || prefix || rest AS text FROM b")
def render_plain(spark, sf):
    return render.render_plain(*_rendered(spark, sf))


@query(f"{_REND} SELECT request_id, substr(sha256(encode('loom-env-1') || '\\x00\\x00\\x00\\x00\\x00\\x00\\x00\\x03'::BLOB || encode(ids)), 1, 32) AS key, md5(prefix || rest) AS content FROM b")
def render_chat(spark, sf):
    chat = F.from_json("text", "messages array<struct<role:string,content:string>>, prompt_cache_key string")
    rows = render.render_chat(*_rendered(spark, sf)).withColumn("j", chat)
    return rows.select("request_id", F.substring("j.prompt_cache_key", 6, 32).alias("key"), F.md5(F.get("j.messages", 0)["content"]).alias("content"))


@query(f"{_REND} SELECT request_id, (prefix <> '')::INT + (rest <> '')::INT AS blocks, CASE WHEN prefix <> '' THEN '1h' END AS first_ttl, md5(prefix || rest) AS content FROM b")
def render_messages(spark, sf):
    j = F.from_json("text", "system array<struct<type:string,text:string,cache_control:struct<type:string,ttl:string>>>")
    rows = render.render_messages(_rendered(spark, sf)[0]).withColumn("s", j["system"])
    return rows.select("request_id", F.size("s").alias("blocks"), F.get("s", 0)["cache_control"]["ttl"].alias("first_ttl"), F.md5(F.array_join(F.transform("s", lambda b: b["text"]), "")).alias("content"))


# --- graph questions ----------------------------------------------------------------------------------------------

_GRAPH = f"WITH RECURSIVE {A.EDGES_SQL}, {A.NODES_SQL}"


def _graph(spark, sf):
    # by source, as the joins that follow need them
    return A.graph_nodes(spark, sf), G.max_weight(A.graph_edges(spark, sf).repartition("src"))


def _parts_by(spark, sf, step):
    """The query set: parts whose number is a multiple of ``step``."""
    return A.table(spark, sf, "part").where(F.col("p_partkey") % step == 0).select(F.concat(F.lit("p"), "p_partkey").alias("id"))


@query(f"{_GRAPH} SELECT dst AS id, src AS caller, path, symbol, weight AS confidence FROM edges JOIN nodes ON nodes.id = src AND valid WHERE kind = 2 AND starts_with(dst, 'p')")
def find_callers(spark, sf):
    nodes, edges = _graph(spark, sf)
    return lookup.callers(_parts_by(spark, sf, 1), nodes, edges)


@query(
    f"""{_GRAPH}, t AS (SELECT 'o' || o_orderkey AS id FROM orders)
    SELECT t.id, 'outgoing' AS direction, CASE kind WHEN 1 THEN 'imports' WHEN 2 THEN 'calls' ELSE 'inherits' END AS reason, dst AS other, path, symbol FROM t JOIN edges ON src = t.id JOIN nodes n ON n.id = dst AND valid
    UNION ALL SELECT t.id, 'incoming', CASE kind WHEN 1 THEN 'imported_by' WHEN 2 THEN 'called_by' ELSE 'inherits' END, src, path, symbol FROM t JOIN edges ON dst = t.id JOIN nodes n ON n.id = src AND valid"""
)
def explain_symbol(spark, sf):
    nodes, edges = _graph(spark, sf)
    targets = A.table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return lookup.explain(targets, nodes, edges)


@query(f"{_GRAPH} SELECT src AS id, dst AS test, path, symbol FROM edges JOIN nodes ON nodes.id = dst AND valid WHERE kind = 3 AND starts_with(src, 'o')")
def find_tests(spark, sf):
    nodes, edges = _graph(spark, sf)
    targets = A.table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    tests = edges.withColumn("kind", F.when(F.col("kind") == S.INHERITS, S.TESTED_BY).otherwise(F.col("kind")))
    return lookup.covering_tests(targets, nodes, tests)


@query(
    f"""{_GRAPH}, bfs(id, d) AS (SELECT 'p' || p_partkey, 0 FROM part WHERE p_partkey % 100 = 0 UNION ALL SELECT e.src, d + 1 FROM bfs b JOIN edges e ON e.dst = b.id WHERE d < 2)
    SELECT id, min(d) AS distance, CASE WHEN starts_with(id, 'o') THEN 'called_by' ELSE 'imported_by' END AS via FROM bfs GROUP BY id HAVING min(d) > 0"""
)
def impact_bfs(spark, sf):
    return G.impact(_parts_by(spark, sf, 100), A.graph_edges(spark, sf), 2)


@query(
    f"""{_GRAPH}, ch AS (SELECT DISTINCT path FROM nodes WHERE path IN ('part/Brand#11', 'part/Brand#23')), mine AS (SELECT id FROM nodes WHERE valid AND path IN (SELECT path FROM ch)),
    x AS (SELECT kind, n.path || '::' || n.symbol AS entry FROM edges JOIN mine ON dst = mine.id JOIN nodes n ON n.id = src AND n.valid WHERE kind IN (1, 2, 3, 5) AND n.path NOT IN (SELECT path FROM ch))
    SELECT CASE kind WHEN 1 THEN 'imports' WHEN 2 THEN 'calls' ELSE 'inherits' END AS relation, md5(string_agg(DISTINCT entry, '|' ORDER BY entry)) AS entries FROM x GROUP BY 1"""
)
def pr_context(spark, sf):
    nodes, edges = _graph(spark, sf)
    changed = nodes.select("path").where(F.col("path").isin("part/Brand#11", "part/Brand#23")).distinct()
    return lookup.changed_context(changed, nodes.withColumn("kind", F.lit(2)), edges).select("relation", F.md5(F.array_join("entries", "|")).alias("entries"))


# --- maintenance --------------------------------------------------------------------------------------------------

_SNAPS = """now AS (SELECT 'f' || o_orderkey AS path, o_orderkey % 7 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS mtime, o_custkey AS size, CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE 'h' END || o_custkey AS content_sha FROM orders WHERE o_orderkey % 11 <> 0),
  before AS (SELECT 'f' || o_orderkey AS path, o_orderkey % 7 AS mtime, o_custkey AS size, 'h' || o_custkey AS content_sha, CASE WHEN o_orderkey % 50 = 1 THEN 'binary' END AS skipped FROM orders WHERE o_orderkey % 13 <> 0)"""


def _snapshots(spark, sf):
    k = F.col("o_orderkey")
    o = A.table(spark, sf, "orders")
    path = F.concat(F.lit("f"), k)
    now = o.where(k % 11 != 0).select(path.alias("path"), (k % 7 + F.when(k % 5 == 0, 1).otherwise(0)).alias("mtime"), F.col("o_custkey").alias("size"), F.concat(F.when(k % 10 == 0, "x").otherwise("h"), "o_custkey").alias("content_sha"))
    before = o.where(k % 13 != 0).select(path.alias("path"), (k % 7).alias("mtime"), F.col("o_custkey").alias("size"), F.concat(F.lit("h"), "o_custkey").alias("content_sha"), F.when(k % 50 == 1, "binary").alias("skipped"))
    return now, before


_STATUS = f"WITH {_SNAPS}, st AS (SELECT coalesce(n.path, b.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN b.path IS NULL THEN 'new' WHEN n.mtime = b.mtime AND n.size = b.size AND b.skipped IS NULL THEN 'unchanged' WHEN n.content_sha = b.content_sha THEN 'touched' ELSE 'changed' END AS status FROM now n FULL JOIN before b ON n.path = b.path)"


@query(f"{_STATUS} SELECT path, status FROM st")
def index_diff(spark, sf):
    return maintain.classify_files(*_snapshots(spark, sf)).select("path", "status")


@query(f"{_STATUS} SELECT path FROM st WHERE status = 'deleted'")
def deleted_files(spark, sf):
    return maintain.classify_files(*_snapshots(spark, sf)).where("status = 'deleted'").select("path")


@query(f"WITH {_SNAPS} SELECT b.path FROM before b LEFT JOIN now n ON n.path = b.path WHERE n.path IS NULL OR n.mtime <> b.mtime OR n.size <> b.size")
def dirty_files(spark, sf):
    return maintain.dirty_files(*_snapshots(spark, sf))


_HELD = "old AS (SELECT DISTINCT 'f' || (l_orderkey % 700) AS path, 'n' || l_partkey AS id FROM lineitem), new AS (SELECT DISTINCT 'f' || (l_orderkey % 700) AS path, 'n' || CASE WHEN l_partkey % 50 = 0 THEN l_partkey + 1000000 ELSE l_partkey END AS id FROM lineitem WHERE l_partkey % 77 <> 0)"


def _held(spark, sf):
    lines = A.table(spark, sf, "lineitem")
    path, k = F.concat(F.lit("f"), F.col("l_orderkey") % 700).alias("path"), F.col("l_partkey")
    old = lines.select(path, F.concat(F.lit("n"), k).alias("id"))
    new = lines.where(k % 77 != 0).select(path, F.concat(F.lit("n"), F.when(k % 50 == 0, k + 1000000).otherwise(k)).alias("id"))
    return old, new


@query(f"WITH {_HELD} SELECT DISTINCT id FROM old WHERE id NOT IN (SELECT id FROM new)")
def mark_stale(spark, sf):
    return maintain.stale_ids(*_held(spark, sf))


_CHANGES = f"{_HELD}, ch AS (SELECT path, id, 'removed' AS change FROM (FROM old EXCEPT FROM new) UNION ALL SELECT path, id, 'added' FROM (FROM new EXCEPT FROM old))"


@query(f"WITH {_CHANGES} SELECT max(id) FILTER (change = 'added') AS src, 7 AS kind, max(id) FILTER (change = 'removed') AS dst, 1.0::DOUBLE AS weight FROM ch GROUP BY path HAVING count(*) FILTER (change = 'added') = 1 AND count(*) FILTER (change = 'removed') = 1")
def supersedes(spark, sf):
    return maintain.supersedes(maintain.node_changes(*_held(spark, sf)))


@query(
    f"""{_STATUS}, {_CHANGES}, p AS (SELECT count(*) AS c FROM (SELECT DISTINCT id FROM old) o JOIN (SELECT DISTINCT id FROM new) n USING (id)), a AS (SELECT count(*) FILTER (status <> 'deleted') AS files_seen, count(*) FILTER (status IN ('new', 'changed')) AS files_indexed, count(*) FILTER (status IN ('unchanged', 'touched')) AS files_unchanged, count(*) FILTER (status = 'deleted') AS files_deleted FROM st),
    b AS (SELECT count(*) FILTER (change = 'added') AS chunks_new, count(*) FILTER (change = 'removed') AS chunks_staled FROM ch)
    SELECT a.*, b.*, c AS chunks_preserved, round(c * 10000.0::DOUBLE / (c + chunks_staled)) / 100 AS preservation_pct FROM a, b, p"""
)
def index_report(spark, sf):
    old, new = _held(spark, sf)
    preserved = old.select("id").distinct().join(new.select("id"), "id", "left_semi")
    return maintain.index_report(maintain.classify_files(*_snapshots(spark, sf)), maintain.node_changes(old, new), preserved)


@query(
    "WITH o AS (SELECT c_custkey AS id, c_name AS path, c_nationkey AS line, c_mktsegment AS body FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, 'new/' || c_name AS path, c_nationkey + 1 AS line, 'other' AS body FROM customer WHERE c_custkey % 2 = 0) SELECT id, coalesce(n.path, o.path) AS path, coalesce(n.line, o.line) AS line, coalesce(o.body, n.body) AS body, o.id IS NULL AS is_new FROM o FULL JOIN n USING (id)"
)
def node_upsert(spark, sf):
    c = A.table(spark, sf, "customer")
    old = c.where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"), F.col("c_nationkey").alias("line"), F.col("c_mktsegment").alias("body"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("new/"), "c_name").alias("path"), (F.col("c_nationkey") + 1).alias("line"), F.lit("other").alias("body"))
    return maintain.upsert(old, new, "id", ("path", "line"))


@query(
    f"WITH {A.EDGES_SQL}, k AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' OR NOT (o_orderdate < TIMESTAMP '1998-08-02' - INTERVAL 30 DAY) UNION ALL SELECT 'p' || p_partkey FROM part) SELECT kind, count(*) AS edges FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY 1"
)
def gc(spark, sf):
    o = A.table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), (F.col("o_orderstatus") != "F").alias("valid"), F.col("o_orderdate").cast("timestamp").alias("staled_at"))
    nodes = o.union(A.table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey"), F.lit(True), F.lit(None).cast("timestamp")))
    # repeated edges go last, where those of a target are already together
    _, edges = maintain.collect_garbage(nodes, A.graph_edges(spark, sf), F.lit("1998-08-02").cast("timestamp"))
    return G.max_weight(edges).groupBy("kind").agg(F.count("*").alias("edges"))


@query("SELECT event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 777")
def retention(spark, sf):
    return maintain.retained(A.pack_log(spark, sf), 777).select("id")


@query("SELECT user_id AS node_id, count(*) AS hits, max(ts) AS last_used, round((1 - pow(0.9, count(*))) / 0.1, 6) AS ewma FROM events GROUP BY 1")
def stats_ewma(spark, sf):
    return maintain.usage_stats(A.pack_log(spark, sf))


# --- reports ------------------------------------------------------------------------------------------------------


@query("SELECT surface, count(*) AS packs, list_sort(list(v))[count(*) // 2 + 1] AS median_saved_pct FROM (SELECT event_type AS surface, round(value, 2) AS v FROM events) GROUP BY 1")
def median_upper(spark, sf):
    return report.upper_medians(A.pack_log(spark, sf), "surface", "saved_pct").select("surface", F.col("n").alias("packs"), F.col("median").alias("median_saved_pct"))


@query("SELECT surface, count(*) AS n, round(median(v), 4) AS median_saved_pct FROM (SELECT event_type AS surface, round(value, 2) AS v FROM events) GROUP BY 1")
def median_true(spark, sf):
    return report.grouped_medians(A.pack_log(spark, sf), "surface", "saved_pct")


@query("SELECT event_id AS id, event_id % 3 <> 0 AS ok FROM events")
def prefix_subsequence(spark, sf):
    k = F.col("id")
    whole = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: i)
    part = F.when(k % 3 == 0, F.array(F.lit(5), F.lit(2))).when(k % 3 == 1, F.array((k % 5 + 1).cast("int"), (k % 5 + 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    return A.pack_log(spark, sf).select("id", T.is_subsequence(part, whole).alias("ok"))


@query(
    f"""WITH {A.DOC_NODES_SQL}, hot AS (SELECT id, row_number() OVER (ORDER BY id) AS position FROM (SELECT id FROM chunks ORDER BY id LIMIT 20)),
    e AS (SELECT event_id, event_id % 4 AS v, round(value, 2) AS pct, event_id % 3 <> 0 AS ordered FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)
    SELECT 3 AS version, 20 AS members, 20 AS live_members, (SELECT sum(tokens)::BIGINT FROM chunks JOIN hot USING (id)) AS reusable_tokens, (SELECT sum(strlen({_ENV}))::BIGINT FROM chunks JOIN hot USING (id)) AS prefix_bytes,
      count(*) AS analyzed, count(*) FILTER (v = 3) AS on_current, count(*) FILTER (v = 3 AND ordered) AS consistent, list_sort(list(pct))[count(*) // 2 + 1] AS median_saved_pct, round(count(*) FILTER (v = 3 AND ordered) / count(*), 2) AS score FROM e"""
)
def cache_report(spark, sf):
    nodes = A.doc_nodes(spark, sf)
    ids = nodes.where("kind = 2").select("id").orderBy("id").limit(20).select(F.col("id").alias("node_id"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")).alias("position"))  # 20 rows
    hot = ids.withColumn("version", F.lit(3))
    lists = ids.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "node_id"))), lambda x: x["node_id"]).alias("all"))
    log = A.pack_log(spark, sf).crossJoin(F.broadcast(lists))  # one row
    packs = log.select("id", "ts", "saved_pct", (F.col("id") % 4).cast("int").alias("hot_set_version"), F.when(F.col("id") % 3 != 0, F.slice("all", 2, 5)).otherwise(F.reverse(F.slice("all", 2, 5))).alias("stable_ids"))
    return report.cache_report(hot, nodes, packs).select(*_long("version", "members", "live_members", "reusable_tokens", "prefix_bytes", "analyzed", "on_current", "consistent"), "median_saved_pct", "score")


@query("SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id FROM documents WHERE text IS NOT NULL ORDER BY (doc_id % 10) DESC, (strlen(text) + 3) // 4, doc_id LIMIT 25")
def top_chunks(spark, sf):
    return hotset.top_chunks(A.doc_nodes(spark, sf), 25).select("id")


@query(f"WITH {A.EDGES_SQL} SELECT (SELECT count(*) FROM documents) AS files, 0 AS skipped_files, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM documents) AS signatures, 0 AS docs, (SELECT count(*) FROM edges) AS edges")
def ag_counts(spark, sf):
    nodes = A.doc_nodes(spark, sf)
    files = nodes.where("kind = 2").select("path", F.lit(None).cast("string").alias("skipped"))
    return report.counts(nodes, files, G.max_weight(A.graph_edges(spark, sf)))


@query("SELECT lang, count(*) AS chunks FROM documents GROUP BY 1")
def ag_lang(spark, sf):
    return report.languages(A.doc_nodes(spark, sf))


# --- whole packs --------------------------------------------------------------------------------------------------


def _packs(spark, sf, *budgets):
    return A.document_packs(A.table(spark, sf, "documents"), A.table(spark, sf, "benchmark"), *budgets)


@query(pack_twin.CONTEXT_PACK)
def context_pack(spark, sf):
    """Budgeted packs for every benchmark item, one batch."""
    return pack_twin.flat(_packs(spark, sf, 2000)[0][0])


@query(pack_twin.TOKEN_SAVINGS)
def bench_token_savings(spark, sf):
    return report.savings(_packs(spark, sf, 2000)[0][1])


@query(pack_twin.BY_BUDGET)
def eval_by_budget(spark, sf):
    budgets = (2000, 6000, 12000)
    rows = [totals.withColumn("budget", F.lit(b)) for b, (_, totals) in zip(budgets, _packs(spark, sf, *budgets))]
    return report.grouped_medians(rows[0].unionByName(rows[1]).unionByName(rows[2]), "budget", "selected_tokens", "raw_tokens", "saved_pct")


# --- sources and parsing ------------------------------------------------------------------------------------------


@query(
    r"""SELECT 'f' || doc_id AS path, CASE doc_id % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'non-utf8' END AS skipped, CASE WHEN doc_id % 3 = 2 THEN sha256(regexp_replace(text, '\n+$', '') || chr(10)) END AS content_sha FROM documents WHERE text IS NOT NULL"""
)
def src_prepare(spark, sf):
    k, body = F.col("doc_id") % 3, F.col("text").cast("binary")
    content = F.when(k == 0, F.concat(body, F.unhex(F.lit("00")))).when(k == 1, F.concat(body, F.unhex(F.lit("FF")))).otherwise(body)
    rows = A.table(spark, sf, "documents").where("text is not null").select(F.concat(F.lit("f"), "doc_id").alias("path"), F.lit(0).cast("long").alias("mtime"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))
    return files.prepare(rows).select("path", "skipped", "content_sha")


_DECLARED = f"""WITH {A.PART_SOURCES_SQL}, declared AS (
  SELECT path, l, 'def' AS part, CASE l WHEN 3 THEN 'record' ELSE 'function' END AS kind, CASE l WHEN 3 THEN 'R' ELSE 'make_' END || k AS name, def_at AS byte_start, rtrim(def, chr(10)) AS body, CASE l WHEN 2 THEN 2 ELSE 3 END AS line_start,
    CASE l WHEN 0 THEN 'f_' || z || '|zz' ELSE 'f_' || z END AS calls, '' AS bases, '' AS impls,
    CASE l WHEN 0 THEN 'def make_' || k || '(a, b=1): ...' WHEN 1 THEN 'def make_' || k || '(a): ...' WHEN 2 THEN 'export const make_' || k || ' = (a: number) => ...' ELSE 'record R' || k || '(int a) {{' || chr(10) || '  int t();' || chr(10) || '}}' END || chr(10) AS signature FROM sources
  UNION ALL SELECT path, l, 'cls', CASE l WHEN 1 THEN 'function' ELSE 'class' END, CASE l WHEN 1 THEN 'bad' ELSE 'Part' || k END, cls_at, rtrim(cls, chr(10)), CASE l WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 3 ELSE 4 END,
    CASE l WHEN 0 THEN 'run_' || k WHEN 1 THEN '' WHEN 2 THEN 'f_' || z || '|zz' ELSE 'Zz|call|f_' || z END, CASE l WHEN 0 THEN 'Base' || z || '|C' WHEN 1 THEN '' ELSE 'Base' || z END, CASE WHEN l >= 2 THEN 'Sold' ELSE '' END,
    CASE l WHEN 0 THEN 'class Part' || k || '(Base' || z || ', m.C):' || chr(10) || '    ' || repeat('"', 3) || 'A part.' || repeat('"', 3) || chr(10) || '    def price(self): ...' WHEN 1 THEN 'def bad(: ...'
      WHEN 2 THEN 'export class Part' || k || ' extends Base' || z || ' implements Sold {{' || chr(10) || '  price(x: string) ...' || chr(10) || '}}' ELSE 'public class Part' || k || ' extends Base' || z || ' implements Sold {{' || chr(10) || '  int price(String s);' || chr(10) || '}}' END || chr(10) FROM sources)"""


def _parsed(spark, sf):
    sources = index.classified(A.part_sources(spark, sf))
    return sources, declarations(sources)


@query(f"{_DECLARED} SELECT path, kind, name, byte_start, byte_start + strlen(body) AS byte_end, line_start, line_start + len(body) - len(replace(body, chr(10), '')) AS line_end, calls, bases, impls, signature FROM declared")
def tg_declarations(spark, sf):
    """Every declaration of a source file for each part, in four languages or states."""
    d = _parsed(spark, sf)[1].select("path", F.explode("decls").alias("d"))
    return d.select("path", "d.kind", "d.name", "d.byte_start", "d.byte_end", "d.line_start", "d.line_end", *(F.array_join(f"d.{c}", "|").alias(c) for c in ("calls", "bases", "impls")), "d.signature")


@query(f"WITH {A.PART_SOURCES_SQL} SELECT path, CASE l WHEN 0 THEN 'lib' WHEN 1 THEN '.lib' WHEN 2 THEN './lib' ELSE 'java.util.L' END || z AS module FROM sources")
def tg_imports(spark, sf):
    return _parsed(spark, sf)[1].select("path", F.explode("imports").alias("module"))


@query(
    f"""{_DECLARED}, found AS (SELECT path, 2 AS kind, name AS symbol, body AS content FROM declared UNION ALL SELECT path, 3, name, signature FROM declared UNION ALL SELECT path, 1, NULL, text FROM sources)
    SELECT path, kind, symbol, (strlen(content) + 3) // 4 AS tokens, sha256(content) AS content_sha FROM found"""
)
def tg_chunks(spark, sf):
    """Chunks, signatures and file nodes of the parts' source files."""
    nodes = index.build_nodes(*_parsed(spark, sf))
    return nodes.select("path", "kind", "symbol", "tokens", F.sha2("content", 256).alias("content_sha"))


@query(
    f"""WITH {A.DOC_NODES_SQL}, top AS (SELECT row_number() OVER (ORDER BY centrality DESC, tokens, id) AS position, id AS node_id FROM chunks QUALIFY position <= 64)
    SELECT v AS version, CASE WHEN v = 4 THEN 65 - position ELSE position END AS position, node_id FROM top CROSS JOIN (SELECT unnest([2, 3, 4]) AS v)"""
)
def hot_set_versions(spark, sf):
    """Three versions of one order, then the reverse: a changed membership makes version 4 and drops version 1; unchanged members make none."""
    top = hotset.top_chunks(A.doc_nodes(spark, sf), 64).select(F.row_number().over(Window.orderBy(F.desc("centrality"), "tokens", "id")).cast("long").alias("position"), F.col("id").alias("node_id"))  # 64 rows
    before = top.withColumn("version", F.explode(F.array(*(F.lit(v).cast("long") for v in (1, 2, 3))))).select("version", "position", "node_id")
    turned = top.withColumn("position", 65 - F.col("position"))
    return hotset.next_version(hotset.next_version(before, turned), turned)


# --- more reports and lookups -------------------------------------------------------------------------------------


@query(f"WITH {A.DOC_NODES_SQL} SELECT id, path, symbol, tokens FROM chunks ORDER BY role = 'test', centrality DESC, tokens DESC, path, id LIMIT 1")
def top_symbol(spark, sf):
    return report.top_symbol(A.doc_nodes(spark, sf)).select("id", "path", "symbol", "tokens")


@query("SELECT count(*) AS packs, list_sort(list(v))[count(*) // 2 + 1] AS median_saved_pct, round(avg(v::DECIMAL(18, 2)), 2) AS mean_saved_pct, least(100.0, min(v)) AS min_saved_pct FROM (SELECT round(value, 2) AS v FROM events)")
def savings(spark, sf):
    return report.savings(A.pack_log(spark, sf))


@query(
    f"""WITH {A.DOC_NODES_SQL}, names AS (SELECT 'doc_' || doc_id AS name FROM documents UNION ALL SELECT doc_id || '.txt' FROM documents)
    SELECT name, id FROM names JOIN chunks ON name = regexp_extract(symbol, '[^.]*$') OR name = regexp_extract(path, '[^/]*$')"""
)
def symbol_and_file_seeds(spark, sf):
    """What every document's symbol and file name mean."""
    nodes = A.doc_nodes(spark, sf)
    d = A.table(spark, sf, "documents").select("doc_id")
    names = d.select(F.concat(F.lit("doc_"), "doc_id").alias("name")).union(d.select(F.concat("doc_id", F.lit(".txt"))))
    return lookup.seeds(names, nodes, nodes.where("kind = 2").select("path"))


@query(f"""WITH {A.DOC_NODES_SQL} SELECT id, '...' AS signature FROM chunks""")
def signatures_of(spark, sf):
    """The signature of every document's chunk."""
    nodes = A.doc_nodes(spark, sf)
    return lookup.signature_of(nodes.where("kind = 2"), nodes).select("id", "signature")
