"""The benchmark tables seen as the engine's own: graph, nodes, requests, logs. Each has a SQL twin for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order calls part (weight by quantity), order inherits supplier, customer imports order; repeated pairs are still there."""
    lines = table(spark, sf_dir, "lineitem")
    part = lines.select(_id("o", "l_orderkey").alias("src"), F.lit(2).alias("kind"), _id("p", "l_partkey").alias("dst"), (F.col("l_quantity") / 50).alias("weight"))
    supplier = lines.select(_id("o", "l_orderkey").alias("src"), F.lit(3).alias("kind"), _id("s", "l_suppkey").alias("dst"), F.lit(0.6).alias("weight"))
    customer = table(spark, sf_dir, "orders").select(_id("c", "o_custkey").alias("src"), F.lit(1).alias("kind"), _id("o", "o_orderkey").alias("dst"), F.lit(1.0).alias("weight"))
    return part.union(supplier).union(customer)


EDGES_SQL = """raw_edges AS (
  SELECT 'o' || l_orderkey AS src, 2 AS kind, 'p' || l_partkey AS dst, l_quantity / 50 AS weight FROM lineitem
  UNION ALL SELECT 'o' || l_orderkey, 3, 's' || l_suppkey, 0.6 FROM lineitem
  UNION ALL SELECT 'c' || o_custkey, 1, 'o' || o_orderkey, 1.0 FROM orders),
edges AS (SELECT src, kind, dst, max(weight) AS weight FROM raw_edges GROUP BY ALL)"""


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders, parts and suppliers: id, path, symbol, valid (orders in status F aren't)."""
    customers = table(spark, sf_dir, "customer").select(_id("c", "c_custkey").alias("id"), F.concat(F.lit("customer/"), "c_mktsegment").alias("path"), F.col("c_name").alias("symbol"), F.lit(True).alias("valid"))
    orders = table(spark, sf_dir, "orders").select(_id("o", "o_orderkey").alias("id"), F.concat(F.lit("orders/"), "o_orderpriority").alias("path"), _id("Order#", "o_orderkey").alias("symbol"), (F.col("o_orderstatus") != "F").alias("valid"))
    parts = table(spark, sf_dir, "part").select(_id("p", "p_partkey").alias("id"), F.concat(F.lit("part/"), "p_brand").alias("path"), F.concat("p_brand", F.lit("."), _id("Part#", "p_partkey")).alias("symbol"), F.lit(True).alias("valid"))
    suppliers = table(spark, sf_dir, "supplier").select(_id("s", "s_suppkey").alias("id"), F.lit("supplier/all").alias("path"), F.col("s_name").alias("symbol"), F.lit(True).alias("valid"))
    return customers.union(orders).union(parts).union(suppliers)


NODES_SQL = """nodes AS (
  SELECT 'c' || c_custkey AS id, 'customer/' || c_mktsegment AS path, c_name AS symbol, true AS valid FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'orders/' || o_orderpriority, 'Order#' || o_orderkey, o_orderstatus <> 'F' FROM orders
  UNION ALL SELECT 'p' || p_partkey, 'part/' || p_brand, p_brand || '.Part#' || p_partkey, true FROM part
  UNION ALL SELECT 's' || s_suppkey, 'supplier/all', s_name, true FROM supplier)"""


def doc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_of_documents(table(spark, sf_dir, "documents"))


def nodes_of_documents(documents: DataFrame) -> DataFrame:
    """Documents as code chunks: one chunk and one signature each."""
    d = documents.where("text is not null")
    size = F.octet_length("text").cast("long")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    chunk = d.select(
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"), F.sha2("text", 256).alias("hash"), F.lit(2).alias("kind"), path.alias("path"), F.concat("lang", F.lit("."), _id("doc_", "doc_id")).alias("symbol"), F.col("lang"),
        F.when(F.col("doc_id") % 7 == 0, "test").otherwise("").alias("role"), F.lit(0).cast("long").alias("byte_start"), size.alias("byte_end"), F.lit(1).cast("long").alias("line_start"), F.lit(9).cast("long").alias("line_end"),
        F.floor((size + 3) / 4).cast("long").alias("tokens"), F.col("text").alias("content"), F.lit(True).alias("valid"), (F.col("doc_id") % 10 / 10).alias("centrality"),
    )
    sig = chunk.withColumns({"id": F.concat(F.lit("s"), F.substring("id", 2, 12)), "hash": F.sha2(F.concat(F.lit("sig"), "hash"), 256), "kind": F.lit(3), "tokens": F.lit(12).cast("long"), "content": F.lit("...")})
    return chunk.unionByName(sig)


DOC_NODES_SQL = """chunks AS (
  SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, sha256(text) AS hash, 2 AS kind, source || '/' || lang || '/' || doc_id || '.txt' AS path,
         lang || '.doc_' || doc_id AS symbol, lang, CASE WHEN doc_id % 7 = 0 THEN 'test' ELSE '' END AS role, 0 AS byte_start, strlen(text) AS byte_end,
         (strlen(text) + 3) // 4 AS tokens, text AS content, (doc_id % 10) / 10.0::DOUBLE AS centrality
  FROM documents WHERE text IS NOT NULL)"""


#: A source file for each part, its language by the key: what stands before, the function and the class, as format strings over ``k`` (key) and ``z`` (size).
SOURCES = {
    "python": ("import lib{z}\n\n", "@checked\ndef make_{k}(a, b=1):\n    return f_{z}(self.zz(a))\n", 'class Part{k}(Base{z}, m.C):\n    """A part."""\n\n    def price(self):\n        run_{k}()\n'),
    "broken": ("from .lib{z} import y\n\n", "def make_{k}(a):\n    return f_{z}(a)\n", "def bad(:\n    x\n"),
    "typescript": ("import {{ a }} from \"./lib{z}\";\n", "export const make_{k} = (a: number) => f_{z}(a);\n", "export class Part{k} extends Base{z} implements Sold {{\n  price(x: string) {{ f_{z}(`n ${{zz(x)}}`); }}\n}}\n"),
    "java": ("package p;\nimport java.util.L{z};\n", "record R{k}(int a) {{ int t() {{ return f_{z}(a); }} }}\n", 'public class Part{k} extends Base{z} implements Sold {{\n  int price(String s) {{ f_{z}("}}"); return new Zz().call(); }}\n}}\n'),
}
_ENDINGS = [".py", ".py", ".ts", ".java"]


def _pieces(template: str) -> str:
    """SQL of a format string over part's key and size, for both engines; ``${`` is parted, since Spark replaces variables in SQL."""
    out = template.replace("${{", "$' || '{{").replace("{{", "\0").replace("}}", "\1").replace("{k}", "\2").replace("{z}", "\3")
    for mark, column in (("\2", "p_partkey"), ("\3", "p_size")):
        out = out.replace(mark, "' || CAST(" + column + " AS STRING) || '")
    return "'" + out.replace("\0", "{").replace("\1", "}").replace("\n", "' || chr(10) || '") + "'"


def _by_language(values) -> str:
    return "CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


PART_SOURCES_SQL = f"""sources AS (
  SELECT *, before || def || cls AS text, strlen(before) AS def_at, strlen(before || def) AS cls_at FROM (
    SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS z, p_partkey % 4 AS l, 'src/p' || p_partkey || {_by_language(f"'{e}'" for e in _ENDINGS)} AS path,
      {", ".join(_by_language(_pieces(t[i]) for t in SOURCES.values()) + " AS " + name for i, name in enumerate(("before", "def", "cls")))} FROM part))"""


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a source file for each part."""
    parts = table(spark, sf_dir, "part")
    path = F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.expr(_by_language(f"'{e}'" for e in _ENDINGS)))
    return parts.select(path.alias("path"), F.concat(*(F.expr(_by_language(_pieces(t[i]) for t in SOURCES.values())) for i in range(3))).alias("text"))


def file_nodes(chunks: DataFrame) -> DataFrame:
    """A file node around each document's chunk, three tokens longer than it."""
    whole = {"id": F.concat(F.lit("f"), F.substring("id", 2, 12)), "hash": F.sha2(F.concat(F.lit("file"), "hash"), 256), "kind": F.lit(1), "symbol": F.lit(None).cast("string"), "tokens": F.col("tokens") + 3}
    return chunks.where("kind = 2").withColumns(whole)


def query_requests(spark: SparkSession, sf_dir: str, budget: int = 2000) -> DataFrame:
    return requests_of_items(table(spark, sf_dir, "benchmark"), budget)


def requests_of_items(items: DataFrame, budget: int) -> DataFrame:
    """The whole text of every benchmark item as a request, modes taken in turn."""
    from loomctx.schema import MODES

    b = items
    mode = F.element_at(F.array(*map(F.lit, MODES)), (F.col("item_id") % 7 + 1).cast("int"))
    return b.select(F.col("item_id").cast("string").alias("request_id"), F.col("text").alias("query"), F.lit(budget).cast("long").alias("token_budget"), mode.alias("mode"), F.lit(False).alias("include_content"), F.array().cast("array<string>").alias("dirty_paths"))


def item_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_of_items(table(spark, sf_dir, "benchmark"))


def nodes_of_items(items: DataFrame) -> DataFrame:
    """Benchmark items as nodes of their own, with the columns of ``doc_nodes``."""
    size = F.octet_length("text").cast("long")
    b = items.where("text is not null")
    return b.select(
        _id("i", "item_id").alias("id"), F.sha2("text", 256).alias("hash"), F.lit(4).alias("kind"), F.concat(F.lit("benchmark/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), _id("item_", "item_id").alias("symbol"), F.lit("").alias("lang"),
        F.lit("").alias("role"), F.lit(0).cast("long").alias("byte_start"), size.alias("byte_end"), F.lit(1).cast("long").alias("line_start"), F.lit(1).cast("long").alias("line_end"),
        F.floor((size + 3) / 4).cast("long").alias("tokens"), F.col("text").alias("content"), F.lit(True).alias("valid"), F.lit(0.0).alias("centrality"),
    )


def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of_mentions(table(spark, sf_dir, "benchmark"), doc_nodes(spark, sf_dir))


def edges_of_mentions(items: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from benchmark items to the documents that have words of theirs, over both whole tables."""
    from loomctx.functions.text import words
    from loomctx.operators.graph import doc_mentions

    names = items.select(_id("i", "item_id").alias("id"), F.explode(words("text")).alias("symbol"))
    return doc_mentions(nodes.where("kind = 2").select("id", "content"), names)


def document_packs(documents: DataFrame, items: DataFrame, *budgets: int, modes: list[str] | None = None) -> list[tuple[DataFrame, DataFrame]]:
    """(items, totals) of every benchmark item's request (of these modes) for context from the documents, under each budget; edges and candidates are made once."""
    from loomctx.operators import hotset, pack
    from loomctx.operators.graph import cut, stored

    docs = nodes_of_documents(documents)
    everything, edges = docs.unionByName(file_nodes(docs)).unionByName(nodes_of_items(items)), cut(edges_of_mentions(items, docs))
    # read many times below, contents twice
    slim = stored(everything.drop("content"))
    files = slim.where("kind = 2").select("path", F.lit(None).cast("string").alias("skipped"))
    hot = cut(hotset.hot_members(slim.where("kind in (2, 3)")))
    asked = lambda b: requests_of_items(items, b).where(F.lit(True) if modes is None else F.col("mode").isin(modes))
    candidates = pack.candidates_of(asked(budgets[0]), everything, edges, files, slim=slim)
    return [pack.packed(candidates, asked(b), everything, hot, 1, slim) for b in budgets]


def pack_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of packs and uses: id, ts, node_id (user), surface (type), saved_pct (value)."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("node_id"), F.col("event_type").alias("surface"), F.round("value", 2).alias("saved_pct"))
