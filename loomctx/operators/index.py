"""Indexing: parsed files to nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.functions.sections import markdown_sections
from loomctx.functions.text import content_hash, is_test_path, language, node_id, token_estimate
from loomctx.operators import delta
from loomctx.operators import graph as G


def _node(kind: int, symbol, content, start, end, first, last):
    digest = content_hash(kind, "lang", content)
    return [node_id(digest).alias("id"), digest.alias("hash"), F.lit(kind).alias("kind"), "path", symbol.alias("symbol"), "lang", "role", start.cast("long").alias("byte_start"), end.cast("long").alias("byte_end"), first.cast("long").alias("line_start"), last.cast("long").alias("line_end"), token_estimate(content).alias("tokens"), content.alias("content")]


def classified(files: DataFrame) -> DataFrame:
    lang = language("path")
    return files.withColumns({"lang": lang, "role": F.when(is_test_path("path", lang), "test").otherwise("")})


def build_nodes(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Chunks, signatures, document sections and file nodes of files (path, text, lang, role); parsed: path, decls, imports."""
    d = files.join(parsed, "path").select("path", "text", "lang", "role", F.explode("decls").alias("d"))
    body = F.substring(F.col("text").cast("binary"), (F.col("d.byte_start") + 1).cast("int"), (F.col("d.byte_end") - F.col("d.byte_start")).cast("int")).cast("string")
    place = [F.col(f"d.{c}") for c in ("byte_start", "byte_end", "line_start", "line_end")]
    chunks = d.select(*_node(S.CHUNK, F.col("d.name"), body, *place))
    signatures = d.select(*_node(S.SIGNATURE, F.col("d.name"), F.col("d.signature"), *place))
    docs = markdown_sections(files.where("lang = 'markdown'"), "path", "text").join(files.select("path", "lang"), "path").withColumn("role", F.lit(""))
    docs = docs.select(*_node(S.DOC, F.col("heading"), F.col("body"), F.lit(0), F.octet_length("body"), F.col("line_start"), F.col("line_end")))
    lines = F.size(F.split("text", "\n")) - 1
    whole = files.select(*_node(S.FILE, F.lit(None).cast("string"), F.col("text"), F.lit(0), F.octet_length("text"), F.lit(1), F.greatest(lines, F.lit(1))))
    return chunks.unionByName(signatures).unionByName(docs).unionByName(whole)


def one_per_id(nodes: DataFrame) -> DataFrame:
    """Equal contents are one node; of its places the last by (path, byte_start) stands."""
    columns = [c for c in nodes.columns if c != "id"]
    return nodes.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("path", "byte_start")).alias("n")).select("id", "n.*")


def build_edges(placed: DataFrame, parsed: DataFrame, files: DataFrame) -> DataFrame:
    """All edges of the current files from nothing. ``placed`` are nodes of every place; parsed: path, decls, imports."""
    now = delta.entries(placed)
    refs = G.targets(delta.references(parsed, placed), now)
    imports = G.resolve_imports(imported(parsed, files), files.select("path"))
    return delta.edges_of(refs, imports, G.doc_mentions(placed.where(F.col("kind") == S.DOC).select("id", "content"), now), placed)


def imported(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, lang) of every import."""
    return parsed.join(files.select("path", "lang"), "path").select("path", "lang", F.explode("imports").alias("module"))
