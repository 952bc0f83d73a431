"""Graph questions about symbols and files: explain, callers, tests, changed context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.functions.text import basename, first_lines
from loomctx.operators.graph import paths_matching, reasons
from loomctx.operators.pack import _first, symbol_hits


def callers(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, caller, path, symbol, confidence): valid sources of call edges into the targets (id)."""
    into = edges.where(F.col("kind") == S.CALLS).join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
    return into.join(nodes.where("valid").select(F.col("id").alias("src"), "path", "symbol"), "src").select(F.col("dst").alias("id"), F.col("src").alias("caller"), "path", "symbol", F.col("weight").alias("confidence"))


def covering_tests(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, test, path, symbol): valid tests of the targets (id)."""
    out = edges.where(F.col("kind") == S.TESTED_BY).join(targets.select(F.col("id").alias("src")), "src", "left_semi")
    return out.join(nodes.where("valid").select(F.col("id").alias("dst"), "path", "symbol"), "dst").select(F.col("src").alias("id"), F.col("dst").alias("test"), "path", "symbol")


def explain(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, direction, reason, other, path, symbol) over the valid neighbours of the targets (id), both ways."""
    some = edges.where(F.col("kind").isin(*S.WALK_KINDS))
    ids = targets.select("id").distinct()
    out = some.select(F.col("src").alias("id"), F.col("dst").alias("other"), "kind", F.lit("outgoing").alias("direction")).join(ids, "id", "left_semi")
    back = some.select(F.col("dst").alias("id"), F.col("src").alias("other"), "kind", F.lit("incoming").alias("direction")).join(ids, "id", "left_semi")
    known = nodes.where("valid").select(F.col("id").alias("other"), "path", "symbol")
    return out.unionByName(back).join(known, "other").select("id", "direction", reasons(F.col("kind"), F.col("direction") == "incoming").alias("reason"), "other", "path", "symbol")


def signature_of(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, path, symbol, signature): a target's signature, or its first three lines."""
    sig = _first(nodes.where("valid"), S.SIGNATURE, "sig").select("path", "symbol", "sig_id").join(nodes.select(F.col("id").alias("sig_id"), F.col("content").alias("sig_content")), "sig_id")
    own = nodes.join(targets.select("id"), "id", "left_semi").select("id", "path", "symbol", "content")
    return own.join(sig, ["path", "symbol"], "left").select("id", "path", "symbol", F.coalesce("sig_content", first_lines("content", 3)).alias("signature"))


def seeds(names: DataFrame, nodes: DataFrame, files: DataFrame, n_files: int = 3, n_symbols: int = 5, with_files: bool = False) -> DataFrame:
    """(name, id): the nodes that a file or symbol name means.

    A name with a slash or a dot means the chunks of up to three files by its last segment (and, on demand, their file nodes); others
    up to five chunks by symbol.
    """
    valid = nodes.where("valid")
    chunks = valid.where(F.col("kind") == S.CHUNK)
    looks_like_file = F.contains("name", F.lit("/")) | F.contains("name", F.lit("."))
    by_file = names.where(looks_like_file).withColumn("suffix", basename("name"))
    hits = by_file.join(paths_matching(files, by_file.select("suffix"), n_files).select("suffix", "path"), "suffix").select("name", "path").distinct()
    inside = chunks if not with_files else valid.where(F.col("kind").isin(S.CHUNK, S.FILE))
    found = hits.join(inside.select("path", "id"), "path").select("name", "id")
    rest = names.where(~looks_like_file)
    return found.unionByName(symbol_hits(chunks, rest.select("name").distinct(), n_symbols).select("name", "id")).distinct()


def changed_context(changed: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(relation, entries): who calls, imports, inherits from or tests the chunks of the changed paths (path); tests may lie in changed files themselves."""
    valid = nodes.where("valid").withColumn("entry", F.concat("path", F.lit("::"), F.coalesce("symbol", F.lit("-")))).select("id", "path", "kind", "entry")
    mine = valid.where(F.col("kind") == S.CHUNK).join(changed.select("path"), "path", "left_semi").select(F.col("id").alias("seed"))
    into = edges.where(F.col("kind").isin(S.CALLS, S.IMPORTS, S.INHERITS, S.TESTED_BY)).join(mine, F.col("dst") == F.col("seed"), "left_semi").select(F.col("src").alias("id"), F.col("kind").alias("k"))
    into = into.join(valid, "id").join(changed.select("path"), "path", "left_anti").select("k", "entry")
    out = edges.where(F.col("kind") == S.TESTED_BY).join(mine, F.col("src") == F.col("seed"), "left_semi").select(F.col("dst").alias("id"), F.col("kind").alias("k")).join(valid, "id").select("k", "entry")
    label = F.element_at(F.create_map(*(F.lit(x) for k, v in S.EDGE_KINDS.items() for x in (k, v))), F.col("k"))
    return into.unionByName(out).groupBy(label.alias("relation")).agg(F.array_sort(F.collect_set("entry")).alias("entries"))
