"""Edges by change: which references, imports and mentions a set of changed files can affect, and those alone resolved again.

What a name means in a path depends on the entries of that name only, so a reference is resolved again if its own file has changed or an entry of its
name has come, gone or changed places in some changed file. An import is, if its file has changed or a path that has come or gone ends in one of its
candidates. A document's mentions are, if it is new or has one of the changed names in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.functions.text import short_name
from loomctx.operators import graph as G

_REFERENCE = ["path", "chunk", "name", "kind", "is_test"]


def references(parsed: DataFrame, placed: DataFrame) -> DataFrame:
    """(path, chunk, name, kind, is_test): what the declarations of files name. placed: nodes of every place; parsed: path, decls, imports."""
    at = placed.where(F.col("kind") == S.CHUNK).select("path", "byte_start", F.col("id").alias("chunk"), (F.col("role") == "test").alias("is_test"))
    d = parsed.select("path", F.explode("decls").alias("d")).select("path", F.col("d.byte_start").alias("byte_start"), "d.calls", "d.bases", "d.impls").join(at, ["path", "byte_start"])
    named = [d.select("path", "chunk", F.explode(column).alias("name"), F.lit(kind).alias("kind"), "is_test") for column, kind in (("calls", S.CALLS), ("bases", S.INHERITS), ("impls", S.IMPLEMENTS))]
    return named[0].unionByName(named[1]).unionByName(named[2]).distinct()


def entries(placed: DataFrame) -> DataFrame:
    """(id, path, symbol, ord) of every place of a chunk."""
    return placed.where(F.col("kind") == S.CHUNK).select("id", "path", "symbol", F.col("byte_start").alias("ord"))


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names of which an entry has come or gone, or stands elsewhere among those of its name in its path; both sides hold the changed paths only."""
    order = Window.partitionBy("path", "name").orderBy("ord", "id")
    ranked = lambda e: e.select("id", "path", short_name("symbol").alias("name"), "ord").withColumn("nth", F.row_number().over(order)).drop("ord")
    old, new = ranked(before), ranked(after)
    return old.exceptAll(new).unionByName(new.exceptAll(old)).select("name").distinct()


def change_references(old: DataFrame, fresh: DataFrame, paths: DataFrame, names: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of references with their targets after a change, and those that were resolved again.

    old: the table before; fresh: references of the changed paths as they are; names: changed names; now: all entries.
    """
    rest = old.join(paths, "path", "left_anti")
    again = G.cut(rest.join(names, "name", "left_semi").select(_REFERENCE).unionByName(fresh.select(_REFERENCE)))
    wanted = now.withColumn("name", short_name("symbol")).join(again.select("name").distinct(), "name", "left_semi").drop("name")
    return rest.join(names, "name", "left_anti").select(*_REFERENCE, "target", "weight").unionByName(G.targets(again, wanted).select(*_REFERENCE, "target", "weight")), again


def change_imports(old: DataFrame, fresh: DataFrame, paths: DataFrame, moved: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table of imports with their targets after a change, and those that were resolved again. fresh: imports of the changed paths; moved: paths that have come or gone; files: all paths."""
    rest = old.join(paths, "path", "left_anti")
    ends = G.path_suffixes(moved).select(F.col("suffix").alias("candidate")).distinct()
    touched = G.import_candidates(rest.select("path", "module", "lang")).join(ends, "candidate", "left_semi").select("path", "module").distinct()
    again = G.cut(rest.join(touched, ["path", "module"], "left_semi").select("path", "module", "lang").unionByName(fresh.select("path", "module", "lang").distinct()))
    found = again.join(G.resolve_imports(again, files), ["path", "module"], "left").select("path", "module", "lang", "target")
    return rest.join(touched, ["path", "module"], "left_anti").select("path", "module", "lang", "target").unionByName(found), again


def change_mentions(old: DataFrame, old_docs: DataFrame, docs: DataFrame, names: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mention edges after a change, and the documents that were read for all names. docs: id, content; names: changed names; now: all entries."""
    known = docs.join(old_docs.select("id"), "id", "left_semi")
    having = G.doc_mentions(known, names.select(F.col("name").alias("id"), F.col("name").alias("symbol")), 1).select(F.col("dst").alias("id"))
    again = G.cut(docs.join(old_docs.select("id"), "id", "left_anti").select("id").unionByName(having).distinct())
    kept = old.join(docs.select(F.col("id").alias("dst")), "dst", "left_semi").join(again.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "kind", "dst", "weight")
    return kept.unionByName(G.doc_mentions(docs.join(again, "id", "left_semi"), now)), again


def edges_of(refs: DataFrame, imports: DataFrame, mentions: DataFrame, placed: DataFrame) -> DataFrame:
    """All edges from references and imports with targets, and mentions."""
    found = refs.where("target is not null")
    direct = found.select(F.col("chunk").alias("src"), "kind", F.col("target").alias("dst"), "weight")
    file_ids = placed.where(F.col("kind") == S.FILE).select("path", F.col("id").alias("file"))
    links = imports.where("target is not null").join(file_ids, "path").join(file_ids.select(F.col("path").alias("target"), F.col("file").alias("dst")), "target")
    links = links.where("file != dst").select(F.col("file").alias("src"), F.lit(S.IMPORTS).alias("kind"), "dst", F.lit(1.0).alias("weight"))
    return G.max_weight(direct.unionByName(G.tested_by(found)).unionByName(links).unionByName(mentions))
