"""The property graph: edge resolution, degrees, bounded walks, reverse impact."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.functions.text import contains_word, dirname, join_relative, short_name, signs, words, words_after_sign, words_before_sign
from loomctx.session import shared_folder


#: Rows of a few columns that may go to every task.
SENT = 300_000


def max_weight(edges: DataFrame) -> DataFrame:
    """One edge for each (src, kind, dst), the heaviest."""
    return edges.groupBy("src", "kind", "dst").agg(F.max("weight").alias("weight"))


def resolve_names(references: DataFrame, entries: DataFrame) -> DataFrame:
    """References that have a target, with it."""
    return targets(references, entries).where("target is not null")


def targets(references: DataFrame, entries: DataFrame) -> DataFrame:
    """Targets of names: the first entry of the name in the same path (weight 1), else the only entry anywhere (0.6), else null.

    references: chunk, path, name, and whatever else; entries: id, path, symbol, and optionally ``ord`` for their order in a
    path. A reference whose target is its own chunk has none, without a fallback.
    """
    order = F.struct("ord", "id") if "ord" in entries.columns else F.struct("id")
    named = entries.select("id", "path", short_name("symbol").alias("name"), order.alias("o"))
    local = named.groupBy("name", "path").agg(F.min_by("id", "o").alias("local_id"))
    alone = named.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("only_id")).where("n = 1").drop("n")
    out = references.join(local, ["name", "path"], "left").join(alone, "name", "left")
    found = F.coalesce("local_id", "only_id")
    out = out.withColumn("target", F.when(found != F.col("chunk"), found)).withColumn("weight", F.when(F.col("local_id").isNotNull(), 1.0).otherwise(0.6))
    return out.drop("local_id", "only_id")


def reference_edges(references: DataFrame, entries: DataFrame) -> DataFrame:
    """Edges of calls, bases and interfaces; calls from tests also say that their target is tested.

    references: chunk, path, name, kind (an edge kind), is_test.
    """
    found = resolve_names(references, entries)
    direct = found.select(F.col("chunk").alias("src"), "kind", F.col("target").alias("dst"), "weight")
    return max_weight(direct.unionByName(tested_by(found)))


def tested_by(found: DataFrame) -> DataFrame:
    """target -> test chunk for every resolved call made from a test."""
    return found.where(F.col("is_test") & (F.col("kind") == S.CALLS)).select(F.col("target").alias("src"), F.lit(S.TESTED_BY).alias("kind"), F.col("chunk").alias("dst"), F.lit(0.8).alias("weight"))


def path_suffixes(files: DataFrame) -> DataFrame:
    """(suffix, path) for every suffix of a path that starts at a segment."""
    parts = F.split("path", "/")
    return files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))


def paths_matching(files: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """Files that are, or end in a slash and, a wanted suffix, shortest first: (suffix, path, nth). Matching is literal."""
    hits = path_suffixes(files).join(wanted.select("suffix").distinct(), "suffix")
    order = Window.partitionBy("suffix").orderBy(F.length("path"), "path")
    return hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def import_candidates(imports: DataFrame) -> DataFrame:
    """(path, module, lang, priority, candidate): what a module may be called in the repository, best first."""
    module, lang = F.col("module"), F.col("lang")
    rel = F.regexp_replace(module, r"^\.+", "")
    slashed = F.replace(rel, F.lit("."), F.lit("/"))
    python = F.array(F.concat(slashed, F.lit(".py")), F.concat(slashed, F.lit("/__init__.py")), F.concat(F.substring_index(rel, ".", -1), F.lit(".py")))
    joined = join_relative(dirname("path"), module)
    script = F.array(*(F.concat(joined, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")))
    java = F.array(F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".java")), F.concat(F.substring_index(module, ".", -1), F.lit(".java")))
    candidates = F.when(lang == "python", python).when(lang.isin("typescript", "tsx") & module.startswith("."), script).when(lang == "java", java)
    return imports.select("path", "module", "lang", F.posexplode(candidates).alias("priority", "candidate"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, target): the file that an import means, if the repository has it.

    Python takes the first candidate with a hit (of two the one in the same directory, else the shorter), TypeScript the first exact path, Java the
    first candidate with exactly one hit. An import of the own file is none. Imports and files both grow, and their estimates don't count what explodes:
    so none of them is sent whole through the driver to every executor.
    """
    candidates = import_candidates(imports.select("path", "module", "lang").distinct())
    exact = candidates.where(F.col("lang").isin("typescript", "tsx")).join(files.select(F.col("path").alias("target")).hint("merge"), F.col("candidate") == F.col("target"))
    exact = exact.select("path", "module", "priority", "target", F.lit(0).alias("near"), F.lit(1).alias("nth"))
    others = candidates.where(~F.col("lang").isin("typescript", "tsx"))
    hits = paths_matching(files, others.select(F.col("candidate").alias("suffix")).hint("merge"), 2)
    hits = hits.withColumn("n", F.count("*").over(Window.partitionBy("suffix"))).select(F.col("suffix").alias("candidate"), F.col("path").alias("target"), "nth", "n")
    suffix = others.join(hits.hint("merge"), "candidate").where("lang = 'python' or n = 1")
    suffix = suffix.select("path", "module", "priority", "target", F.when(F.col("target").startswith(dirname("path")), 0).otherwise(1).alias("near"), "nth")
    best = exact.unionByName(suffix).groupBy("path", "module").agg(F.min_by("target", F.struct("priority", "near", "nth")).alias("target"))
    return best.where("target != path")


def doc_mentions(docs: DataFrame, entries: DataFrame, per_doc: int = S.MENTIONS_PER_DOC) -> DataFrame:
    """Edges from code to the documents that name it: names of four bytes or more, the first ``per_doc`` of a document by name.

    A name is there where it stands next to no letter, digit or underscore. Names of such characters alone are the words of a document. Of any other
    name, as ``$scope`` or ``a->b``, the longest word with the sign before it, or without one the longest with the sign after it, or without any word the first
    character, stands in the document as well and finds the documents in which the whole name is then looked for. A document is read again once for
    all names that it may have, in their order, until ``per_doc`` of them are found.
    """
    named = entries.select("id", short_name("symbol").alias("name")).where(F.octet_length("name") >= 4).groupBy("name").agg(F.min("id").alias("id"))
    named = named.withColumn("word", F.get(words("name"), 0).eqNullSafe(F.col("name")))
    contents = docs.select(F.col("id").alias("doc"), "content")
    found = contents.select("doc", F.explode(F.array_distinct(words("content"))).alias("name")).join(named.where("word"), "name").select("doc", "id", "name")
    odd = named.where("not word")
    if not odd.isEmpty():
        longest = lambda marked: F.get(F.array_sort(marked, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 0)
        odd = odd.withColumn("anchor", F.coalesce(longest(words_after_sign("name")), longest(words_before_sign("name")), F.substring("name", 1, 1)))
        anchors = F.array_distinct(F.concat(words_after_sign("content"), words_before_sign("content"), signs("content")))
        maybe = contents.select("doc", F.explode(anchors).alias("anchor")).join(odd, "anchor").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("name", "id"))).alias("names"))
        there = lambda n: F.contains("content", n["name"]) & contains_word("content", n["name"])
        first = F.aggregate("names", F.slice("names", 1, 0), lambda acc, n: F.when(F.size(acc) >= per_doc, acc).when(there(n), F.concat(acc, F.array(n))).otherwise(acc))
        found = found.unionByName(maybe.join(contents, "doc").select("doc", F.explode(first).alias("n")).select("doc", "n.id", "n.name"))
    order = Window.partitionBy("doc").orderBy("name")
    kept = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_doc)
    return kept.select(F.col("id").alias("src"), F.lit(S.MENTIONS).alias("kind"), F.col("doc").alias("dst"), F.lit(0.7).alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over both ends of every edge; counted at each end before the shuffle."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def centrality(edges: DataFrame) -> DataFrame:
    """(id, degree, centrality): degree over the greatest degree."""
    d = degrees(edges)
    return d.crossJoin(F.broadcast(d.agg(F.greatest(F.max("degree"), F.lit(1)).alias("top")))).select("id", "degree", (F.col("degree") / F.col("top")).alias("centrality"))


def reasons(kind, reverse):
    """Direction-aware reason of an edge."""
    table = F.create_map(*(F.lit(x) for k, pair in S.REASONS.items() for x in (k, F.array(F.lit(pair[0]), F.lit(pair[1])))))
    return F.element_at(F.element_at(table, kind), F.when(reverse, 2).otherwise(1))


def neighbours(frontier: DataFrame, edges: DataFrame, kinds=S.WALK_KINDS) -> DataFrame:
    """(source, id, kind, reverse, weight) over the edges of these kinds, both ways; frontier: id."""
    some = edges.where(F.col("kind").isin(*kinds))
    ids = frontier.select(F.col("id").alias("source"))
    out = some.select(F.col("src").alias("source"), F.col("dst").alias("id"), "kind", F.lit(False).alias("reverse"), "weight").join(ids, "source", "left_semi")
    back = some.select(F.col("dst").alias("source"), F.col("src").alias("id"), "kind", F.lit(True).alias("reverse"), "weight").join(ids, "source", "left_semi")
    return out.unionByName(back)


def walk(seeds: DataFrame, edges: DataFrame, valid: DataFrame, priors, hops: int = 2, group: tuple[str, ...] = (), most: int | None = None, inside: DataFrame | None = None, sent: int = 300_000) -> DataFrame:
    """Nodes within ``hops`` of the seeds that aren't seeds: (id, hops, reason, source), the best edge for each.

    Among edges that reach a node in the same hop the one with the greater prior, lesser kind, forward direction and lesser source wins. ``valid`` lists
    the ids that may be entered. A frontier of at most ``sent`` nodes goes to all edges, a larger one meets them by a shuffle. With ``group`` columns in seeds every group walks for itself, all in the same jobs; a group whose
    frontier has ``most`` nodes or more stops. ``inside`` (id, member) replaces nodes by their members, as files by their chunks.
    """
    keys = list(group)
    some = edges.where(F.col("kind").isin(*S.WALK_KINDS))
    end = lambda a, b, reverse: F.struct(F.col(a).alias("source"), F.col(b).alias("id"), F.lit(reverse).alias("reverse"))
    both = some.select("kind", F.explode(F.array(end("src", "dst", False), end("dst", "src", True))).alias("e")).select("e.source", "e.id", "kind", "e.reverse")
    known = cut(seeds.select(*keys, "id").distinct())
    frontier, found = known, None
    for hop in range(1, hops + 1):
        if most is not None:
            n = F.count("*").over(Window.partitionBy(*keys)) if keys else F.count("*").over(Window.partitionBy(F.lit(0)))
            frontier = frontier.withColumn("n", n).where(F.col("n") < most).drop("n")
        start = frontier.select(*keys, F.col("id").alias("source"))
        near = F.broadcast if start.count() <= sent else lambda rows: rows
        # edges of the frontiers of all groups, once for all of them
        steps = both.join(near(start.select("source").distinct() if keys else start), "source")
        if inside is not None:
            steps = steps.join(inside, "id", "left").withColumn("id", F.coalesce("member", "id")).drop("member")
        steps = steps.join(valid.select("id"), "id", "left_semi").withColumn("reason", reasons(F.col("kind"), F.col("reverse")))
        order = [(-priors(F.col("reason"))).alias("p"), F.col("kind"), F.col("reverse"), F.col("source")]
        if keys:
            # groups prefer alike, so the steps to a node are numbered once and a group takes the least number of its own
            steps = cut(steps.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy(*order))).select("id", "nth", "source", "reason"))
            least = steps.select("id", "nth", "source").join(near(start), "source").groupBy(*keys, "id").agg(F.min("nth").alias("nth"))
            best = least.join(known, [*keys, "id"], "left_anti").join(steps, ["id", "nth"])
        else:
            best = steps.join(known, "id", "left_anti").groupBy("id").agg(F.min_by(F.struct("reason", "source"), F.struct(*order)).alias("b")).select("id", "b.*")
        level = cut(best.select(*keys, "id", F.lit(hop).alias("hops"), "reason", "source"))
        found = level if found is None else found.unionByName(level)
        frontier = level.select(*keys, "id")
        known = known.unionByName(frontier)
    return found


def impact(seeds: DataFrame, edges: DataFrame, depth: int = 3, valid: DataFrame | None = None, kinds=S.IMPACT_KINDS) -> DataFrame:
    """(id, distance, via): what reaches the seeds along edges, followed backwards, breadth first.

    Each level is checkpointed, so lineage does not grow with depth; the loop ends at the first empty level. Nodes not in ``valid`` are
    visited but neither reported nor expanded. ``via`` is the reason of the edge with the least (kind, target).
    """
    back = edges.where(F.col("kind").isin(*kinds)).select(F.col("dst").alias("at"), F.col("src").alias("id"), "kind")
    seen = seeds.select("id").distinct()
    frontier, levels = seen, []
    for d in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("at")).join(back, "at").join(seen, "id", "left_anti")
        level = step.groupBy("id").agg(F.min(F.struct("kind", "at")).alias("e")).select("id", F.lit(d).alias("distance"), reasons(F.col("e.kind"), F.lit(True)).alias("via"))
        level = cut(level)
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("id"))
        frontier = level if valid is None else level.join(valid.select("id"), "id", "left_semi")
        levels.append(frontier)
    if not levels:
        return seeds.select("id").limit(0).select("id", F.lit(0).alias("distance"), F.lit("").alias("via"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in the session's checkpoint folder; where none is set, in a local one if all executors are threads of this process, else an error."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        shared_folder(df.sparkSession)
    return df.checkpoint()


def sent(rows: DataFrame, most: int = SENT) -> DataFrame:
    """``rows``, which are counted and so should be kept, as a side that goes to every task if they are ``most`` at most, else as they are."""
    return F.broadcast(rows) if rows.count() <= most else rows


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table, of which later steps read the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
