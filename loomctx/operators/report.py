"""Reports: counts, coverage, risk, cache report, pack summaries, medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.functions.text import envelope, is_subsequence, upper_median
from loomctx.operators.graph import cut
from loomctx.operators.pack import item_type


def counts(nodes: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, skipped_files, chunks, signatures, docs, edges."""
    n = nodes.where("valid").agg(*(F.count_if(F.col("kind") == k).alias(c) for k, c in ((S.CHUNK, "chunks"), (S.SIGNATURE, "signatures"), (S.DOC, "docs"))))
    f = files.agg(F.count_if(F.col("skipped").isNull()).alias("files"), F.count_if(F.col("skipped").isNotNull()).alias("skipped_files"))
    return f.crossJoin(n).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each


def coverage(items: DataFrame) -> DataFrame:
    """By request and reason: items, tokens, distinct files."""
    return items.groupBy("request_id", "reason").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.count_distinct("path").alias("files"))


def risk(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Sufficiency flags and a risk level by request; a request without items lacks everything.

    Risks: stale files, no full implementation, no tests, chunks reduced to signatures. One is medium, two or more are high.
    """
    test = (F.col("type") == "test") | (F.col("reason") == "tested_by")
    flags = items.groupBy("request_id").agg(
        F.bool_or((F.col("type") == "ast_chunk") & F.col("reason").isin("anchor", "search_hit")).alias("has_direct"),
        F.bool_or(test).alias("has_tests"),
        F.bool_or(F.col("reason").isin("calls", "called_by")).alias("has_callers"),
        F.bool_or(F.col("type") == "doc_chunk").alias("has_docs"),
        F.count_if(F.col("type") == "signature").alias("substituted"),
    )
    out = requests.select("request_id", F.coalesce(F.size("dirty_paths"), F.lit(0)).alias("stale_files")).join(flags, "request_id", "left")
    out = out.fillna(False, ["has_direct", "has_tests", "has_callers", "has_docs"]).fillna(0, ["substituted"])
    n = F.when(F.col("stale_files") > 0, 1).otherwise(0) + F.when(F.col("has_direct"), 0).otherwise(1) + F.when(F.col("has_tests"), 0).otherwise(1) + F.when(F.col("substituted") > 0, 1).otherwise(0)
    return out.withColumn("risks", n).withColumn("level", F.when(n == 0, "low").when(n == 1, "medium").otherwise("high"))


def pack_summary(items: DataFrame) -> DataFrame:
    """By request: items, paths, counts by type and reason, items from edges, mean and greatest score."""
    by = lambda c: F.count_if(c)
    return items.groupBy("request_id").agg(
        F.count("*").alias("items"),
        F.count_distinct("path").alias("paths"),
        *(by(F.col("type") == t).alias(f"type_{t}") for t in ("ast_chunk", "signature", "doc_chunk", "test")),
        *(by(F.col("reason") == r).alias(f"reason_{r}") for r in ("anchor", "search_hit")),
        by(~F.col("reason").isin("anchor", "search_hit")).alias("graph_items"),
        F.round(F.avg("score"), 4).alias("avg_score"),
        F.max("score").alias("max_score"),
    )


def cache_report(hot: DataFrame, nodes: DataFrame, packs: DataFrame, latest: int = 50) -> DataFrame:
    """One row on the hot set and the latest packs.

    hot: version, position, node_id (all versions); packs: id, ts, hot_set_version, saved_pct, stable_ids. The score is the share of packs whose stable items
    are, on the current version, in the hot set's order; 1 without packs.
    """
    version = hot.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))
    current = hot.join(version, "version")
    env = envelope(F.col("id"), F.col("path"), item_type(F.lit(False), F.lit(""), F.col("kind")), F.col("line_start"), F.col("line_end"), F.col("symbol"), F.col("content"))
    live = current.join(nodes.where("valid"), F.col("node_id") == F.col("id"), "left")
    prefix = live.agg(F.count("*").alias("members"), F.count("id").alias("live_members"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("reusable_tokens"), F.coalesce(F.sum(F.octet_length(env)), F.lit(0)).alias("prefix_bytes"), F.transform(F.array_sort(F.collect_list(F.struct("position", "node_id"))), lambda x: x["node_id"]).alias("hot_ids"))
    recent = packs.orderBy(F.desc("ts"), F.desc("id")).limit(latest).crossJoin(F.broadcast(version)).crossJoin(F.broadcast(prefix.select("hot_ids")))  # one row each
    ok = (F.col("hot_set_version") == F.col("version")) & is_subsequence(F.col("stable_ids"), F.col("hot_ids"))
    log = recent.agg(F.count("*").alias("analyzed"), F.count_if(F.col("hot_set_version") == F.col("version")).alias("on_current"), F.count_if(ok).alias("consistent"), upper_median(F.collect_list("saved_pct")).alias("median_saved_pct"))
    score = F.when(F.col("analyzed") == 0, 1.0).otherwise(F.round(F.col("consistent") / F.col("analyzed"), 2))
    return version.crossJoin(prefix.drop("hot_ids")).crossJoin(log).withColumn("score", score)


def upper_medians(rows: DataFrame, key: str, value: str, bins: int = 1024) -> DataFrame:
    """(key, n, median): the middle of each key's values, the higher one of two; null values don't count.

    Exact, without a list of values: counts by ``bins`` ranges tell in which one the middle lies, and that one is cut up again until its
    ends are equal. A pass shuffles as many rows as there are ranges, whatever the number of values.
    """
    some = rows.select(F.col(key).alias("at"), F.col(value).alias("v")).where("v is not null")
    state = cut(some.groupBy(F.col("at").alias("of")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("rank", F.floor(F.col("n") / 2)))
    place = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    while not state.where("lo < hi").isEmpty():
        inside = some.join(state.where("lo < hi"), F.expr("at <=> of")).where("v between lo and hi")
        parts = inside.groupBy("of", "n", "rank", place.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("c").over(Window.partitionBy("of").orderBy("bin")) - F.col("c")
        found = parts.withColumn("before", before).where("rank >= before and rank < before + c").select("of", "n", "lo", "hi", (F.col("rank") - F.col("before")).alias("rank"))
        state = cut(state.where("lo = hi").unionByName(found))
    return state.select(F.col("of").alias(key), "n", F.col("lo").alias("median"))


def savings(totals: DataFrame) -> DataFrame:
    """One row: packs, upper median, mean (two decimals) and least of the saved percentages; the least is 100 at most."""
    middle = upper_medians(totals.withColumn("all", F.lit(True)), "all", "saved_pct").select(F.col("median").alias("median_saved_pct"))
    rest = totals.agg(F.count("*").alias("packs"), F.round(F.avg("saved_pct"), 2).alias("mean_saved_pct"), F.least(F.lit(100.0), F.min("saved_pct")).alias("min_saved_pct"))
    return rest.join(F.broadcast(middle), F.lit(True), "left").select("packs", "median_saved_pct", "mean_saved_pct", "min_saved_pct")  # one row each


def grouped_medians(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """True medians of the values by key, with the number of rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), *(F.round(F.median(v), 4).alias(f"median_{v}") for v in values))


def languages(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("valid") & (F.col("kind") == S.CHUNK)).groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("chunks"))


def recent(rows: DataFrame, n: int) -> DataFrame:
    """The latest rows by ts, then id."""
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def top_symbol(nodes: DataFrame) -> DataFrame:
    """The most central chunk outside of tests, else any: of equals the larger, then the lesser path."""
    chunks = nodes.where(F.col("valid") & (F.col("kind") == S.CHUNK))
    return chunks.withColumn("t", F.when(F.col("role") == "test", 1).otherwise(0)).orderBy("t", F.desc("centrality"), F.desc("tokens"), "path", "id").limit(1).drop("t")


