"""Incremental maintenance as set operations between snapshots, and the bookkeeping of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.functions.text import ewma, preservation


def classify_files(now: DataFrame, before: DataFrame, force: bool = False) -> DataFrame:
    """``status`` of each file: unchanged (same mtime and size, not skipped before), touched (same content), changed, new, deleted.

    now: path, mtime, size, content_sha; before: the same with ``skipped``. ``force`` makes every file that is there changed or new.
    """
    old = before.select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.col("content_sha").alias("old_sha"), F.col("skipped").alias("old_skipped"), F.lit(True).alias("was"))
    both = now.withColumn("is", F.lit(True)).join(old, "path", "full_outer")
    same_stat = (F.col("mtime") == F.col("old_mtime")) & (F.col("size") == F.col("old_size")) & F.col("old_skipped").isNull()
    status = F.when(F.col("is").isNull(), "deleted").when(F.col("was").isNull(), "new")
    if not force:
        status = status.when(F.coalesce(same_stat, F.lit(False)), "unchanged").when(F.coalesce(F.col("content_sha") == F.col("old_sha"), F.lit(False)), "touched")
    return both.withColumn("status", status.otherwise("changed")).drop("is", "was")


def dirty_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Known paths whose mtime or size differ, or that are gone; new files aren't reported."""
    return before.select("path", F.col("mtime").alias("m"), F.col("size").alias("s")).join(now.select("path", "mtime", "size"), "path", "left").where(~(F.col("mtime").eqNullSafe(F.col("m")) & F.col("size").eqNullSafe(F.col("s")))).select("path")


def members(files: DataFrame) -> DataFrame:
    """(path, id) of every entry of the files' merkle lists."""
    return files.select("path", F.explode("merkle").alias("e")).select("path", "e.id").distinct()


def node_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, id, change): added or removed entries of a path; old and new: path, id. One aggregate over both: entries may repeat."""
    both = old.select("path", "id", F.lit(True).alias("was")).unionByName(new.select("path", "id", F.lit(False).alias("was")))
    sides = both.groupBy("path", "id").agg(F.min("was").alias("a"), F.max("was").alias("b"))
    return sides.where("a = b").select("path", "id", F.when(F.col("a"), "removed").otherwise("added").alias("change"))


def stale_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids that no path holds any more, whatever their kind: a node that another file still has stays valid."""
    return old.select("id").distinct().join(new.select("id"), "id", "left_anti")


def supersedes(changes: DataFrame) -> DataFrame:
    """Edges new -> old for paths with exactly one chunk added and one removed."""
    one = changes.groupBy("path").agg(F.count_if(F.col("change") == "added").alias("a"), F.count_if(F.col("change") == "removed").alias("r"), F.max(F.when(F.col("change") == "added", F.col("id"))).alias("src"), F.max(F.when(F.col("change") == "removed", F.col("id"))).alias("dst"))
    return one.where("a = 1 and r = 1").select("src", F.lit(S.SUPERSEDES).alias("kind"), "dst", F.lit(1.0).alias("weight"))


def upsert(old: DataFrame, new: DataFrame, key: str, refreshed: tuple[str, ...]) -> DataFrame:
    """Keyed merge: new keys come in whole; known ones take the ``refreshed`` columns and keep the rest. Adds ``is_new``."""
    there = F.col("__new").isNotNull()
    cols = [F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in refreshed else F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in old.columns if c != key]
    both = old.withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), key, "full_outer")
    return both.select(key, *cols, F.col("__old").isNull().alias("is_new"))


def index_report(status: DataFrame, changes: DataFrame, preserved: DataFrame) -> DataFrame:
    """One row of counters. status: path, status; changes: path, id, change; preserved: ids in both snapshots."""
    s = status.agg(F.count_if(F.col("status") != "deleted").alias("files_seen"), F.count_if(F.col("status").isin("new", "changed")).alias("files_indexed"), F.count_if(F.col("status").isin("unchanged", "touched")).alias("files_unchanged"), F.count_if(F.col("status") == "deleted").alias("files_deleted"))
    c = changes.agg(F.count_if(F.col("change") == "added").alias("chunks_new"), F.count_if(F.col("change") == "removed").alias("chunks_staled"))
    out = s.crossJoin(c).crossJoin(preserved.agg(F.count("*").alias("chunks_preserved")))  # one row each
    return out.withColumn("preservation_pct", preservation(F.col("chunks_preserved"), F.col("chunks_staled")))


def retained(log: DataFrame, keep: int = S.PACKS_KEPT) -> DataFrame:
    """The latest rows of a log by (ts, id): a top-k with a merge of partial results, not one sorted partition."""
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(keep)


def usage_stats(events: DataFrame, key: str = "node_id") -> DataFrame:
    """(key, hits, last_used, ewma) from usage events (key, ts)."""
    return events.groupBy(key).agg(F.count("*").alias("hits"), F.max("ts").alias("last_used")).withColumn("ewma", F.round(ewma(F.col("hits")), 6))


def collect_garbage(nodes: DataFrame, edges: DataFrame, now, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left after stale nodes older than ``days`` and edges without both ends are gone."""
    kept = nodes.where(~(~F.col("valid") & (F.col("staled_at") < now - F.expr(f"interval {days} days"))) | F.col("staled_at").isNull())
    ids = kept.select("id")
    return kept, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)
