"""The versioned hot set: signatures of the most central chunks under a token cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.operators.pack import _first


def top_chunks(nodes: DataFrame, limit: int) -> DataFrame:
    """Most central valid chunks; of equals the smaller, then the lesser id."""
    return nodes.where(F.col("valid") & (F.col("kind") == S.CHUNK)).orderBy(F.desc("centrality"), "tokens", "id").limit(limit)


def hot_members(nodes: DataFrame, pool: int = S.HOT_POOL, cap: int = S.HOT_TOKENS, most: int = S.HOT_MEMBERS) -> DataFrame:
    """(position, node_id), ordered by id. One fold over at most ``pool`` rows; a member that would pass the cap is left out, later ones may fit."""
    top = top_chunks(nodes, pool).where("centrality > 0").join(_first(nodes.where("valid"), S.SIGNATURE, "sig"), ["path", "symbol"], "left")
    item = F.struct((-F.col("centrality")).alias("c"), "tokens", "id", F.coalesce("sig_id", "id").alias("member"), F.coalesce("sig_tokens", "tokens").alias("cost"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        ok = (acc["used"] + x["cost"] <= cap) & (F.size(acc["ids"]) < most)
        return F.when(ok, F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["ids"], F.array(x["member"])).alias("ids"))).otherwise(acc)

    ids = top.agg(F.array_sort(F.collect_list(item)).alias("x")).select(F.array_sort(F.aggregate("x", zero, step, lambda a: a["ids"])).alias("ids"))
    return ids.select(F.posexplode("ids").alias("position", "node_id")).select((F.col("position") + 1).cast("long").alias("position"), "node_id")


def next_version(previous: DataFrame, members: DataFrame, keep: int = S.HOT_VERSIONS) -> DataFrame:
    """The hot-set table after a run: unchanged if the members are those of the latest version, else with a new version and the last ``keep`` only."""
    latest = previous.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v"))
    now = previous.join(latest, F.col("version") == F.col("v"))
    differs = members.join(now.select("position", "node_id"), ["position", "node_id"], "full_outer").join(members.withColumn("here", F.lit(1)), ["position", "node_id"], "left").join(now.select("position", "node_id", F.lit(1).alias("there")), ["position", "node_id"], "left")
    changed = differs.agg(F.coalesce(F.bool_or(F.col("here").isNull() | F.col("there").isNull()), F.lit(False)).alias("changed"))
    new = members.crossJoin(latest).crossJoin(changed).where("changed").select((F.col("v") + 1).alias("version"), "position", "node_id")  # one row each
    every = previous.select("version", "position", "node_id").unionByName(new)
    newest = every.agg(F.max("version").alias("newest"))
    return every.crossJoin(newest).where(F.col("version") > F.col("newest") - keep).drop("newest")
