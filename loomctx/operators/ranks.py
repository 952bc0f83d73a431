"""Degrees, their maximum and the most central nodes kept up to date by changes of edges, without reading the edges again.

* A change is signed: an added edge counts one at both ends, a removed one takes one away; only the nodes at those ends get new rows.
* The maximum must survive the removal of the node that has it, so a histogram (degree, nodes) is kept beside the degrees; the greatest degree with nodes is it.
* The pool holds more of the most central nodes than are asked for. All nodes outside it stand behind its floor, the place of the last one when it was filled;
  after a change only nodes at changed ends can have passed it, and those are met. While enough stand before the floor the pool is exact, else it is filled again from the degrees.

Tables: degrees (id, degree), histogram (degree, nodes), pool (id, degree) with its floor, one row (degree, id), none where all nodes are in it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomctx.operators.graph import cut, degrees


@dataclass
class Ranks:
    degrees: DataFrame
    histogram: DataFrame
    pool: DataFrame
    floor: tuple[int, str] | None
    refilled: bool = True


def _filled(table: DataFrame, size: int) -> tuple[DataFrame, tuple[int, str] | None]:
    """The first ``size`` nodes by falling degree, then id, and the place of the last of them if there are others."""
    first = cut(table.orderBy(F.desc("degree"), "id").limit(size + 1))
    last = first.orderBy(F.desc("degree"), "id").offset(size - 1).limit(2).collect()
    if len(last) < 2:
        return first, None
    floor = (last[0]["degree"], last[0]["id"])
    return first.where(_before(floor)), floor


def _before(floor: tuple[int, str]) -> Column:
    """At the floor or before it."""
    return (F.col("degree") > floor[0]) | ((F.col("degree") == floor[0]) & (F.col("id") <= floor[1]))


def from_edges(edges: DataFrame, pool: int = 400) -> Ranks:
    """Ranks of edges (src, dst) from nothing, with the ``pool`` most central nodes."""
    table = cut(degrees(edges))
    return Ranks(table, cut(table.groupBy("degree").agg(F.count("*").alias("nodes"))), *_filled(table, pool))


def changed(ranks: Ranks, added: DataFrame, removed: DataFrame, need: int = 200, pool: int = 400) -> Ranks:
    """Ranks after edges (src, dst) were added and removed; a removed edge must be there, one that is added and removed changes nothing.

    ``need`` nodes of the pool are exact afterwards, or all that there are. A node without edges is in none of the tables.
    """
    ends = lambda e, sign: e.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(sign).cast("long").alias("by"))
    delta = ends(added, 1).unionByName(ends(removed, -1)).groupBy("id").agg(F.sum("by").alias("by")).where("by != 0")
    touched = cut(delta.join(ranks.degrees, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("was"), (F.coalesce("degree", F.lit(0)) + F.col("by")).alias("degree")))
    table = cut(ranks.degrees.join(touched.select("id"), "id", "left_anti").unionByName(touched.where("degree > 0").select("id", "degree")))
    moves = touched.select(F.explode(F.array(F.struct(F.col("was").alias("degree"), F.lit(-1).cast("long").alias("nodes")), F.struct("degree", F.lit(1).cast("long").alias("nodes")))).alias("m")).select("m.*").where("degree > 0")
    histogram = cut(ranks.histogram.unionByName(moves).groupBy("degree").agg(F.sum("nodes").alias("nodes")).where("nodes > 0"))
    # whoever wasn't in the pool and hasn't been touched stands behind the floor, as before
    met = ranks.pool.join(touched.select("id"), "id", "left_anti").unionByName(touched.where("degree > 0").select("id", "degree"))
    met = cut(met if ranks.floor is None else met.where(_before(ranks.floor)))
    have = met.count()
    if ranks.floor is None or need <= have:
        if have <= 2 * pool:
            return Ranks(table, histogram, met, ranks.floor, False)
        # grown by touched nodes: its first ones again, with a nearer floor
        return Ranks(table, histogram, *_filled(met, pool), False)
    return Ranks(table, histogram, *_filled(table, pool))


def greatest(ranks: Ranks) -> DataFrame:
    """(top): the greatest degree, at least 1, from the histogram."""
    return ranks.histogram.agg(F.greatest(F.coalesce(F.max("degree"), F.lit(0)), F.lit(1)).alias("top"))


def centrality(ranks: Ranks) -> DataFrame:
    """(id, degree, centrality): as of all edges."""
    return ranks.degrees.crossJoin(F.broadcast(greatest(ranks))).select("id", "degree", (F.col("degree") / F.col("top")).alias("centrality"))  # one row


def most_central(ranks: Ranks, limit: int = 200) -> DataFrame:
    """(id, degree, centrality) of the first nodes by falling degree, then id, from the pool alone; ``limit`` is at most what ``changed`` was asked to need."""
    return ranks.pool.orderBy(F.desc("degree"), "id").limit(limit).crossJoin(F.broadcast(greatest(ranks))).select("id", "degree", (F.col("degree") / F.col("top")).alias("centrality"))
