"""Connected components of an edge table, by hooking in partitions and shortcutting in joins.

Edges stay distributed, each from a larger to a smaller node. A round deals them by their larger node, replaces what meets in a task by stars
around the least node of each of its components, and then lets every edge end where the edge after it ends. The only node
with many edges is a small one, which a round meets in a join whose skewed keys Spark splits. A round's table is written, the one before it
deleted; three numbers reach the driver. Every round lowers an edge until all are stars, so it ends whatever the graph; rounds grow with
the logarithm of its diameter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomctx.llm.stage import release, written


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components, each from a node to the least of its component; none for the least nodes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        # hook the roots, not only the nodes, so that long chains shrink by halves
        for x in (label[a], label[b], a, b):
            np.minimum.at(now, x, low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    there = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[there], nodes[label[there]]


def _hook(batches):
    parts = [b for b in batches if b.num_rows]
    if parts:
        u, v = (np.concatenate([np.asarray(b.column(k)) for b in parts]) for k in "uv")
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(u, v)], names=["u", "v"])


def forest(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that is not the smallest of its component.

    ``edges`` has two integer columns; direction, repeats, nulls and loops don't matter. An empty table gives none.
    """
    a, b = (F.col(c).cast("long") for c in edges.columns)
    now, last = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)), None
    while True:
        hooked = now.repartition("u").mapInArrow(_hook, "u long, v long")
        # a node that several tasks hooked has several edges, which all stay; what ends in it goes on to the least. The keys are negated so that
        # both sides of the join are shuffled for it, which lets Spark split a key that a third of the edges share
        then = hooked.groupBy("u").agg(F.min("v").alias("w")).select((-F.col("u")).alias("key"), "w")
        moved = hooked.withColumn("key", -F.col("v")).join(then, "key", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved"))
        now = written(moved, "edges")
        if last is not None:
            release(last)
        n, distinct, open_ = now.agg(F.count("*"), F.count_distinct("u"), F.count_if("moved")).first()
        if n == distinct and not open_:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        now, last = now.select("u", "v"), now


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node with an edge; component is the smallest id reachable. As ``forest``, with the smallest nodes themselves."""
    found = forest(edges)
    a, b = edges.columns
    alone = edges.select(F.col(a).cast("long").alias("id")).union(edges.select(F.col(b).cast("long").alias("id"))).where("id is not null").distinct()
    return alone.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
