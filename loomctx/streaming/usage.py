"""Streaming forms of the incremental parts: usage statistics from an event stream, and index runs driven by a file stream.

Extensions: they follow the batch operators (``usage_stats``, ``Engine.index``) and end in the same state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomctx.functions.text import ewma


def usage_stream(events: DataFrame, key: str = "node_id", delay: str = "1 hour") -> DataFrame:
    """Running (key, hits, last_used, ewma) of a stream (event_id, ts, key); events repeated within ``delay`` count once."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(key).agg(F.count("*").alias("hits"), F.max("ts").alias("last_used")).withColumn("ewma", F.round(ewma(F.col("hits")), 6))


def windowed_packs(events: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Packs and mean saved percentage by surface and window of event time; late events beyond ``delay`` are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), "surface").agg(F.count("*").alias("packs"), F.round(F.avg("saved_pct"), 4).alias("mean_saved_pct")).select(F.col("window.start").alias("start"), "surface", "packs", "mean_saved_pct")


def on_changes(spark: SparkSession, folder: str, run: Callable[[list[str]], None], checkpoint: str):
    """Calls ``run`` with the names of changed files, which a watcher writes as text lines into ``folder``, once for each micro-batch."""

    def act(batch: DataFrame, _: int) -> None:
        names = [r["value"] for r in batch.select(F.trim("value").alias("value")).where("value != ''").distinct().orderBy("value").collect()]
        if names:
            run(names)

    return spark.readStream.text(folder).writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
