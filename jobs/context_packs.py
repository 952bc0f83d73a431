"""Builds budgeted context packs from a document table for a table of requests.

    python -m jobs.context_packs --documents PATH --requests PATH --packs PATH --budget 2000

Every request (item_id, text) gets the documents, signatures and related requests that serve it best under the token budget: by names, BM25
search and mentions, ranked by the profile of the request's mode. Packs are written as ``items`` and ``totals`` below the given
path, partitioned by mode. A run replaces the partitions of the modes it is asked for and leaves the others alone; repeating
it gives the same rows.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import settings
from loomctx import schema as S
from loomctx.plans import adapters, pack_twin

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "context_packs.json")
SETTINGS = {"documents": str, "requests": str, "packs": str, "budget": int, "modes": str}
log = logging.getLogger("jobs.context_packs")


def run(spark: SparkSession, documents: str, requests: str, packs: str, budget: int = S.DEFAULT_BUDGET, modes: str = "all") -> dict:
    """Writes the packs of requests in ``modes`` (names with commas between, or all); numbers of rows read and written.

    An unknown mode is an error. A mode of which no request is left keeps the partition it had, unless all modes are written.
    """
    wanted = list(S.MODES) if modes == "all" else [m.strip() for m in modes.split(",")]
    for m in wanted:
        S.profile(m)
    docs, items = spark.read.parquet(documents), spark.read.parquet(requests)
    done = {"documents": docs.count(), "requests": items.count()}
    log.info("read %s: %d rows, %s: %d rows", documents, done["documents"], requests, done["requests"])
    mode = adapters.requests_of_items(items, budget).select("request_id", "mode")
    # every item is a node of the graph that packs are taken from; only those of the wanted modes ask
    built, sums = adapters.document_packs(docs, items, budget, modes=wanted)[0]
    for name, rows in (("items", pack_twin.flat(built)), ("totals", sums.drop("hot_set_version"))):
        partitions = "dynamic" if modes != "all" else "static"
        rows.join(mode, "request_id").repartition("mode").write.mode("overwrite").option("partitionOverwriteMode", partitions).partitionBy("mode").parquet(f"{packs}/{name}")
        done[name] = spark.read.parquet(f"{packs}/{name}").where(F.col("mode").isin(wanted)).count()
        log.info("wrote %s/%s: %d rows of modes %s", packs, name, done[name], ", ".join(wanted))
    return done


def result(spark: SparkSession, packs: str) -> DataFrame:
    """All items as they stand, with their mode."""
    return spark.read.parquet(f"{packs}/items")


def main(arguments: list[str] | None = None) -> None:
    given = settings(__doc__, CONFIG, SETTINGS, arguments)
    from loomctx.session import session

    spark = session()
    try:
        run(spark, **given)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
