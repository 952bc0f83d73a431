"""Keeps a search index of a growing document table: a file stream that takes only files it has not seen.

    python -m jobs.index_documents --documents PATH --index PATH --checkpoint PATH

Each run takes what has come since the last one, in batches of so many files, and ends. A document replaces an earlier one of its id, one
without text deletes it. Batches are numbered by the checkpoint and written over what a broken run left of them, so running
again, also after a failure, gives the same index. Its tables are those of ``loomctx.operators.postings``, partitioned by batch and term bucket.
"""

from __future__ import annotations

import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.settings import settings
from loomctx.operators import postings
from loomctx.operators.graph import stored

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "index_documents.json")
SETTINGS = {"documents": str, "index": str, "checkpoint": str, "id_column": str, "text_column": str, "files_per_batch": int}
log = logging.getLogger("jobs.index_documents")


def run(spark: SparkSession, documents: str, index: str, checkpoint: str, id_column: str = "doc_id", text_column: str = "text", files_per_batch: int = 1000) -> dict:
    """Takes the new files of ``documents`` into ``index``; the number of rows read, documents written and deleted, and the newest batch.

    ``checkpoint`` belongs to one pair of documents and index. Rows without an id are counted and left out. Of rows that share an id in a batch, the one whose text comes last in
    order stands, one without text before any other.
    """
    done = {"read": 0, "written": 0, "deleted": 0, "without_id": 0}

    def take(rows: DataFrame, batch: int) -> None:
        rows = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
        # written once, as it is read several times below and its texts would be shuffled each time
        known = stored(rows.where("id is not null").groupBy("id").agg(F.max("text").alias("text")))
        present, absent = known.where("text is not null"), known.where("text is null").select("id")
        postings.write_batch(spark, index, batch, present, "id", "text", deleted=absent)
        counts = rows.agg(F.count("*").alias("read"), F.count_if(F.col("id").isNull()).alias("without_id")).first()
        counts = counts.asDict() | {"written": present.count(), "deleted": absent.count()}
        for k, v in counts.items():
            done[k] += v
        log.info("batch %d of %s: %s", batch, documents, counts)

    known = spark.read.parquet(documents)
    stream = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", files_per_batch).parquet(_streamed(known, documents))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done["batch"] = postings.last_batch(spark, index)
    log.info("wrote %s: %s", index, done)
    return done


def _streamed(known: DataFrame, path: str) -> str:
    """The path for a file stream, which takes folders and patterns: a pattern with one meaning where it is a single file."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    single = [f.rsplit("/", 1)[-1] for f in known.inputFiles()] == [name]
    return f"{path[:-1]}[{path[-1]}]" if single else path


def result(spark: SparkSession, index: str, id_type: str = "bigint") -> DataFrame:
    """The whole index as it stands: (term, id, tf, dl, df) of every live document's terms."""
    read = postings.read(spark, index, id_type)
    return postings.postings(read).join(read.df, ["bucket", "term"]).select("term", "id", "tf", "dl", "df")


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
