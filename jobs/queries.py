"""The jobs as queries: each runs twice into a folder of its own below the shared one and returns its output as the second run left it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import context_packs, index_documents
from loomctx.plans import pack_twin
from loomctx.plans.catalogue import FOLD
from loomctx.session import shared_folder


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        index_documents.run(spark, f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/checkpoint")
    return index_documents.result(spark, f"{at}/index")


def job2_context_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        context_packs.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", at, 2000)
    return context_packs.result(spark, at)


QUERIES = {"job1_index_documents": job1_index_documents, "job2_context_packs": job2_context_packs}
ORACLES = {
    "job1_index_documents": rf"""WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all({FOLD.format("text")}, '[\p{{L}}\p{{N}}_]+')) AS term FROM documents WHERE text IS NOT NULL),
      p AS (SELECT term, id, count(*) AS tf FROM t GROUP BY ALL)
      SELECT term, id, tf, CAST(sum(tf) OVER (PARTITION BY id) AS BIGINT) AS dl, count(*) OVER (PARTITION BY term) AS df FROM p""",
    "job2_context_packs": f"{pack_twin.packs((2000,))} SELECT {pack_twin.ITEMS}, mode FROM packed",
}
