"""Training-corpus pipeline: five stages over ``documents``, each on all rows that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's input.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomctx.llm.decontam import contaminated_rows
from loomctx.llm.mixing import mix
from loomctx.llm.neardup import near_duplicate_rows
from loomctx.llm.pii import redacted
from loomctx.llm.queries import MIX_SHARE, mixture_levels, mixture_weights
from loomctx.llm.stage import ROW, numbered, tables, written
from loomctx.llm.toxicity import not_toxic


def _without(rows: DataFrame, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose number isn't among ``dropped``."""
    return rows.join(dropped.select(ROW).distinct(), ROW, "left_anti").select(columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return not_toxic(docs, tables(spark, sf_dir, "labels"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the one with the least id, of each group of near duplicates; rows without an id come last."""
    rows = numbered(docs)
    return _without(rows, near_duplicate_rows(rows).where(F.col("component") != F.col(ROW)), docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, re-parameterised or not."""
    rows = numbered(docs)
    return _without(rows, contaminated_rows(rows, tables(spark, sf_dir, "benchmark")), docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by the kind in angle brackets."""
    return redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken into the mixture, with the epoch that takes them and their tokens."""
    return mix(docs, mixture_levels(), MIX_SHARE, mixture_weights())


STAGES = [
    ("toxicity", toxic),
    ("minhash_near_dedup", near_duplicate),
    ("benchmark_decontamination", decontaminated),
    ("pii", without_personal_data),
    ("source_mixing", mixed),
]

#: The label model, the near-duplicate components and the boosted trees have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from ``documents``."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "text", "lang", "source", "n_chars", "epoch", "mix_tokens")
