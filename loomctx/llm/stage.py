"""Lineage cuts and small helpers shared by the training-data operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` (shared by driver and executors);
only where that is unset and the executors are threads of this process, as in tests, a folder of this machine is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PATHS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, from the session; a local one where it names none and has no executors elsewhere, else an error."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (None if known.isEmpty() else known.get())
    if named:
        return str(named).rstrip("/")
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    local = "file://" + tempfile.mkdtemp(prefix="loomctx-")
    sc.setCheckpointDir(local)
    return local


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _PATHS.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete written tables that nothing still to be run reads."""
    for df in frames:
        path = df.__dict__.pop("_written_path", None)
        if path is not None:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_written() -> None:
    """Delete every intermediate table of this process; results that still read them become invalid."""
    while _PATHS:
        spark, path = _PATHS.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the shared folder's owner cleans up
            return


atexit.register(drop_written)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Column of the rows' numbers.
ROW = "__row_number"


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs``, or these columns of it, with a unique long in ``ROW``, in the order of doc_id, null ids last.

    It is doc_id itself where that is unique; only where ids repeat or are null are the rows written once more.
    """
    key = F.col("doc_id").cast("long")
    odd = docs.groupBy(key.alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    rows = docs.drop(ROW).select(*columns) if columns else docs.drop(ROW)
    if not odd:
        return rows.withColumn(ROW, key)
    order = [key.asc_nulls_last(), F.xxhash64("text")]
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(ROW, F.monotonically_increasing_id()), "rows")


def numbers_differ(rows: DataFrame) -> bool:
    """Whether rows of ``numbered`` got numbers other than their doc_id, for which they were written once more."""
    return "_written_path" in rows.__dict__


def small_batches(spark: SparkSession, records: int = 1000, size: int = 8 << 20) -> None:
    """Bound the Arrow batches sent to Python from now on, so that long rows can't fill a worker's memory."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", records), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = str(spark.conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def raw_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body): the text's UTF-8 bytes, so Python kernels never decode. Arrow batches are bounded from here on."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))


def key_groups(batches, keys: list[str]):
    """Tables of the rows with equal keys, from batches sorted by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        values = [np.asarray(table[k]) for k in keys]
        cut = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        at = [0, *cut.tolist()]
        for a, b in zip(at, at[1:]):
            yield table.slice(a, b - a)
        rest = table.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield rest
