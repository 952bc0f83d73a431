"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language a raw-content zstandard dictionary is filled with whole training texts. Texts are lower-cased
(A-Z) and everything but letters becomes single spaces; what is left is compressed whole with every
dictionary, and the smallest result names the language. The score grows with the gap to the next
smallest; below ``narrow`` the prediction is marked rejected, its best guess kept.

Training reads whole texts of a bounded sample of rows: of the ``languages`` most frequent languages each gives texts, lowest hash of doc_id first and
those longer than a quarter of ``size`` last, until they have ``size`` bytes, ``sample`` of them at most. So a dictionary has ``size`` bytes and
a text more at most, at any number of rows or languages. The chosen ids, at most ``languages * sample``, are broadcast.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomctx.llm.stage import raw_text, small_batches
from loomctx.llm.toxicity import held_out

UNKNOWN = "und"
#: Times the sample that hashes leave of a language before it is ranked, and the hashes' range.
SPARE, HASHES = 8, 1 << 30
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTER = re.compile(r"[^\W\d_]")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def squeezed(body: bytes) -> bytes:
    return b" ".join(body.translate(_TABLE).split())


def has_letter(body: bytes) -> bool:
    return bool(_ASCII_LETTER.search(body)) or any(c.isalpha() for c in body.decode("utf-8", "replace"))


def _flat(batches):
    for batch in batches:
        bodies = [squeezed(b or b"") for b in batch.column("body").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("doc_id"), pa.array(bodies, pa.binary())], names=["lang", "doc_id", "flat"])


def _classify(dictionaries: dict[str, bytes], level: int, narrow: float):
    def kernel(batches):
        names = sorted(dictionaries)
        coders = []
        for n in names:
            d = zstandard.ZstdCompressionDict(dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False, level=level))
        for batch in batches:
            out = []
            for body in batch.column("body").to_pylist():
                if not body or not names or not has_letter(body):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                flat = squeezed(body)
                sizes = [len(c.compress(flat)) for c in coders]
                order = np.argsort(sizes, kind="stable")
                gap = 1.0 if len(sizes) == 1 else 1 - sizes[order[0]] / sizes[order[1]]
                out.append((names[order[0]], float(1 - np.exp(-20 * gap)), gap < narrow))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return kernel


def dictionaries(docs: DataFrame, sample: int = 400, size: int = 256 << 10, languages: int = 1000, folds: int = 4, fold: int = 2) -> dict[str, bytes]:
    """A raw-content dictionary for each of the most frequent languages of the training rows, ties by name."""
    train = docs.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"), folds, fold))
    counted = train.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    names = sorted(r["lang"] for r in counted)
    if not names:
        return {}
    order = Window.partitionBy("lang").orderBy(F.col("bytes") > size // 4, F.xxhash64("doc_id"), "doc_id", "bytes")
    known = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], min(1.0, SPARE * sample / r["ids"]) * HASHES) for r in counted], "lang string, share double"))
    first = train.select("doc_id", "lang", F.octet_length("text").cast("long").alias("bytes")).where("bytes > 0").join(known, "lang")
    # some times the sample is left for one task of a language to rank, however many rows it has
    first = first.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(HASHES)) < F.col("share")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)
    before = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chosen = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < size).select("doc_id", "lang").distinct()
    small_batches(docs.sparkSession)
    texts = docs.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    # rows that repeat an id give one text to a dictionary
    rows = texts.mapInArrow(_flat, "lang string, doc_id long, flat binary").groupBy("lang", "doc_id").agg(F.min("flat").alias("flat")).collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"])):
        out[r["lang"]] = out.get(r["lang"], b"") + bytes(r["flat"]) + b" "
    return {k: v for k, v in out.items() if len(v) >= 8}


def identify(docs: DataFrame, level: int = 6, narrow: float = 0.01, **parameters) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for each row of ``docs``.

    ``und`` and 0 for a null text or one without a letter, and where no language could be learned. Texts of any length
    are compressed whole; repeated rows are each returned; an empty table gives an empty result. Languages beyond the ``languages`` most
    frequent of the training rows are not learned.
    """
    known = dictionaries(docs, **parameters)
    found = raw_text(docs).mapInArrow(_classify(known, level, narrow), "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id"), parameters.get("folds", 4), parameters.get("fold", 2)).alias("held_out"), "lang_pred", "score", "rejected")
