"""Markdown sections without leaving SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sections below so many bytes are dropped.
LEAST_BYTES = 30


def markdown_sections(docs: DataFrame, key: str, text: str, least: int = LEAST_BYTES) -> DataFrame:
    """(key, section, heading, line_start, line_end, body): a section begins at any line that starts with ``#``, in code fences too.

    What stands before the first one has an empty heading. Lines count from 1; the empty piece after the last line end is no line.
    """
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(text, "\n\\z", ""), "\n")).alias("pos", "line"))
    head = F.col("line").startswith("#")
    lines = lines.withColumn("section", F.sum(head.cast("int")).over(Window.partitionBy(key).orderBy("pos")))
    rows = lines.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"), F.max(F.when(head, F.trim(F.regexp_replace("line", "^#+", "")))).alias("heading"))
    body = F.concat(F.array_join(F.transform("x", lambda i: i["line"]), "\n"), F.lit("\n"))
    out = rows.select(key, "section", F.coalesce("heading", F.lit("")).alias("heading"), (F.get("x", 0)["pos"] + 1).cast("long").alias("line_start"), (F.get("x", F.size("x") - 1)["pos"] + 1).cast("long").alias("line_end"), body.alias("body"))
    return out.where(F.octet_length("body") >= least)
