"""An inverted index in blocks with impact bounds, kept as Parquet by batches, and exact top-k search that reads and scores what can matter.

Tables of an index, each in a folder of its own with a folder for each batch below:

* ``forward`` (id, dl, terms, codes, tfs): the terms of each document by their codes, by which single documents are scored;
* ``blocks`` (bucket, term, shard, block, n, max_tf, min_dl, postings): a term's postings of a shard of documents by falling
  impact, ``BLOCK`` to a row. A block's greatest part of a score follows from its greatest ``tf`` and least ``dl`` at any average length, so bounds hold as the index grows;
* ``df`` (bucket, term, df) and ``stats`` (docs, words): what the batch adds to counts, less what it takes away;
* ``gone`` (id, of): documents of earlier batches that this batch replaces or deletes. Their postings stay in their blocks and are passed over.

A batch is written over whatever a failed run left of it, ``stats`` last, so repeating it gives the same tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomctx.functions.text import words
from loomctx.operators.graph import sent, stored
from loomctx.operators.search import B, K1, _body, fold, query_terms

#: Postings of a block and documents of a shard, so that no term's postings are sorted in one task.
BLOCK, SHARD = 128, 250_000
#: Bytes of text that a task splits and postings that a task sorts: more documents are more tasks, not larger ones.
TEXT, POSTS = 4 << 20, 1_000_000
#: Folders of a batch by term.
BUCKETS = 16
#: Document length at which impacts are compared when postings are sorted; bounds don't depend on it.
PIVOT = 256.0
#: Of each query, terms whose best blocks are read first and documents that are scored for a first threshold.
PROBED_TERMS, PROBED_DOCS = 16, 96
#: Scores are rounded to six digits, so thresholds give way by two of the last.
MARGIN = 2e-6

_POSTING = "struct<id:{id},tf:bigint,dl:bigint>"
SCHEMAS = {
    "forward": "id {id}, dl long, terms array<string>, codes array<bigint>, tfs array<bigint>",
    "blocks": f"bucket int, term string, shard long, block long, n long, max_tf long, min_dl long, postings array<{_POSTING}>",
    "df": "bucket int, term string, df long",
    "stats": "docs long, words long",
    "gone": "id {id}, of long",
}


@dataclass
class Index:
    """Live documents (``forward``), blocks with their ``batch``, document frequencies, and documents that blocks still hold but searches pass over."""

    forward: DataFrame
    blocks: DataFrame
    df: DataFrame
    stats: DataFrame
    gone: DataFrame | None = None


def code(term):
    """Number of a term. Documents are scored by these, which is exact unless two terms share one; searches look for that."""
    return F.xxhash64(term)


def bucket(number):
    return F.pmod(number, F.lit(BUCKETS)).cast("int")


def forward(docs: DataFrame, id_col: str, *texts: str) -> DataFrame:
    """(id, dl, terms, codes, tfs) of documents with any word; ids are unique. Only texts are shuffled, and once."""
    bodies = docs.select(F.col(id_col).alias("id"), _body(texts).alias("text"))
    size = bodies.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = bodies.repartition(max(1, -(-size // TEXT)), "id").select("id", words(fold(F.col("text"))).alias("w"))
    counted = found.select("id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    listed = counted.groupBy("id", "dl").agg(F.array_sort(F.collect_list(F.struct(code("term").alias("code"), "term", "tf"))).alias("t"))
    return listed.select("id", "dl", F.col("t.term").alias("terms"), F.col("t.code").alias("codes"), F.col("t.tf").alias("tfs"))


def blocks(listed: DataFrame) -> DataFrame:
    """Blocks of these documents' postings, dealt by ranges of terms; equal impacts go by id."""
    docs, n = listed.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    shards, tasks = max(1, -(-docs // SHARD)), max(1, -(-n // POSTS))
    posts = listed.select("id", "dl", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    posts = posts.select("shard", bucket(code("t.terms")).alias("bucket"), F.col("t.terms").alias("term"), "id", F.col("t.tfs").alias("tf"), "dl")
    order = Window.partitionBy("shard", "bucket", "term").orderBy((K1 * (1 - B) + K1 * B / PIVOT * F.col("dl")) / F.col("tf"), "id")
    placed = posts.repartitionByRange(tasks, "shard", "bucket", "term").withColumn("k", F.row_number().over(order)).withColumn("block", F.floor((F.col("k") - 1) / BLOCK))
    row = F.struct("id", "tf", "dl")
    made = placed.groupBy("shard", "bucket", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.array_sort(F.collect_list(F.struct("k", row.alias("p")))).alias("ps"))
    return made.select("bucket", "term", "shard", "block", "n", "max_tf", "min_dl", F.col("ps.p").alias("postings"))


def _df(listed: DataFrame, sign: int = 1) -> DataFrame:
    return listed.select(F.explode("terms").alias("term")).groupBy("term").agg((F.count("*") * sign).alias("df")).select(bucket(code("term")).alias("bucket"), "term", "df")


def _stats(listed: DataFrame, sign: int = 1) -> DataFrame:
    return listed.agg((F.count("*") * sign).alias("docs"), F.coalesce(F.sum("dl") * sign, F.lit(0).cast("long")).alias("words"))


def build(docs: DataFrame, id_col: str, *texts: str) -> Index:
    """An index for the use of one session."""
    listed = stored(forward(docs, id_col, *texts))
    made = stored(blocks(listed))
    counts = made.groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    return Index(listed, made.withColumn("batch", F.lit(0).cast("long")), counts, _stats(listed))


def _read(spark: SparkSession, path: str, name: str, id_type: str, first: int, last: int) -> DataFrame:
    """Rows of batches first to last; a folder that isn't there yet gives none."""
    schema = SCHEMAS[name].format(id=id_type) + ", batch long"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if last < first or not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col("batch").between(first, last))


def last_batch(spark: SparkSession, path: str) -> int:
    """The newest whole batch, -1 before the first."""
    return _read(spark, path, "stats", "string", 0, 1 << 62).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]


def read(spark: SparkSession, path: str, id_type: str = "string", upto: int | None = None) -> Index:
    """The index as of a batch, the newest whole one unless told otherwise."""
    last = last_batch(spark, path) if upto is None else upto
    tables = {name: _read(spark, path, name, id_type, 0, last) for name in SCHEMAS}
    gone = tables["gone"].select("id", F.col("of").alias("batch"))
    counts = tables["df"].groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
    stats = tables["stats"].agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    return Index(tables["forward"].join(gone, ["id", "batch"], "left_anti"), tables["blocks"], counts, stats, gone)


def write_batch(spark: SparkSession, path: str, batch: int, docs: DataFrame, id_col: str, *texts: str, deleted: DataFrame | None = None) -> None:
    """Adds documents, which replace those of the same id, and deletes those of ``deleted`` (id). What stays is neither read as a whole nor written again."""
    id_type = docs.schema[id_col].dataType.simpleString()
    folder = lambda name: f"{path}/{name}/batch={batch}"
    ids = docs.select(F.col(id_col).alias("id"))
    if deleted is not None:
        ids = ids.unionByName(deleted.select("id"))
    forward(docs, id_col, *texts).write.mode("overwrite").parquet(folder("forward"))
    before = read(spark, path, id_type, batch - 1).forward
    left = before.join(ids.distinct(), "id", "left_semi")
    left.select("id", F.col("batch").alias("of")).write.mode("overwrite").parquet(folder("gone"))
    listed = spark.read.schema(SCHEMAS["forward"].format(id=id_type)).parquet(folder("forward"))
    lost = spark.read.schema(SCHEMAS["gone"].format(id=id_type)).parquet(folder("gone")).select("id", F.col("of").alias("batch"))
    lost = _read(spark, path, "forward", id_type, 0, batch - 1).join(lost, ["id", "batch"], "left_semi")
    made = blocks(listed)
    made.write.mode("overwrite").partitionBy("bucket").parquet(folder("blocks"))
    counts = _df(listed).unionByName(_df(lost, -1)).groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df != 0")
    counts.repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(folder("df"))
    both = _stats(listed).unionByName(_stats(lost, -1)).agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"))
    both.coalesce(1).write.mode("overwrite").parquet(folder("stats"))


def postings(index: Index) -> DataFrame:
    """(bucket, term, id, tf, dl) of every live document."""
    rows = index.blocks.select("bucket", "term", "batch", F.explode("postings").alias("p")).select("bucket", "term", "batch", "p.id", "p.tf", "p.dl")
    return _live(rows, index).drop("batch")


def _live(rows: DataFrame, index: Index) -> DataFrame:
    return rows if index.gone is None else rows.join(index.gone, ["id", "batch"], "left_anti")


def _sums(k1: float, b: float, mean: float):
    """Scores of pairs from a document's codes, which are in order, and a query's codes and weights."""

    def kernel(batches):
        for batch in batches:
            lists = {}
            for name in ("codes", "tfs", "q_codes", "q_weights"):
                column = batch.column(name)
                lists[name] = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
            length = k1 * (1 - b + b * np.asarray(batch.column("dl")) / mean)
            score = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                codes, tfs, asked, weights = (values[at[i] : at[i + 1]] for values, at in lists.values())
                at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
                hit = codes[at] == asked
                tf = tfs[at[hit]]
                score[i] = (weights[hit] * tf / (tf + length[i])).sum()
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(score)], names=["query_id", "id", "score"])

    return kernel


def _scored(pairs: DataFrame, asked: DataFrame, index: Index, mean: float, clash: bool) -> DataFrame:
    """``pairs`` (query_id, id) with their whole scores, from the documents' terms: by codes, by the terms where codes clash."""
    key = "terms" if clash else "codes"
    # a few documents of each query: their ids go to the documents' terms, not the terms of all documents to them
    found = sent(stored(pairs)).join(index.forward.select("id", "dl", key, "tfs"), "id").join(asked.select("query_id", f"q_{key}", "q_weights"), "query_id")
    if clash:
        at = lambda values, keys, t: F.element_at(values, F.array_position(F.col(keys), t).cast("int"))
        parts = F.transform(F.array_intersect("terms", "q_terms"), lambda t: F.struct(at("q_weights", "q_terms", t).alias("w"), at("tfs", "terms", t).alias("tf")))
        score = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["w"] * p["tf"] / (p["tf"] + K1 * (1 - B + B * F.col("dl") / mean)))
        found = found.select("query_id", "id", score.alias("score"))
    else:
        types = dict(found.dtypes)
        found = found.mapInArrow(_sums(K1, B, mean), f"query_id {types['query_id']}, id {types['id']}, score double")
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


def _nth(rows: DataFrame, n: int) -> DataFrame:
    """(query_id, floor): the n-th greatest score of each query that has so many."""
    best = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("nth") <= n)
    return best.where(F.col("nth") == n).select("query_id", F.col("score").alias("floor"))


def _most(rows: DataFrame, by: str, n: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(by), "id")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def top_hits(index: Index, queries: DataFrame, k: int, counts: dict[str, DataFrame] | None = None) -> DataFrame:
    """(query_id, id, score) of the ``k`` documents with the greatest BM25 scores of each query (query_id, query); equal scores go by id.

    Exact, with three thresholds. First the best blocks of each query's weightiest terms name documents, and the k-th greatest of their whole scores is a floor that k
    documents reach. A document that reaches it has a heaviest term, and all of its score but that term's part is at most the sum of the
    bounds of the query's lighter terms: so of each term only blocks are read whose bound makes up for what that sum lacks. Their
    partial sums bound what a document can have at most, and the whole scores of those with the greatest sums raise the floor. Documents
    that can't reach it, even with the best unread postings of the terms they have, fall; the others are scored from their own terms.

    ``counts`` receives (query_id, n) for each name: postings "probed" and "read", documents "scored".
    """
    docs, total = index.stats.first()
    if not docs:
        return queries.select("query_id").join(index.forward.select("id"), F.lit(False)).select("query_id", "id", F.lit(0.0).alias("score"))
    idf = F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = query_terms(queries).withColumn("code", code("term"))
    # all terms with the code of a query's term: another one than that is a clash
    terms = terms.withColumn("bucket", bucket(F.col("code"))).join(index.df.select("bucket", F.col("term").alias("other"), code("term").alias("code"), "df"), ["bucket", "code"])
    weight = (F.col("mult") * F.when(idf <= 0, 1e-6).otherwise(idf) * (K1 + 1)).alias("w")
    terms = stored(terms.select("query_id", "bucket", "code", "term", (F.col("term") != F.col("other")).alias("clash"), weight))
    clash = not terms.where("clash").isEmpty()
    terms = terms.where("not clash").drop("clash")
    length_of = lambda dl: K1 * (1 - B + B * dl / (total / docs))
    score = lambda pairs: _scored(pairs.select("query_id", "id"), asked, index, total / docs, clash)
    # one array for each query, as long as the query
    asked = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "code", "w"))).alias("q"))
    asked = asked.select("query_id", F.col("q.term").alias("q_terms"), F.col("q.code").alias("q_codes"), F.col("q.w").alias("q_weights"))
    heads = index.blocks.select("bucket", "term", "batch", "shard", "block", "n", "max_tf", "min_dl")
    bound = F.col("w") * F.col("max_tf") / (F.col("max_tf") + length_of(F.col("min_dl")))
    heads = stored(terms.join(heads, ["bucket", "term"]).select("query_id", "bucket", "term", "w", "batch", "shard", "block", "n", bound.alias("bound")))
    lists = heads.groupBy("query_id", "term").agg(F.max("bound").alias("top"))
    lighter = Window.partitionBy("query_id").orderBy("top", "term")
    lists = lists.withColumn("below", F.coalesce(F.sum("top").over(lighter.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    lists = stored(lists.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("top"), F.desc("term")))))
    place = ["bucket", "term", "batch", "shard", "block"]
    bodies = index.blocks.join(sent(terms.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi").select(*place, "postings")

    def opened(some: DataFrame, *more: str) -> DataFrame:
        """Postings of these blocks, about ``POSTS`` to a task, so that no task's sums grow with the index."""
        tasks = max(1, -(-(some.agg(F.sum("n")).first()[0] or 0) // POSTS))
        rows = some.drop("n").repartition(tasks, *place).hint("merge").join(bodies.repartition(tasks, *place), place).select("query_id", "w", "batch", *more, F.explode("postings").alias("p"))
        return _live(rows.select("query_id", "batch", *more, "p.id", (F.col("w") * F.col("p.tf") / (F.col("p.tf") + length_of(F.col("p.dl")))).alias("part")), index)

    first = heads.where("block = 0").join(lists.where(F.col("place") <= PROBED_TERMS).select("query_id", "term"), ["query_id", "term"], "left_semi")
    probed = opened(first).groupBy("query_id", "id").agg(F.sum("part").alias("part"), F.count("*").alias("n"))
    probed = stored(probed)
    floors = stored(_nth(score(_most(probed, "part", PROBED_DOCS)), k))

    needed = lists.join(floors, "query_id", "left").select("query_id", "term", (F.coalesce("floor", F.lit(float("-inf"))) - MARGIN - F.col("below")).alias("need"))
    heads = heads.join(needed, ["query_id", "term"])
    # what a document may still have of a term's unread blocks
    left = heads.groupBy("query_id", "term").agg(F.coalesce(F.max(F.when(F.col("bound") < F.col("need"), F.col("bound"))), F.lit(0.0)).alias("left"))
    left = stored(left)
    reading = heads.where("bound >= need").join(left, ["query_id", "term"])
    sums = opened(reading, "left").groupBy("query_id", "id").agg(F.sum("part").alias("part"), F.sum(F.col("part") - F.col("left")).alias("gain"), F.count("*").alias("n"))
    # terms of one code add up, so that a document with either has room for both
    by_code = left.where("left > 0").groupBy("query_id", code("term").alias("code")).agg(F.sum("left").alias("left"))
    unread = by_code.groupBy("query_id").agg(F.sum("left").alias("rest"), F.collect_list(F.struct("code", "left")).alias("l"))
    unread = stored(unread.select("query_id", "rest", F.col("l.code").alias("l_codes"), F.col("l.left").alias("lefts")))
    able = sums.join(unread.select("query_id", "rest"), "query_id", "left").join(floors, "query_id", "left")
    able = stored(able.where(F.col("floor").isNull() | (F.col("gain") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor") - MARGIN)))
    raised = _nth(score(_most(able, "part", PROBED_DOCS)), k).select("query_id", F.col("floor").alias("raised"))
    able = able.join(raised, "query_id", "left").withColumn("floor", F.greatest("floor", "raised")).where(F.col("floor").isNull() | (F.col("gain") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor") - MARGIN))
    # only unread terms that the document has can add to it; a clash of codes makes the bound no smaller
    able = able.select("query_id", "id", "gain", "floor").join(unread, "query_id", "left").join(index.forward.select("id", "codes"), "id")
    open_ = F.aggregate(F.array_intersect("codes", "l_codes"), F.lit(0.0), lambda acc, c: acc + F.element_at("lefts", F.array_position(F.col("l_codes"), c).cast("int")))
    able = able.where(F.col("floor").isNull() | (F.col("gain") + F.coalesce(open_, F.lit(0.0)) >= F.col("floor") - MARGIN)).select("query_id", "id")
    if counts is not None:
        able = stored(able)
        counts |= {"probed": probed.groupBy("query_id").agg(F.sum("n").alias("n")), "read": sums.groupBy("query_id").agg(F.sum("n").alias("n")), "scored": able.groupBy("query_id").agg(F.count("*").alias("n"))}
    return _most(score(able), "score", k)
