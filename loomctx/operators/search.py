"""Lexical search: postings, BM25, positional scores. Inverted index and ranking are joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomctx.functions.text import search_terms, words

# Folded letters of Latin-1 and Latin Extended-A, so that search ignores their accents.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
K1, B = 1.2, 0.75


def fold(text):
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def _body(texts):
    return F.concat_ws(" ", *(F.coalesce(F.col(t), F.lit("")) for t in texts))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, mult): folded terms of queries (query_id, query); repeated terms count."""
    terms = queries.select("query_id", F.explode(search_terms("query")).alias("t")).select("query_id", fold(F.col("t")).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("mult"))


def postings(docs: DataFrame, id_col: str, *texts: str, only: DataFrame | None = None) -> DataFrame:
    """(term, id, tf): folded words of the given columns; null columns are empty.

    With ``only`` (term) just the postings of these terms are made: the rest is dropped before anything is shuffled.
    """
    terms = docs.select(F.col(id_col).alias("id"), F.explode(words(fold(_body(texts)))).alias("term"))
    if only is not None:
        terms = terms.join(only.select("term").distinct(), "term", "left_semi")
    return terms.groupBy("term", "id").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str, *texts: str) -> DataFrame:
    """(id, dl): words of each document that has any; no shuffle."""
    return docs.select(F.col(id_col).alias("id"), F.size(words(_body(texts))).cast("long").alias("dl")).where("dl > 0")


def bm25(posts: DataFrame, dl: DataFrame, queries: DataFrame, restricted: bool = False) -> DataFrame:
    """(query_id, id, score) of every document with a term of the query; repeated terms count repeatedly.

    Queries are a table, so many are answered in one job. ``restricted`` says that ``posts`` has the queries' terms only.
    """
    terms = query_terms(queries)
    stats = dl.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = posts if restricted else posts.join(terms.select("term").distinct(), "term", "left_semi")
    # tf takes part so that both uses of the postings read one exchange
    df = hits.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = terms.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("idf", F.when(idf <= 0, 1e-6).otherwise(idf))  # stats is one row
    part = F.col("mult") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.join(weights, "term").join(dl, "id").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def positional(ranked: DataFrame, limit: int) -> DataFrame:
    """Top hits of each query with ``rank`` from 0, ``hits`` and the positional score 1 - rank / hits; ties go by id."""
    per_query = Window.partitionBy("query_id")
    top = ranked.withColumn("rank", F.row_number().over(per_query.orderBy(F.desc("score"), "id")) - 1).where(F.col("rank") < limit)
    return top.withColumn("hits", F.count("*").over(per_query)).withColumn("position_score", 1 - F.col("rank") / F.col("hits"))


def matched_term(query, symbol, content):
    """First query term that the content or symbol has as it is written, else the first term."""
    terms = search_terms(query)
    inside = F.filter(terms, lambda t: F.coalesce(F.contains(content, t), F.lit(False)) | F.coalesce(F.contains(symbol, t), F.lit(False)))
    return F.coalesce(F.get(inside, 0), F.get(terms, 0))
