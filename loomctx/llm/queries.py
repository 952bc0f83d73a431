"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomctx.llm import oracles
from loomctx.llm.stage import tables


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomctx.llm.neardup import near_duplicates

    return near_duplicates(tables(spark, sf_dir, "documents"))


QUERIES = {"op1_minhash_dedup": op1_minhash_dedup}
ORACLES: dict[str, str] = {}


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomctx.llm.pii import personal_data

    return personal_data(tables(spark, sf_dir, "documents")).drop("redactions")


QUERIES["op8_pii"] = op8_pii


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomctx.llm.toxicity import toxicity

    return toxicity(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomctx.llm.langid import identify

    return identify(tables(spark, sf_dir, "documents"))


QUERIES |= {"op5_toxicity": op5_toxicity, "op6_language_id": op6_language_id}


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomctx.llm.decontam import contaminated

    return contaminated(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


#: Target weights of the mixture's tree: domains, then languages in every domain; sources weigh their tokens' share.
DOMAINS = {"web": 0.5, "books": 0.3, "code": 0.2}
LANGUAGES = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}
MIX_SHARE = 0.5


def mixture_levels() -> dict:
    """Domain by the number in the source's name, language, source."""
    from pyspark.sql import functions as F

    number = F.regexp_extract("source", "([0-9]{1,6})$", 1).try_cast("int") % 3
    return {"domain": F.when(number == 0, "web").when(number == 1, "books").when(number == 2, "code").otherwise("other"), "lang": F.col("lang"), "source": F.col("source")}


def mixture_weights() -> dict[tuple, float]:
    return {(d,): w for d, w in DOMAINS.items()} | {(d, lang): w for d in DOMAINS for lang, w in LANGUAGES.items()}


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomctx.llm.mixing import mix

    return mix(tables(spark, sf_dir, "documents"), mixture_levels(), MIX_SHARE, mixture_weights()).select("doc_id", "lang", "source", "epoch", "mix_tokens")


QUERIES |= {"op3_decontamination": op3_decontamination, "op10_source_mixing": op10_source_mixing}


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomctx.llm.covertree import near_vectors

    return near_vectors(tables(spark, sf_dir, "embeddings"))


QUERIES["op9_cover_tree"] = op9_cover_tree


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomctx.llm.impact import top_products

    return top_products(tables(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomctx.llm.whitening import whiten

    return whiten(tables(spark, sf_dir, "embeddings"))


QUERIES |= {"op11_impact_search": op11_impact_search, "op12_whitening": op12_whitening}


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomctx.llm.suffixtree import repeated_words

    return repeated_words(tables(spark, sf_dir, "documents")).drop("spans")


QUERIES["op7_suffix_tree"] = op7_suffix_tree


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomctx.llm.suffixarray import repeated_bytes

    return repeated_bytes(tables(spark, sf_dir, "documents")).drop("spans")


QUERIES["op4_suffix_array"] = op4_suffix_array


#: Tools that the adapter below makes of conversation turns.
TOOLS = {
    "reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "string"}}},
    "configure": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}}},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of chat turns: a user turn calls ``reply`` and names the user turn two before it, the assistant turn after it is the result.

    A system turn calls ``configure``, which has no result. Identifiers are ``c<turn>``.
    """
    from pyspark.sql import functions as F

    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.lit(0).alias("seq"), name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.when(F.col("turn") >= 2, F.concat(F.lit("$"), name(F.col("turn") - 2))).alias("after"), F.col("text").alias("prompt"), "turn")).alias("arguments"))
    told = turns.where("role = 'system'").select("conv_id", "turn", F.lit(0).alias("seq"), name(F.col("turn")).alias("call_id"), F.lit("configure").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"))
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return asked.union(told), answers


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomctx.llm.toolcalls import link_calls

    return link_calls(*conversation_calls(tables(spark, sf_dir, "conversations")), TOOLS)


QUERIES["op2_tool_calls"] = op2_tool_calls
ORACLES["op2_tool_calls"] = """
WITH c AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name, text,
         CASE WHEN role = 'user' AND turn >= 2 THEN 'c' || (turn - 2) END AS need
  FROM conversations WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, 'c' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
j AS (
  SELECT c.*, r.text AS result, r.call_id IS NOT NULL AS answered, c.need IS NOT NULL AND d.call_id IS NULL AS unresolved,
         row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS position
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
         LEFT JOIN c d ON d.conv_id = c.conv_id AND d.call_id = c.need)
SELECT conv_id, call_id, position, name,
       CASE WHEN name = 'reply' AND text = '' THEN 'invalid' WHEN unresolved THEN 'unresolved' WHEN NOT answered THEN 'unanswered' ELSE 'ok' END AS status,
       CASE WHEN name = 'reply' AND text = '' THEN '$.prompt: too short' ELSE '' END AS errors,
       CAST(1 AS BIGINT) AS n_calls, CAST(answered AS BIGINT) AS n_results,
       '{"arguments":{' || CASE WHEN need IS NOT NULL THEN '"after":"$' || need || '",' ELSE '' END
         || CASE name WHEN 'reply' THEN '"prompt":' ELSE '"text":' END || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn
         || '},"id":"' || call_id || '","name":"' || name || '","result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || '}' AS json
FROM j
UNION ALL
SELECT r.conv_id, r.call_id, NULL, NULL, 'orphan', '', CAST(0 AS BIGINT), CAST(1 AS BIGINT), NULL
FROM r LEFT JOIN c ON c.conv_id = r.conv_id AND c.call_id = r.call_id WHERE c.call_id IS NULL
"""
ORACLES |= {"op1_minhash_dedup": oracles.NEAR_DUPLICATES, "op4_suffix_array": oracles.REPEATED_BYTES, "op7_suffix_tree": oracles.REPEATED_WORDS, "op9_cover_tree": oracles.NEAR_VECTORS, "op11_impact_search": oracles.TOP_PRODUCTS}
