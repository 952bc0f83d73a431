"""Rendering of packs: plain text, message blocks with cache hints, chat message with a cache key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomctx.functions.text import envelope

ENVELOPE_VERSION = "loom-env-1"


def blocks(items: DataFrame) -> DataFrame:
    """(request_id, prefix, query_block, stable_ids): envelopes in order, the stable ones first."""
    env = envelope(F.col("node"), F.col("path"), F.col("type"), F.get("lines", 0), F.get("lines", 1), F.col("symbol"), F.col("content"))
    rows = items.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("ord", "stable", env.alias("env"), "node"))).alias("x"))
    part = lambda stable: F.array_join(F.transform(F.filter("x", lambda i: i["stable"] == stable), lambda i: i["env"]), "")
    return rows.select("request_id", part(True).alias("prefix"), part(False).alias("query_block"), F.transform(F.filter("x", lambda i: i["stable"]), lambda i: i["node"]).alias("stable_ids"))


def render_plain(items: DataFrame, totals: DataFrame) -> DataFrame:
    """(request_id, text): one header comment, then all items."""
    head = F.format_string("<!-- context pack %s (%d tokens, saved %.1f%%) -->\n", F.col("request_id"), F.col("selected_tokens"), F.col("saved_pct"))
    return blocks(items).join(totals, "request_id").select("request_id", F.concat(head, "prefix", "query_block").alias("text"))


def render_messages(items: DataFrame) -> DataFrame:
    """(request_id, text): system blocks as JSON, the stable prefix with a one-hour cache hint, the rest with the default one; empty blocks are left out."""
    hint = "type string, text string, cache_control struct<type:string,ttl:string>"
    of = lambda c, ttl: F.struct(F.lit("text").alias("type"), F.col(c).alias("text"), F.struct(F.lit("ephemeral").alias("type"), F.lit(ttl).cast("string").alias("ttl")).alias("cache_control")).cast(f"struct<{hint.replace(' string', ':string').replace(' struct', ':struct')}>")
    kept = F.filter(F.array(of("prefix", "1h"), of("query_block", None)), lambda b: b["text"] != "")
    return blocks(items).select("request_id", F.to_json(F.struct(kept.alias("system"))).alias("text"))


def cache_key(hot_set_version, stable_ids):
    """First 32 digits of the SHA-256 of envelope version, hot-set version (eight bytes, big-endian) and the stable ids."""
    version = F.unhex(F.lpad(F.hex(hot_set_version), 16, "0"))
    return F.substring(F.sha2(F.concat(F.lit(ENVELOPE_VERSION).cast("binary"), version, F.array_join(stable_ids, "").cast("binary")), 256), 1, 32)


def render_chat(items: DataFrame, totals: DataFrame) -> DataFrame:
    """(request_id, text): one system message and a cache key as JSON."""
    message = F.array(F.struct(F.lit("system").alias("role"), F.concat("prefix", "query_block").alias("content")))
    key = F.concat(F.lit("loom-"), cache_key(F.col("hot_set_version").cast("long"), F.col("stable_ids")))
    return blocks(items).join(totals.select("request_id", "hot_set_version"), "request_id").select("request_id", F.to_json(F.struct(message.alias("messages"), key.alias("prompt_cache_key"))).alias("text"))
