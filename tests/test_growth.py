"""Steps whose work must be shared by all tasks and whose tables must cross the network no more often than needed."""

import re

import pytest

from pyspark.sql import functions as F

from loomctx.functions.parse import declarations
from loomctx.operators import graph, maintain, pack
from loomctx.plans import catalogue


def test_one_partition_is_parsed_by_many_tasks(spark):
    files = spark.createDataFrame([(f"p{i}.py", "python", f"def f{i}():\n    g()\n") for i in range(100)], "path string, lang string, text string").coalesce(1)
    found = declarations(files)
    assert found.rdd.getNumPartitions() >= 4 and {(r["path"], r["decls"][0]["name"]) for r in found.collect()} == {(f"p{i}.py", f"f{i}") for i in range(100)}


def test_changes_of_repeated_entries(spark):
    table = lambda rows: spark.createDataFrame(rows, "path string, id string")
    got = maintain.node_changes(table([("a", "1"), ("a", "1"), ("a", "2"), ("b", "3"), ("b", "3")]), table([("a", "2"), ("a", "2"), ("a", "4"), ("a", "4")])).collect()
    assert sorted(map(tuple, got)) == [("a", "1", "removed"), ("a", "4", "added"), ("b", "3", "removed")]


@pytest.mark.parametrize("name", ["gc", "explain_symbol"])
def test_edges_are_not_dealt_by_three_columns_first(spark, sf, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"hashpartitioning\(src#\d+, kind#\d+, dst#\d+", plan)


def test_walk_of_sent_and_shuffled_frontiers(spark):
    edges = spark.createDataFrame([(f"n{i}", 2 if i % 2 else 3, f"n{i * 7 % 50}") for i in range(50)], "src string, kind int, dst string")
    seeds, valid = spark.createDataFrame([("n3",), ("n10",)], "id string"), spark.createDataFrame([(f"n{i}",) for i in range(48)], "id string")
    rows = [sorted(map(tuple, graph.walk(seeds, edges, valid, pack.default_prior, sent=n).collect())) for n in (0, 1000)]
    assert rows[0] == rows[1] and len(rows[0]) > 3


def test_more_postings_are_more_tasks(spark, monkeypatch):
    """Tasks that split texts and sort postings hold a bounded number of them; before, the session's partitions and a shard's 16 buckets had all."""
    from loomctx.operators import postings

    monkeypatch.setattr(postings, "TEXT", 2000)
    monkeypatch.setattr(postings, "POSTS", 300)
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 97}" for j in range(40))) for i in range(300)], "id long, text string")
    listed = graph.stored(postings.forward(docs, "id", "text"))
    made = graph.stored(postings.blocks(listed))
    sizes = [r["n"] for r in made.groupBy(F.input_file_name()).agg(F.sum("n").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) <= 1200 and sum(sizes) == listed.agg(F.sum(F.size("terms"))).first()[0]
    assert listed.select(F.input_file_name()).distinct().count() > 8


def test_budgets_share_one_gathering(spark, monkeypatch):
    """Packs under several budgets are selected from candidates gathered once, and are those of each budget alone."""
    from loomctx.plans import adapters

    documents = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma{i % 5} delta " * (5 + i), "en", "s") for i in range(12)], "doc_id long, text string, lang string, source string")
    items = spark.createDataFrame([(1, "alpha beta1 gamma2"), (2, "delta doc_3 beta2")], "item_id long, text string")
    calls, gather = [], pack.gather
    monkeypatch.setattr(pack, "gather", lambda *a, **b: calls.append(1) or gather(*a, **b))
    rows = lambda found: sorted(map(tuple, found.select("request_id", "ord", "node", "score").collect()))
    both = [rows(found) for found, _ in adapters.document_packs(documents, items, 60, 400)]
    assert len(calls) == 1 and len(both[0]) < len(both[1])
    assert [rows(adapters.document_packs(documents, items, b)[0][0]) for b in (60, 400)] == both
