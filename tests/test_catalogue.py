"""Every query with a SQL twin gives the same rows in DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from loomctx.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    done = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in done.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_packs_keep_their_budgets(spark, sf):
    from pyspark.sql import functions as F

    items = catalogue.context_pack(spark, sf)
    most = items.groupBy("request_id").agg(F.sum("tokens").alias("t")).agg(F.max("t")).first()[0]
    assert 0 < most <= 2000


def test_packs_walk_the_mentions_of_whole_items(spark, sf):
    import re

    from loomctx.operators import pack
    from loomctx.plans import adapters as A

    read = lambda t, k: {r[k]: r["text"] for r in spark.read.parquet(f"{sf}/{t}.parquet").where("text is not null").collect()}
    items, docs = read("benchmark", "item_id"), read("documents", "doc_id")
    requests = A.query_requests(spark, sf)
    assert {int(r["request_id"]): r["query"] for r in requests.collect()} == items
    words = lambda t: set(re.findall(r"\w+", t))
    named = {}
    for i, t in items.items():
        for w in words(t):
            if len(w.encode()) >= 4:
                named[w] = min(named.get(w, f"i{i}"), f"i{i}")
    want = {(named[w], f"d{d:012}") for d, t in docs.items() for w in sorted(x for x in words(t) if x in named)[:8]}
    edges = A.mention_edges(spark, sf)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == want
    near = {}
    for a, b in want:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nodes = A.doc_nodes(spark, sf)
    files = nodes.where("kind = 2").select("path", F.lit(None).cast("string").alias("skipped"))
    some = requests.where("cast(request_id as long) < 5")
    got = pack.gather(some, nodes.unionByName(A.item_nodes(spark, sf)), edges, files, pack.profiles(spark), most=1 << 30).select("request_id", "id", "hops").collect()
    for q in {r["request_id"] for r in got}:
        at = {h: {r["id"] for r in got if r["request_id"] == q and r["hops"] == h} for h in (0, 1, 2)}
        one = set().union(*(near.get(x, set()) for x in at[0])) - at[0]
        two = set().union(*(near.get(x, set()) for x in one)) - at[0] - one if len(one) < 512 else set()
        assert at[1] == one and at[2] == two and (one or two)
    assert catalogue.context_pack(spark, sf).where("reason = 'doc_mention'").count() > 0
