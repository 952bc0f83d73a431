"""Postings in batches against a rebuild and plain Python; pruned search against all scores."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomctx.operators import postings as P
from loomctx.operators import search

DOCS = "id long, text string"
WORDS = [f"w{i}" for i in range(60)]


def text(rng):
    return " ".join(rng.choices(WORDS, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(0, 60)))


def bm25(docs, query, k):
    """All scores in plain Python, the best k."""
    lists = {i: re.findall(r"\w+", (t or "").lower()) for i, t in docs.items()}
    lists = {i: w for i, w in lists.items() if w}
    n, avg = len(lists), sum(map(len, lists.values())) / max(len(lists), 1)
    df, out = Counter(w for words in lists.values() for w in set(words)), []
    asked = Counter(w for w in re.findall(r"\w+", query.lower()) if len(w) > 1)
    for i, words in lists.items():
        tf, score = Counter(words), 0.0
        for t, m in asked.items():
            idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5)) if t in df else 0
            score += m * (idf if idf > 0 else 1e-6) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(words) / avg))
        if any(tf[t] for t in asked):
            out.append((-round(score, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def hits(index, queries, spark, k, counts=None):
    found = P.top_hits(index, spark.createDataFrame(list(enumerate(queries)), "query_id int, query string"), k, counts).collect()
    out = {q: [] for q in range(len(queries))}
    for r in sorted(found, key=lambda r: (r["query_id"], -r["score"], r["id"])):
        out[r["query_id"]].append((r["id"], r["score"]))
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_search_after_random_edits(spark, tmp_path, monkeypatch, clash):
    rng = random.Random(7)
    monkeypatch.setattr(P, "BLOCK", 4)
    monkeypatch.setattr(P, "PROBED_TERMS", 2)
    monkeypatch.setattr(P, "PROBED_DOCS", 6)
    if clash:  # many terms share a code: documents are scored by the terms themselves
        monkeypatch.setattr(P, "code", lambda t: F.pmod(F.xxhash64(t), F.lit(8)))
    path, docs = f"file://{tmp_path}/index", {}
    for batch in range(2 if clash else 4):
        new = {rng.randrange(150): text(rng) for _ in range(60)}
        out = rng.sample(sorted(docs), 10) if docs else []
        P.write_batch(spark, path, batch, spark.createDataFrame(list(new.items()), DOCS), "id", "text", deleted=spark.createDataFrame([(i,) for i in out], "id long"))
        docs = {i: t for i, t in docs.items() if i not in out} | new
    # a repeated batch changes nothing
    P.write_batch(spark, path, batch, spark.createDataFrame(list(new.items()), DOCS), "id", "text", deleted=spark.createDataFrame([(i,) for i in out], "id long"))
    index = P.read(spark, path, "bigint")
    want = sorted((t, i, n, sum(Counter(d.split()).values())) for i, d in docs.items() for t, n in Counter(d.split()).items())
    assert sorted(map(tuple, P.postings(index).select("term", "id", "tf", "dl").collect())) == want
    df = Counter(t for t, *_ in want)
    assert {r["term"]: r["df"] for r in index.df.collect()} == df
    assert tuple(index.stats.first()) == (sum(bool(d) for d in docs.values()), sum(len(d.split()) for d in docs.values()))
    queries = [text(rng) + " w1 w55" for _ in range(6)] + ["", "nothing here", "w0", "w59 W59 w59"]
    got = hits(index, queries, spark, 5)
    for q, query in enumerate(queries):
        want = bm25(docs, query, 5)
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=2e-6)


def test_earlier_batches_can_still_be_read(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    P.write_batch(spark, path, 0, spark.createDataFrame([(1, "apple pear"), (2, "apple"), (3, None), (4, "")], DOCS), "id", "text")
    P.write_batch(spark, path, 1, spark.createDataFrame([(2, "plum")], DOCS), "id", "text")
    terms = lambda index: sorted((r["id"], r["term"]) for r in P.postings(index).collect())
    assert terms(P.read(spark, path, "bigint", 0)) == [(1, "apple"), (1, "pear"), (2, "apple")]
    assert terms(P.read(spark, path, "bigint")) == [(1, "apple"), (1, "pear"), (2, "plum")]
    assert P.last_batch(spark, path) == 1 and P.last_batch(spark, f"file://{tmp_path}/none") == -1
    assert hits(P.read(spark, f"file://{tmp_path}/none", "bigint"), ["apple"], spark, 3) == {0: []}


def test_pruned_search_scores_few_and_loses_none(spark):
    """Against every score of every document, over enough documents for floors to matter."""
    rng = random.Random(3)
    words = [f"v{i}" for i in range(3000)]
    weights = [1 / (i + 8) for i in range(3000)]
    docs = [(i, " ".join(rng.choices(words, weights=weights, k=rng.randint(20, 120)))) for i in range(4000)]
    d = spark.createDataFrame(docs, DOCS)
    queries = [" ".join(rng.choices(words, weights=weights, k=12)) for _ in range(8)] + [" ".join(docs[7][1].split()[:15])]
    counts = {}
    got = hits(P.build(d, "id", "text"), queries, spark, 10, counts)
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    everything = search.bm25(search.postings(d, "id", "text"), search.lengths(d, "id", "text"), asked).collect()
    for q in range(len(queries)):
        scores = sorted(((-round(r["score"], 5), r["id"]) for r in everything if r["query_id"] == q))[:10]
        assert [round(s, 5) for _, s in got[q]] == pytest.approx([-s for s, _ in scores], abs=3e-5)
    scored = counts["scored"].agg(F.sum("n")).first()[0]
    assert scored * 10 < len(everything)


def test_opened_postings_are_dealt_by_their_number(spark, monkeypatch):
    """A task opens about ``POSTS`` postings, however few files hold their blocks, with the same hits."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 9))) for i in range(300)], "id long, text string")
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4 w0"), (3, "w5 w6 w1")], "query_id long, query string")
    index = P.build(docs, "id", "text")
    want = sorted(map(tuple, P.top_hits(index, queries, 20).collect()))
    monkeypatch.setattr(P, "POSTS", 40)
    counts = {}
    assert sorted(map(tuple, P.top_hits(index, queries, 20, counts).collect())) == want
    tasks = [int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", counts["read"]._jdf.queryExecution().analyzed().toString())]
    read = counts["read"].agg({"n": "sum"}).first()[0]
    assert read > 40 and tasks and set(tasks) == {-(-read // 40)}
