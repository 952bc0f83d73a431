"""Kept ranks are those made anew after random changes of edges, removals of the greatest node and refills among them."""

import random
from collections import Counter

from loomctx.operators import graph as G
from loomctx.operators import ranks as R


def test_ranks_after_random_changes(spark):
    rng = random.Random(2)
    frame = lambda rows: spark.createDataFrame(sorted(rows), "src string, dst string")
    pick = lambda: f"n{int(40 * rng.random() ** 2):02d}"
    edges = {(pick(), pick()) for _ in range(90)}
    ranks, refills = R.from_edges(frame(edges), 8), 0
    for step in range(8):
        degree = Counter(x for e in edges for x in e)
        top = max(degree, key=lambda x: (degree[x], x))
        removed = {e for e in edges if top in e} if step in (2, 5) else set(rng.sample(sorted(edges), rng.randint(0, min(25, len(edges)))))
        added = {(pick(), pick()) for _ in range(rng.randint(0, 12))} - edges if step != 6 else set()
        edges = edges - removed | added
        ranks = R.changed(ranks, frame(added), frame(removed), need=5, pool=8)
        refills += ranks.refilled
        degree = Counter(x for e in edges for x in e)
        assert {r["id"]: r["degree"] for r in ranks.degrees.collect()} == degree
        assert {r["degree"]: r["nodes"] for r in ranks.histogram.collect()} == Counter(degree.values())
        order = sorted(degree, key=lambda x: (-degree[x], x))[:5]
        assert [(r["id"], r["degree"], r["centrality"]) for r in R.most_central(ranks, 5).collect()] == [(x, degree[x], degree[x] / max(degree.values())) for x in order]
    assert {tuple(r) for r in R.centrality(ranks).collect()} == {tuple(r) for r in G.centrality(frame(edges)).collect()}
    assert 0 < refills < 8
    gone = R.changed(ranks, frame(set()), frame(edges), need=5, pool=8)
    assert gone.degrees.count() == gone.histogram.count() == gone.pool.count() == 0 and R.greatest(gone).first()["top"] == 1
    back = R.changed(gone, frame({("a", "a")}), frame(set()), need=5, pool=8)
    assert [tuple(r) for r in R.most_central(back, 5).collect()] == [("a", 2, 1.0)]
