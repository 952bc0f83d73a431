import collections

import numpy as np

from loomctx.llm import neardup
from loomctx.llm.components import components


def sets(texts):
    out = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute(texts):
    s, parent = sets(texts), {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for k, x in s.items():
        shared = collections.Counter(e for g in x for e in where[g])
        for e, n in shared.items():
            if 100 * n >= 75 * (len(x) + len(s[e]) - n):
                a, b = sorted((find(k), find(e)))
                parent[b] = a
        for g in x:
            where[g].append(k)
    return {k: (len(s[k]), find(k)) for k in texts}


def test_like_brute_force(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute(texts)


def test_group_of_near_copies(spark):
    """Copies that differ in a few words, some linked only through others, in buckets with several components."""
    rng = np.random.Generator(np.random.PCG64(3))
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 6))):
            w[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(dict(rows))


def test_odd_sketch_estimates():
    rng = np.random.Generator(np.random.PCG64(5))
    for similarity in (0.6, 0.75, 0.9):
        shared = int(1000 * similarity)
        a, b = (np.concatenate([np.arange(shared), rng.integers(10**6, 10**12, (1000 - shared) // 2)]).astype(np.uint64) for _ in range(2))
        hashes, counts = np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)])
        x, y = neardup.odd_sketches(hashes, counts).view(np.uint64)
        bits = int(np.bitwise_count(x ^ y).sum())
        assert abs(bits - neardup.most_bits(similarity)) < 4096 * 0.06


def test_odd_rows(odd, nothing):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["component_id"] == by[2]["component_id"] == 1 and not by[2]["kept"]
    assert all(by[k]["n_shingles"] == 0 and by[k]["component_id"] == k and by[k]["kept"] for k in (3, 4, 10))
    assert by[6]["n_shingles"] == 1 and by[7]["n_shingles"] == 1
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert neardup.near_duplicates(nothing).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 150: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
