"""Impact-ordered search and whitening against brute force, on real, structured and odd vectors."""

import math

import numpy as np
import pytest

from loomctx.llm import impact, whitening

SCHEMA = "vec_id long, embedding array<double>, score int, key string, x int, row int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "k", 1, 2) for i, v in rows], SCHEMA)


def quantise(v):
    if v is None or any(c is None or not math.isfinite(c) or abs(c * 64) >= 2**53 for c in v):
        return None
    return [math.floor(64 * c) for c in v]


def brute_top(rows, k, divisor):
    """Rows as (query_id, rank, vec_id, score); rows that repeat an id are told apart by their place."""
    known = [(n, i, quantise(v)) for n, (i, v) in enumerate(rows)]
    known = [r for r in known if r[2] is not None]
    out = []
    for n, i, q in known:
        if i is not None and i % divisor == 0:
            scored = [(-sum(a * b for a, b in zip(q, x)), j is None, j if j is not None else 0) for m, j, x in known if m != n]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=repr)


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(i, [0.5] * 8) for i in range(60, 110)] + [(0, [0.5] * 8), (0, [0.5] * 8), (20, None), (40, []), (5, [0.0] * 8), (60, [1.0, None] + [0.0] * 6)]
    return rows + [(80, [float("nan")] + [0.0] * 7), (81, [float("inf")] * 8), (100, [2.0, -1.0]), (None, [3.0] * 8), (None, [3.0] * 8), (100, [1e300] * 8), (120, [-0.0, -1e-9] + [0.0] * 6)]


def test_top_products_of_odd_vectors(spark):
    rows = odd_vectors()
    for k, chunk in ((20, 2048), (3, 7)):
        assert found(impact.top_products(table(spark, rows), "vec_id % 20 = 0", k, chunk)) == brute_top(rows, k, 20)


def test_top_products_need_others(spark):
    assert found(impact.top_products(table(spark, [(0, [1.0])]), "true")) == []
    assert found(impact.top_products(table(spark, []), "true")) == []
    assert found(impact.top_products(table(spark, [(0, [1.0]), (1, [0.5])]), "vec_id = 0")) == [(0, 1, 1, 2048)]
    assert found(impact.top_products(table(spark, [(None, [1.0]), (1, [0.5])]), "vec_id is null or vec_id = 1")) == [(1, 1, None, 2048)]


def test_top_products_beyond_a_long(spark):
    rows = [(0, [1e13, 2.0]), (1, [1e13, 1.0]), (2, [-1e13, 1.0]), (3, [0.25, 1.0]), (4, [1e13, 1.5])]
    got = found(impact.top_products(table(spark, rows), "vec_id = 0"))
    want = [(q, r, v, max(-(2**63), min(2**63 - 1, s))) for q, r, v, s in brute_top(rows, 20, 100)]
    assert got == want and got[0][2] == 4


@pytest.mark.parametrize("spread", [1.0, 60.0])
def test_search_drops_pairs_on_proof_only(spread):
    """Structured vectors: few pairs are scored in full, and none of the best is lost, ties and signs included."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32)) * spread
    vectors = np.floor(centres[rng.integers(0, 12, 3000)] * 8 + rng.normal(size=(3000, 32)) * 4)
    queries = vectors[::100]
    best, scored = impact.Best(len(queries), 10), 0
    for s in range(0, 3000, 500):
        block = impact.Block.load(impact.Block(np.arange(s, s + 500), np.arange(s, s + 500), vectors[s : s + 500]).dump())
        assert (block.spread() == vectors[s : s + 500]).all()
        scored += impact.search(block, queries, best)
    products = (queries @ vectors.T).astype(np.int64)
    order = [sorted(range(3000), key=lambda j: (-p[j], j))[:10] for p in products]
    assert best.rows[3].tolist() == [j for o in order for j in o]
    assert best.rows[1].astype(np.int64).tolist() == [int(p[j]) for p, o in zip(products, order) for j in o]
    assert scored < 0.2 * products.size


def brute_whiten(rows, most=16):
    known = [(i, quantise(v)) for i, v in rows]
    known = [(i, v) for i, v in known if v is not None]
    width = max([len(v) for _, v in known] + [1])
    x = [[c + 1000000 for c in v] + [1000000] * (width - len(v)) for _, v in known]
    fit = [list(v) for v in sorted(set(map(tuple, x)))]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    # exact centring first, as the covariance of small deviations on a large shift needs it
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    return [-1 if i is None else i for i, _ in known], x, n, sums, deviation, centred


def check_whitened(rows, got, most=16):
    ids, x, n, sums, deviation, centred = brute_whiten(rows)
    got = [r.asDict() | {"vec_id": -1 if r["vec_id"] is None else r["vec_id"]} for r in got]  # ids sort
    width = len(sums)
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    count = min(most, width)
    assert sorted((r["vec_id"], r["component"], r["deviation"]) for r in got) == sorted((i, c + 1, d) for i, d in zip(ids, deviation) for c in range(count))
    assert {r["n"] for r in got} == {n}
    real = [c for c in range(count) if e[c] > 1e-9 * e[0]]
    for c in range(count):
        mine = sorted((r["vec_id"], r["deviation"], r["whitened"]) for r in got if r["component"] == c + 1)
        explained = {r["explained"] for r in got if r["component"] == c + 1}
        assert len(explained) == 1
        if c not in real:
            assert explained == {0.0} and all(w is None for *_, w in mine)
            continue
        assert explained.pop() == pytest.approx(e[c] / e.sum(), rel=1e-6)
        want = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in x]) @ axes[:, c] / math.sqrt(e[c])
        want = sorted((i, d, w) for i, d, w in zip(ids, deviation, want))
        a, b = np.array([w for *_, w in mine]), np.array([w for *_, w in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
    assert {r["identity_error"] for r in got}.pop() < 1e-8


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=5) * [8, 4, 2, 1, 0.5]).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (7, [1.0] * 5), (None, [2.0] * 5), (9, [1.0, 2.0]), (10, []), (11, None), (12, [1.0, None, 0.0, 0.0, 0.0]), (13, [float("nan")] * 5), (14, [float("-inf")] * 5)]
    got = whitening.whiten(table(spark, rows).repartition(7)).collect()
    check_whitened(rows, got)
    assert len(got) == 5 * (300 + 5)


def test_whitening_without_variance(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    got = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got) == [(v, c, 1, 0, None, None, None) for v in (1, 2) for c in (1, 2)]
    rows = [(i, [i / 64, 2 * i / 64, 0.0]) for i in range(50)]
    check_whitened(rows, whitening.whiten(table(spark, rows)).collect())


def test_whitening_of_the_table(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whitening.whiten(vectors).collect()
    assert len(got) == 16 * vectors.count()
    check_whitened([(r["vec_id"], r["embedding"]) for r in vectors.collect()], got)


def test_triangles_fold_in_a_tree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(-500, 500, size=(400, 6)) + 1000000
    monkeypatch.setattr(whitening, "FAN", 1)
    fit = spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>").repartition(9)
    centre = whitening.Centre(400, [int(s) for s in x.sum(axis=0)])
    r = whitening.compressed(fit, centre)
    m = x - x.mean(axis=0)
    assert np.abs(r.T @ r - m.T @ m).max() < 1e-6 * np.abs(m.T @ m).max()


def test_jacobi_keeps_small_deviations():
    rng = np.random.default_rng(4)
    for d in (1, 2, 7, 40):
        u, _ = np.linalg.qr(rng.normal(size=(d, d)))
        v, _ = np.linalg.qr(rng.normal(size=(d, d)))
        want = 10.0 ** np.linspace(0, -6, d)
        sigma, axes = whitening.jacobi(u * want @ v.T)
        assert np.allclose(sigma, want, rtol=1e-8)
        assert np.abs(axes.T @ axes - np.eye(d)).max() < 1e-13
    # columns of very different sizes keep their relative digits
    graded = np.triu(rng.normal(size=(6, 6))) * 10.0 ** np.array([0, -3, -6, -9, -12, -15])
    sigma, axes = whitening.jacobi(graded)
    product = graded @ axes
    cosines = product.T @ product / np.outer(sigma, sigma) - np.eye(6)
    assert np.abs(cosines).max() < 1e-9 and sigma[-1] > 0


def test_deviations_beyond_fast_integers():
    big = 2**52
    x = np.array([[big, 0], [0, 1], [3, 5]], np.int64) + 1000000
    centre = whitening.Centre(10**4, [int(s) for s in x.sum(axis=0)])
    exact = centre.exact(x)
    assert [[int(v) for v in r] for r in exact] == [[10**4 * int(c) - s for c, s in zip(r, centre.sums)] for r in x]
    assert centre.deviation(exact)[0] is None
