import json
import random
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomctx.llm import covertree, decontam, mixing, toolcalls
from loomctx.llm import queries as Q
from test_catalogue import TABLES, plain


def test_template_windows(spark):
    d = spark.createDataFrame([(1, "Intro text here. Alice bought 12 kg of apples from the old market near Boston for 30 dollars each day."), (2, "so Carol bought 7 pounds of apples from the old market near Denver for 99 euros each day"), (3, "he said Carol bought 7 of pears"), (4, None), (5, ""), (None, "Alice bought 12 kg of apples from the old market near Boston for 30 dollars"), (6, "so Carol bought 7 pounds of apples from the old market near Denver, for 99 euros each day; then Erin bought 7 pounds of apples from the old market")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "Then Bob bought 5 kg of apples from the old market near Paris for 30 dollars each day."), (10, "tiny one two"), (11, None), (None, "x")], "item_id long, text string")
    for sent in (1 << 20, 0):
        got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(d, b, sent=sent).collect()}
        assert set(got) == {(1, 9), (2, 9), (6, 9)}
        assert got[2, 9]["replaced"] > got[1, 9]["replaced"] > 0


def test_inconsistent_slots_do_not_count(spark):
    item = "Anna gave Bertha the old silver coins before noon and then Anna told Bertha about every hidden room below"
    swap = "now Carla gave Dora the old silver coins before noon and then Carla told Dora about every hidden room below"
    mixed = "now Carla gave Dora the old silver coins before noon and then Emma told Fiona about every hidden room below"
    d = spark.createDataFrame([(1, swap), (2, mixed)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["windows"] for r in decontam.contaminated(d, b, share=0.0).collect()}
    assert got[1] > got[2]


def test_benchmark_passages_are_found(spark, sf, docs, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, q in items.items() if q in (t or "")}
    got = {(r["doc_id"], r["item_id"]) for r in Q.op3_decontamination(spark, sf).collect()}
    assert want <= got and len(got) <= len(want) + 2


def brute_mix(rows, levels, total, weights, epochs, seed, spark):
    have = {}
    for r in rows:
        have[r["leaf"]] = have.get(r["leaf"], 0) + r["tokens"]
    plan = mixing.budgets(have, total * sum(have.values()), weights, epochs)
    ids = spark.createDataFrame([(r["doc_id"], e) for r in rows for e in range(epochs)], "doc_id long, epoch int")
    order = {(r["doc_id"], r["epoch"]): r["h"] for r in ids.select("doc_id", "epoch", F.xxhash64(F.lit(seed), "epoch", "doc_id").alias("h")).collect()}
    out = set()
    for leaf, budget in plan.items():
        mine = [r for r in rows if r["leaf"] == leaf]
        for e in range(epochs):
            left = min(have[leaf], budget - e * have[leaf])
            if left <= 0:
                continue
            for r in sorted(mine, key=lambda r: order[r["doc_id"], e] % 2**64):
                if r["tokens"] > left:
                    break
                left -= r["tokens"]
                out.add((r["doc_id"], e))
    return out


def test_mixing_like_brute_force(spark, docs):
    rows = [{"doc_id": r["doc_id"], "tokens": (len(r["text"].encode()) + 3) // 4, "leaf": (r["d"], r["lang"], r["source"])} for r in docs.withColumn("d", Q.mixture_levels()["domain"]).collect()]
    for total, epochs in ((0.5, 2), (0.9, 3)):
        got = {(r["doc_id"], r["epoch"]) for r in mixing.mix(docs, Q.mixture_levels(), total, Q.mixture_weights(), epochs).collect()}
        assert got == brute_mix(rows, None, total, Q.mixture_weights(), epochs, 17, spark)


def test_shortages_go_to_siblings_first():
    have = {("a", "x"): 10, ("a", "y"): 1000, ("b", "z"): 1000}
    got = mixing.budgets(have, 800, {("a",): 0.5, ("b",): 0.5, ("a", "x"): 0.5, ("a", "y"): 0.5}, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 390, ("b", "z"): 400}
    short = mixing.budgets({("a", "x"): 10, ("b", "z"): 1000}, 800, {("a",): 0.5, ("b",): 0.5}, 2)
    assert short == {("a", "x"): 20, ("b", "z"): 780}


def brute_budgets(tokens, total, weights, epochs):
    """Token by token: each goes down the tree to the child that has least for its weight and still takes any."""
    paths = {leaf[:k] for leaf in tokens for k in range(len(leaf) + 1)}
    size = {p: sum(n for leaf, n in tokens.items() if leaf[: len(p)] == p) for p in paths}
    weight = {p: weights.get(p, size[p] / (size[p[:-1]] or 1)) for p in paths if p}
    given = dict.fromkeys(paths, 0)

    def room(p):
        return given[p] < tokens[p] * epochs if p in tokens else any(weight[c] > 0 and room(c) for c in paths if len(c) == len(p) + 1 and c[: len(p)] == p)

    for _ in range(total):
        p = ()
        if not room(p):
            break
        while p not in tokens:
            given[p] += 1
            p = min((c for c in paths if len(c) == len(p) + 1 and c[: len(p)] == p and weight[c] > 0 and room(c)), key=lambda c: ((given[c] + 1) / weight[c], c))
        given[p] += 1
    return {leaf: given[leaf] for leaf in tokens}


def test_budgets_like_dealing_token_by_token():
    rng = np.random.Generator(np.random.PCG64(6))
    for _ in range(60):
        tokens = {(d, lang, s): int(rng.integers(0, 40)) for d in "ab" for lang in "xy" for s in "pq" if rng.random() < 0.8}
        weights = {p: float(rng.choice([0, 0, 0.2, 0.5, 1.0])) for p in {leaf[:k] for leaf in tokens for k in (1, 2, 3)} if rng.random() < 0.6}
        total, epochs = int(rng.integers(1, 200)), int(rng.integers(1, 3))
        got, want = mixing.budgets(tokens, total, weights, epochs), brute_budgets(tokens, total, weights, epochs)
        assert sum(got.values()) == sum(want.values())
        # rounding may shift a token a level and sibling
        assert all(abs(got[k] - want[k]) <= 4 for k in tokens), (tokens, weights, total, epochs)


def test_shortages_reach_the_ancestors_siblings():
    have = {("a", "x"): 100, ("a", "y"): 100, ("b", "x"): 300}
    assert mixing.budgets(have, 300, {("a",): 0.7, ("b",): 0.3, ("a", "y"): 0.0}, 1) == {("a", "x"): 100, ("a", "y"): 0, ("b", "x"): 200}
    assert mixing.budgets({("a",): 1, ("b",): 1, ("c",): 1}, 2, {}, 1) == {("a",): 1, ("b",): 1, ("c",): 0}
    assert mixing.budgets({}, 5, {}, 2) == {}


def test_mixing_odd_rows(odd, nothing):
    got = mixing.mix(odd, Q.mixture_levels(), 1.9, Q.mixture_weights())
    assert "epoch" in got.columns and 0 < got.count() <= 2 * odd.count()
    assert mixing.mix(nothing, Q.mixture_levels(), 0.5, {}).collect() == []


def brute_vectors(ids, x, threshold=0.95):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        now = np.array([min([label[i], *label[near[i]]]) for i in range(len(ids))])
        if (now == label).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), label)}
        label = now


@pytest.mark.parametrize("chunk", [16, 2048])
def test_vectors_like_brute_force(spark, chunk):
    rng = np.random.Generator(np.random.PCG64(2))
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[100:160] = x[0] + rng.normal(size=(60, 8)).astype(np.float32) * 0.15
    x[160:170] = x[5]
    ids = rng.permutation(200).astype(np.int64)
    rows = [(int(i), [float(c) for c in v], 1) for i, v in zip(ids, x)]
    bad = [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [1.0, None] * 4, 1), (1004, [float("inf")] * 8, 1), (1005, [], 1), (None, [1.0] * 8, 1), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("weight", F.lit(1))
    got = covertree.near_vectors(df, chunk=chunk, cells=8, sample=64).collect()
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None and r["vec_id"] < 1000}
    assert found == brute_vectors(ids, x.astype(np.float64)) and len(got) == 209
    rest = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert all(rest[k] == (0, k, True) for k in range(1000, 1006)) and rest[1006] == (1, 1006, True) and rest[1007] == (1, 1006, False) and rest[None] == (0, None, True)


def test_vectors_that_share_an_id(spark):
    """Rows are told apart by their vectors, each with the links of its own; ids name the components."""
    rng = np.random.Generator(np.random.PCG64(9))
    base = rng.normal(size=(30, 6))
    rows = [(int(rng.integers(0, 40)), base[rng.integers(0, 30)] + rng.normal(size=6) * rng.choice([0, 0.15])) for _ in range(120)]
    rows += [(1, np.array([1.0, 0, 0, 0, 0, 0])), (1, np.array([0, 1.0, 0, 0, 0, 0])), (2, np.array([1.0, 0.01, 0, 0, 0, 0]))]
    x = np.array([v / np.linalg.norm(v) for _, v in rows])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(rows))
    for _ in rows:
        label = np.array([min([label[i], *label[near[i]]]) for i in range(len(rows))])
    least = {c: min(rows[i][0] for i in np.flatnonzero(label == c)) for c in set(label.tolist())}
    want = sorted((rows[i][0], int(near[i].sum()), least[label[i]]) for i in range(len(rows)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = covertree.near_vectors(df, chunk=16, cells=8, sample=64).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_vectors_of_many_lengths(spark):
    rows = [(i, [1.0] * (i // 2 + 1)) for i in range(2400)]
    got = covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), sample=64)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()} == {(i, 1, i - i % 2) for i in range(2400)}


def test_groups_of_chunks_cover_all_pairs():
    rng = np.random.Generator(np.random.PCG64(8))
    centres = rng.normal(size=(6, 4))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    stats = {(4, c): (0.3, int(rng.integers(1, 900))) for c in range(6)} | {(7, 0): (2.0, 500)}
    cells, ranges = covertree.layout(stats, {4: centres}, 0.3, 16)
    group = {(d, c, k): (at + k) // per for d, c, n, at, per in cells for k in range(n)}
    met = {(d, a, b) for d, a0, a1, b0, b1 in ranges for a in range(a0, a1 + 1) for b in range(b0, b1 + 1)}
    for (d, i, k), g in group.items():
        for (e, j, m), h in group.items():
            if d == e and i <= j and (d == 7 or np.linalg.norm(centres[i] - centres[j]) <= 0.9):
                assert (d, g, h) in met
    assert sum(n for d, _, n, _, _ in cells if d == 7) == 32 and len({g for (d, _, _), g in group.items() if d == 7}) == 8


def test_no_vectors(spark):
    assert covertree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_cover_tree_bounds():
    rng = np.random.Generator(np.random.PCG64(4))
    x = np.concatenate([rng.normal(size=6) + rng.normal(size=(40, 6)) * 0.1 for _ in range(8)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = covertree.CoverTree(x, 100)
    assert len(t.levels) > 2
    d = np.linalg.norm(x - x[t.levels[-1]][t.owner], axis=1)
    assert (d <= t.cover[-1][t.owner] + 1e-9).all()
    for k in range(1, len(t.levels)):
        assert set(t.levels[k - 1].tolist()) <= set(t.levels[k].tolist())


SCHEMAS = {"f": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "s": {"type": "string", "maxLength": 3}, "r": {"type": "string"}}}}


def test_calls(spark):
    calls = [
        (1, 0, 0, "x", "f", '{"s": "é", "a": 1}'), (1, 1, 0, "y", "f", '{"a": -1, "z": 2}'), (1, 2, 0, "w", "f", '{"a": 3, "r": "$v"}'), (1, 3, 0, "v", "f", '{"a": 4}'), (1, 3, 0, "v", "f", '{"a": 4}'), (1, 4, 0, "u", "g", "{}"),
        (2, 0, 0, "p", "f", '{"a": 1, "r": "$q"}'), (2, 1, 0, "q", "f", '{"a": 1, "r": "$p"}'), (2, 2, 0, "m", "f", '{"a": 1, "r": "$none"}'), (2, 3, 0, "n", "f", "{bad"), (2, 4, 0, "o", "f", None), (None, 0, 0, "k", "f", "{}"), (3, None, 0, "k", "f", "{}"),
    ]
    results = [(1, 5, "x", "ok"), (1, 6, "x", "later"), (1, 7, "w", None), (1, 8, "ghost", "?"), (1, 9, "v", "done"), (None, 1, "x", "n")]
    c = spark.createDataFrame(calls, "conv_id long, turn long, seq int, call_id string, name string, arguments string").withColumn("result", F.lit(1))
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    got = {(x["conv_id"], x["call_id"]): x for x in toolcalls.link_calls(c, r, SCHEMAS).collect()}
    status = {k: v["status"] for k, v in got.items()}
    assert status == {(1, "x"): "ok", (1, "y"): "invalid", (1, "w"): "ok", (1, "v"): "ok", (1, "u"): "invalid", (2, "p"): "cyclic", (2, "q"): "cyclic", (2, "m"): "unresolved", (2, "n"): "invalid", (2, "o"): "invalid", (1, "ghost"): "orphan"}
    assert got[1, "x"]["json"] == '{"arguments":{"a":1,"s":"é"},"id":"x","name":"f","result":"ok"}' and got[1, "v"]["n_calls"] == 2
    assert got[1, "v"]["position"] < got[1, "w"]["position"] and sorted(v["position"] for k, v in got.items() if k[0] == 1 and v["position"]) == [1, 2, 3, 4, 5]
    assert got[1, "y"]["errors"] == "$.a: below minimum; $.z: unknown"
    empty = toolcalls.link_calls(c.limit(0), r.limit(0), SCHEMAS)
    assert empty.collect() == []


def test_calls_like_sql(spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = Q.op2_tool_calls(spark, sf)
    done = con.execute(Q.ORACLES["op2_tool_calls"])
    names = [d[0] for d in done.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in done.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr) == want
    assert all(json.loads(r["json"]) for r in got.where("json is not null").collect())


def test_pipeline(spark, sf, odd):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii", "source_mixing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, sf), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    last = P.STAGES[-1][1](spark, docs, sf)
    assert 0 < last.count() and P.run(spark, sf).count() == last.count()
    assert not docs.where(F.col("text").rlike(r"[a-z]+\.\d\d@mail")).count()
    assert P.STAGES[1][1](spark, odd, sf).columns == odd.columns
    assert "corpus_pipeline" in sys.modules


def test_verbatim_copies_of_items_with_few_literals(spark):
    texts = ["Compute 12 + 7 * 3 - 45 / 9 + 8", "3 4 7 1 9 12 44 6 81 2 5", "go with Ada, Bob, Cyd, Dan, Eve, Fay, Gus, Hal, Ivy, Jon", "Why 42?"]
    b = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    d = spark.createDataFrame([(i, f"so we said {t} and left") for i, t in enumerate(texts)] + [(10, "Compute 13 + 7 * 3 - 45 / 9 + 8"), (11, "Why 43? go with Kim, Lea, Max, Ned, Ole, Pia, Quin, Ray, Sue, Tim")], "doc_id long, text string")
    for sent in (1 << 20, 0):
        got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(d, b, sent=sent).collect()}
        assert set(got) == {(i, i) for i in range(4)} and all(r["coverage"] == 1 and r["replaced"] == 0 for r in got.values())


def test_names_that_begin_sentences_are_swapped(spark):
    b = spark.createDataFrame([(1, "Tom has 5 apples. Tom gives 2 to Sara. How many apples does Tom have?"), (2, "Greta walks to the station every morning before work.")], "item_id long, text string")
    d = spark.createDataFrame([(1, "Anna has 7 apples. Anna gives 3 to Lucy. How many apples does Anna have?"), (2, "We saw that Paula walks to the station every morning before work."), (3, "Peter walks to the market every evening after work.")], "doc_id long, text string")
    for sent in (1 << 20, 0):
        got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(d, b, sent=sent).collect()}
        assert set(got) == {(1, 1), (2, 2)} and got[1, 1]["coverage"] > 0.8 and got[1, 1]["replaced"] == 4


def test_stages_decide_by_row(spark, sf, docs):
    import corpus_pipeline as P

    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(P.near_duplicate(spark, make([(None, base), (2, base), (2, base), (2, "one other text of a few words"), (None, None)]), sf)) == [(2, base), (2, "one other text of a few words"), (None, None)]
    assert rows(P.decontaminated(spark, make([(None, item), (5, item), (5, base), (None, base)]), sf)) == [(5, base), (None, base)]
    private = make([(None, "mail a@b.cd now"), (7, "mail a@b.cd now"), (7, "at 10.0.0.1 end"), (7, "no such thing here"), (None, None)])
    assert rows(P.without_personal_data(spark, private, sf)) == [(7, "at <ip> end"), (7, "mail <email> now"), (7, "no such thing here"), (None, "mail <email> now"), (None, None)]
    both = P.toxic(spark, docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))), sf)
    assert both.where("doc_id is null").count() == both.where("doc_id is not null").count() < docs.count()


def test_budgets_of_many_leaves_are_water_filling():
    """At 20000 leaves: sums whole, no leaf above its capacity, all that are below it at one level but for a token."""
    r = random.Random(5)
    tokens = {("a", f"s{i:05d}"): r.randint(1, 10**6) for i in range(20000)}
    weights = {k: r.choice([0.25, 1.0, 3.0]) for k in tokens}
    total = sum(tokens.values()) // 2
    got = mixing.budgets(tokens, total, weights, 1)
    assert sum(got.values()) == total and all(0 <= got[k] <= tokens[k] for k in tokens)
    short = [k for k in tokens if got[k] < tokens[k]]
    low, high = max((got[k] - 1) / weights[k] for k in short), min((got[k] + 1) / weights[k] for k in short)
    assert low <= high  # one level fits all
    assert all(tokens[k] / weights[k] <= high for k in tokens if got[k] == tokens[k])


def brute_places(own, needs):
    """Places pushed along all needs until nothing moves, endless ones by their length; None on or behind a cycle."""
    place = {c: (*k, 0) for c, k in own.items()}
    for _ in range(3 * len(own) + 3):
        for c, some in needs.items():
            for n in some:
                if place[n] >= place[c]:
                    place[c] = (*place[n][:2], place[n][2] + 1)
    return {c: None if p[2] > len(own) else p for c, p in place.items() if p[2]}


def test_places_like_pushing_until_nothing_moves():
    r = random.Random(8)
    for _ in range(3000):
        n = r.randint(1, 9)
        own = {i: (r.randint(0, 5), r.randint(0, 1)) for i in range(n)}
        needs = {i: r.sample(range(n), r.randint(0, min(2, n))) for i in range(n) if r.random() < r.choice([0.3, 0.9])}
        assert toolcalls.places(own, needs) == brute_places(own, needs), (own, needs)


def test_a_long_chain_of_calls_takes_one_task(spark):
    n = 3000
    rows = [(1, i, 0, f"c{i}", [f"c{i + 1}"] if i < n - 1 else []) for i in range(n)] + [(2, 0, 0, "a", ["b"]), (2, 1, 0, "b", ["a"]), (2, 2, 0, "d", ["b"]), (2, 0, 1, "e", ["b"]), (3, 0, 0, "x", []), (3, 1, 0, "y", ["x"])]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, seq int, call_id string, needs array<string>")
    got = {(x["conv_id"], x["call_id"]): (tuple(x["place"]), x["cyclic"]) for x in toolcalls._ordered(calls).collect()}
    assert all(got[1, f"c{i}"] == ((n - 1, 0, n - 1 - i), False) for i in range(n))
    rest = {k: v for k, v in got.items() if k[0] > 1}
    assert rest == {(2, "a"): ((0, 0, 0), True), (2, "b"): ((1, 0, 0), True), (2, "d"): ((2, 0, 0), False), (2, "e"): ((0, 1, 0), True), (3, "x"): ((0, 0, 0), False), (3, "y"): ((1, 0, 0), False)}
    some = calls.where("conv_id > 1")
    assert {(x["conv_id"], x["call_id"]): (tuple(x["place"]), x["cyclic"]) for x in toolcalls._ordered(some, 0).collect()} == rest
