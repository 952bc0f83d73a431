import collections
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomctx.llm.suffixarray import repeated_bytes, suffix_array
from loomctx.llm.suffixtree import prefix_groups, repeated_words
from loomctx.llm.suffixtree import repeats as tree_repeats


def brute_words(texts, length=20):
    seen, out = set(), {}
    for k in sorted(texts):
        w = (texts[k] or "").encode().split()
        gone = bytearray(len(w))
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = [x for x, g in zip(w, gone) if not g]
        out[k] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def brute_bytes(texts, length):
    bodies = {k: (t or "").encode() for k, t in texts.items()}
    count = collections.Counter(b[i : i + length] for b in bodies.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in bodies.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


SPECIAL = {-1: None, -2: "", -3: "w0 w1 w2 " * 30, -4: "a " * 500, -5: "x " * 3000 + " ".join(map(str, range(50))), -6: " ".join(map(str, range(10, 60))), -7: "ab" * 300, -8: "a" * 399, -9: "é" * 200, -10: "z" * 3000 + " ".join(map(str, range(200))), -11: " ".join(map(str, range(10, 190)))}


@pytest.fixture(scope="module")
def with_special(spark, docs, texts):
    return docs.select("doc_id", "text").union(spark.createDataFrame(list(SPECIAL.items()), "doc_id long, text string")), texts | SPECIAL


def test_words_like_brute_force(with_special):
    df, texts = with_special
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeated_words(df).collect()}
    assert got == brute_words(texts)


def test_bytes_like_brute_force(with_special):
    df, texts = with_special
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_bytes(df).collect()}
    assert got == brute_bytes(texts, 400)


@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(2, 40), st.booleans(), st.integers(1, 3))
@settings(max_examples=120, deadline=None)
def test_suffix_array(symbols, depth, on_disk, copies):
    text = np.array(symbols * copies + [0], np.uint16)
    order, prefix = suffix_array(text, depth, 8 if on_disk else 1 << 20)
    t, n = text.tolist(), len(text)
    assert sorted(order.tolist()) == list(range(n))
    cut = [tuple(t[i : i + depth]) for i in order]
    assert cut == sorted(cut)
    common = [0] + [next((k for k in range(depth) if a + k >= n or b + k >= n or t[a + k] != t[b + k]), depth) for a, b in zip(order[:-1].tolist(), order[1:].tolist())]
    assert prefix.tolist() == common


@given(st.lists(st.integers(0, 3), min_size=12, max_size=150), st.integers(2, 8))
@settings(max_examples=60, deadline=None)
def test_subtrees(symbols, group):
    hashes = np.array(symbols, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    suffixes = np.arange(len(symbols) - 7)
    parts = [p for p, _ in prefix_groups(hashes, suffixes, 8, group)]
    assert len(np.unique(np.concatenate(parts))) == sum(map(len, parts)) if parts else True
    got = set()
    for order, node in tree_repeats(hashes, suffixes, 8, group):
        for k in np.unique(node):
            got.add(tuple(sorted(order[node == k].tolist())))
    where = collections.defaultdict(list)
    for i in suffixes.tolist():
        where[tuple(symbols[i : i + 8])].append(i)
    assert got == {tuple(v) for v in where.values() if len(v) > 1}


def test_odd_rows(odd, nothing):
    words, data = repeated_words(odd).collect(), repeated_bytes(odd).collect()
    assert len(words) == len(data) == odd.count()
    # rows that repeat an id are documents of their own: of equal texts the first keeps its words
    two = sorted(r["n_removed"] for r in words if r["doc_id"] == 2)
    assert two == [28, 28] and [r["n_removed"] for r in words if r["doc_id"] == 1] == [0]
    assert [r["n_removed"] for r in words if r["doc_id"] is None and r["n_words"]] == [28]
    assert {r["n_words"] for r in words if r["doc_id"] in (3, 4, 10)} == {0}
    assert [r["n_removed"] for r in data if r["doc_id"] == 11] == [20000]
    assert repeated_words(nothing).collect() == repeated_bytes(nothing).collect() == []


def test_widely_shared_passages(spark, monkeypatch):
    """The same result where anchors are hot."""
    from loomctx.llm import segments

    monkeypatch.setattr(segments, "HOT_ROWS", 4)
    passage = " ".join(f"p{i}" for i in range(150))
    texts = {i: " ".join(f"a{i}x{j}" for j in range(i % 30)) + " " + passage + " " + " ".join(f"b{i}x{j}" for j in range(i % 17)) for i in range(120)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeated_words(df).collect()} == brute_words(texts)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_bytes(df).collect()} == brute_bytes(texts, 400)


def test_copies_of_hot_anchors_meet_no_counts(spark, monkeypatch):
    """Of a hot anchor's rows only a few for each content go on to be joined with counts, however many copies there are; texts are joined alike at any size."""
    from loomctx.llm import segments

    monkeypatch.setattr(segments, "HOT_ROWS", 4)
    monkeypatch.setattr(segments, "PARTS", 2)
    write, led = segments.written, []

    def counted(df, name):
        out = write(df, name)
        if name == "leads":
            led.append((out.count(), out.select("anchor", "content").distinct().count()))
        return out

    monkeypatch.setattr(segments, "written", counted)
    passage = " ".join(f"p{i}" for i in range(150))
    texts = {i: passage if i % 4 else f"{i} {passage}" for i in range(160)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = repeated_bytes(df)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()} == brute_bytes(texts, 400)
    assert len(led) == 1 and 0 < led[0][0] <= 2 * led[0][1]
    assert "strategy=merge" in out._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("crowd", [3, 1000])
def test_texts_are_joined_alike_crowded_or_not(spark, monkeypatch, crowd):
    """The segments to compare are written before the result is made, which reads the texts once, whether an anchor is crowded or not."""
    from loomctx.llm import segments

    monkeypatch.setattr(segments, "CROWD", crowd)
    write, names = segments.written, []
    monkeypatch.setattr(segments, "written", lambda df, name: names.append(name) or write(df, name))
    passage = " ".join(f"p{i}" for i in range(150))
    texts = {i: f"{'ab'[i % 2] * (i % 5)} a{i} {passage} b{i}" for i in range(40)}
    out = repeated_bytes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    leaves = out._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert [leaves.apply(i).toString().count("text#") for i in range(leaves.size()) if "text#" in leaves.apply(i).toString()] == [1]
    assert "cut" in names and any(n.startswith("fine-") for n in names) == (crowd == 3)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()} == brute_bytes(texts, 400)


@pytest.mark.parametrize("words", [12, 18, 70, 150])
def test_crowded_passages(spark, monkeypatch, words):
    """The same result where an anchor's contents are too many for one task, down to whole windows as keys; hot anchors or not."""
    from loomctx.llm import segments

    monkeypatch.setattr(segments, "CROWD", 3)
    monkeypatch.setattr(segments, "HOT_ROWS", 4 if words in (18, 150) else 1000)
    passage = " ".join(f"p{i}" for i in range(words))
    texts = {i: f"{'ab'[i % 2] * (i % 5)} a{i % 40} " + passage + " " + " ".join(f"b{i % 50}x{j}" for j in range(i % 17)) + (" z" * 500 if i % 10 == 0 else "") for i in range(120)}
    texts |= {200: None, 201: "", 202: passage, 203: passage + " " + passage}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeated_words(df).collect()} == brute_words(texts)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_bytes(df).collect()} == brute_bytes(texts, 400)


def test_finer_keys_are_those_of_the_window():
    """Equal windows have equal keys at every width, wherever they stand; at width 1 different windows have different keys."""
    from loomctx.llm import segments

    rng = np.random.default_rng(7)
    core = bytes(rng.integers(97, 101, 60))
    bodies = [bytes(rng.integers(97, 99, k)) + core + bytes(rng.integers(97, 99, 9 - k)) for k in range(10)]
    for width in (0, 8, 3, 1):
        e = segments.ByteElements(bodies, 30)
        key = {}
        for start, n, k in zip(*(x.tolist() for x in segments.segments(e, 30, 6, width)[:3])):
            for s in range(start, start + n):
                assert key.setdefault(e.data[s : s + 30].tobytes(), k) == k
        assert width != 1 or len(set(key.values())) == len(key)
