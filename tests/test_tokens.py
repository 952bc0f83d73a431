"""Exact tokens against a naive merge and against an independent tokenizer."""

import base64
import os
import random
import time

import pytest

from loomctx.functions import tokens
from loomctx.plans.engine import Engine

FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def naive(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def test_merges_like_the_naive_ones():
    rng = random.Random(3)
    for _ in range(400):
        ranks = {}
        for _ in range(rng.randint(0, 30)):
            ranks.setdefault(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))), len(ranks))
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 40)))
        if piece not in ranks:
            assert tokens.pair_merges(piece, ranks) == naive(piece, ranks), (piece, ranks)
        assert b"".join(tokens.pair_merges(piece, ranks)) == piece


def test_one_very_long_piece():
    ranks = {b"a" * (1 << k): k for k in range(1, 12)}
    start = time.monotonic()
    assert len(tokens.pair_merges(b"a" * 200_000, ranks)) == 200_000 // 2048 + bin(200_000 % 2048).count("1")
    assert time.monotonic() - start < 20


def test_rank_files(spark, tmp_path):
    path = str(tmp_path / "ranks")
    with open(path, "w", encoding="ascii") as f:
        for rank, token in enumerate((b"a", b"b", b"ab", b"abab")):
            f.write(f"{base64.b64encode(token).decode()} {rank}\n")
    ranks = tokens.read_ranks(spark, path)
    assert ranks == {b"a": 0, b"b": 1, b"ab": 2, b"abab": 3}
    with pytest.raises(ValueError, match="more than 3 ranks"):
        tokens.read_ranks(spark, path, 3)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "abab"), (4, "ababa x"), (5, "\U0001f600")], "k int, text string")
    got = {r["k"]: r["n"] for r in rows.select("k", tokens.exact_tokens(spark, "text", ranks).alias("n")).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 4, 5: 4}
    assert spark.createDataFrame([], "text string").select(tokens.exact_tokens(spark, "text", ranks).alias("n")).count() == 0


@pytest.mark.skipif(not os.path.exists(FILE), reason="no rank file")
def test_documents_like_an_independent_tokenizer(spark, sf):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokens.read_ranks(spark, FILE)
    other = tiktoken.Encoding("other", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in docs.select("text", tokens.exact_tokens(spark, "text", ranks).alias("n")).collect():
        assert r["n"] == len(other.encode_ordinary(r["text"] or ""))


def test_engine_counts_by_the_encoding_of_its_settings(spark, tmp_path):
    root, ranks = tmp_path / "repo", tmp_path / "ranks"
    root.mkdir()
    ranks.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate((b"de", b"def", b" a"))))
    (root / "m.py").write_text("def f(a):\n    return a\n")
    engine = Engine(spark, str(root))
    engine.index()
    estimates = {r["id"]: r["tokens"] for r in engine.store.table("nodes").collect()}
    (root / ".loomctx" / "config.toml").write_text(f'[plan]\nencoding = "{ranks}"\n')
    engine.index()
    table = tokens.read_ranks(spark, str(ranks))
    count = lambda text: sum(len(naive(p.encode(), table)) for p in tokens.regex.findall(tokens.PATTERN, text))
    rows = engine.store.table("nodes").collect()
    assert {r["id"]: r["tokens"] for r in rows} == {r["id"]: count(r["content"]) for r in rows} != estimates
    (root / "n.py").write_text("def g(a):\n    return a\n")
    engine.index()
    rows = engine.store.table("nodes").collect()
    assert len(rows) > len(estimates) and all(r["tokens"] == count(r["content"]) for r in rows)
    pack = engine.packs(engine.requests([{"query": "f"}]))[0]
    assert pack["token_estimate"] is False and pack["tokenizer"] == "ranks"
