"""Index, edit, index again; packs and graph questions on a small repository."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomctx.operators import search
from loomctx.plans.engine import Engine, NoIndex
from loomctx.rpc import answer
from loomctx.sources import config

FILES = {
    "fx.py": 'class FxRateService:\n    """Rates."""\n\n    def rate(self, a):\n        return self.lookup(a)\n\n    def lookup(self, a):\n        return 1.0\n',
    "payments.py": "from fx import FxRateService\n\n\nclass PaymentValidator:\n    def validate(self, amount):\n        return amount > 0\n\n    def limits(self):\n        return 1\n\n\ndef process_payment(amount):\n    return PaymentValidator().validate(amount)\n",
    "tests/test_payments.py": "from payments import PaymentValidator, process_payment\n\n\ndef test_validate():\n    assert PaymentValidator().validate(1)\n    assert process_payment(1)\n",
    "README.md": "# Demo\n\nPaymentValidator and process_payment are described here.\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    e = Engine(spark, str(root))
    with pytest.raises(NoIndex):
        e.status()
    e.first = e.index()
    return e


def test_first_index(engine):
    assert (engine.first["files_indexed"], engine.first["chunks_new"]) == (4, 4)
    nodes, edges = engine.store.table("nodes"), engine.store.table("edges")
    assert {r["kind"]: r["count"] for r in nodes.groupBy("kind").count().collect()} == {1: 4, 2: 4, 3: 4, 4: 1}
    assert {r["kind"]: r["count"] for r in edges.groupBy("kind").count().collect()} == {1: 2, 2: 3, 5: 2, 6: 2}
    top = nodes.where("kind = 2").orderBy(F.desc("centrality")).first()
    assert top["centrality"] == 1.0


def test_pack_is_relevant_explained_and_stable(engine):
    a = engine.pack("Refactor PaymentValidator to use FxRateService", 4000, log=False)
    assert {"PaymentValidator", "FxRateService"} <= {i["symbol"] for i in a["items"] if i["type"] == "ast_chunk" and i["why"]["reason"] == "anchor"}
    assert a["totals"]["selected_tokens"] <= 4000 < 10**6 and all(i["why"]["detail"] for i in a["items"])
    b = engine.pack("Refactor PaymentValidator to use FxRateService", 4000, log=False)
    assert [i["node"] for i in a["items"]] == [i["node"] for i in b["items"]]
    small = engine.pack("Refactor PaymentValidator to use FxRateService", 60, log=False)
    assert small["totals"]["selected_tokens"] <= 60


def test_modes(engine):
    pr = engine.pack("improve logging", 4000, "pr", dirty_paths=["payments.py"], log=False)
    assert any(i["why"]["reason"] == "anchor" and i["path"] == "payments.py" for i in pr["items"]) and pr["freshness"]["state"] == "stale"
    assert not any(i["why"]["reason"] == "anchor" for i in engine.pack("improve logging", 4000, dirty_paths=["payments.py"], log=False)["items"])
    security = engine.pack("review PaymentValidator", 4000, "security", log=False)
    assert any("security mode: matches 'valid'" in i["why"]["detail"] for i in security["items"])
    with pytest.raises(ValueError, match="unknown mode"):
        engine.pack("x", mode="yolo")


def test_questions(engine):
    assert [c["symbol"] for c in engine.callers("PaymentValidator")] == ["process_payment", "test_validate"]
    assert engine.tests("process_payment")[0]["symbol"] == "test_validate"
    assert engine.tests("payments.py")
    with pytest.raises(KeyError):
        engine.tests("nothing_there")
    assert engine.explain("PaymentValidator")["signature"].startswith("class PaymentValidator")
    assert engine.impact("fx.py", 3)[0]["distance"] == 1
    packed = engine.pack("process_payment", 500)
    assert engine.why(packed["pack_id"])["query"] == "process_payment" and engine.why("none") is None
    assert engine.cache_report()["score"] == 1.0
    for form in ("plain", "messages", "chat"):
        assert "process_payment" in engine.render(packed, form)
    assert engine.pr_context()["suggested_pack"] is None
    assert engine.coverage(packed)["risk"]["level"] in ("low", "medium", "high")


def test_rpc(engine):
    ask = lambda **m: answer(engine, {"jsonrpc": "2.0", "id": 1, **m})
    assert len(ask(method="tools/list")["result"]["tools"]) == 8
    assert ask(method="tools/call", params={"name": "find_callers"})["result"]["isError"]
    got = ask(method="tools/call", params={"name": "find_callers", "arguments": {"symbol": "PaymentValidator"}})
    assert "process_payment" in json.loads(got["result"]["content"][0]["text"])["callers"][0]["symbol"]
    assert ask(method="nope")["error"]["code"] == -32601 and answer(engine, {"method": "ping"}) is None


def test_edits(engine):
    again = engine.index()
    assert (again["chunks_new"], again["chunks_staled"], again["chunks_preserved"], again["files_unchanged"]) == (0, 0, 4, 4)
    path = f"{engine.root}/payments.py"
    text = open(path).read()
    open(path, "w").write("# a comment\n" + text)
    comment = engine.index()
    assert (comment["chunks_new"], comment["chunks_staled"], comment["files_indexed"]) == (0, 0, 1)
    open(path, "w").write("# a comment\n" + text.replace("return 1\n", "return 22\n"))
    edited = engine.index()
    assert (edited["chunks_new"], edited["chunks_staled"]) == (1, 1)
    assert engine.store.table("edges").where("kind = 7").count() == 1
    open(f"{engine.root}/new.bin.py", "wb").write(b"a\0b")
    assert engine.dirty() == []
    assert engine.index()["files_seen"] == 5
    assert engine.status()["skipped_files"] == 1 and [c[0] for c in engine.doctor()].count("fail") == 0
    import os

    os.remove(f"{engine.root}/README.md")
    assert engine.dirty() == ["README.md"]
    assert engine.index()["files_deleted"] == 1 and engine.status()["docs"] == 0
    assert engine.gc(0)["nodes_removed"] > 0


def test_config(tmp_path):
    assert config.load(str(tmp_path))["budget"] == 12000
    assert config.init(str(tmp_path)) == ["config.toml", ".gitignore"] and config.init(str(tmp_path)) == []
    (tmp_path / ".loomctx" / "config.toml").write_text("[plan]\nthreshold = 0.55\n")
    assert config.load(str(tmp_path)) == {"weights": {"text": 0.4, "hop": 0.25, "edge_prior": 0.15, "centrality": 0.1, "role": 0.1}, "budget": 12000, "threshold": 0.55}
    (tmp_path / ".loomctx" / "config.toml").write_text("[plan\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path))


def test_bm25_like_fts5(spark):
    texts = ["the quick brown fox", "the lazy dog and the fox", "quick quick dog", "nothing here", "fox fox fox in socks", "un café à la carte"]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(body, tokenize=\"unicode61 tokenchars '_'\")")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    con.executemany("insert into t(rowid, body) values (?, ?)", list(enumerate(texts)))
    want = {r: -s for r, s in con.execute("select rowid, bm25(t) from t where t match 'fox OR quick OR cafe'")}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    posts = search.postings(docs, "id", "body")
    got = search.bm25(posts, search.lengths(docs, "id", "body"), spark.createDataFrame([(1, "fox quick café")], "query_id int, query string"))
    assert {r["id"]: pytest.approx(r["score"], abs=1e-5) for r in got.collect()} == want


def test_usage_stream(spark, tmp_path):
    from loomctx.operators.maintain import usage_stats
    from loomctx.streaming.usage import usage_stream

    rows = spark.createDataFrame([(i, f"n{i % 3}") for i in range(20)], "event_id long, node_id string").withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1700000000))
    rows.unionByName(rows.limit(5)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = usage_stream(stream).writeStream.outputMode("complete").format("memory").queryName("usage_now").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("usage_now").collect())) == sorted(map(tuple, usage_stats(rows).collect()))


def test_evaluation(spark, tmp_path):
    from loomctx.plans.evaluate import evaluate, verify

    root = tmp_path / "small"
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    manifest = evaluate(spark, [str(root), str(tmp_path / "missing")], str(tmp_path / "out"))
    assert (manifest["repos"], manifest["packs"], manifest["failures"]) == (1, 9, 1)
    checks = verify(spark, [str(root)], str(tmp_path / "out"))
    assert [c for c, ok in checks if not ok] == ["no failures"] and len(checks) == 12
    assert "| budget |" in (tmp_path / "out" / "report.md").read_text()


def test_only_changed_files_are_parsed(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    e = Engine(spark, str(tmp_path))
    e.index()
    assert e.parsed == 4
    (tmp_path / "fx.py").write_text(FILES["fx.py"] + "\n\ndef amount(x):\n    return process_payment(x)\n")
    (tmp_path / "README.md").unlink()
    e.index()
    assert e.parsed == 1 and {r["path"] for r in e.store.table("declarations").collect()} == set(FILES) - {"README.md"}
    graph = lambda: {(r["src"], r["kind"], r["dst"], r["weight"]) for r in e.store.table("edges").where("kind < 7").collect()}
    before = graph()
    e.index(force=True)
    assert e.parsed == 3 and graph() == before
