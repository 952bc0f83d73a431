"""Jobs: growing input, repeated and broken runs, replaced partitions, command lines."""

import json
import os
import re
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from jobs import context_packs, index_documents, queries, settings
from loomctx.operators import postings, search
from loomctx.plans import catalogue

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def add(spark, path, rows):
    spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], DOCS).coalesce(1).write.mode("append").parquet(path)


def terms(docs):
    plain = str.maketrans(search.ACCENTED, search.PLAIN)
    lists = {i: re.findall(r"\w+", t.lower().translate(plain)) for i, t in docs.items()}
    df = Counter(w for words in lists.values() for w in set(words))
    return sorted((w, i, n, len(words), df[w]) for i, words in lists.items() for w, n in Counter(words).items())


def indexed(spark, path):
    return sorted(map(tuple, index_documents.result(spark, path).collect()))


def test_index_takes_only_what_is_new(spark, sf, tmp_path):
    at = {k: f"file://{tmp_path}/{k}" for k in ("documents", "index", "checkpoint")}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40 and text is not null").collect()}
    first = {i: t for i, t in texts.items() if i < 25}
    add(spark, at["documents"], [*first.items(), (None, "nobody's text"), (3, "a a"), (3, None)])
    first[3] = max(first.get(3, ""), "a a")
    done = index_documents.run(spark, **at)
    assert done == {"read": len(first) + 3 - (3 not in texts), "written": len(first), "deleted": 0, "without_id": 1, "batch": 0}
    assert indexed(spark, at["index"]) == terms(first)
    # nothing new: nothing is read or written
    before = {str(p): p.stat().st_mtime_ns for p in tmp_path.joinpath("index").rglob("*.parquet")}
    assert index_documents.run(spark, **at)["read"] == 0
    assert before == {str(p): p.stat().st_mtime_ns for p in tmp_path.joinpath("index").rglob("*.parquet")}
    # one new file: new documents, one replaced, one deleted, one deletion of nothing
    late = {i: t for i, t in texts.items() if i >= 25} | {5: "quite another text"}
    add(spark, at["documents"], [*late.items(), (7, None), (1000, None)])
    done = index_documents.run(spark, **at)
    assert (done["read"], done["written"], done["deleted"], done["batch"]) == (len(late) + 2, len(late), 2, 1)
    now = {i: t for i, t in (first | late).items() if i != 7}
    assert indexed(spark, at["index"]) == terms(now)
    assert {str(p) for p in tmp_path.joinpath("index").rglob("*.parquet")} > set(before)


def test_a_broken_run_is_repeated(spark, tmp_path, monkeypatch):
    at = {k: f"file://{tmp_path}/{k}" for k in ("documents", "index", "checkpoint")}
    add(spark, at["documents"], [(1, "red green"), (2, "blue")])
    index_documents.run(spark, **at)
    add(spark, at["documents"], [(2, "red"), (3, "green green")])
    whole = postings.blocks

    def broken(*arguments):
        raise OSError("executors lost")

    monkeypatch.setattr(postings, "blocks", broken)
    with pytest.raises(Exception):
        index_documents.run(spark, **at)
    # readers still see the batch before
    assert indexed(spark, at["index"]) == terms({1: "red green", 2: "blue"})
    monkeypatch.setattr(postings, "blocks", whole)
    index_documents.run(spark, **at)
    assert indexed(spark, at["index"]) == terms({1: "red green", 2: "red", 3: "green green"})


def test_files_come_in_batches(spark, tmp_path):
    at = {k: f"file://{tmp_path}/{k}" for k in ("documents", "index", "checkpoint")}
    for n in range(3):
        add(spark, at["documents"], [(n, f"text {n}"), (9, f"version {n}")])
    done = index_documents.run(spark, **at, files_per_batch=1)
    assert done["batch"] == 2 and done["read"] == 6
    assert [t for t, i, *_ in indexed(spark, at["index"]) if i == 9 and t != "version"] in (["0"], ["1"], ["2"])


@pytest.fixture(scope="module")
def packed(spark, sf, tmp_path_factory):
    out = f"file://{tmp_path_factory.mktemp('packs')}"
    paths = (f"{sf}/documents.parquet", f"{sf}/benchmark.parquet", out)
    return paths, context_packs.run(spark, *paths, 2000)


def rows(spark, out):
    return sorted((tuple(r[c] for c in sorted(r.asDict())) for r in context_packs.result(spark, out).collect()), key=repr)


def test_packs_replace_their_modes_only(spark, packed):
    paths, done = packed
    before = rows(spark, paths[2])
    assert done["items"] == len(before) > 0 and done["totals"] > 0
    files = lambda: {m: sorted(f for f in context_packs.result(spark, paths[2]).where(f"mode = '{m}'").inputFiles() if f"mode={m}/" in f) for m in ("bugfix", "test")}
    old = files()
    context_packs.run(spark, *paths, 2000, modes="bugfix")
    assert rows(spark, paths[2]) == before
    assert files()["test"] == old["test"] and files()["bugfix"] != old["bugfix"]
    context_packs.run(spark, *paths, 500, modes="bugfix, test")
    after = rows(spark, paths[2])
    spent = Counter()
    for r in context_packs.result(spark, paths[2]).collect():
        spent[r["mode"], r["request_id"]] += r["tokens"]
    assert after != before and max(v for (m, _), v in spent.items() if m in ("bugfix", "test")) <= 500 < max(spent.values())
    with pytest.raises(ValueError):
        context_packs.run(spark, *paths, 2000, modes="nonsense")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_jobs_match_their_twins(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    done = con.execute(queries.ORACLES[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in done.fetchall())


def test_settings_of_a_job(tmp_path, capsys):
    file = tmp_path / "job.json"
    file.write_text(json.dumps({"documents": "a", "budget": 5}))
    read = lambda *options: settings.settings("a job", str(file), {"documents": str, "budget": int}, list(options))
    assert read() == {"documents": "a", "budget": 5}
    assert read("--budget", "7") == {"documents": "a", "budget": 7}
    file.write_text(json.dumps({"documents": "a", "colour": 1}))
    with pytest.raises(SystemExit):
        read()
    assert "budget, colour" in capsys.readouterr().err
    for job in (index_documents, context_packs):
        with open(job.CONFIG, encoding="utf-8") as f:
            assert set(json.load(f)) == set(job.SETTINGS)


def test_command_line_runs_a_job(spark, tmp_path):
    add(spark, f"file://{tmp_path}/documents", [(1, "red green"), (2, "blue")])
    at = [f"--{k}=file://{tmp_path}/{k}" for k in ("documents", "index", "checkpoint")]
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "jobs.index_documents", *at], cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "'read': 2" in done.stderr and "'written': 2" in done.stderr
    assert indexed(spark, f"file://{tmp_path}/index") == terms({1: "red green", 2: "blue"})


def test_catalogue_has_no_job_names():
    assert not set(queries.QUERIES) & set(catalogue.QUERIES)
