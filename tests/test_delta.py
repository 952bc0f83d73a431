"""Edges by change against a rebuild: the operators on random entries, the engine on edited repositories."""

import random
import shutil

from pyspark.sql import functions as F

from loomctx import schema as S
from loomctx.operators import delta, graph
from loomctx.plans.engine import Engine

LONG = "This section has words enough to be kept as a piece of documentation. " * 3
ENTRIES = "id string, path string, symbol string, ord long"
REFERENCES = "path string, chunk string, name string, kind int, is_test boolean"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def module(rng, path):
    """Entries and references of a file of a few functions."""
    names = [f"f{rng.randrange(12)}" for _ in range(rng.randint(0, 4))]
    placed = [(f"{path}:{n}:{rng.randrange(3)}:{k}", path, f"M.{n}", k * 10) for k, n in enumerate(names)]
    refs = {(path, e[0], f"f{rng.randrange(14)}", S.CALLS, path.startswith("t")) for e in placed for _ in range(2)}
    return placed, sorted(refs)


def test_references_and_imports_after_random_changes(spark):
    rng = random.Random(2)
    paths = [f"{'t' if i % 4 == 0 else 'p'}/m{i}.py" for i in range(30)]
    state = {p: module(rng, p) for p in paths[:24]}
    imports = lambda p: [(p, m, "python") for m in {f"m{hash(p) % 7}", f"p.m{len(p) * 3 % 30}", ".m9", "m25"}]
    frame = lambda st, k, schema: spark.createDataFrame([r for v in st.values() for r in v[k]], schema)
    files = lambda st: spark.createDataFrame([(p,) for p in st], "path string")
    asked = lambda st: spark.createDataFrame([r for p in st for r in imports(p)], "path string, module string, lang string")
    refs = graph.cut(graph.targets(frame(state, 1, REFERENCES), frame(state, 0, ENTRIES)))
    links = graph.cut(asked(state).join(graph.resolve_imports(asked(state), files(state)), ["path", "module"], "left"))
    for step in range(3):
        new = dict(state)
        changed = rng.sample(sorted(state), 2) + [paths[24 + step]]
        for p in changed[:2]:
            new[p] = module(rng, p)
        new[changed[2]] = module(rng, changed[2])
        gone = rng.choice(sorted(set(state) - set(changed)))
        del new[gone]
        touched = spark.createDataFrame([(p,) for p in [*changed, gone]], "path string")
        before, now = frame(state, 0, ENTRIES), frame(new, 0, ENTRIES)
        names = delta.changed_names(before.join(touched, "path", "left_semi"), now.join(touched, "path", "left_semi"))
        fresh = frame(new, 1, REFERENCES).join(touched, "path", "left_semi")
        refs, again = delta.change_references(refs, fresh, touched, names, now)
        refs = graph.cut(refs)
        columns = REFERENCES.replace(" string", "").replace(" int", "").replace(" boolean", "").split(", ") + ["target"]
        assert rows(refs, *columns) == rows(graph.targets(frame(new, 1, REFERENCES), now), *columns)
        assert rows(refs.where("target is not null"), "chunk", "target", "weight") == rows(graph.resolve_names(frame(new, 1, REFERENCES), now), "chunk", "target", "weight")
        moved = spark.createDataFrame([(changed[2],), (gone,)], "path string")
        links, links_again = delta.change_imports(links, asked(new).join(touched, "path", "left_semi"), touched, moved, files(new))
        links = graph.cut(links)
        want = asked(new).join(graph.resolve_imports(asked(new), files(new)), ["path", "module"], "left")
        assert rows(links, "path", "module", "target") == rows(want, "path", "module", "target")
        # a part of them only
        assert 0 < again.count() < refs.count() and 0 < links_again.count() < links.count()
        state = new


def test_moves_within_a_path_change_no_name(spark):
    before = spark.createDataFrame([("a", "p", "f", 1), ("b", "p", "g", 5), ("c", "p", "g", 9)], ENTRIES)
    assert rows(delta.changed_names(before, before.withColumn("ord", F.col("ord") + 3)), "name") == []
    assert rows(delta.changed_names(before, before.withColumn("ord", -F.col("ord"))), "name") == [("g",)]
    assert rows(delta.changed_names(before.limit(0), before), "name") == [("f",), ("g",)]


def edges(engine):
    return rows(engine.store.table("edges").where(F.col("kind") != S.SUPERSEDES), "src", "kind", "dst", "weight")


def test_engine_resolves_what_a_change_affects(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "pkg").mkdir(parents=True)
    for i in range(6):
        (root / "pkg" / f"m{i}.py").write_text(f"from pkg import m{(i + 1) % 6}\n\ndef work_{i}(a):\n    return shared(work_{(i + 1) % 6}(a))\n\ndef only_{i}():\n    return work_{i}(1)\n")
    (root / "notes.md").write_text(f"# Work\n\nwork_1 and work_2 are here. {LONG}\n\n# Other\n\nonly_3 too. {LONG}\n")
    (root / "more.md").write_text(f"# Late\n\nshared comes late. {LONG}\n")
    engine = Engine(spark, str(root))
    engine.index()
    whole = dict(engine.resolved)

    def rebuilt(name):
        copy = tmp_path / name
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".*"))
        other = Engine(spark, str(copy))
        other.index()
        return edges(other)

    # a body changes: its own references, and those to the names in it
    (root / "pkg" / "m2.py").write_text((root / "pkg" / "m2.py").read_text().replace("work_2(1)", "work_2(2)"))
    engine.index()
    assert engine.resolved["references"] <= 4 < whole["references"] and engine.resolved["imports"] == 1 < whole["imports"] and engine.resolved["documents"] == 0
    # a name comes that others have called and a document has named, another file goes
    (root / "pkg" / "late.py").write_text("from pkg import m0\n\ndef shared(a):\n    return a\n")
    (root / "pkg" / "m4.py").unlink()
    (root / "notes.md").write_text(f"# Work\n\nwork_1 and work_2 are here. {LONG}\n\n# Other\n\nonly_1 too. {LONG}\n")
    engine.index()
    assert engine.resolved["documents"] == 2
    assert edges(engine) == rebuilt("second")
