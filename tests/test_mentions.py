"""Mentions of names with any signs in them, against plain Python."""

import random
import re
import time

from loomctx.operators import graph


def mentioned(text, name):
    at = text.find(name)
    word = lambda c: re.fullmatch(r"\w", c) is not None
    while at >= 0:
        if not (at and word(text[at - 1])) and not (at + len(name) < len(text) and word(text[at + len(name)])):
            return True
        at = text.find(name, at + 1)
    return False


def test_names_with_signs(spark):
    rng = random.Random(5)
    parts = ["$", "$$$$", "->", " ", "scope", "initAll", "é", "ß_x", "\\E", "\\Q", "-", "😀", "(", ")", "x", "name", "\n", "=", "*+?"]
    docs = {i: "".join(rng.choices(parts, k=rng.randint(0, 14))) for i in range(250)} | {900: "call $scopeInit and plainName here", 901: None}
    names = {"".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(150)} | {"$scopeInit", "plainName", "$$$$", "😀", "\\E\\Q", "scope", "initAll"}
    entries = [(f"n{i}", f"Mod.{n}" if i % 2 else n) for i, n in enumerate(sorted(n for n in names if "." not in n))] + [("a0", "scope")]
    got = graph.doc_mentions(spark.createDataFrame(list(docs.items()), "id int, content string"), spark.createDataFrame(entries, "id string, symbol string"), 3).collect()
    known = {}
    for i, s in entries:
        name = s.rsplit(".", 1)[-1]
        if len(name.encode()) >= 4:
            known[name] = min(known.get(name, i), i)
    want = sorted((known[n], d) for d, t in docs.items() if t for n in sorted((x for x in known if mentioned(t, x)), key=str.encode)[:3])
    missing = sorted(set(want) - {(r["src"], r["dst"]) for r in got})[:4]
    assert not missing, [(dict((i, n) for n, i in known.items())[s], docs[d]) for s, d in missing]
    assert sorted((r["src"], r["dst"]) for r in got) == want
    assert (known["$scopeInit"], 900) in want and (known["plainName"], 900) in want and len(want) > 100


def test_a_document_is_read_once_for_all_its_names(spark):
    """Many odd names whose words all stand in one long document: before, the document was copied and searched for each name (a minute and more)."""
    n = 3000
    text = " ".join(f"word{i}" for i in range(8 * n)) + " " + " ".join(f"=word{i}" for i in range(20))
    entries = [(f"a{i:05}", f"$word{i}") for i in range(n)] + [(f"b{i:05}", f"=word{i}") for i in range(n)] + [(f"c{i:05}", f"word{i}=x") for i in range(n)]
    began = time.monotonic()
    got = graph.doc_mentions(spark.createDataFrame([("d", text)], "id string, content string"), spark.createDataFrame(entries, "id string, symbol string")).collect()
    assert sorted(r["src"] for r in got) == sorted(f"b{i:05}" for i in sorted(range(20), key=str)[:8])
    assert time.monotonic() - began < 20
