"""Decontamination against a plain twin over strings: tokens, readings, slot consistency and thresholds; empty tables."""

import random
import re
from collections import Counter, defaultdict

from loomctx.llm import decontam, pii

WIDTH, LITERALS, SHARE, RUN = 8, 4, 0.5, 6
NUM, UNIT, NAME = ("number",), ("unit",), ("name",)


def token_rows(text):
    """(word in lower case, reading with inner names, reading with all capitalised words as names); a reading is a placeholder or None."""
    raw = (text or "").encode().decode("latin-1")
    out, last, first, counted = [], 0, True, False
    for m in re.finditer(r"[A-Za-z\x80-\xff]+|[0-9]+(?:[.,][0-9]+)*", raw):
        word = re.sub("[A-Z]+", lambda c: c[0].lower(), m[0])
        number = m[0][0] in "0123456789" or word in decontam.NUMBER_WORDS
        unit = not number and counted and word in decontam.UNITS
        large = [x.start() for x in re.finditer("[A-Z]|\xc3(?=[\x80-\x9e])", m[0])]
        capital = not number and not unit and large == [0] and len(m[0]) > 1
        inner = capital and not first and not re.search("[.!?:;\n]", raw[last : m.start()])
        slot = NUM if number else UNIT if unit else None
        out.append((word, slot or (NAME if inner else None), slot or (NAME if capital else None)))
        last, first, counted = m.end(), False, number
    return out


def readings(rows, width):
    """[(at, window, slot values, whether it is a template)]."""
    out = []
    for at in range(len(rows) - width + 1):
        some, fewer = rows[at : at + width], -1
        for k in (1, 2) if width >= decontam.SHORTEST else ():
            slots = [r[0] for r in some if r[k]]
            if len(slots) > fewer and width - len(slots) >= min(LITERALS, width - 1):
                out.append((at, tuple(r[k] or r[0] for r in some), slots, True))
            fewer = len(slots)
        if fewer != 0:
            out.append((at, tuple(r[0] for r in some), [], False))
    return out


def brute(docs, items):
    known, about = defaultdict(list), {}
    for item, text in items.items():
        rows = token_rows(text)
        width = min(WIDTH, len(rows))
        if width:
            found = readings(rows, width)
            templated = {at for at, _, _, t in found if t}
            about[item] = (templated, len(rows) - width + 1)
            for at, window, slots, _ in found:
                known[window].append((item, at, slots))
    rank = {}
    order = lambda w: rank.setdefault(w, int(decontam._word_hashes([w.encode("latin-1").decode("utf-8", "surrogateescape")])[0].astype("int64")))
    out = {}
    for doc, text in docs.items():
        hits = defaultdict(list)
        rows = token_rows(text)
        for width in {len(w) for w in known}:
            for _, window, slots, _ in readings(rows, width):
                for item, at, theirs in known.get(window, ()):
                    hits[item].append((at, theirs, slots))
        for item, some in hits.items():
            pairs = Counter(p for _, a, b in some for p in zip(a, b))
            stands = {a: max((n, order(y), y) for (x, y), n in pairs.items() if x == a)[2] for a, _ in pairs}
            ats = {at for at, a, b in some if all(stands[x] == y for x, y in zip(a, b))}
            templated, windows = about[item]
            templates = len(ats & templated)
            enough = templates >= RUN or templated and templates >= SHARE * len(templated)
            n, of = (templates, len(templated)) if enough else (len(ats), windows)
            if n and (n / of >= SHARE or n >= RUN):
                out[doc, item] = (n, of, n / of, sum(x != y for x, y in stands.items()))
    return out


def compare(spark, docs, items):
    d = spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")
    b = spark.createDataFrame(sorted(items.items()), "item_id long, text string")
    want = brute(docs, items)
    got = {(r["doc_id"], r["item_id"]): (r["windows"], r["item_windows"], r["coverage"], r["replaced"]) for r in decontam.contaminated(d, b).collect()}
    assert got == want
    return want


def test_whole_tables_like_the_plain_twin(spark, texts, sf):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    found = compare(spark, texts, items)
    assert found
    # every item once more, its numbers, names and units changed alike or each on its own, among other text
    rng, docs = random.Random(4), {}
    names = ["Ulla", "Viktor", "Wanda", "Xaver"]
    for n, text in items.items():
        same = {}
        swap = lambda m: same.setdefault(m[0], str(rng.randint(2, 999)))
        docs[10 * n] = "so then " + re.sub(r"\d+", swap, text) + " and that was all"
        docs[10 * n + 1] = re.sub(r"\d+", lambda m: str(rng.randint(2, 999)), text)
        docs[10 * n + 2] = re.sub(r"(?<=[a-z] )[A-Z][a-z]+", lambda m: same.setdefault(m[0], rng.choice(names)), text)
        words = text.split(" ")
        rng.shuffle(words)
        docs[10 * n + 3] = " ".join(words)
    found = compare(spark, docs, items)
    assert all((10 * n, n) in found for n, t in items.items() if t and len(token_rows(t)) >= WIDTH)


def test_random_questions_like_the_plain_twin(spark):
    rng = random.Random(11)
    vocabulary = "the of sold bought apples boxes and gives to then Tom Anna Sara Öz Émil two seven 12 3.5 1,000 kg miles hours . ? : how many are left McX I".split()
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = {i: make(rng.choice([1, 2, 3, 5, 9, 16, 24])) for i in range(40)} | {90: "", 91: None, 92: "...", 93: "Why 42?"}
    docs = {}
    for i in range(120):
        words = (items[rng.randrange(40)] or "").split(" ")
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs[i] = make(rng.randint(0, 6)) + " " + " ".join(words) + " " + make(rng.randint(0, 12))
    docs |= {500: None, 501: "", 502: "é" * 2000, 503: "12 " * 300}
    assert compare(spark, docs, items)


def test_empty_tables(spark, sf, nothing):
    import corpus_pipeline as P

    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontam.contaminated(nothing, benchmark).collect() == []
    assert decontam.contaminated(nothing.union(spark.createDataFrame([(1, "some text", "en", "s", 9)], nothing.schema)), benchmark.limit(0)).collect() == []
    assert pii.personal_data(nothing).collect() == [] and pii.redacted(nothing).collect() == []
    for _, stage in P.STAGES:
        out = stage(spark, nothing, sf)
        assert out.collect() == [] and set(nothing.columns) <= set(out.columns)
