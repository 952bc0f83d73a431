import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from loomctx.llm import langid, pii, toxicity
from loomctx.llm.pii import Boosted, personal_data, redacted

PATTERNS = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == 0 or (kind == 1 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))) or (kind == 2 and 12 <= len(digits) <= 19 and luhn(digits)) or (kind == 3 and 9 <= len(digits) <= 15)
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


TEXTS = [
    None, "", "a.b@c.d_e@f.gh é 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 +1 (377) 555-0271. x@y@z.co +4912345678-", " q@w.com 12-34 +1 +2 +12345678901 ", "001.002.3.04 256.1.1.1 0000000255.1.1.1 a@@b.c %@x.y. 4 1 1 1-1111111111111 +1234567890123456 +123-45-6789-",
    " a@b.cd  10.0.0.1", "1" * 3000, "1 " * 3000, "x+" * 2000, "4111111111111111@4.5.6.7",
]


def test_base_spans(spark, docs, texts):
    rows = [(-1 - i, t) for i, t in enumerate(TEXTS)]
    all_texts = texts | dict(rows)
    for r in personal_data(docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        want = base_spans(all_texts[r["doc_id"]])
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[1] == i for x in want) for i in range(4)]
        spans = [tuple(x) for x in r["redactions"]]
        assert set(want) <= set(spans) and spans == sorted(spans)


def test_long_chains_do_not_recurse(spark):
    rows = spark.createDataFrame([(1, "1 " * 60000), (2, "a@b" + ".c" * 40000), (3, "9." * 30000), (4, "+" + "1(" * 40000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in personal_data(rows).collect()}
    assert got[2]["n_email"] == 1 and got[1]["n_card"] == 0 and got[4]["n_phone"] == 0


def test_boosting_learns_cells():
    cells = [((a, b), 50.0 if (a > 1) != (b > 2) else 1.0, 1.0 if (a > 1) != (b > 2) else 50.0) for a in range(4) for b in range(5)]
    model = Boosted().fit(cells)
    assert all((model.score(x) > 0.5) == (p > n) for x, p, n in cells)
    assert Boosted().fit([]).trees == []


def test_redaction(spark, odd):
    rows = spark.createDataFrame([(1, "mail a@b.cd now é 10.0.0.1 end", 5), (2, "plain", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in redacted(rows).collect()}
    assert got == {1: ("mail <email> now é <ip> end", 27), 2: ("plain", 5), 3: (None, None)}
    assert redacted(odd).count() == odd.count() and personal_data(odd).count() == odd.count()


def test_toxicity_held_out(spark, docs):
    rng = np.random.Generator(np.random.PCG64(1))
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        words = [f"w{rng.integers(0, 400)}" for _ in range(40)] + (["idiot", f"vile{rng.integers(0, 50)}x"] if toxic else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(d, y, sample=400).join(y, "doc_id").where("held_out").toPandas()
    assert 200 < len(got) < 400 and (got.predicted == got.toxic).mean() > 0.98 and got.score.between(0, 1).all()


def test_label_model_discounts_copies():
    y = np.array([1, 0] * 200)
    good = (y ^ (np.random.Generator(np.random.PCG64(6)).random(400) < 0.2)).astype(float)
    votes = np.stack([good, good, good, y.astype(float)], 1)
    posterior, weight, _ = toxicity.label_model(votes, y)
    single = toxicity.label_model(votes[:, 2:], y)[1]
    assert abs(weight[:3].sum() - single[0]) < 1e-6 and weight[3] > weight[:3].sum() and ((posterior > 0.5) == y).mean() > 0.85


def test_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (8, None), (1, 1)], "doc_id long, toxic int")
    for labels in (none, some):
        rows = toxicity.toxicity(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
        assert toxicity.toxicity(nothing, labels).collect() == []
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 8, 10)} == {"und"}
    assert langid.identify(nothing).collect() == []
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_held_out(docs):
    got = langid.identify(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 100").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.85


def test_training_takes_whole_texts(spark):
    """Every text of the sample is whole in its language's dictionary, whatever the number of languages; long ones come last."""
    rows = [(i, f"word{chr(97 + i % 26)} " * (5 + i % 7), f"l{i % 300:03d}") for i in range(1500)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.dictionaries(many, sample=3)
    assert len(found) == 300 and len(langid.dictionaries(many, languages=7)) == 7
    for lang, dictionary in found.items():
        flat = [langid.squeezed(t.encode()) for _, t, k in rows if k == lang]
        assert sum(dictionary.count(f) > 0 for f in set(flat)) >= 1
        rest = dictionary
        for f in sorted(set(flat), key=len, reverse=True):
            rest = rest.replace(f, b"")
        assert not rest.strip()
    long = [(1, "abc " * 400, "xx"), (2, "def " * 6, "xx"), (3, "ghi " * 400, "yy")]
    found = langid.dictionaries(spark.createDataFrame(long, "doc_id long, text string, lang string"), size=100, sample=1, folds=1, fold=7)
    assert b"def" in found["xx"] and b"abc" not in found["xx"] and found["yy"].count(b"ghi") == 400
    assert langid.identify(many).count() == 1500


def test_dropping_follows_the_scores(spark, sf, docs, odd):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = toxicity.not_toxic(docs, labels)
    want = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    assert toxicity.not_toxic(odd, labels).columns == odd.columns


def test_long_tokens_are_candidates(spark):
    token = "aB3" * 400
    rows = spark.createDataFrame([(1, f"secret={token} end"), (2, "x " + "Z9" * 50000)], "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["__redaction_proposed"] if s["kind"] == pii.KINDS.index("secret")] for r in pii.candidates(rows).collect()}
    assert got == {1: [(7, 1207)], 2: [(2, 100002)]}
