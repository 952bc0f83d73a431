"""Personal data: base patterns, high-recall candidates, boosted trees over a feature cube, calibrated thresholds.

Everything on the data is DataFrame expressions. Positions come from marking every match with a private-use character
and splitting there, so offsets are code points and one pass of a pattern finds all of a text's matches. Quantifiers
are possessive and starts are guarded where that changes no match, so long runs neither backtrack nor recurse.

Base kinds follow fixed patterns and checks and are always kept. Three generators propose more: digit groups, tokens
with an at sign, and long mixed tokens. Candidates that overlap a base span are the positive examples, as are long
tokens right after an assignment to a secret's name; the boosted trees see format and context, never the checks or
that assignment. Training reads only the cube: counts of positive and negative candidates for each combination of small
categorical features, of which there are at most ``CUBE_BOUND`` whatever the input, so all documents count and the driver holds
no rows. Even and odd hash halves of the texts give the fit and the calibration. Candidates stay in their document's row, in a written
table from which the cube, the scores and the redacted texts are made without a join or a shuffle of rows. Each generator's threshold is the
lowest score whose calibrated precision reaches ``precision``; candidates at or above it that no base span
overlaps are added, the earlier one where two overlap.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomctx.llm.stage import written

MARK, STAND_IN = "\ue000", "\ue001"
KINDS = ("email", "ip", "card", "phone", "mail", "number", "secret")
BASE = 4

# Fixed patterns of the base kinds: the same matches as the plain forms, without backtracking.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Generators.
MAIL = r"(?<!\S)[^\s@]++@[^\s@]++(?!\S)"
NUMBER = r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().-]{0,2}+[0-9])++(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+(?![A-Za-z0-9_+/-])"

ASSIGNED = r"(?i)(token|secret|passw(or)?d|api.?key|credential|auth)\w*\s*[=:]\s*[\"']?$"
CONTEXT = (r"(?i)(tel|phone|call|fax|mobile|contact)", r"(?i)(card|visa|master|amex|credit|iban|account)", r"(?i)(\bip\b|host|server|address|addr)", r"(?i)(mail|write to|reach)")

#: Feature names with their number of values; with the three generators they bound the cube.
FEATURES = {"gen": 3, "digits": 8, "groups": 5, "seps": 8, "plus": 2, "before": 3, "after": 3, "context": 5, "size": 6, "letters": 3}
CUBE_BOUND = reduce(lambda a, b: a * b, FEATURES.values())


def _pieces(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)


_SPANS = "array<struct<start:bigint,end:bigint,body:string>>"
#: Pieces whose offsets are summed up at once, an even number: arrays that grow by appending stay short.
RUN = 256


def _located(pieces: Column) -> Column:
    """Matches (every second piece) with their code-point offsets, end exclusive."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("odd"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.char_length(piece)
        grown = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"), piece.alias("body"))))
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), F.when(acc["odd"], grown).otherwise(acc["out"]).alias("out"))

    numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / RUN).cast("int"))
    runs = F.transform(numbers, lambda k: F.aggregate(F.slice(pieces, k * RUN + 1, RUN), zero, step, lambda acc: F.struct(acc["at"].alias("length"), acc["out"].alias("out"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<struct<at:bigint,out:{_SPANS}>>").alias("runs"))
    placed = F.aggregate(runs, start, lambda acc, r: F.struct((acc["at"] + r["length"]).alias("at"), F.concat(acc["runs"], F.array(F.struct(acc["at"].alias("at"), r["out"].alias("out")))).alias("runs")), lambda acc: acc["runs"])
    return F.flatten(F.transform(placed, lambda r: F.transform(r["out"], lambda m: F.struct((m["start"] + r["at"]).alias("start"), (m["end"] + r["at"]).alias("end"), m["body"].alias("body")))))


def _digits(body: Column, drop: str) -> Column:
    return F.translate(body, drop, "")


def _octets(body: Column) -> Column:
    """All four parts are at most 255, leading zeros aside."""

    def ok(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.char_length(bare) <= 3) & (F.coalesce(F.substring(bare, 1, 3).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(body, r"\."), ok)


def _luhn(digits: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    short = F.substring(F.reverse(digits), 1, 19)
    each = F.transform(F.split(short, ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).when(d.try_cast("int") > 4, d.try_cast("int") * 2 - 9).otherwise(d.try_cast("int") * 2))
    return F.char_length(digits).between(12, 19) & (F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0)


CHECKS = {
    "email": lambda b: F.lit(True),
    "ip": _octets,
    "card": lambda b: _luhn(_digits(b, " -")),
    "phone": lambda b: F.char_length(_digits(b, "+ ().-")).between(9, 15),
}


def _below(values: Column, bound: Column) -> Column:
    """How many of the sorted ``values`` are less than ``bound``, by bisection."""
    zero = F.struct(F.lit(0).alias("low"), F.size(values).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        less = F.coalesce(F.get(values, middle) < bound, F.lit(False))
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & less, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~less, middle).otherwise(acc["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int")), zero, step, lambda acc: acc["low"])


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with its checked base spans in ``__redaction_base`` and the generators' in ``__redaction_proposed``, these with their features.

    A proposed span is ``covered`` if it overlaps a base span. Columns of ``docs`` named ``__redaction*`` are left out.
    """
    docs = docs.drop(*(c for c in docs.columns if c.startswith("__redaction")))
    name = lambda c: f"__redaction_{c}"
    text = F.col(name("text"))
    out = docs.withColumn(name("text"), F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(STAND_IN)))
    out = out.withColumns({name("at"): F.contains(text, F.lit("@")), name("digit"): text.rlike("[0-9]"), name("plus"): F.contains(text, F.lit("+")), name("long"): text.rlike("[A-Za-z0-9_+/-]{20}")})
    for kind, pattern, when in (("email", EMAIL, "at"), ("ip", IP, "digit"), ("card", CARD, "digit"), ("phone", PHONE, "plus"), ("mail", MAIL, "at"), ("number", NUMBER, "digit"), ("secret", SECRET, "long")):
        out = out.withColumn(name("pieces"), F.when(F.col(name(when)), _pieces(text, pattern)))
        out = out.withColumn(name(kind), F.when(F.size(name("pieces")) > 1, _located(F.col(name("pieces")))).otherwise(F.array().cast(_SPANS)))

    def plain(kind: str, number: int) -> Column:
        return F.transform(F.filter(name(kind), lambda m: CHECKS[kind](m["body"])), lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))

    def proposed(kind: str, number: int) -> Column:
        return F.transform(name(kind), lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), m["body"].alias("body"), F.substring(text, F.greatest(m["start"] - 23, F.lit(1)).cast("int"), F.least(m["start"], F.lit(24)).cast("int")).alias("before"), F.substring(text, (m["end"] + 1).cast("int"), F.lit(1)).alias("after")))

    useful = F.filter(name("number"), lambda m: F.char_length(F.regexp_replace(m["body"], "[^0-9]", "")) >= 7)
    out = out.withColumn(name("number"), useful).withColumn(name("secret"), F.filter(name("secret"), lambda m: m["body"].rlike("[0-9]") & m["body"].rlike("[A-Za-z]")))
    base = F.array_sort(F.concat(*(plain(k, i) for i, k in enumerate(KINDS[:BASE]))))
    spans = F.concat(*(proposed(k, BASE + i) for i, k in enumerate(KINDS[BASE:])))
    out = out.select(*docs.columns, base.alias(name("base")), spans.alias(name("spans")))
    # starts and ends of the base spans, sorted once for a document
    edges = F.array(F.struct(F.transform(name("base"), lambda s: s["start"]).alias("starts"), F.array_sort(F.transform(name("base"), lambda s: s["end"])).alias("ends")))

    def featured(e: Column) -> Column:
        overlaps = lambda m: F.when(F.size(e["starts"]) == 0, F.lit(False)).otherwise(_below(e["starts"], m["end"]) > _below(e["ends"], m["start"] + 1))
        return F.transform(name("spans"), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), overlaps(m).alias("covered"), *(c.alias(k) for k, c in _features(m).items())))

    return out.withColumn(name("proposed"), F.flatten(F.transform(edges, featured))).drop(name("spans"))


def _features(m: Column) -> dict[str, Column]:
    digits = F.char_length(F.regexp_replace(m["body"], "[^0-9]", ""))
    edge = lambda c: F.when(c.rlike(r"^\s?$"), 0).when(c.rlike("[A-Za-z0-9]"), 1).otherwise(2)
    context = reduce(lambda acc, kp: acc.when(m["before"].rlike(kp[1]), kp[0] + 1), enumerate(CONTEXT), F.when(F.lit(False), 0)).otherwise(0)
    has = lambda c, n: F.when(F.contains(m["body"], F.lit(c)), n).otherwise(0)
    return {
        "gen": m["kind"] - BASE,
        "digits": F.when(digits < 7, 0).when(digits < 9, 1).when(digits < 11, 2).when(digits < 13, 3).when(digits < 16, 4).when(digits == 16, 5).when(digits < 20, 6).otherwise(7),
        "groups": F.least(F.size(F.split(m["body"], "[^A-Za-z0-9]+")) - 1, F.lit(4)),
        "seps": has(" ", 1) + has("-", 2) + has(".", 4),
        "plus": F.when(F.startswith(m["body"], F.lit("+")), 1).otherwise(0),
        "before": edge(F.substring(m["before"], -1, 1)),
        "after": edge(m["after"]),
        "context": context,
        "size": F.least(F.floor(F.char_length(m["body"]) / 8), F.lit(5)).cast("int"),
        "letters": F.when(m["body"].rlike(r"^[0-9a-f]+$"), 1).when(m["body"].rlike("[a-z]") & m["body"].rlike("[A-Z]"), 2).otherwise(0),
        "assigned": m["before"].rlike(ASSIGNED),
    }


class Boosted:
    """Gradient-boosted trees of depth two for the logistic loss, fitted to weighted categorical cells."""

    def __init__(self, rounds: int = 24, rate: float = 0.4, least: float = 5.0):
        self.rounds, self.rate, self.least, self.trees, self.start = rounds, rate, least, [], 0.0

    def fit(self, cells: list[tuple[tuple[int, ...], float, float]]) -> Boosted:
        """cells: (features, positives, negatives)."""
        pos, neg = sum(c[1] for c in cells), sum(c[2] for c in cells)
        self.start = math.log((pos + 1) / (neg + 1))
        margin = [self.start] * len(cells)
        for _ in range(self.rounds):
            grad, hess = [], []
            for (_, p, n), m in zip(cells, margin):
                q = 1 / (1 + math.exp(-m))
                grad.append(p - (p + n) * q)
                hess.append((p + n) * q * (1 - q))
            tree = self._grow(cells, grad, hess, range(len(cells)), 2)
            if not isinstance(tree, tuple):
                break
            self.trees.append(tree)
            for i, (x, _, _) in enumerate(cells):
                margin[i] += self._leaf(tree, x)
        return self

    def _grow(self, cells, grad, hess, rows, depth):
        g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        if depth and cells:
            best = (1e-6, None, None)
            for f in range(len(cells[0][0])):
                by: dict[int, list[float]] = {}
                for i in rows:
                    a = by.setdefault(cells[i][0][f], [0.0, 0.0, 0.0])
                    a[0] += grad[i]
                    a[1] += hess[i]
                    a[2] += cells[i][1] + cells[i][2]
                lg = lh = lw = 0.0
                all_w = sum(a[2] for a in by.values())
                for v in sorted(by)[:-1]:
                    lg, lh, lw = lg + by[v][0], lh + by[v][1], lw + by[v][2]
                    if min(lw, all_w - lw) >= self.least:
                        gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                        if gain > best[0]:
                            best = (gain, f, v)
            if best[1] is not None:
                f, v = best[1:]
                low, high = [i for i in rows if cells[i][0][f] <= v], [i for i in rows if cells[i][0][f] > v]
                return (f, v, self._grow(cells, grad, hess, low, depth - 1), self._grow(cells, grad, hess, high, depth - 1))
        return self.rate * g / (h + 1)

    def _leaf(self, tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, x: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-(self.start + sum(self._leaf(t, x) for t in self.trees))))

    def column(self, of: Callable[[int], Column]) -> Column:
        """The score of a candidate whose features ``of`` gives by number."""

        def grown(tree) -> Column:
            return F.when(of(tree[0]) <= tree[1], grown(tree[2])).otherwise(grown(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

        return F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(lambda a, b: a + b, (grown(t) for t in self.trees), F.lit(float(self.start)))))


def thresholds(model: Boosted, cells, precision: float) -> dict[int, float]:
    """By generator, the lowest score from which on the held-out precision (two failures added) reaches the aim; 2.0 if none does."""
    out = {}
    for gen in range(FEATURES["gen"]):
        scored = sorted(((model.score(x), p, n) for x, p, n in cells if x[0] == gen), reverse=True)
        pos = neg = 0.0
        out[gen] = 2.0
        for i, (s, p, n) in enumerate(scored):
            pos, neg = pos + p, neg + n
            if (i + 1 == len(scored) or scored[i + 1][0] < s) and pos / (pos + neg + 2) >= precision:
                out[gen] = s
    return out


def selected(found: DataFrame, precision: float) -> Column:
    """Trains on all of ``found`` (a written table of ``candidates``); the sorted spans to redact in each of its rows, (start, kind, end)."""
    spans = found.select(F.explode("__redaction_proposed").alias("s"), F.pmod(F.xxhash64("__redaction_half"), F.lit(2)).alias("half")).select("half", "s.*")
    positive = F.col("covered") | (F.col("assigned") & (F.col("gen") == 2))
    cube = spans.groupBy("half", *FEATURES).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")).collect()  # at most 2 * CUBE_BOUND rows
    cells = [[(tuple(r[f] for f in FEATURES), r["pos"], r["neg"]) for r in sorted(cube) if r["half"] == k] for k in (0, 1)]
    model = Boosted().fit(cells[0])
    least = thresholds(model, cells[1], precision)
    names = list(FEATURES)
    limit = lambda s: F.element_at(F.array(*(F.lit(least[g]) for g in range(FEATURES["gen"]))), s["gen"] + 1)
    fit = F.filter("__redaction_proposed", lambda s: ~s["covered"] & (model.column(lambda i: s[names[i]]) >= limit(s) - 1e-9))
    slim = F.array_sort(F.transform(fit, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>").alias("out"))
    # the earlier one where two overlap
    added = F.aggregate(slim, zero, lambda acc, s: F.struct(F.greatest(acc["reach"], s["end"]).alias("reach"), F.when(s["start"] >= acc["reach"], F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out")), lambda acc: acc["out"])
    return F.array_sort(F.concat("__redaction_base", added))


def _halved(rows: DataFrame) -> DataFrame:
    """The value whose hash parts the documents into fit and calibration: their own text's."""
    return rows.withColumn("__redaction_half", F.xxhash64("text"))


def personal_data(docs: DataFrame, precision: float = 0.8) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redactions) for each row of ``docs``.

    ``redactions`` is the array of (start, kind, end) behind ``spans``, kind by its number in ``KINDS``. Null and empty texts have
    no spans. Repeated rows and null ids are returned as they are; columns besides doc_id and text are not read.
    """
    found = _halved(candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))).drop("text")
    found = written(found, "pii")
    found = found.withColumn("redactions", selected(found, precision))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("__redaction_base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])), F.sha2(text("__redaction_base"), 256).alias("base_sha256"), text("redactions").alias("spans"), "redactions")


def redacted(docs: DataFrame, precision: float = 0.8) -> DataFrame:
    """``docs`` with every redaction replaced by ``<kind>`` in its text; other columns stay, as do null texts.

    A length column ``n_chars`` of the input is brought up to date where something is redacted. Spans stay with their row, so ids may repeat or be null. Columns
    named ``__redaction*`` are left out.
    """
    found = written(_halved(candidates(docs)), "pii")
    rows = found.withColumn("__redaction_spans", selected(found, precision))
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        # spans in order; one that begins inside the span before is cut by what is gone already
        start = F.greatest(s["start"], acc["at"])
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (start - acc["at"]).cast("int"))
        inside = s["end"] <= acc["at"]
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.concat(gap, F.element_at(names, s["kind"] + 1))))).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate("__redaction_spans", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    some = F.size("__redaction_spans") > 0
    out = rows.select(*found.columns, F.when(some, whole).otherwise(F.col("text")).alias("__redaction_text"), some.alias("__redaction_some"))
    changed = {"text": F.col("__redaction_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__redaction_some"), F.char_length("__redaction_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    kept = [c for c in docs.columns if not c.startswith("__redaction")]
    return out.withColumns(changed).select(kept)
