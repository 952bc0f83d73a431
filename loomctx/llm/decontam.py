"""Benchmark decontamination by templates: placeholders for numbers, names and units, windows joined by hash, slots checked.

Tokens are maximal runs of letters or of digits (with inner points and commas). A template replaces

* digit runs and number words by ``<num>``,
* a unit right after a number by ``<unit>``,
* a word with one capital, its first letter, that doesn't begin a sentence by ``<name>``,

and lower-cases the rest. A word with such a capital that begins a sentence may be a name or not, so windows with one are read both
ways. Windows of ``width`` tokens are hashed (an item with fewer tokens is one window) in up to three readings: as templates, the
words that begin sentences literal or names, where at least ``literals`` tokens are literal and the window has four at least, and by the
words themselves.
A document's windows that equal an item's are joined with it; then the slots of templates are checked: within a document and
item each slot value of the item must always stand for the same value, names for names and numbers for numbers. Templates that
break this majority mapping don't count. A pair is reported when the windows found cover ``share`` of the item's, or of those of
them that have a template, or ``run`` of them match. So a verbatim copy of any item with a letter or digit is found, however few literal
tokens it has.

The items' window hashes are sent to every task while there are at most ``sent`` of them (8 bytes each); a larger benchmark is
joined by shuffling the documents' windows, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomctx.llm.stage import ROW, numbered, raw_text, written
from loomctx.llm.textkernel import _BASE, _INV, _VALUE_LOWER, blocks, mix, powers, windows, within

_U = np.uint64
# Words that count as numbers and as units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros degree degrees meter meters metre metres kilometer kilometers kilometre kilometres watt watts volt volts byte bytes".split()
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?:;\n"]] = True
#: Tokens that a template has at least.
SHORTEST = 4
_NUM, _UNIT, _NAME = _U(0x6E756D), _U(0x756E6974), _U(0x6E616D65)


def _word_hashes(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        v = _VALUE_LOWER[np.frombuffer(w.encode(), np.uint8)]
        out.append(mix(np.array([(v * powers(_BASE, len(v))).sum(dtype=np.uint64)]))[0])
    return np.sort(np.array(out, dtype=np.uint64))


_NUMBER_WORDS, _UNITS = _word_hashes(NUMBER_WORDS), _word_hashes(UNITS)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Template:
    """Template tokens of several texts: ``doc``, ``template`` hashes, ``value`` hashes of the words themselves, ``slot`` flags."""

    def __init__(self, bodies: list[bytes]):
        data = np.frombuffer(b"\n".join(bodies) + b"\n", dtype=np.uint8)
        ends = np.cumsum(np.fromiter((len(b) + 1 for b in bodies), np.int64, len(bodies)))
        letter, digit = _LETTER[data], _DIGIT[data]
        inner = ((data == 46) | (data == 44)) & np.concatenate([[False], digit[:-1]]) & np.concatenate([digit[1:], [False]])
        kind = letter.view(np.int8) + 2 * (digit | inner).view(np.int8)
        change = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
        start = change[kind[change] != 0]
        stop = np.append(change[1:], len(data)) if len(change) else change
        stop = stop[kind[change] != 0]
        value = _VALUE_LOWER[data] * powers(_BASE, len(data))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        self.value = mix((total[stop] - total[start]) * powers(_INV, len(data))[start])
        self.doc = np.searchsorted(ends, start, side="right")
        self.count = np.bincount(self.doc, minlength=len(bodies))
        self.first = np.cumsum(self.count) - self.count
        n = len(start)
        number = (kind[start] == 2) | _in(self.value, _NUMBER_WORDS)
        previous = np.concatenate([[False], number[:-1]]) & (np.concatenate([[-1], self.doc[:-1]]) == self.doc) if n else number
        unit = ~number & previous & _in(self.value, _UNITS)
        upper = ((data >= 65) & (data <= 90)) | ((data == 0xC3) & np.append((data[1:] >= 0x80) & (data[1:] <= 0x9E), False))
        uppers = np.concatenate([[0], np.cumsum(upper)])
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        last = np.concatenate([[0], stop[:-1]]) if n else stop
        capital = (kind[start] == 1) & upper[start] & (uppers[stop] - uppers[start] == 1) & (stop - start > 1) & ~number & ~unit if n else number
        inner_name = capital & (breaks[start] == breaks[last]) if n else number
        if n:
            inner_name[self.first[self.count > 0]] = False
        # with the words that begin sentences literal, then as names
        self.templates = [(np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, self.value))), number | unit | name) for name in (inner_name, capital)]

    def readings(self, width: int, literals: int):
        """(first tokens, hashes, slot flags) of the windows of this width: as templates, then by the words themselves, each where it differs."""
        inside = within(self.doc, width)
        if not len(inside):
            return
        fewer, plain = np.full(len(inside), -1), inside
        for template, slot in self.templates if width >= SHORTEST else ():
            slots = np.concatenate([[0], np.cumsum(slot)])
            slots = slots[width:] - slots[:-width]
            ok = inside & (slots > fewer) & (width - slots >= min(literals, width - 1))
            yield np.flatnonzero(ok), windows(template, width)[ok] + _U(width), slot
            fewer, plain = slots, inside & (slots > 0)
        yield np.flatnonzero(plain), windows(self.value, width)[plain] + _U(width), np.zeros(len(self.value), bool)

    def slots(self, at: int, width: int, slot: np.ndarray) -> list[int]:
        s = slice(at, at + width)
        return self.value[s][slot[s]].view(np.int64).tolist()


def _item_windows(width: int, literals: int):
    def kernel(batches):
        for batch in batches:
            out = []
            for item, body in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                t = Template([body or b""])
                w = min(width, len(t.value))
                if w:
                    readings = list(t.readings(w, literals))
                    templates = {int(a) for at, _, _ in readings[:-1] for a in at}
                    out += [(item, w, int(a), int(h), t.slots(a, w, slot), int(a) in templates, len(templates), len(t.value) - w + 1) for at, hashes, slot in readings for a, h in zip(at, hashes.view(np.int64))]
            cols = list(zip(*out)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int32(), pa.int32()))], names=["item_id", "width", "at", "hash", "item_slots", "templated", "item_templates", "item_windows"])

    return kernel


def _doc_windows(widths: list[int], width: int, literals: int, known):
    def kernel(batches):
        wanted = None if known is None else known.value
        for batch in batches:
            ids, bodies = batch.column("doc_id").to_pylist(), [b or b"" for b in batch.column("body").to_pylist()]
            for first, run in blocks(bodies):
                t = Template(run)
                for w in widths:
                    for at, hashes, slot in t.readings(w, literals):
                        if wanted is not None:
                            hit = _in(hashes, wanted)
                            at, hashes = at[hit], hashes[hit]
                        doc = t.doc[at]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[first + d] for d in doc], pa.int64()), pa.array((at - t.first[doc]).astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array([t.slots(a, w, slot) for a in at], pa.list_(pa.int64()))],
                            names=["doc_id", "place", "hash", "doc_slots"],
                        )

    return kernel


def contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, coverage, replaced) for each document and item found in it.

    ``replaced`` counts the item's slot values that stand for another value. ``windows`` and ``item_windows`` count those with a
    template where these alone suffice, else all. Null texts and texts without letters and digits match nothing; an item of one to three
    tokens is found where these follow one another; null ids are not reported; of rows that repeat an id the one with most of the item counts. Other columns
    are not read; empty tables give an empty result.
    """
    rows = numbered(docs, "doc_id", "text")
    found = contaminated_rows(rows, benchmark, **parameters)
    named = found.join(rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null"), ROW)
    best = F.max_by(F.struct("windows", "item_windows", "coverage", "replaced"), F.struct("coverage", "windows", ROW)).alias("best")
    return named.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def contaminated_rows(rows: DataFrame, benchmark: DataFrame, width: int = 8, literals: int = 4, share: float = 0.5, run: int = 6, sent: int = 1 << 22) -> DataFrame:
    """As ``contaminated``, by the number in ``ROW`` instead of doc_id, for every row."""
    items = benchmark.select(F.col("item_id").alias("doc_id"), F.col("text"))
    wanted = written(raw_text(items).where("doc_id is not null").mapInArrow(_item_windows(width, literals), "item_id long, width int, at int, hash long, item_slots array<long>, templated boolean, item_templates int, item_windows int").distinct(), "items")
    widths = sorted(r["width"] for r in wanted.select("width").distinct().collect())  # at most ``width`` of them
    known = None
    hashes = wanted.select("hash").distinct()
    if hashes.count() <= sent:
        known = rows.sparkSession.sparkContext.broadcast(np.sort(np.asarray(hashes.toArrow()["hash"]).view(np.uint64)))
    found = raw_text(rows, ROW).mapInArrow(_doc_windows(widths, width, literals, known), "doc_id long, place int, hash long, doc_slots array<long>")
    hits = written(found.join(wanted, "hash").select("doc_id", "item_id", "place", "at", "doc_slots", "item_slots", "templated", "item_templates", "item_windows"), "hits")
    pairs = hits.where(F.size("item_slots") > 0).select("doc_id", "item_id", F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s")).groupBy("doc_id", "item_id", "s.item_slots", "s.doc_slots").agg(F.count("*").alias("n"))
    major = pairs.groupBy("doc_id", "item_id", "item_slots").agg(F.max_by("doc_slots", F.struct("n", "doc_slots")).alias("stands_for"))
    mapping = major.groupBy("doc_id", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("item_slots", "stands_for"))).alias("m"), F.count_if(F.col("item_slots") != F.col("stands_for")).alias("replaced"))
    checked = hits.join(mapping, ["doc_id", "item_id"], "left")
    agree = F.forall(F.arrays_zip("item_slots", "doc_slots"), lambda s: F.element_at("m", s["item_slots"]) == s["doc_slots"])
    ok = checked.where((F.size("item_slots") == 0) | agree)
    places = ok.groupBy("doc_id", "item_id", "at", "templated").agg(F.max("item_templates").alias("item_templates"), F.max("item_windows").alias("item_windows"), F.max("replaced").alias("replaced"))
    out = places.groupBy("doc_id", "item_id").agg(
        F.count_if("templated").alias("templates"), F.max("item_templates").cast("long").alias("item_templates"), F.count_distinct("at").alias("windows"), F.max("item_windows").cast("long").alias("item_windows"), F.coalesce(F.max("replaced"), F.lit(0)).cast("long").alias("replaced")
    )
    enough = (F.col("templates") >= run) | ((F.col("item_templates") > 0) & (F.col("templates") >= share * F.col("item_templates")))
    out = out.select("doc_id", "item_id", F.when(enough, F.col("templates")).otherwise(F.col("windows")).alias("windows"), F.when(enough, F.col("item_templates")).otherwise(F.col("item_windows")).alias("item_windows"), "replaced")
    return out.withColumn("coverage", F.col("windows") / F.col("item_windows")).where((F.col("coverage") >= share) | (F.col("windows") >= run)).select(F.col("doc_id").alias(ROW), "item_id", "windows", "item_windows", "coverage", "replaced")
