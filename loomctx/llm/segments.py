"""Which windows of a corpus can repeat, and where: segments of windows that share an anchor.

A window is ``length`` consecutive elements (bytes or words) of one document. Its anchor is the least hash of the runs of ``gram``
elements in it, so equal windows have equal anchors. Consecutive windows with one anchor make a segment. Segments
with equal content (a 128-bit print: anchor and content hash) are copies of each other, all windows alike;
windows can only be shared between segments of one anchor. So of each content one segment, the first, has to be compared, and only if
its anchor has other contents too, or may come up twice inside it: those first segments are cut out of the texts and go, by anchor, to the operators'
suffix structures.

Anchors that many documents share are told apart by a sample. Their rows are dealt by content and by parts of the documents too, so a window
holds a part of one content's copies; the first of each part, a few for each content, then meet by content. Rows are joined with no counts of
copies, so nothing but rows themselves and contents grows with a group.

An anchor with more than ``CROWD`` contents (a passage in very many documents, each time with other text around it) does not meet in one
task either: its segments are parted further by what their windows have in common besides the anchor. Windows whose anchor lies at
places q * width to q * width + width - 1 share length + 1 - width elements, whose hash is the next, finer key. Widths fall
to 1, where a key is a whole window, so no key stays crowded, and equal windows have equal keys at each width, so none are missed.

Texts are shuffled once, by document. Segment rows are fixed-size; a long run of one anchor (periodic text) is cut into pieces of
``PIECE`` windows, which the suffix structures treat like any others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomctx.llm.stage import release, small_batches, written
from loomctx.llm.textkernel import _BASE, _INV, _VALUE, Words, blocks, mix, powers, sliding_min, windows, within

_U = np.uint64
PIECE = 2048
#: An anchor is hot if it may have more rows than HOT_ROWS and than one for HOT_SHARE documents; one document in HOT_SAMPLE is looked at. So
#: at most 2 * HOT_SHARE times the mean number of segments of a document are hot.
HOT_ROWS, HOT_SHARE, HOT_SAMPLE = 1000, 200, 16
#: Low bits that hold a place while anchors are looked for; the bits above them are the anchor.
PLACE = 28
#: Contents of one anchor that may be compared in one task, and the widths by which those of others are parted.
CROWD = 1000
#: Parts of the documents by which copies of one content are dealt where its anchor is hot.
PARTS = 32
WIDTHS = {"bytes": (48, 6, 1), "words": (4, 1)}


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(row, body) with unique rows in the order of doc_id, and (row, doc_id) where that isn't doc_id itself.

    Only where ids repeat or are null are the texts written once more, to give every row a number of its own.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    odd = slim.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return slim.select(F.col("doc_id").alias("row"), "body").where("row is not null"), None
    sorted_ = slim.repartitionByRange(F.col("doc_id").asc_nulls_last(), F.xxhash64("body")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("body"))
    numbered = written(sorted_.withColumn("row", F.monotonically_increasing_id()), "rows")
    return numbered.select("row", "body").where("row is not null"), numbered.select("row", "doc_id")


class WordElements:
    """Words, unchanged; offsets count words."""

    def __init__(self, bodies: list[bytes], length: int):
        w = Words(bodies, lower=False)
        self.hash, self.first, self.doc = w.hash, w.first, w.doc
        self.valid = within(w.doc, length)

    @classmethod
    def held(cls, parts: list[bytes], length: int) -> WordElements:
        """Of word hashes, as ``cut`` returns them."""
        e = cls.__new__(cls)
        size = np.fromiter((len(p) // 8 for p in parts), np.int64, len(parts))
        e.hash, e.first, e.doc = np.frombuffer(b"".join(parts), np.uint64), np.cumsum(size) - size, np.repeat(np.arange(len(parts)), size)
        e.valid = within(e.doc, length)
        return e

    def grams(self, gram: int) -> np.ndarray:
        return windows(self.hash, gram)

    def cut(self, doc: int, start: int, stop: int) -> bytes:
        return self.hash[self.first[doc] + start : self.first[doc] + stop].tobytes()

    def totals(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * powers(_BASE, len(self.hash)))])


class ByteElements:
    """Bytes; the separators between documents belong to no window."""

    def __init__(self, bodies: list[bytes], length: int):
        self.data = np.frombuffer(b"\n".join(bodies) + b"\n", dtype=np.uint8)
        size = np.fromiter((len(b) + 1 for b in bodies), np.int64, len(bodies))
        end = np.cumsum(size)
        self.first = end - size
        self.doc = np.repeat(np.arange(len(bodies)), size)
        self._totals = None
        n = len(self.data) - length + 1
        self.valid = np.arange(n) + length <= np.repeat(end - 1, size)[:n] if n > 0 else np.empty(0, bool)

    @classmethod
    def held(cls, parts: list[bytes], length: int) -> ByteElements:
        return cls(parts, length)

    def totals(self) -> np.ndarray:
        if self._totals is None:
            self._totals = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[self.data] * powers(_BASE, len(self.data)))])
        return self._totals

    def grams(self, gram: int) -> np.ndarray:
        t, n = self.totals(), len(self.data) - gram + 1
        return mix((t[gram:] - t[:n]) * powers(_INV, n)) if n > 0 else np.empty(0, np.uint64)

    def cut(self, doc: int, start: int, stop: int) -> bytes:
        return self.data[self.first[doc] + start : self.first[doc] + stop].tobytes()


ELEMENTS = {"words": WordElements, "bytes": ByteElements}


def _least(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every ``span`` grams, without its low bits, and its leftmost place; in slices whose places fit into those bits."""
    n, low = len(grams) - span + 1, _U(PLACE)
    least, place = np.empty(n, np.uint64), np.empty(n, np.int64)
    step = (1 << PLACE) - span
    for at in range(0, n, step):
        part = grams[at : at + step + span - 1] >> low << low
        found = sliding_min(part | np.arange(len(part), dtype=np.uint64), span)
        least[at : at + len(found)] = found >> low
        place[at : at + len(found)] = (found & _U((1 << PLACE) - 1)).astype(np.int64) + at
    return least, place


def segments(e, length: int, gram: int, width: int = 0) -> tuple[np.ndarray, ...]:
    """(first window's place, windows, key, content hash, whether a window may repeat inside) of every segment in ``e``.

    The key is the anchor, or with a ``width`` the anchor and what windows with their anchor at about the same place have in common.
    Equal windows of one segment have their leftmost anchors at different places, so where that never moves none repeats.
    """
    valid = e.valid
    if not valid.any():
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2 + (np.empty(0, bool),)
    key, place = _least(e.grams(gram), length - gram + 1)
    if width:
        window = np.arange(len(key))
        part = (place - window) // width
        # outside of texts a place may lie beyond the last gram; no window is valid there
        common = e.grams(length + 1 - width)
        key = mix(key) + mix(common[np.minimum(place - part * width, len(common) - 1)] + part.astype(np.uint64))
    fresh = valid.copy()
    fresh[1:] &= ~(valid[:-1] & (key[1:] == key[:-1]))
    start = np.flatnonzero(fresh)
    # a segment ends before the next one, or at its document's last window
    stop = np.append(start[1:], len(valid))
    seen = np.concatenate([[0], np.cumsum(valid)])
    count = seen[stop] - seen[start]
    moves = np.concatenate([[0], np.cumsum(np.concatenate([[False], place[1:] != place[:-1]]))])
    inside = moves[start + count] > moves[np.minimum(start + 1, len(moves) - 1)]
    pieces = -(-count // PIECE)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, count, inside = np.repeat(start, pieces) + nth * PIECE, np.minimum(np.repeat(count, pieces) - nth * PIECE, PIECE), np.repeat(inside, pieces)
    total = e.totals()
    content = mix((total[start + count + length - 1] - total[start]) * powers(_INV, len(total))[start] + count.astype(np.uint64))
    return start, count, mix(key[start]), content, inside


def _segment_rows(kind: str, length: int, gram: int):
    def kernel(batches):
        for batch in batches:
            rows, bodies = np.asarray(batch.column("row")), [b or b"" for b in batch.column("body").to_pylist()]
            for first, run in blocks(bodies):
                e = ELEMENTS[kind](run, length)
                start, count, anchor, content, inside = segments(e, length, gram)
                doc = e.doc[start]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(rows[first + doc]), pa.array((start - e.first[doc]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(inside)],
                    names=["anchor", "content", "row", "start", "n", "inside"],
                )

    return kernel


def _cut(kind: str, length: int):
    def kernel(batches):
        for batch in batches:
            rows, lists = batch.column("row").to_pylist(), batch.column("wanted")
            for row, body, wanted in zip(rows, batch.column("body"), lists):
                e = ELEMENTS[kind]([body.as_py() or b""], length)
                out = wanted.values
                start, n = np.asarray(out.field("start")), np.asarray(out.field("n"))
                yield pa.RecordBatch.from_arrays(
                    [out.field("anchor"), pa.array(np.full(len(start), row)), out.field("start"), out.field("n"), out.field("copies"), out.field("crowded"), pa.array([e.cut(0, s, s + c + length - 1) for s, c in zip(start.tolist(), n.tolist())], pa.binary())],
                    names=["anchor", "row", "start", "n", "copies", "crowded", "data"],
                )

    return kernel


def _finer(kind: str, length: int, gram: int, width: int):
    """Segments of segments, which carry their elements with them."""

    def kernel(batches):
        for batch in batches:
            rows, starts = np.asarray(batch.column("row")), np.asarray(batch.column("start"))
            for first, run in blocks(batch.column("data").to_pylist()):
                e = ELEMENTS[kind].held(run, length)
                start, count, key, _, inside = segments(e, length, gram, width)
                part = e.doc[start]
                at = start - e.first[part]
                data = [e.cut(p, s, s + c + length - 1) for p, s, c in zip(part.tolist(), at.tolist(), count.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(rows[first + part]), pa.array((starts[first + part] + at).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(inside), pa.array(data, pa.binary())],
                    names=["anchor", "row", "start", "n", "inside", "data"],
                )

    return kernel


def _dealt(rows: DataFrame, hot) -> DataFrame:
    """Rows with ``first`` of their content, its ``copies``, and the ``low``, ``high`` and number of ``contents`` of their key, all from one shuffle.

    Cool keys meet in one task. Rows of hot ones are dealt by content and one of ``PARTS`` parts of the documents as well, and what they
    get holds for their part only.
    """
    dealt = rows.withColumn("deal", F.when(hot, F.xxhash64("content", F.pmod(F.xxhash64("row"), F.lit(PARTS))))).repartition("anchor", "deal")
    same, alike = Window.partitionBy("anchor", "deal", "content"), Window.partitionBy("anchor", "deal")
    seen = dealt.withColumns({"first": F.row_number().over(same.orderBy("row", "start")) == 1, "copies": F.count("*").over(same)})
    seen = seen.withColumns({"low": F.min("content").over(alike), "high": F.max("content").over(alike), "contents": F.sum(F.col("first").cast("int")).over(alike)})
    return seen.drop("deal")


def _decided(met: DataFrame, first_stays: bool, finest: bool, hot) -> DataFrame:
    """What becomes of segments that ``_dealt`` returns: of a hot key, a part's first one leads its copies there, which go whatever other parts hold."""
    lead = hot & F.col("first")
    gone = ~F.col("first") if first_stays else ~lead & (F.col("copies") > 1)
    compared = ~hot & F.col("first") & ((F.col("low") != F.col("high")) | F.col("inside"))
    crowded = F.lit(False) if finest else compared & (F.col("contents") > CROWD)
    return met.withColumns({"copies": F.least("copies", F.lit(2)).cast("int"), "gone": gone, "compared": compared, "crowded": crowded, "lead": lead}).where("gone or compared or lead")


def _led(leads: DataFrame, first_stays: bool, finest: bool, few_keys: bool, name: str) -> DataFrame:
    """What becomes of the leads of hot keys, of which a content has ``PARTS`` at most.

    A lead that isn't its content's first is a copy; only first ones, one for each content, meet the counts of their keys.
    """
    same = Window.partitionBy("anchor", "content")
    told = leads.withColumns({"first": F.row_number().over(same.orderBy("row", "start")) == 1, "copies": F.sum("copies").over(same)})
    told = written(told, name)
    keys = told.where("first").groupBy("anchor").agg(F.min("content").alias("low"), F.max("content").alias("high"), F.count("*").alias("contents"))
    firsts = told.where("first").join(F.broadcast(keys) if few_keys else keys.hint("merge"), "anchor").select(*told.columns, *keys.columns[1:])
    others = told.where("not first").select("*", *(F.lit(None).cast("long").alias(c) for c in keys.columns[1:]))
    return _decided(firsts.unionByName(others), first_stays, finest, F.lit(False))


def repeated(texts: DataFrame, kind: str, length: int, gram: int, compare, first_stays: bool, keep: bool) -> DataFrame:
    """(row, spans): for each document with repeated windows, the element ranges (start, stop) that they cover.

    ``compare`` is a mapInArrow kernel over the first segments of one task's anchors, sorted by anchor, which returns
    (row, start, n) of runs of windows to remove. With ``first_stays`` the first of equal segments isn't removed
    by its copies. With ``keep`` segment rows are written once, else made again for the sample in which hot anchors are looked for: rows of long
    windows are few, those of short ones would take as much room as the texts.
    """
    schema = "anchor long, content long, row long, start int, n int, inside boolean"
    found = texts.mapInArrow(_segment_rows(kind, length, gram), schema)
    found = written(found, "all") if keep else found
    # Anchors that many documents may share, by a sample; which path an anchor takes does not change the result.
    most = max(HOT_ROWS, texts.count() // HOT_SHARE)
    chosen = F.pmod(F.xxhash64("row"), F.lit(HOT_SAMPLE)) == 0
    sample = found.where(chosen) if keep else texts.where(chosen).mapInArrow(_segment_rows(kind, length, gram), schema)
    hot = written(sample.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > most / (2 * HOT_SAMPLE)).select("anchor"), "hot")
    # all rows meet the few hot anchors at once, so that they are made and shuffled once
    is_hot = F.coalesce(F.col("hot"), F.lit(False))
    seen = _decided(_dealt(found.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "anchor", "left"), is_hot), first_stays, False, is_hot)
    columns = ["anchor", "row", "start", "n", "copies", "gone", "compared", "crowded"]
    of_lead = lambda *names: [F.when(F.col("lead"), F.col(c)).alias(c) for c in names]
    kept = written(seen.select(*columns, "lead", *of_lead("content", "inside")), "segments")
    release(found)
    if not hot.isEmpty():
        decided = _led(kept.where("lead").drop("gone", "compared", "crowded", "lead"), first_stays, False, True, "leads")
        kept = kept.where("not lead").select(columns).unionByName(decided.select(columns))
    release(hot)
    wanted = kept.where("compared").groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "n", "copies", "crowded")).alias("wanted"))
    # texts are shuffled however few rows they meet, and segments written whether keys are crowded or not: a small table, in which none are and both
    # joins of the texts could share one shuffle, would tell nothing of a large one
    cut = texts.join(wanted.hint("merge"), "row").mapInArrow(_cut(kind, length), "anchor long, row long, start int, n int, copies int, crowded boolean, data binary")
    cut = written(cut, "cut")
    gone, crowds = kept.where("gone").select("row", "start", "n"), not kept.where("crowded").isEmpty()
    compared, deep = cut.where("not crowded").drop("crowded"), cut.where("crowded")
    for width in WIDTHS[kind] if crowds else ():
        fine = deep.select("row", "start", "data").mapInArrow(_finer(kind, length, gram, width), "anchor long, row long, start int, n int, inside boolean, data binary")
        fine = written(fine.withColumn("content", F.xxhash64("data")), f"fine-{width}")
        seen = _decided(_dealt(fine, F.lit(True)), first_stays, False, F.lit(True))
        seen = written(seen.select("anchor", "row", "start", "n", "copies", "lead", *of_lead("content", "inside", "data")), f"fine-seen-{width}")
        release(fine)
        gone = gone.union(seen.where("not lead").select("row", "start", "n"))
        met = _led(seen.where("lead").drop("lead"), first_stays, width == 1, False, f"fine-leads-{width}")
        met = met.select("anchor", "row", "start", "n", "copies", "gone", "compared", "crowded", F.when(F.col("compared"), F.col("data")).alias("data"))
        gone = gone.union(met.where("gone").select("row", "start", "n"))
        compared = compared.unionByName(met.where("compared and not crowded").select("anchor", "row", "start", "n", "copies", "data"))
        deep = met.where("crowded")
        if deep.isEmpty():
            break
    partial = compared.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "row long, start int, n int")
    return gone.union(partial).groupBy("row").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + (length - 1)).alias("stop"))).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Ranges from an Arrow list of (start, stop), merged where they touch, in order."""
    if spans is None or not len(spans):
        return []
    values = spans.values
    start, stop = np.asarray(values.field("start"), np.int64), np.asarray(values.field("stop"), np.int64)
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    first = np.concatenate([[True], start[1:] > stop[:-1]])
    last = np.append(first[1:], True)
    return list(zip(start[first].tolist(), stop[last].tolist()))


def shards(batches, limit: int):
    """Lists of rows of whole anchors, of about ``limit`` bytes of data each, from batches sorted by anchor."""
    rows, size, last = [], 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "row", "start", "n", "copies", "data"))):
            if row[0] != last and size >= limit:
                yield rows
                rows, size = [], 0
            last = row[0]
            rows.append(row)
            size += len(row[5])
    if rows:
        yield rows


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return list(zip(start.tolist(), (stop - start).tolist()))
