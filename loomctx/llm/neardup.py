"""MinHash near-duplicate classes: banded candidates, checked by odd sketches, confirmed on full shingle sets.

A document's set holds its distinct five-word shingles (lower-cased A-Z; a shorter document is one shingle; no
words: an empty set, linked with nothing). Two documents are linked when |A & B| / |A | B| >= 3/4.

How the work is spread:

1. One pass over the texts makes, for each document, its set size, a 128-bit print of the set, and 32 band keys of four
   MinHash samples each.
2. Documents with equal sets form a class, found by its print; only its smallest doc_id goes on.
3. Members of a bucket (equal band key) are paired with its smallest one. Members get an odd sketch: a map of 4096 bits in which each of 1024 (number, MinHash sample) toggles
   one. The population count of the XOR of two of them estimates the similarity; pairs below the threshold by a margin go.
4. Each document's best pair is confirmed on full sets, which gives first labels; then its other pairs, and those of members with another member, picked by a
   hash, of buckets that hold several labels. Then the classes are connected. What is left are pairs in buckets of three or more that still hold several components:
   members outside the bucket's largest component against the rest. All of these are confirmed, so no link between
   components that share a bucket is lost, and a group of copies yields a number of pairs linear in its size. Sketches are compared in blocks of members, and only pairs that pass
   become rows, each in the first band that both share.

A pair at the threshold shares no bucket with probability (1 - 0.75**4)**32 = 5e-6; the sketch passes 0.06 below it,
more than four standard deviations (0.0135) of its estimate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomctx.llm.components import forest
from loomctx.llm.stage import ROW, key_groups, numbered, numbers_differ, raw_text, release, written
from loomctx.llm.textkernel import Words, blocks, mix, windows, within

SHINGLE = 5
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Samples and bits of the odd sketches, which only members of buckets get.
ODD_SAMPLES, BITS = 1024, 4096
#: Members of a bucket that are compared with each other, or with as many others, at once.
BLOCK = 1024
_U = np.uint64
_seed = np.random.Generator(np.random.PCG64(11))
_MUL = _seed.integers(0, 1 << 63, ODD_SAMPLES, dtype=np.uint64) * _U(2) + _U(1)
_XOR = _seed.integers(0, 1 << 63, ODD_SAMPLES, dtype=np.uint64)
_HASH_BITS = 52


def shingle_sets(bodies: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of several documents, sorted within each: (hashes, number for each document)."""
    w = Words(bodies, lower=True)
    full = windows(w.hash, width)
    full, doc = full[ok := within(w.doc, width)], w.doc[: len(full)][ok]
    if len(short := np.flatnonzero((w.count > 0) & (w.count < width))):
        # fewer words: the whole sequence is one shingle; its length goes in, as does each word's place
        h = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            there = w.count[short] > k
            h[there] = h[there] * _U(0xA0761D6478BD642F) + w.hash[w.first[short[there]] + k]
        full, doc = np.concatenate([full, mix(h + w.count[short].astype(np.uint64))]), np.concatenate([doc, short])
    key = (doc.astype(np.uint64) << _U(_HASH_BITS)) | (full >> _U(64 - _HASH_BITS))
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    counts = np.bincount((key >> _U(_HASH_BITS)).astype(np.int64), minlength=len(bodies))
    return key & _U((1 << _HASH_BITS) - 1), counts


def signatures(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents with a non-empty set: prints (n, 2) and band keys (n, BANDS)."""
    counts = counts[counts > 0]
    at = np.cumsum(counts) - counts
    n = len(counts)
    if not n:
        return np.empty((0, 2), np.int64), np.empty((0, BANDS), np.int64)
    prints = np.stack([np.add.reduceat(mix(hashes ^ _U(c)), at) for c in (0x5DEECE66D, 0xBF58476D1CE4E5B9)], axis=1)
    spread = mix(hashes)
    bands = np.zeros((n, BANDS), np.uint64)
    for k in range(SAMPLES):
        least = np.minimum.reduceat((spread ^ _XOR[k]) * _MUL[k], at)
        bands[:, k // ROWS] = mix(bands[:, k // ROWS] + least + _U(k // ROWS))
    return prints.view(np.int64), bands.view(np.int64)


def odd_sketches(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For documents with a non-empty set: a map of BITS bits in which each of ODD_SAMPLES (number, MinHash sample) toggles one."""
    counts = counts[counts > 0]
    at = np.cumsum(counts) - counts
    sketch = np.zeros((len(counts), BITS // 64), np.uint64)
    rows, spread = np.arange(len(counts)), mix(hashes)
    for k in range(ODD_SAMPLES if len(counts) else 0):
        bit = mix(np.minimum.reduceat((spread ^ _XOR[k]) * _MUL[k], at) + _XOR[k]) & _U(BITS - 1)
        sketch[rows, (bit >> _U(6)).astype(np.int64)] ^= _U(1) << (bit & _U(63))
    return sketch.view(np.int64)


def _lists(values: np.ndarray, there: np.ndarray) -> pa.Array:
    """Rows of ``values`` as lists; empty lists where ``there`` is false."""
    ends = np.concatenate([[0], np.cumsum(there * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


def _sign(batches):
    for batch in batches:
        ids, bodies = batch.column("doc_id"), [b or b"" for b in batch.column("body").to_pylist()]
        for first, run in blocks(bodies):
            hashes, counts = shingle_sets(run)
            prints, bands = signatures(hashes, counts)
            there = counts > 0
            both = np.zeros((len(run), 2), np.int64)
            both[there] = prints
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(run)), pa.array(counts.astype(np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), _lists(bands, there)], names=["doc_id", "n_shingles", "print_a", "print_b", "bands"])


def _sets(batches):
    for batch in batches:
        ids, bodies = batch.column("doc_id"), [b or b"" for b in batch.column("body").to_pylist()]
        for first, run in blocks(bodies):
            hashes, counts = shingle_sets(run)
            ends = np.cumsum(counts)
            sketch = _lists(odd_sketches(hashes, counts), counts > 0)
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(run)), pa.array([hashes[e - c : e].tobytes() for e, c in zip(ends, counts)], type=pa.binary()), sketch], names=["doc_id", "shingles", "sketch"])


def _rows(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _across(most: int):
    """Pairs of different components in a pair of blocks of one bucket, if the sketches allow and no earlier band has both."""

    def kernel(batches):
        for group in key_groups(batches, ["band", "i", "j"]):
            g = group.combine_chunks().to_batches()[0]
            band, i, j = (g.column(k)[0].as_py() for k in ("band", "i", "j"))
            ids, c, side = (np.asarray(g.column(k)) for k in ("doc_id", "c", "side"))
            main = np.asarray(g.column("in_main").cast(pa.int8())) == 1
            bands, sketch = _rows(g.column("bands"), BANDS), _rows(g.column("sketch"), BITS // 64).view(np.uint64)
            out = []
            for x in np.flatnonzero(~main).tolist():
                ok = (c != c[x]) & (main | (ids > ids[x]))
                if i != j:
                    ok &= side != side[x]
                y = np.flatnonzero(ok)
                y = y[np.bitwise_count(sketch[y] ^ sketch[x]).sum(1) <= most]
                if len(y):
                    place = int(np.flatnonzero(bands[x] == band)[0])
                    y = y[~(bands[y, :place] == bands[x, :place]).any(1)]
                    out.append((np.full(len(y), ids[x]), ids[y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k)) for k in zip(*out)], names=["x", "y"])

    return kernel


def _confirm(threshold_pct: int):
    def kernel(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_x"), batch.column("set_y")):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(x, y) if len(x) else np.zeros(len(y), np.int64)
                both = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)) if len(x) else 0
                keep.append(100 * both >= threshold_pct * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep, type=pa.bool_()))

    return kernel


def differing_bits(a: str, b: str) -> Column:
    """Population count of the XOR of two odd sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def most_bits(similarity: float) -> int:
    """Expected differing bits of two odd sketches of documents with this similarity, rounded up."""
    return math.ceil(BITS / 2 * (1 - math.exp(-2 * (2 * ODD_SAMPLES * (1 - similarity)) / BITS)))


def near_duplicates(docs: DataFrame, threshold_pct: int = 75, sketch_margin: float = 0.06) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns are not read).

    Null and wordless texts have n_shingles 0 and are components of their own. Rows that repeat a doc_id are each
    returned and each compared with its own text. A null doc_id stays null and is kept; it never names a component. An empty table gives an empty result.
    """
    rows = numbered(docs, "doc_id", "text")
    found = near_duplicate_rows(rows, threshold_pct, sketch_margin)
    ids = rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id"))
    # rows are numbered in the order of doc_id, so the component's first row has its smallest id
    named = found.join(ids, ROW).join(ids.select(F.col(ROW).alias("component"), F.col("doc_id").alias("component_id")), "component") if numbers_differ(rows) else found.select("*", F.col(ROW).alias("doc_id"), F.col("component").alias("component_id"))
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicate_rows(rows: DataFrame, threshold_pct: int = 75, sketch_margin: float = 0.06) -> DataFrame:
    """(ROW, n_shingles, component) for rows with a unique number in ``ROW``; component is the smallest number reachable."""
    texts = raw_text(rows, ROW)
    signed = written(texts.mapInArrow(_sign, "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>"), "minhash")
    prints = ["print_a", "print_b"]
    # a table of its own, so that the joins with it have plain shuffles on both sides, which Spark can split where a set has many copies
    classes = written(signed.where("n_shingles > 0").groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select(*prints, "rep"), "classes")
    named = signed.join(classes, prints, "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    banded = named.where("doc_id = rep").select("doc_id", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("doc_id").alias("leader"), F.count("*").alias("size")).where("size > 1")
    members = written(banded.join(leaders, "band").select("band", "doc_id", "leader", "size"), "buckets")
    involved = members.select("doc_id").distinct()
    sets = written(texts.join(involved, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary, sketch array<long>"), "sets")
    most = most_bits(threshold_pct / 100 - sketch_margin)

    def sketched(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("doc_id").alias(n), F.col("sketch").alias(f"s{n}")) for n in "xy")
        return pairs.join(x, "x").join(y, "y").select("x", "y", differing_bits("sx", "sy").alias("bits")).where(F.col("bits") <= most)

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = (sets.select(F.col("doc_id").alias(n), F.col("shingles").alias(f"set_{n}")) for n in "xy")
        return pairs.select("x", "y").join(x, "x").join(y, "y").mapInArrow(_confirm(threshold_pct), "x long, y long")

    def labelled(rows: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
        return rows.join(known.select(F.col("id").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))

    star = written(sketched(members.where("doc_id != leader").select(F.col("doc_id").alias("x"), F.col("leader").alias("y")).distinct()), "star")
    best = star.groupBy("x").agg(F.min_by("y", F.struct("bits", "y")).alias("y"))
    links = written(confirmed(best), "links")
    # each document has one link to a smaller one here: three steps along these give a label that many of a group share
    known = links.select(F.col("x").alias("id"), F.col("y").alias("component"))
    steps = links.select(F.col("x").alias("component"), F.col("y").alias("next"))
    for _ in range(2):
        known = known.join(steps, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
    known = written(known, "labels")

    larger = members.where("size > 2")
    tagged = labelled(larger, known, "doc_id", "c")
    picked = tagged.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min_by(F.struct("doc_id", "c"), F.xxhash64("doc_id", "band")).alias("pick")).where("low != high")
    second = tagged.join(picked, "band").where("c != pick.c and doc_id != leader and pick.doc_id != leader")
    second = sketched(second.select(F.greatest("doc_id", "pick.doc_id").alias("x"), F.least("doc_id", "pick.doc_id").alias("y")).distinct())
    others = labelled(labelled(star.join(best, ["x", "y"], "left_anti"), known, "x", "cx"), known, "y", "cy").where("cx != cy")
    more = written(confirmed(others.select("x", "y").union(second.select("x", "y"))), "links")
    release(star, known)
    known = forest(links.union(more))

    tagged = labelled(larger.select("band", "doc_id", "size"), known, "doc_id", "c")
    parts = tagged.groupBy("band", "c").agg(F.count("*").alias("n"))
    largest = parts.groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("band", "main")
    several = tagged.join(largest, "band").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    several = several.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meeting = several.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "doc_id", "c", (F.col("c") == F.col("main")).alias("in_main"))
    meeting = meeting.join(signed.select("doc_id", "bands"), "doc_id").join(sets.select("doc_id", "sketch"), "doc_id").select("band", "i", "j", "side", "doc_id", "c", "in_main", "bands", "sketch")
    rest = meeting.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_across(most), "x long, y long").distinct()
    last = written(confirmed(rest), "links")
    # what follows reads the signatures, the classes and the components only
    release(sets, members, links, more)
    if not last.isEmpty():
        known = forest(known.union(last))
    release(last)
    final = known.withColumnRenamed("id", "rep")
    return named.select("doc_id", "n_shingles", "rep").join(final, "rep", "left").select(F.col("doc_id").alias(ROW), "n_shingles", F.coalesce("component", "rep").alias("component"))
