"""Exact threshold pairs of vectors by cover trees and dual traversal.

Unit vectors x, y have cosine >= t exactly when |x - y| <= sqrt(2 - 2 t), a metric, so trees prune: a pair of nodes is dropped
once the distance of their centres less both covering radii passes that limit.

The tree is nested in two parts. Its top is built on the driver from a bounded sample (``sample`` vectors, at most ``cells``
centres at the last level); every vector belongs to its nearest centre, and an aggregation gives the cells' covering radii.
Cells are cut into chunks of about ``chunk`` vectors, each packed into one row with the lower part of the tree: levels of
halving radii, as long as they group vectors at all. Chunks of neighbouring cells form groups of bounded size, and pairs of cells that
the bound does not drop give pairs of groups. A chunk is sent once to each pair that its group is in; there pairs of chunks are
traversed from the roots, level by level with whole frontiers at once, and what survives is multiplied out in
single precision with a margin and confirmed in double precision. Vectors of different lengths have trees of their own; a length that
the sample misses has one cell.

No pair becomes a row: a pair of chunks returns, for each vector with a link, its number of links and the least id of
its component among the two chunks, which is all that link counts and components need. Equal vectors travel once.

Vectors without structure (all distances alike) leave most pairs of nodes standing; the work is then every block
against every block, in matrix products. A vector then travels once for each group, of which there are ``SPREAD`` until groups have ``GROUP`` bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomctx.llm.components import components
from loomctx.llm.stage import key_groups, small_batches, written

#: Added to bounds and to single-precision products, so that rounding excludes no pair.
SLACK = 1e-5
#: Groups that the chunks of one length are dealt to at least, and bytes of a group's vectors at most (one chunk if that has more).
SPREAD, GROUP = 8, 32 << 20


class CoverTree:
    """Nested levels with halving radii over unit vectors.

    ``levels[k]``: rows that are centres at level k, each level holding the one above. ``owner``: for each row, the place of its
    centre in the last level. ``parent[k]``: for each centre of level k, the place of its parent in level k - 1.
    ``cover[k]``: a bound on the distance from a centre to any row below it. A level that would need more than
    ``most`` centres is not made.
    """

    def __init__(self, points: np.ndarray, most: int, top: float = 2.0):
        n = len(points)
        self.levels, self.parent = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        owner = np.zeros(n, np.int64)
        dist = _distances(points, points[:1])[:, 0]
        radius = top
        while radius > 0.01:
            radius /= 2
            centres, mother = self.levels[-1].tolist(), list(range(len(self.levels[-1])))
            new_owner, new_dist = owner.copy(), dist.copy()
            far = np.flatnonzero(new_dist > radius)
            while len(far) and len(centres) <= most:
                row = int(far[0])
                mother.append(int(owner[row]))
                centres.append(row)
                d = _distances(points[far], points[row : row + 1])[:, 0]
                near = d < new_dist[far]
                new_dist[far[near]], new_owner[far[near]] = d[near], len(centres) - 1
                far = far[(new_dist[far] > radius) & (far != row)]
            if len(far):
                break
            if len(centres) > len(self.levels[-1]):
                self.levels.append(np.array(centres, np.int64))
                self.parent.append(np.array(mother, np.int64))
                owner, dist = new_owner, new_dist
        self.owner = owner
        self.cover = [np.zeros(len(x)) for x in self.levels]
        np.maximum.at(self.cover[-1], owner, dist)
        for k in range(len(self.levels) - 1, 0, -1):
            par = self.parent[k]
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", points[self.levels[k]], points[self.levels[k - 1]][par])))
            np.maximum.at(self.cover[k - 1], par, d + self.cover[k])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class Packed:
    """A chunk's vectors with its tree; rows are sorted by their centre in the last level."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, weight: np.ndarray):
        tree = CoverTree(points, max(8, len(points) // 16))
        order = np.argsort(tree.owner, kind="stable")
        self.ids, self.points, self.weight = ids[order], points[order], weight[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(tree.owner, minlength=len(tree.levels[-1])))])
        self.centres = [points[x] for x in tree.levels]
        self.parent, self.cover = tree.parent, tree.cover

    def dump(self) -> dict[str, bytes]:
        sizes = np.array([len(self.ids), self.points.shape[1], len(self.centres), *map(len, self.centres)], np.int64)
        tree = np.concatenate([np.concatenate([c.ravel(), p.astype(np.float64), r]) for c, p, r in zip(self.centres, self.parent, self.cover)])
        return {"ids": self.ids.tobytes(), "points": self.points.tobytes(), "weight": self.weight.tobytes(), "start": self.start.tobytes(), "sizes": sizes.tobytes(), "tree": tree.tobytes()}

    @classmethod
    def load(cls, row: dict[str, bytes]) -> Packed:
        out = cls.__new__(cls)
        n, dim, depth, *sizes = np.frombuffer(row["sizes"], np.int64)
        out.ids, out.weight, out.start = (np.frombuffer(row[k], np.int64) for k in ("ids", "weight", "start"))
        out.points = np.frombuffer(row["points"], np.float64).reshape(n, dim)
        tree, at = np.frombuffer(row["tree"], np.float64), 0
        out.centres, out.parent, out.cover = [], [], []
        for m in sizes:
            out.centres.append(tree[at : at + m * dim].reshape(m, dim))
            out.parent.append(tree[at + m * dim : at + m * dim + m].astype(np.int64))
            out.cover.append(tree[at + m * dim + m : at + m * dim + 2 * m])
            at += m * (dim + 2)
        return out


def surviving(a: Packed, b: Packed, limit: float) -> np.ndarray:
    """Which pairs of last-level nodes may hold a pair within the limit: the traversal's last frontier, as a matrix."""
    i = j = 0
    alive = np.ones((1, 1), bool)
    while True:
        alive = alive & (_distances(a.centres[i], b.centres[j]) <= a.cover[i][:, None] + b.cover[j][None, :] + limit + SLACK)
        if i + 1 < len(a.centres) and (i <= j or j + 1 == len(b.centres)):
            i += 1
            alive = alive[a.parent[i]]
        elif j + 1 < len(b.centres):
            j += 1
            alive = alive[:, b.parent[j]]
        else:
            return alive
        if not alive.any():
            return np.zeros((len(a.centres[-1]), len(b.centres[-1])), bool)


def linked(a: Packed, b: Packed, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of a, of b) with cosine of at least the threshold."""
    alive = surviving(a, b, math.sqrt(2 - 2 * threshold))
    wide_a, wide_b = np.diff(a.start), np.diff(b.start)
    standing = (alive * wide_a[:, None] * wide_b[None, :]).sum()
    if not standing:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fa, fb = a.points.astype(np.float32), b.points.astype(np.float32)
    if standing * 3 > len(a.ids) * len(b.ids):
        x, y = np.nonzero(fa @ fb.T >= threshold - SLACK)
    else:
        found = []
        for node in np.flatnonzero(alive.any(1)):
            rows = np.concatenate([np.arange(b.start[k], b.start[k + 1]) for k in np.flatnonzero(alive[node])])
            p, q = np.nonzero(fa[a.start[node] : a.start[node + 1]] @ fb[rows].T >= threshold - SLACK)
            found.append((p + a.start[node], rows[q]))
        x, y = (np.concatenate(c) for c in zip(*found))
    ok = np.empty(len(x), bool)
    for s in range(0, len(x), 1 << 18):
        ok[s : s + (1 << 18)] = np.einsum("ij,ij->i", a.points[x[s : s + (1 << 18)]], b.points[y[s : s + (1 << 18)]]) >= threshold
    return x[ok], y[ok]


def _matrix(column) -> np.ndarray:
    whole = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(whole.flatten(), dtype=np.float64).reshape(len(whole), -1)


def _unit(batches):
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            x = np.array([np.nan if c is None else c for c in v], np.float64)
            norm = math.sqrt(float(x @ x)) if len(x) and np.isfinite(x).all() else 0.0
            if norm and math.isfinite(norm):
                out.append(x / norm)
            else:
                big = float(np.abs(x).max()) if len(x) and np.isfinite(x).all() else 0.0
                # squares out of range: scale first
                x = x / big if big else x
                out.append(x / math.sqrt(float(x @ x)) if big else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("weight"), pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "weight", "unit"])


def _assign(centres: dict[int, np.ndarray]):
    """Nearest centre among those of the vector's length; cell 0 where there are none."""

    def kernel(batches):
        for batch in batches:
            dims = np.asarray(batch.column("unit").value_lengths())
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                cell, near = np.zeros(part.num_rows, np.int64), np.full(part.num_rows, 2.0)
                if dim in centres:
                    d = _distances(_matrix(part.column("unit")), centres[dim])
                    cell = d.argmin(1)
                    near = d[np.arange(len(d)), cell]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("weight"), part.column("unit"), pa.array(np.full(len(cell), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(near)], names=["vec_id", "weight", "unit", "dim", "cell", "d"])

    return kernel


def _per(chunks: int, chunk: int, dim: int) -> int:
    """Chunks of a group."""
    return max(1, min(GROUP // (chunk * dim * 8), -(-chunks // SPREAD)))


def layout(stats: dict[tuple[int, int], tuple[float, int]], centres: dict[int, np.ndarray], limit: float, chunk: int) -> tuple[list[tuple], list[tuple]]:
    """Cells (dim, cell, chunks, first chunk, chunks of a group), and the ranges of groups (dim, a, to a, b, to b) of cells that may hold a pair.

    ``stats``: covering radius and number of vectors of each (dim, cell).
    """
    cells, ranges = [], []
    for dim in sorted({d for d, _ in stats}):
        mine = {c: stats[d, c] for d, c in sorted(stats) if d == dim}
        chunks = {c: -(-n // chunk) for c, (_, n) in mine.items()}
        per, first, at = _per(sum(chunks.values()), chunk, dim), {}, 0
        for c, k in chunks.items():
            first[c], at = at, at + k
            cells.append((dim, c, k, first[c], per))
        between = _distances(centres[dim], centres[dim]) if dim in centres else np.zeros((1, 1))
        span = {c: (first[c] // per, (first[c] + chunks[c] - 1) // per) for c in mine}
        ranges += [(dim, *span[i], *span[j]) for i in mine for j in mine if i <= j and between[i, j] <= mine[i][0] + mine[j][0] + limit]
    return cells, sorted(set(ranges))


_PACKED = "dim int, group int, chunk int, ids binary, points binary, weight binary, start binary, sizes binary, tree binary"


def _pack(table: pa.Table) -> pa.Table:
    order = np.argsort(np.asarray(table["vec_id"]), kind="stable")
    packed = Packed(np.asarray(table["vec_id"])[order], _matrix(table["unit"])[order], np.asarray(table["weight"])[order])
    return pa.table({k: pa.array([table[k][0].as_py()], pa.int32()) for k in ("dim", "group", "chunk")} | {k: pa.array([v], pa.binary()) for k, v in packed.dump().items()})


def _meet(threshold: float):
    keys = ("ids", "points", "weight", "start", "sizes", "tree")

    def kernel(batches):
        for table in key_groups(batches, ["dim", "a", "b"]):
            parts = [(table["group"][i].as_py(), table["chunk"][i].as_py(), Packed.load({k: table[k][i].as_py() for k in keys})) for i in range(table.num_rows)]
            first, last = table["a"][0].as_py(), table["b"][0].as_py()
            for a, b in ((p[2], q[2]) for p in parts for q in parts if p[0] == first and q[0] == last and p[:2] <= q[:2]):
                same = a is b
                x, y = linked(a, b, threshold)
                if same:
                    ok = x != y
                    x, y = x[ok], y[ok]
                if not len(x):
                    continue
                ids = a.ids if same else np.concatenate([a.ids, b.ids])
                shift = 0 if same else len(a.ids)
                links = np.bincount(x, weights=b.weight[y], minlength=len(ids))
                if not same:
                    links += np.bincount(y + shift, weights=a.weight[x], minlength=len(ids))
                label, before = ids.copy(), None
                while before is None or (label != before).any():
                    before = label.copy()
                    np.minimum.at(label, x, before[y + shift])
                    np.minimum.at(label, y + shift, label[x])
                there = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[there]), pa.array(links[there].astype(np.int64)), pa.array(label[there])], names=["vec_id", "links", "least"])

    return kernel


def near_vectors(vectors: DataFrame, threshold: float = 0.95, sample: int = 4096, cells: int = 256, chunk: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding; labels aren't read).

    Null, empty or zero vectors and those with null or non-finite components link with nothing, and vectors of different
    lengths do not link with each other. A null vec_id is returned with no links and is nobody's partner; rows that
    repeat an id with an equal vector count as links of each other, with different vectors each row has the links of its own. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark, size=32 << 20)
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")), "vectors")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    valid = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda c: c != 0))
    copies = valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    copies = written(copies, "copies")
    repeated = copies.groupBy("rep").count().where("count > 1").limit(1).count() > 0
    if repeated:
        # different vectors share an id: keys in the order of the ids tell them apart
        order = [F.col("rep"), F.xxhash64("embedding")]
        copies = written(copies.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()), "copies")
    else:
        copies = copies.withColumn("key", F.col("rep"))
    unit = copies.select(F.col("key").alias("vec_id"), "weight", "embedding").mapInArrow(_unit, "vec_id long, weight long, unit array<double>").where("unit is not null")
    unit = written(unit, "unit")
    some: dict[int, list] = {}
    for r in unit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("unit").collect():
        some.setdefault(len(r["unit"]), []).append(r["unit"])
    centres = {dim: np.array(v)[CoverTree(np.array(v), cells).levels[-1]] for dim, v in some.items()}
    placed = written(unit.mapInArrow(_assign(centres), "vec_id long, weight long, unit array<double>, dim int, cell int, d double"), "cells")
    # a row for each centre, so at most ``sample``, and one for each length without any
    stats = {(s["dim"], s["cell"]): (s["r"], s["n"]) for s in placed.groupBy("dim", "cell").agg(F.max("d").alias("r"), F.count("*").alias("n")).collect()}
    places, ranges = layout(stats, centres, math.sqrt(2 - 2 * threshold) + SLACK, chunk)
    places = spark.createDataFrame(places, "dim int, cell int, chunks int, first int, per int")
    packed = placed.join(F.broadcast(places), ["dim", "cell"]).withColumn("chunk", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("chunks"))).cast("int"))
    packed = packed.select("dim", F.floor(F.col("chunk") / F.col("per")).cast("int").alias("group"), "chunk", "vec_id", "weight", "unit")
    packed = written(packed.groupBy("dim", "group", "chunk").applyInArrow(_pack, _PACKED), "chunks")
    spans = spark.createDataFrame(ranges, "dim int, a0 int, a1 int, b0 int, b1 int")
    pairs = spans.select("dim", F.explode(F.sequence("a0", "a1")).alias("a"), "b0", "b1").select("dim", "a", F.explode(F.sequence("b0", "b1")).alias("b"))
    pairs = written(pairs.select("dim", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    sides = pairs.withColumn("group", F.col("a")).union(pairs.where("a != b").withColumn("group", F.col("b")))
    meeting = packed.join(sides, ["dim", "group"]).repartition("dim", "a", "b").sortWithinPartitions("dim", "a", "b")
    links = written(meeting.mapInArrow(_meet(threshold), "vec_id long, links long, least long"), "links")
    total = links.groupBy(F.col("vec_id").alias("key")).agg(F.sum("links").alias("links"))
    final = components(links.select("vec_id", "least")).where("id != component").select(F.col("id").alias("key"), "component")
    if repeated:
        final = final.join(copies.select(F.col("key").alias("component"), F.col("rep").alias("least")), "component").select("key", F.col("least").alias("component"))
    known = copies.join(total, "key", "left").join(final, "key", "left").select("embedding", "rep", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(known, "embedding", "left")
    ok = F.col("rep").isNotNull() & F.col("vec_id").isNotNull()
    return out.select(
        "vec_id",
        F.when(ok, F.col("links") + F.col("weight") - 1).otherwise(0).cast("long").alias("n_links"),
        F.when(ok, F.col("component")).otherwise(F.col("vec_id")).alias("component_id"),
        F.coalesce(F.when(ok, F.col("component") == F.col("vec_id")), F.lit(True)).alias("kept"),
    )
