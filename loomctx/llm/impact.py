"""Exact top-k inner products by an impact-ordered index, a score at a time.

Components become integers, ``floor(64 * x)``. Equal vectors are indexed once: all their rows score alike and equal scores go by id,
so of one vector only its ``k + 1`` smallest rows can stand in a result of k rows (one of them may be the query's own). Vectors are dealt to blocks; a
block's postings (position, dimension, value) stand in segments by falling quantised impact, which is the value's size against a few levels.

A task takes a group of blocks and a group of queries and adds a block's segments up, level by level, for many queries at once. What a
vector has not yet added lies below the level, so its score is known to within ``(level - 1) * sum |q|`` over its open dimensions. A pair is
dropped on proof alone: when its greatest possible score is below the k-th score already proven for the query, or equals it with a larger
id. Once few pairs stand, they are scored from all their postings and join the query's best; a block whose segments have all been added has its exact scores anyway. Groups
return ``k + 1`` vectors for each query, and a window takes the best of all groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomctx.llm.stage import key_groups, release, small_batches, written

#: Shares of a block's postings that its levels hold together, and the share of pairs at which scoring them is cheaper than one more level.
LEVELS, FEW = (0.3, 0.5, 0.7, 0.85, 1.0), 0.03
#: Bytes of a group's postings at most (one block if that has more), groups of vectors and of queries at least, queries added up together.
GROUP, SPREAD, QUERY_SPREAD, BATCH = 32 << 20, 8, 2, 512
#: Whole numbers below it are exact in a double.
WHOLE = 2.0**53
_LONGEST = (1 << 63) - 1


def quantised(column: str = "embedding"):
    """The vector's integers as doubles; null where it is null or a component is null, not finite or, times 64, not below 2 ** 53 in size."""
    scaled = F.transform(F.col(column).cast("array<double>"), lambda c: c * 64.0)
    usable = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < WHOLE))
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(scaled, lambda c: F.floor(c).cast("double")))


def matrix(column) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    whole = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(whole.value_lengths())
    width = max(int(sizes.max(initial=0)), 1)
    out = np.zeros((len(whole), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.asarray(whole.flatten(), np.float64)
    return out


class Block:
    """Vectors as postings in segments of falling impact, with their keys and ids."""

    TYPES = {"keys": np.int64, "ids": np.int64, "at": np.int32, "dim": np.int32, "value": np.float64, "ends": np.int64, "floors": np.float64, "width": np.int64}

    def __init__(self, keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.keys, self.ids, self.width = keys, ids, np.array([vectors.shape[1]])
        at, dim = np.nonzero(vectors)
        value = vectors[at, dim]
        order = np.argsort(-np.abs(value), kind="stable")
        self.at, self.dim, self.value = at[order].astype(np.int32), dim[order].astype(np.int32), value[order]
        size, ends, floors = np.abs(self.value), [], []
        for share in LEVELS if len(size) else ():
            # a segment holds all postings of its least impact
            level = size[max(0, int(share * len(size)) - 1)]
            end = int(np.searchsorted(-size, -level, side="right"))
            if not ends or end > ends[-1]:
                ends.append(end)
                floors.append(level)
        self.ends, self.floors = np.array(ends, np.int64), np.array(floors, np.float64)

    def dump(self) -> dict[str, bytes]:
        return {k: getattr(self, k).astype(t).tobytes() for k, t in self.TYPES.items()}

    @classmethod
    def load(cls, row: dict[str, bytes]) -> Block:
        out = cls.__new__(cls)
        for k, t in cls.TYPES.items():
            setattr(out, k, np.frombuffer(row[k], t))
        return out

    def spread(self, first: int = 0, last: int | None = None, width: int = 0, kind=np.float64) -> np.ndarray:
        """Postings first to last as a matrix with a row for each vector."""
        out = np.zeros((len(self.keys), max(width, int(self.width[0]))), kind)
        out[self.at[first:last], self.dim[first:last]] = self.value[first:last]
        return out


class Best:
    """The best vectors of each query so far: score falling, then id and key rising."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64)]
        #: score and id of the k-th, a proof of what can't be among the best
        self.floor, self.last = np.full(queries, -np.inf), np.full(queries, _LONGEST)

    def add(self, query, score, ids, keys) -> None:
        query, score, ids, keys = (np.concatenate(x) for x in zip(self.rows, (query, score, ids, keys)))
        if score.dtype == object:
            order = np.array(sorted(range(len(score)), key=lambda i: (query[i], -score[i], ids[i], keys[i])), np.int64)
        else:
            order = np.lexsort((keys, ids, -score, query))
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, rank = order[rank < self.k], rank[rank < self.k]
        self.rows = [x[order] for x in (query, score, ids, keys)]
        full = order[rank == self.k - 1]
        self.floor[query[full]], self.last[query[full]] = score[full].astype(np.float64), ids[full]


def search(block: Block, queries: np.ndarray, best: Best, base: int = 0) -> int:
    """Adds the block's vectors to the best of ``queries``, numbered from ``base``; the number of pairs that were not dropped."""
    width = max(int(block.width[0]), queries.shape[1])
    q = np.zeros((len(queries), width))
    q[:, : queries.shape[1]] = queries
    most = np.abs(block.value).max(initial=0.0) * np.abs(q).max(initial=0.0) * width
    if most >= WHOLE:
        return _search_large(block, q, best, base)
    kind = np.float32 if most < 2.0**24 else np.float64  # sums of products are exact integers in it
    qs, n, end = q.astype(kind), len(block.keys), 0
    size = np.abs(qs)
    floor, last = best.floor[base : base + len(q), None], best.last[base : base + len(q), None]
    known, open_ = np.zeros((len(q), n), kind), np.zeros((n, width), kind)
    open_[block.at, block.dim] = 1
    kth = lambda score: np.partition(score, n - best.k, axis=1)[:, n - best.k, None] if n >= best.k else floor
    for stop, level in zip(block.ends.tolist(), block.floors.tolist()):
        known += qs @ block.spread(end, stop, width, kind).T
        open_[block.at[end:stop], block.dim[end:stop]] = 0
        end = stop
        if end == len(block.value):
            break
        slack = (size @ open_.T) * kind(level - 1)
        low, top = np.maximum(floor, kth(known - slack)), known + slack
        alive = (top > low) | ((top == low) & ((low > floor) | (block.ids[None, :] <= last)))
        if alive.sum() <= FEW * alive.size:
            break
    done = end == len(block.value)
    if done:
        low = np.maximum(floor, kth(known))
        alive = (known > low) | ((known == low) & ((low > floor) | (block.ids[None, :] <= last)))
    i, v = np.nonzero(alive)
    if done:
        score = known[i, v].astype(np.float64)
    else:
        rows, score = block.spread(width=width), np.empty(len(v))
        for s in range(0, len(v), 1 << 16):
            score[s : s + (1 << 16)] = np.einsum("ij,ij->i", rows[v[s : s + (1 << 16)]], q[i[s : s + (1 << 16)]])
    best.add(i + base, score, block.ids[v], block.keys[v])
    return len(v)


def _search_large(block: Block, q: np.ndarray, best: Best, base: int) -> int:
    """Products that a double can't hold: every pair in whole numbers of any size."""
    rows = [[int(x) for x in r] for r in block.spread(width=q.shape[1])]
    for i, r in enumerate(q):
        query, score = [int(x) for x in r], np.empty(len(rows), object)
        score[:] = [sum(a * b for a, b in zip(query, row)) for row in rows]
        best.add(np.full(len(rows), i + base), score, block.ids, block.keys)
    return len(rows) * len(q)


_PARTS = list(Block.TYPES)
_INDEX = "group int, block int, " + ", ".join(f"{p} binary" for p in _PARTS)


def _pack(table: pa.Table) -> pa.Table:
    order = np.lexsort((np.asarray(table["key"]), np.asarray(table["id"])))
    block = Block(np.asarray(table["key"])[order], np.asarray(table["id"])[order], matrix(table["x"])[order])
    return pa.table({k: pa.array([table[k][0].as_py()], pa.int32()) for k in ("group", "block")} | {k: pa.array([v], pa.binary()) for k, v in block.dump().items()})


def _meet(k: int):
    def kernel(batches):
        for table in key_groups(batches, ["q", "d"]):
            sides: dict[bool, list[Block]] = {True: [], False: []}
            for i in range(table.num_rows):
                sides[table["asks"][i].as_py()].append(Block.load({p: table[p][i].as_py() for p in _PARTS}))
            for asked in sides[True]:
                queries, best = asked.spread(), Best(len(asked.keys), k)
                for block in sorted(sides[False], key=lambda b: int(b.ids[0])):
                    for s in range(0, len(queries), BATCH):
                        search(block, queries[s : s + BATCH], best, s)
                query, score, _, keys = best.rows
                # a long can't hold all scores of large components: these travel as text
                texts = [None if abs(x) <= _LONGEST else str(x) for x in map(int, score)] if score.dtype == object else [None] * len(score)
                short = [0 if t else int(x) for t, x in zip(texts, score)] if score.dtype == object else score.astype(np.int64)
                columns = [pa.array(asked.ids[query]), pa.array(asked.keys[query]), pa.array(keys), pa.array(short, pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "query", "key", "score", "large"])

    return kernel


def _dealt(rows: DataFrame, chunk: int, spread: int, width: int) -> tuple[DataFrame, int]:
    """Rows (key, id, x) packed in blocks of about ``chunk``, these in groups of bounded size; the number of groups."""
    blocks = max(1, -(-rows.count() // chunk))
    per = max(1, min(GROUP // (chunk * width * 16), -(-blocks // spread)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("group", F.floor(F.col("block") / per).cast("int"))
    return dealt.groupBy("group", "block").applyInArrow(_pack, _INDEX), -(-blocks // per)


def top_products(vectors: DataFrame, is_query, k: int = 20, chunk: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` greatest integer inner products of each row of ``vectors`` (vec_id, embedding) that ``is_query``, a condition on vec_id, admits.

    Candidates are all rows but the query's own; equal scores go by vec_id, a null one last. Rows that repeat an id each ask and are found on their own; a row without an id asks
    nothing, but is found. Vectors take no part that are null or hold a component that is null, not finite or, times 64, 2 ** 53 or more in size; a
    shorter vector, an empty one too, is filled up with zeros. With fewer than k others a query has fewer rows, with none no row.
    Scores beyond a long are ranked by their exact value and returned as the nearest long. An empty table gives an empty result; other columns aren't read.
    """
    small_batches(vectors.sparkSession, records=4096, size=32 << 20)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised().alias("x")).where("x is not null")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "impact-rows")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 1
    # the window's limit is applied before its shuffle too, so copies of one vector are few there
    copies = Window.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last(), "row")
    members = rows.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).withColumn("key", F.first("row").over(copies))
    members = written(members.select("key", "nth", "vec_id", "row", F.when(F.col("nth") == 1, F.col("x")).alias("x")), "impact-members")
    index, d_groups = _dealt(members.where("nth = 1").select("key", F.coalesce("vec_id", F.lit(_LONGEST)).alias("id"), "x"), chunk, SPREAD, width)
    asked, q_groups = _dealt(rows.where(F.col("vec_id").isNotNull()).where(is_query).select(F.col("row").alias("key"), F.col("vec_id").alias("id"), "x"), chunk, QUERY_SPREAD, width)
    index, asked = written(index, "impact-index"), written(asked, "impact-queries")
    d_side = index.withColumns({"q": F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))), "d": F.col("group"), "asks": F.lit(False)})
    q_side = asked.withColumns({"d": F.explode(F.sequence(F.lit(0), F.lit(d_groups - 1))), "q": F.col("group"), "asks": F.lit(True)})
    meeting = d_side.unionByName(q_side).repartition(q_groups * d_groups, "q", "d").sortWithinPartitions("q", "d")
    found = meeting.mapInArrow(_meet(k + 1), "query_id long, query long, key long, score long, large string")
    found = found.select("query_id", "query", "key", F.coalesce(F.col("large").cast("decimal(38,0)"), F.col("score").cast("decimal(38,0)")).alias("value"))
    found = written(found, "impact-found")
    release(rows, index, asked)
    order = [F.desc("value"), F.col("vec_id").asc_nulls_last(), F.col("row")]
    hits = found.join(members.select("key", "vec_id", "row"), "key").where("row != query")
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    longest = F.lit(_LONGEST).cast("decimal(38,0)")
    return best.select("query_id", "rank", "vec_id", F.greatest(F.least("value", longest), -longest - 1).cast("long").alias("score"))
