"""Repeated byte strings by suffix arrays built with external induced sorting.

A shard is the text of many segments, parted by separators. Its suffixes are sorted by induction:

1. Suffixes are typed; the leftmost S suffixes (S*) are sorted by their substrings with a first induction, named, and,
   where names repeat, the string of names is sorted recursively: by doubling of names, as deep as a match counts.
2. From the sorted S* suffixes the L suffixes are induced in ascending order, and from these the S suffixes in descending order.

The queues of an induction hold tuples (suffix, common prefix with the tuple before) under their first symbol. A
queue's tuples leave in the order in which they came, which is that of their ranks, so taking the least symbol's queue first
is a priority queue. Tuples beyond a memory budget go to a file and come back in order; the text and its types
are memory-mapped there too once the shard is large. Common-prefix values are carried, not recomputed: the value of two successive
tuples is one more than the least value between the tuples that induced them, which each queue tracks as it is fed. They are exact
up to the depth that counts.

All tuples of one symbol that are known at a time are handled at once, as arrays.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomctx.llm.segments import keyed, merged, repeated, runs_of, shards
from loomctx.llm.textkernel import _BASE, _INV, _VALUE, mix, powers

_U = np.uint64
GRAM = 24
SHARD = 1 << 20
#: Tuples in memory before queues go to disk, and text length from which arrays are memory-mapped.
IN_MEMORY = 1 << 24
_FAR = np.int32(1 << 30)


class Workspace:
    """Arrays and queue pages of one shard; large ones live in a temporary file that goes when closed."""

    def __init__(self, in_memory: int = IN_MEMORY):
        self.in_memory, self.held, self.file, self.size, self.queues = in_memory, 0, None, 0, []

    def _open(self):
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        return self.file

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= self.in_memory:
            return np.empty(n, dtype)
        handle = tempfile.TemporaryFile()
        return np.memmap(handle, dtype, "w+", shape=(n,))

    def page(self, values: np.ndarray) -> tuple[int, int]:
        f = self._open()
        f.seek(0, 2)
        at = f.tell()
        f.write(values.tobytes())
        return at, len(values)

    def load(self, at: int, n: int, dtype) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * np.dtype(dtype).itemsize), dtype)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


class Queue:
    """Tuples of one symbol in order of arrival; pages go to the workspace's file when too many tuples are held."""

    def __init__(self, space: Workspace):
        self.space, self.pages = space, []
        self.least = _FAR  # least common prefix of the inducing tuples since the last one that fed this queue
        self.fresh, self.fed = True, False

    def put(self, suffix: np.ndarray, prefix: np.ndarray) -> None:
        self.space.held += len(suffix)
        if self.space.held > self.space.in_memory:
            self.pages.append((self.space.page(suffix), self.space.page(prefix)))
            self.space.held -= len(suffix)
        else:
            self.pages.append((suffix, prefix))

    def take(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Everything that is in the queue now."""
        if not self.pages:
            return None
        pages, self.pages = self.pages, []
        out = []
        for suffix, prefix in pages:
            if isinstance(suffix, tuple):
                out.append((self.space.load(*suffix, np.int64), self.space.load(*prefix, np.int32)))
            else:
                self.space.held -= len(suffix)
                out.append((suffix, prefix))
        return out[0] if len(out) == 1 else (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]))


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is S (less than the next); the last symbol is the least and S."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32)))
    place = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(place[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(following, n - 2)] > 0
    return out


def run_lengths(text: np.ndarray) -> np.ndarray:
    """Length of the run of one symbol that starts at each place."""
    n = len(text)
    end = np.where(np.append(text[1:] != text[:-1], True), np.arange(n), n)
    return np.minimum.accumulate(end[::-1])[::-1] - np.arange(n) + 1


def _feed(queues: dict[int, Queue], space: Workspace, text, kinds, want_s: bool, suffix: np.ndarray, prefix: np.ndarray | None, depth: int) -> None:
    """Induce the predecessors of these tuples, which follow all tuples given before; without ``prefix`` no values are carried."""
    before = suffix - 1
    place = np.flatnonzero((kinds[before] == want_s) & (before >= 0))
    before = before[place]
    head = text[before]
    by = np.argsort(head, kind="stable")  # a radix sort: symbols have 16 bits
    before, place, head = before[by], place[by], head[by]
    cuts = np.flatnonzero(head[1:] != head[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(head)] if len(head) else []
    for a, b in zip(bounds, bounds[1:]):
        h = int(head[a])
        q = queues.get(h)
        if q is None:
            q = queues[h] = Queue(space)
        if prefix is None:
            q.put(before[a:b], np.zeros(b - a, np.int32))
            continue
        part = place[a:b]
        values = np.empty(b - a, np.int32)
        # a tuple's value: the least between its inducer and the one before; the first also has what came since this queue was fed
        values[0] = min(int(prefix[: part[0] + 1].min()), int(q.least))
        if b - a > 1:
            values[1:] = np.minimum.reduceat(prefix[: part[-1] + 1], part[:-1] + 1)
        np.minimum(values + 1, depth, out=values)
        if q.fresh:
            values[0], q.fresh = 0, False
        tail = prefix[part[-1] + 1 :]
        q.least, q.fed = (int(tail.min()) if len(tail) else _FAR), True
        q.put(before[a:b], values)
    if prefix is not None and len(prefix):
        total = int(prefix.min())
        for q in queues.values():
            if not q.fed:
                q.least = min(q.least, total)
            q.fed = False


def induce(text: np.ndarray, kinds: np.ndarray, seeds: dict[int, tuple[np.ndarray, np.ndarray]], space: Workspace, depth: int, runs: np.ndarray, carry: bool = True) -> dict[int, tuple]:
    """By first symbol: (L suffixes, values, S suffixes, values), each ascending; a value is the common prefix with the one before.

    ``seeds``: S* suffixes by first symbol in order, with their values. Values of first suffixes of a symbol's
    L or S part are 0. Without ``carry`` all values are 0.
    """
    symbols = np.flatnonzero(np.bincount(text)).tolist()
    queues: dict[int, Queue] = {}
    large: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    empty = np.empty(0, np.int64), np.empty(0, np.int32)
    for c in symbols:
        got = []
        q = queues.setdefault(c, Queue(space))
        while (batch := q.take()) is not None:
            got.append(batch)
            _feed(queues, space, text, kinds, False, batch[0], batch[1] if carry else None, depth)
        large[c] = (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else empty
        queues.pop(c)
        if c in seeds:
            suffix, prefix = seeds[c]
            prefix = prefix.copy()
            prefix[0] = min(runs[suffix[0]], runs[large[c][0][-1]]) if got else 0
            _feed(queues, space, text, kinds, False, suffix, prefix if carry else None, depth)
    out: dict[int, tuple] = {}
    queues = {symbols[0]: Queue(space)}
    queues[symbols[0]].put(np.array([len(text) - 1]), np.zeros(1, np.int32))  # the last suffix, which nothing induces
    for c in reversed(symbols):
        got = []
        q = queues.setdefault(c, Queue(space))
        while (batch := q.take()) is not None:
            got.append(batch)
            _feed(queues, space, text, kinds, True, batch[0], batch[1] if carry else None, depth)
        queues.pop(c)
        small = (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])) if got else empty
        suffix, prefix = large[c]
        if len(suffix):
            # descending: each value belongs to the pair with the one that follows it
            down = np.concatenate([[min(runs[small[0][-1]], runs[suffix[-1]]) if len(small[0]) else 0], prefix[1:][::-1]]).astype(np.int32)
            _feed(queues, space, text, kinds, True, suffix[::-1], down if carry else None, depth)
        up = np.concatenate([[0], small[1][1:][::-1]]).astype(np.int32) if len(small[0]) else small[1]
        out[c] = (suffix, prefix, small[0][::-1], up)
    return out


def _by_symbol(text: np.ndarray, suffixes: np.ndarray, values: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sorted suffixes parted by their first symbols."""
    head = text[suffixes]
    cuts = np.flatnonzero(head[1:] != head[:-1]) + 1
    return {int(text[s[0]]): (s, v) for s, v in zip(np.split(suffixes, cuts), np.split(values, cuts)) if len(s)}


def sort_names(names: np.ndarray, reach: int) -> np.ndarray:
    """Order of the suffixes of a string of names, to a depth of ``reach`` names, by doubling; by threes where ranks are small enough."""
    rank, width, n = names.astype(np.int64), 1, len(names)
    times = 3 if n < (1 << 21) - 2 else 2
    while True:
        key = rank.copy()
        for k in range(1, times):
            key *= n + 2
            if k * width < n:
                key[: n - k * width] += rank[k * width :] + 1
        order = np.argsort(key)
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        width *= times
        if width >= reach or fresh[-1] == n - 1:
            return order


class Prints:
    """Substring hashes of a text, for equality and common prefixes of many pairs at once."""

    def __init__(self, text: np.ndarray):
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[text % 256] * (text.astype(np.uint64) * _U(2) + _U(1)) * powers(_BASE, len(text)))])
        self.inverse = powers(_INV, len(text) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.total[stop] - self.total[start]) * self.inverse[start])

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Whether the substrings of this length are equal; not beyond the text."""
        n = len(self.total) - 1
        ea, eb = a + length, b + length
        inside = (ea <= n) & (eb <= n)
        ea, eb = np.minimum(ea, n), np.minimum(eb, n)
        # (total[e] - total[s]) / base**s compared without division by either power
        left = (self.total[ea] - self.total[a]) * self.inverse[a]
        return inside & (left == (self.total[eb] - self.total[b]) * self.inverse[b])

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Common prefix of the suffixes at a and b, up to ``most``: whole ones first, then short ones, then by halving."""
        out = np.full(len(a), most, np.int64)
        rest = np.flatnonzero(~self.same(a, b, most))
        short = min(16, most)
        beyond = self.same(a[rest], b[rest], short)
        for part, low, high in ((rest[~beyond], 0, short), (rest[beyond], short, most)):
            x, y = a[part], b[part]
            lo, hi = np.full(len(part), low), np.full(len(part), high)
            while len(part) and (hi - lo > 1).any():
                mid = (lo + hi) // 2
                ok = self.same(x, y, mid)
                lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid)
            out[part] = lo
        return out


def suffix_array(text: np.ndarray, depth: int, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order to ``depth`` symbols, and each one's common prefix with the one before, capped at ``depth``.

    ``text``: small non-negative symbols; the last is the only one of its kind and the least. Suffixes equal to that depth
    are neighbours in any order.
    """
    space = Workspace(in_memory)
    try:
        held = space.array(len(text), np.uint16)
        held[:] = text
        kinds, runs = types(text), run_lengths(text)
        star = np.flatnonzero(kinds[1:] & ~kinds[:-1]) + 1
        if len(star) > 1:
            # substrings from each S* suffix to the next, sorted by a first induction, then named
            by_head = star[np.argsort(held[star], kind="stable")]
            first = induce(held, kinds, _by_symbol(held, by_head, np.zeros(len(by_head), np.int32)), space, depth, runs, False)
            is_star = np.zeros(len(text), bool)
            is_star[star] = True
            order = np.concatenate([np.concatenate([v[0], v[2]]) for _, v in sorted(first.items())])
            order = order[is_star[order]]
            prints = Prints(held)
            stop = np.full(len(text), len(text), np.int64)
            stop[star[:-1]] = star[1:] + 1
            same = (prints.of(order[1:], stop[order[1:]]) == prints.of(order[:-1], stop[order[:-1]])) & (stop[order[1:]] - order[1:] == stop[order[:-1]] - order[:-1])
            name = np.empty(len(text), np.int64)
            name[order] = np.concatenate([[0], np.cumsum(~same)])
            # an S* substring has two symbols at least besides the one it shares
            order = star[sort_names(name[star], depth // 2 + 2)] if same.any() else order
            values = np.concatenate([[0], prints.common(order[:-1], order[1:], depth)]).astype(np.int32)
        else:
            order, values = star, np.zeros(len(star), np.int32)
        final = induce(held, kinds, _by_symbol(held, order, values), space, depth, runs)
        suffixes, prefixes = [], []
        for _, (large, lv, small, sv) in sorted(final.items()):
            lv, sv = lv.copy(), sv.copy()
            if len(large):
                lv[0] = 0
            if len(small):
                sv[0] = min(runs[large[-1]], runs[small[0]]) if len(large) else 0
            suffixes += [large, small]
            prefixes += [lv, sv]
        return np.concatenate(suffixes), np.minimum(np.concatenate(prefixes), depth)
    finally:
        space.close()


def _compare(length: int):
    def kernel(batches):
        for rows in shards(batches, SHARD):
            # symbols: 0 ends the text, 1 parts segments, bytes follow
            sizes = np.array([len(r[5]) for r in rows])
            first = np.cumsum(sizes + 1) - sizes - 1
            text = np.ones(int(sizes.sum()) + len(rows) + 1, np.uint16)
            text[-1] = 0
            for r, at in zip(rows, first.tolist()):
                text[at : at + len(r[5])] = np.frombuffer(r[5], np.uint8) + np.uint16(2)
            order, prefix = suffix_array(text, length)
            twice = np.flatnonzero(prefix >= length)
            mark = np.zeros(len(text), bool)
            mark[order[twice]] = mark[order[twice - 1]] = True
            out = []
            for r, at in zip(rows, first.tolist()):
                if r[4] == 1:  # segments with copies are removed as wholes
                    out += [(r[1], r[2] + s, c) for s, c in runs_of(mark[at : at + r[3]])]
            if out:
                w, s, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(s, pa.int32()), pa.array(c, pa.int32())], names=["row", "start", "n"])

    return kernel


def _strip(batches):
    for batch in batches:
        out = []
        for body, spans in zip(batch.column("body"), batch.column("spans")):
            data = memoryview(body.as_buffer()) if body.is_valid else memoryview(b"")
            removed, at, digest = merged(spans) if spans.is_valid else [], 0, hashlib.sha256()
            for a, b in removed:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append((len(data), sum(b - a for a, b in removed), len(removed), digest.hexdigest(), [{"start": a, "stop": b} for a, b in removed]))
        n, gone, spans_, sha, ranges = zip(*out) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans_, pa.int64()), pa.array(sha, pa.string()), pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_bytes(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row of ``docs`` (doc_id, text; other columns aren't read).

    ``spans`` are the removed byte ranges. Null texts are empty; texts under ``length`` bytes keep everything. Rows that repeat a
    doc_id, and null ids, are documents of their own, so equal rows remove each other's long strings.
    """
    texts, ids = keyed(docs)
    spans = repeated(texts, "bytes", length, GRAM, _compare(length), first_stays=False, keep=True)
    out = texts.join(spans.hint("merge"), "row", "left").mapInArrow(_strip, "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>")
    out = out.withColumn("doc_id", F.col("row")) if ids is None else out.join(ids, "row")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
