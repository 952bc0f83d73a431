"""Repeated word windows by prefix-partitioned suffix trees.

A shard's suffixes (one for each window start of its segments) are dealt to groups by variable-length prefixes: one word
where that gives at most ``group`` suffixes, else one word more, and so on. Each group's subtree is built top-down, all its nodes of one
depth at once: a node's children are its suffixes parted by their next words, and suffixes alone in a node are leaves
that need no further work. Internal nodes at the depth of a window are maximal in number of words that matter here: the suffixes below one are the
occurrences of one window, of which all but the earliest (smaller doc_id, then smaller start) are marked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomctx.llm.segments import keyed, merged, repeated, runs_of, shards
from loomctx.llm.textkernel import mix, windows

_U = np.uint64
GRAM = 4
SHARD = 8 << 20


def _parted(order: np.ndarray, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part every node by ``key``; drops suffixes left alone. Returns the suffixes and their new nodes, numbered from 0."""
    both = mix(key + node.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    by = np.argsort(both, kind="stable")
    order, both = order[by], both[by]
    first = np.concatenate([[True], both[1:] != both[:-1]]) if len(both) else np.empty(0, bool)
    number = np.cumsum(first) - 1
    alone = np.bincount(number, minlength=number[-1] + 1 if len(number) else 0) == 1
    keep = ~alone[number]
    return order[keep], np.unique(number[keep], return_inverse=True)[1] if keep.any() else number[keep]


def prefix_groups(hashes: np.ndarray, suffixes: np.ndarray, depth: int, group: int):
    """Groups of suffixes by variable-length prefixes: (suffixes, prefix length). Groups of one are dropped."""
    stack = [(suffixes, 0)]
    while stack:
        part, known = stack.pop()
        if len(part) < 2:
            continue
        if known and (len(part) <= group or known == depth):
            yield part, known
            continue
        key = hashes[part + known]
        by = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], key[by][1:] != key[by][:-1]]))
        parts = np.split(part[by], cuts[1:])
        small: list[np.ndarray] = []
        size = 0
        for p in parts:
            if len(p) > group:
                stack.append((p, known + 1))
            elif len(p) > 1:
                # small prefixes share a memory-sized group; they part again at its roots
                small.append(p)
                size += len(p)
                if size >= group:
                    yield np.concatenate(small), known
                    small, size = [], 0
        if small:
            yield np.concatenate(small), known


def repeats(hashes: np.ndarray, suffixes: np.ndarray, depth: int, group: int = 1 << 18):
    """Deep internal nodes: (suffixes, node of each) for suffixes whose first ``depth`` words occur more than once."""
    steps = [1, 2, 4, 8, 16]
    known = {w: windows(hashes, w) if w > 1 else hashes for w in steps}
    for part, start in prefix_groups(hashes, suffixes, depth, group):
        order, node, at = part, np.zeros(len(part), np.int64), 0
        while at < depth and len(order):
            step = next(w for w in reversed(steps) if w <= depth - at and (w <= max(1, at)))
            order, node = _parted(order, node, known[step][order + at])
            at += step
        if len(order):
            yield order, node


def _compare(length: int):
    def kernel(batches):
        for rows in shards(batches, SHARD):
            parts = [np.frombuffer(r[5], np.uint64) for r in rows]
            sizes = np.array([len(p) for p in parts])
            first = np.cumsum(sizes) - sizes
            hashes = np.concatenate(parts)
            n = np.array([r[3] for r in rows])
            which = np.repeat(np.arange(len(rows)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            # suffixes in the order of (document, start), so the first of a node is the earliest occurrence
            row, start = np.array([r[1] for r in rows])[which], np.array([r[2] for r in rows])[which] + offset
            rank = np.lexsort((start, row))
            place = np.empty(len(hashes), np.int64)
            place[(first[which] + offset)[rank]] = np.arange(len(rank))
            mark = np.zeros(len(hashes), bool)
            for order, node in repeats(hashes, first[which] + offset, length):
                by = np.lexsort((place[order], node))
                order, node = order[by], node[by]
                head = np.concatenate([[True], node[1:] != node[:-1]])
                # a window found in two segments at one place is one occurrence
                same = row[rank[place[order]]], start[rank[place[order]]]
                leader = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
                mark[order[(same[0] != same[0][leader]) | (same[1] != same[1][leader])]] = True
            out = [(rows[k][1], rows[k][2] + s, c) for k in range(len(rows)) for s, c in runs_of(mark[first[k] : first[k] + n[k]])]
            if out:
                r, s, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(s, pa.int32()), pa.array(c, pa.int32())], names=["row", "start", "n"])

    return kernel


def _strip(batches):
    for batch in batches:
        out = []
        for body, spans in zip(batch.column("body"), batch.column("spans")):
            words, at, kept = (body.as_py() or b"").split(), 0, []
            removed = merged(spans) if spans.is_valid else []
            for a, b in removed:
                kept += words[at:a]
                at = b
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, gone, digest = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), batch.column("spans")], names=["row", "n_words", "n_removed", "kept_sha256", "spans"])


def repeated_words(docs: DataFrame, length: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for each row of ``docs`` (doc_id, text; other columns aren't read).

    ``spans`` are the ranges of words covered by windows that start earlier too, as found (null without any). Null and empty texts have no words.
    Rows that repeat a doc_id, and null ids (last), are documents of their own in the order of their texts' hash.
    """
    texts, ids = keyed(docs)
    spans = repeated(texts, "words", length, GRAM, _compare(length), first_stays=True, keep=False)
    out = texts.join(spans, "row", "left").mapInArrow(_strip, "row long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,stop:int>>")
    out = out.withColumn("doc_id", F.col("row")) if ids is None else out.join(ids, "row")
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")
