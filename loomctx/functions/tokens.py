"""Exact token counts: byte-pair merges by a table of ranks, once for each distinct piece that a task meets.

A text is cut into pieces by the encoding's pattern; in a piece the neighbours whose joined bytes have the least rank are merged, of equals the first,
until no joined pair has a rank. A heap of pairs over a linked list takes n log n steps for n bytes, so one line of a megabyte is no trouble. The ranks
come from a file of lines "base64 rank"; a byte without a rank stays a token of its own.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the split pattern of the widely used byte-level encodings.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranks that a file may hold; they are sent to every executor.
MOST_RANKS = 1_000_000
#: Pieces whose counts a task remembers, and the bytes of the longest of them.
REMEMBERED, SHORT = 200_000, 64


def read_ranks(spark: SparkSession, path: str, most: int = MOST_RANKS) -> dict[bytes, int]:
    """Bytes to rank; a file of more than ``most`` lines, or with a line that is none, is an error."""
    rows = spark.read.text(path).where("value != ''").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} ranks in {path}")
    out = {}
    for row in rows:
        token, _, rank = row["value"].partition(" ")
        out[base64.b64decode(token, validate=True)] = int(rank)
    return out


def fingerprint(ranks: dict[bytes, int]) -> str:
    """What tells one table of ranks from another."""
    return hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()


def pair_merges(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of one piece."""
    n = len(piece)
    if piece in ranks or n < 2:
        return [piece] if n else []
    after, before = list(range(1, n + 2)), list(range(-1, n))
    gone = bytearray(n + 1)
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        """The pair of the part that starts at ``at`` and its right neighbour, if they may be joined."""
        if after[at] < n:
            end = after[after[at]]
            rank = ranks.get(piece[at:end])
            if rank is not None:
                heapq.heappush(heap, (rank, at, end))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, at, end = heapq.heappop(heap)
        # a pair is stale once its left part was swallowed or either part has grown
        if gone[at] or after[at] >= n or after[after[at]] != end:
            continue
        gone[after[at]] = 1
        after[at] = end
        if end < n:
            before[end] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    out, at = [], 0
    while at < n:
        out.append(piece[at : after[at]])
        at = after[at]
    return out


def exact_tokens(spark: SparkSession, text: Column | str, ranks: dict[bytes, int], pattern: str = PATTERN) -> Column:
    """The number of tokens of a text; null and empty texts have none. Ranks are broadcast: ``read_ranks`` bounds them."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, cut, seen = shared.value, regex.compile(pattern), {}

        def tokens(piece: str) -> int:
            n = seen.get(piece)
            if n is None:
                n = len(pair_merges(piece.encode("utf-8", "surrogatepass"), table))
                if len(piece) <= SHORT:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[piece] = n
            return n

        for batch in batches:
            yield pd.Series([sum(map(tokens, cut.findall(t))) if t else 0 for t in batch], dtype="int64")

    return count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
