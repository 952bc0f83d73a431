"""Vectorised text kernels: words, word hashes, shingles and windows of many documents at once.

A word is a maximal run of bytes other than space and 0x09-0x0D; its hash is a 64-bit polynomial over
randomised byte values, made by prefix sums, so no Python loop touches a word.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once.
BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        out = np.ones(size, dtype=np.uint64)
        out[1:] = _U(base)
        np.multiply.accumulate(out, out=out)
        _POWERS[base] = have = out
    return have[:n]


def blocks(bodies, limit: int = BLOCK, most: int = 4096):
    """Split a sequence of byte strings into runs of about ``limit`` bytes and at most ``most`` strings: (first index, list)."""
    start, size, run = 0, 0, []
    for i, body in enumerate(bodies):
        if run and (size + len(body) > limit or len(run) == most):
            yield start, run
            start, size, run = i, 0, []
        run.append(body)
        size += len(body)
    if run:
        yield start, run


class Words:
    """Words of several documents: ``start``/``end`` byte offsets in ``data``, ``doc`` indices, 64-bit ``hash``es."""

    def __init__(self, bodies: list[bytes], lower: bool):
        self.data = np.frombuffer(b"\n".join(bodies) + b"\n", dtype=np.uint8)
        lengths = np.fromiter((len(b) + 1 for b in bodies), dtype=np.int64, count=len(bodies))
        self.doc_end = np.cumsum(lengths)
        self.doc_start = self.doc_end - lengths
        word = ~_SPACE[self.data]
        edge = np.diff(word.view(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.doc_end, self.start, side="right")
        value = (_VALUE_LOWER if lower else _VALUE)[self.data]
        value *= powers(_BASE, len(value))
        total = np.empty(len(value) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(value, out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * powers(_INV, len(value))[self.start])
        self.count = np.bincount(self.doc, minlength=len(bodies))
        #: Index of each document's first word.
        self.first = np.cumsum(self.count) - self.count


_STEP = 0xD1342543DE82EF95


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` hashes (len - width + 1 of them), order-sensitive."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= _U(_STEP)
        out += hashes[k : k + n]
    return mix(out)


def within(words_doc: np.ndarray, width: int) -> np.ndarray:
    """For each of the len - width + 1 windows, whether it stays in one document."""
    n = len(words_doc) - width + 1
    return words_doc[:n] == words_doc[width - 1 :] if n > 0 else np.empty(0, dtype=bool)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out
