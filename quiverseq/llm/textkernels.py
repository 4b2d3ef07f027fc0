"""NumPy kernels over whole batches of texts: words, word hashes, shingles. No Spark here.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lower-cased. All bytes of non-ASCII characters are
0x80 or more, so working on UTF-8 bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multiplier of the rolling word hash; its inverse modulo 2**64 exists because it is odd.
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or one row if that alone is longer."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection that spreads every bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), BASE if kind == "up" else INVERSE, U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if n <= 1 << 23:
            _powers[kind] = have
    return have[:n]


class Words:
    """The words of rows: start and end (byte positions), row, and hash (64 bits, of the lower-cased bytes)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~SPACE[data]
        n = len(data)
        first = inside.copy()
        first[1:] &= SPACE[data[:-1]]
        last = inside.copy()
        last[:-1] &= SPACE[data[1:]]
        edges = offsets[:-1][(offsets[1:] > offsets[:-1])]
        first[edges] = inside[edges]
        ends = offsets[1:][(offsets[1:] > offsets[:-1])] - 1
        last[ends] = inside[ends]
        self.rows = len(offsets) - 1
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.firsts = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.firsts)
        self.row = np.repeat(np.arange(self.rows), self.counts)
        self.data = LOWER[data]
        sums = np.zeros(n + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * _power("up", n), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _power("down", n + 1)[self.start] + (self.end - self.start).astype(U)) if n else np.zeros(0, U)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), in row order, of all runs of k words; a row with fewer words, but some, gives its whole sequence."""
    m = len(words.hash)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, U)
    n = max(m - k + 1, 0)
    h = np.zeros(n, U)
    for j in range(k if n else 0):
        h = mix(h + words.hash[j : n + j] + U(j + 1))
    full = words.row[:n] == words.row[k - 1 :] if n else np.zeros(0, bool)
    row, h = words.row[:n][full], h[full]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        own = np.zeros(len(short), U)
        for j in range(k - 1):
            has = words.counts[short] > j
            own[has] = mix(own[has] + words.hash[words.firsts[short[has]] + j] + U(j + 1))
        row, h = np.concatenate([row, short]), np.concatenate([h, mix(own ^ (U(0xA5A5A5A5A5A5A5A5) + words.counts[short].astype(U)))])
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return row, h


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row then hash; row is sorted."""
    h = h.copy()
    edges = np.flatnonzero(np.diff(row, prepend=-1, append=-2)) if len(row) else np.zeros(0, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


def row_sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums modulo 2**64 of values by row; row is sorted."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    edge = np.searchsorted(row, np.arange(rows + 1))
    return sums[edge[1:]] - sums[edge[:-1]]


def lists(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """An Arrow list per row of the values; row is sorted."""
    edge = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(values, kind))
