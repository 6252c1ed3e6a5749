"""Vectorised words, word hashes and shingles of Arrow string columns.

Words are runs of anything but space and the characters 09 to 0D.  All work
is done on the UTF-8 bytes of a whole batch at once; no Python loop runs per
word.  Null texts count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: A random odd base of the polynomial hash and the constants
#: of the 64-bit finaliser of SplitMix64.
BASE = 0x9E6C63D0876A9A47
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)

SPAN = 1 << 20

_space = np.zeros(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def odd(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers derived from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SPAN + 1)
        ups = np.full(size, BASE, dtype=np.uint64)
        ups[0] = 1
        downs = np.full(size, pow(BASE, -1, 1 << 64), dtype=np.uint64)
        downs[0] = 1
        _powers[:] = [np.cumprod(ups), np.cumprod(downs)]
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after another, and ``rows + 1`` offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: where each begins and ends in ``data``, the row it
    belongs to, and for each row the index of its first word (rows + 1)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if len(self.starts) > 1 and (self.starts[1:] < self.starts[:-1]).any():
            order = np.argsort(self.starts, kind="stable")
            ordered = np.empty(len(order), dtype=np.uint64)
            ordered[order] = Words(self.data, self.starts[order], self.ends[order], self.row, self.first).hashes()
            return ordered
        out = np.empty(len(self.starts), dtype=np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + SPAN, side="right")))
            lo = int(self.starts[i])
            part = self.data[lo : int(self.ends[j - 1])]
            ups, downs = _power_tables(len(part) + 1)
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * ups[: len(part)], out=total[1:])
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = (total[e] - total[s]) * downs[s] + (e - s).astype(np.uint64) * MIX1
            i = j
        return mix(out)


#: A-Z become a-z, and ASCII other than letters and digits becomes space.
_bare = _lower.copy()
_bare[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = True, bare: bool = False) -> Words:
    """Words of every row; ``lower`` maps A-Z to a-z first.  With ``bare``,
    punctuation of ASCII separates words as well and is no part of them."""
    if bare:
        data = _bare[data]
    elif lower:
        data = _lower[data]
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~_space[data]
    begins = inside[1:-1] & ~inside[:-2]
    finishes = inside[1:-1] & ~inside[2:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    edge = np.unique(edge)
    begins[edge] |= inside[1:-1][edge]
    finishes[edge - 1] |= inside[1:-1][edge - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    first = np.searchsorted(starts, offsets, side="left")
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, starts, ends, row, first)


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and the row of each, in row order.

    A row of one to ``k - 1`` words gives one shingle of its whole sequence;
    a row without words gives none.
    """
    scale = odd(k, 11)
    n = words.counts()
    out_row, out = [], []
    if len(hashes) >= k:
        total = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
        for j in range(k):
            total += hashes[j : len(hashes) - k + 1 + j] * scale[j]
        whole = words.row[: len(total)] == words.row[k - 1 :]
        out.append(mix(total[whole] + np.uint64(k)))
        out_row.append(words.row[: len(total)][whole])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        total = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = n[short] > j
            total[has] += hashes[words.first[short[has]] + j] * scale[j]
        out.append(mix(total + n[short].astype(np.uint64)))
        out_row.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sh, row = np.concatenate(out), np.concatenate(out_row)
    if len(out) > 1:
        order = np.argsort(row, kind="stable")
        sh, row = sh[order], row[order]
    return sh, row


def distinct(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, sorted within the row."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], r[keep]


def row_slices(column: pa.Array, limit: int = 1 << 21):
    """(start, length) of runs of rows whose texts have about ``limit`` bytes."""
    _, offsets = text_bytes(column)
    start, n = 0, len(column)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield start, min(stop, n) - start
        start = stop
