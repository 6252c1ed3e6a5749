"""Benchmark decontamination by SimHash of item-sized windows.

For every benchmark item, the windows of a text that have as many words as the
item are fingerprinted: each window's 5-word shingles, weighted by their
counts, vote on 128 bits.  An index of 8 blocks of 16 bits finds all items of
that size within 32 bits: of 32 differing bits at most 4 can fall in some
block, and the index holds every value within 4 bits of an item's block.  Found pairs are
verified by the exact similarity of weighted shingles, the sum of smaller
counts over the sum of larger counts, which must reach 0.8.

A text that is shorter than an item, but long enough to reach the similarity,
is one window as a whole.

Windows that hold too few shingles of any item to reach that similarity are
skipped before they are fingerprinted, which loses nothing.  At a similarity
of exactly 0.8 a window's fingerprint lies beyond the radius with a
probability of about 0.001, and less above.

Words are runs of letters, digits and other characters beyond ASCII, with A-Z
in lower case, so punctuation and markup around words don't hide a passage.

Defined cases: null and empty texts match nothing; items with less than five
words are no evidence and match nothing; a passage that occurs repeatedly is
reported once per document and item, at its best and first window; null
item texts are skipped; repeated documents are each reported, with a null doc_id
too; very long texts are read in overlapping parts.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, row_slices, shingles, split, text_bytes

K = 5
THRESHOLD = 0.8
WORDS64 = 2
RADIUS = 32
BLOCKS = 8
NEAR = RADIUS // BLOCKS
#: Up to so many items of a size their blocks are compared at once, beyond by tables.
DIRECT = 64
#: Items in one index; more items are taken in blocks, each a pass over the texts.
BLOCK_ITEMS = 1000
#: Shingles of a text whose votes are summed at once.
REGION = 1 << 13

MATCH = "doc_id long, item_id long, similarity double, start_word long, n_words long"

_masks = np.array([sum(1 << b for b in c) for n in range(NEAR + 1) for c in combinations(range(16), n)], dtype=np.uint16)


def _votes(sh: np.ndarray) -> np.ndarray:
    """One row of 128 votes, +1 or -1, for each shingle."""
    bits = np.stack([mix(sh + np.uint64(i * 0x632BE59BD9B4E019 & (1 << 64) - 1)) for i in range(WORDS64)], axis=1)
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _prints(total: np.ndarray) -> np.ndarray:
    """Fingerprints of summed votes as 8 numbers of 16 bits."""
    return np.packbits(total > 0, axis=1).view(np.uint16)


class Index:
    """Fingerprints, shingle counts and block tables of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        words = split(*text_bytes(pa.array([t for _, t in items], pa.string())), bare=True)
        sh, row = shingles(words, words.hashes(), K)
        n = words.counts()
        at = np.searchsorted(row, np.arange(len(items) + 1))
        self.ids = [i for i, _ in items]
        self.counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.by_size: dict[int, list[int]] = {}
        prints = []
        for i in range(len(items)):
            own = sh[at[i] : at[i + 1]]
            if n[i] < K:
                prints.append(np.zeros(BLOCKS, np.uint16))
                continue
            self.counts[i] = np.unique(own, return_counts=True)
            self.by_size.setdefault(len(own), []).append(i)
            prints.append(_prints(_votes(own).sum(axis=0, dtype=np.int32)[None])[0])
        self.prints = np.array(prints, dtype=np.uint16).reshape(-1, BLOCKS)
        self.known = np.unique(np.concatenate([c[0] for c in self.counts.values()] or [np.zeros(0, np.uint64)]))
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[self.known >> np.uint64(42)] = True
        self.tables: dict[int, list] = {}

    def table(self, size: int) -> list:
        """For each block: values near an item's, sorted, and their items."""
        if size not in self.tables:
            own = np.array(self.by_size[size])
            out = []
            for b in range(BLOCKS):
                values = (self.prints[own, b][:, None] ^ _masks[None, :]).ravel()
                order = np.argsort(values, kind="stable")
                out.append((np.searchsorted(values[order], np.arange(65537)).astype(np.int32), np.repeat(own, len(_masks)).astype(np.int32)[order]))
            self.tables[size] = out
        return self.tables[size]

    def near(self, prints: np.ndarray, size: int) -> list[tuple[int, int]]:
        """(window, item) of all fingerprints within the radius."""
        if len(self.by_size[size]) <= DIRECT:
            own = np.array(self.by_size[size])
            apart = np.bitwise_count(prints[:, None, :] ^ self.prints[own][None])
            window, item = np.nonzero((apart.min(axis=2) <= NEAR) & (apart.sum(axis=2) <= RADIUS))
            return list(zip(window.tolist(), own[item].tolist()))
        found: set[tuple[int, int]] = set()
        for b, (first, items) in enumerate(self.table(size)):
            value = prints[:, b].astype(np.int64)
            for w in np.flatnonzero(first[value + 1] > first[value]).tolist():
                for i in set(items[first[value[w]] : first[value[w] + 1]].tolist()):
                    found.add((w, i))
        return [(w, i) for w, i in sorted(found) if int(np.bitwise_count(prints[w] ^ self.prints[i]).sum()) <= RADIUS]

    def verify(self, own: np.ndarray, item: int) -> float:
        values, count = np.unique(own, return_counts=True)
        theirs, n = self.counts[item]
        where = np.minimum(np.searchsorted(theirs, values), len(theirs) - 1)
        same = theirs[where] == values
        common = int(np.minimum(count[same], n[where[same]]).sum())
        return common / (len(own) + int(n.sum()) - common)

    def matches(self, column: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) in a column of texts."""
        if not self.by_size:
            return []
        words = split(*text_bytes(column), bare=True)
        sh, row = shingles(words, words.hashes(), K)
        hit = self.maybe[sh >> np.uint64(42)]
        if not hit.any():
            return []
        at = np.flatnonzero(hit)
        where = np.minimum(np.searchsorted(self.known, sh[at]), len(self.known) - 1)
        hit[at] = self.known[where] == sh[at]
        reach = max(self.by_size)
        begins = np.searchsorted(row, np.arange(len(column) + 1))
        out = []
        for r in np.unique(row[np.flatnonzero(hit)]).tolist():
            lo, hi = begins[r], begins[r + 1]
            best: dict[int, tuple[float, int, int]] = {}
            spots = np.flatnonzero(hit[lo:hi])
            cuts = np.flatnonzero(np.diff(spots) > reach)
            for a, b in zip(spots[np.concatenate([[0], cuts + 1])].tolist(), spots[np.concatenate([cuts, [len(spots) - 1]])].tolist()):
                begin, end = max(0, a - reach), min(hi - lo, b + reach + 1)
                for step in range(begin, end, REGION):  # parts overlap by a window, so every window lies in one of them
                    self._region(sh[lo:hi], hit[lo:hi], step, min(end, step + REGION + reach), hi - lo, best)
            out += [(r, i, s, p, len_ + K - 1) for i, (s, p, len_) in sorted(best.items())]
        return out

    def _region(self, sh: np.ndarray, hit: np.ndarray, lo: int, hi: int, whole: int, best: dict) -> None:
        part = sh[lo:hi]
        held = np.concatenate([[0], np.cumsum(hit[lo:hi])])
        votes = None
        for size in self.by_size:
            n, need = min(size, len(part)), math.ceil(THRESHOLD * size - 1e-9)
            if n < need or n < size and n < whole:  # a region is shorter than the item only where the text is
                continue
            starts = np.flatnonzero(held[n:] - held[:-n] >= need)
            if not len(starts):
                continue
            if votes is None:
                votes = np.zeros((len(part) + 1, 64 * WORDS64), np.int32)
                np.cumsum(_votes(part), axis=0, out=votes[1:])
            for w, item in self.near(_prints(votes[starts + n] - votes[starts]), size):
                p = int(starts[w])
                s = self.verify(part[p : p + n], item)
                if s >= THRESHOLD - 1e-9 and (item not in best or s > best[item][0] + 1e-12):
                    best[item] = (s, lo + p, n)


_indexes: dict[str, Index] = {}


def _blocks(items: DataFrame) -> list:
    """Items in blocks of bounded size, each broadcast once."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null").orderBy("item_id", "text")
    blocks, held = [], []
    for r in rows.toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == BLOCK_ITEMS:
            blocks.append(spark.sparkContext.broadcast(held))
            held = []
    return [*blocks, spark.sparkContext.broadcast(held)] if held else blocks


def _index(items) -> Index:
    """The worker's index of a broadcast block, made once."""
    key = repr(hash(tuple(items.value)))
    if key not in _indexes:
        if len(_indexes) > 3:
            _indexes.clear()
        _indexes[key] = Index(items.value)
    return _indexes[key]


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word and n_words of every match."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], MATCH)
    for block in _blocks(items):

        def run(batches, block=block):
            index = _index(block)
            for batch in batches:
                for lo, n in row_slices(batch.column(1)):
                    part = batch.slice(lo, n)
                    found = index.matches(part.column(1))
                    if found:
                        rows, item, s, start, size = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(rows)), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(s, pa.float64()), pa.array(start, pa.int64()), pa.array(size, pa.int64())],
                            names=["doc_id", "item_id", "similarity", "start_word", "n_words"],
                        )

        out = out.unionByName(source.mapInArrow(run, MATCH))
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that match an item; nothing is shuffled."""
    for block in _blocks(items):
        at = docs.columns.index("text")

        def run(batches, block=block, at=at):
            index = _index(block)
            for batch in batches:
                for lo, n in row_slices(batch.column(at)):
                    part = batch.slice(lo, n)
                    keep = np.ones(n, dtype=bool)
                    keep[[m[0] for m in index.matches(part.column(at))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
