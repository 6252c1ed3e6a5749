"""Language-model scores from a hierarchical Pitman-Yor model.

Restaurants, from the leaves up: one for each preceding word (or the start of a
text) that training saw; the word restaurant, their common parent; and the
spelling of words, a hierarchy over bytes whose restaurants for the last three
byte classes share those for two, for one and for none as parents, down to the
uniform distribution.  A table of a word after another is a customer of the
word restaurant, and a table there one of the spelling.

Seating is sampled by Gibbs sweeps: all customers of a dish in a restaurant
leave, and its new number of tables is drawn from its exact conditional
distribution (generalised Stirling numbers) given the tables of all other dishes
and the parent's probabilities.  Dishes of a sweep are drawn at once, given the
last sweep's totals, and more than ``EXACT`` customers of one dish are seated
one after another in batches of an eighth of what already sits; these are
approximations.  Spelling probabilities are averaged over sweeps, and the
predictive probabilities of words over several seatings.

Words that training never saw count as one further type, as in the base
score; it has what the spelling leaves beyond all known words.

How it runs: texts are coded once, in blocks of some megabytes, as indexes into
the block's distinct words.  Word buckets (by hash) count all words and number
them; a block then sends its distinct pairs of words, as numbers, to pair
buckets, which merge them.  A bucket holds whole contexts; a context with more
tokens than a bucket should have is dealt over all buckets by the
following word, and only these contexts' table totals, one number each and at most
as many as there are buckets, meet on the driver.  In a sweep a pair bucket sends
its tables of each word to the word buckets and gets the words' probabilities
back.  At last blocks get the probabilities of their pairs in the order in which
they asked, and sum them by document.  All arrays travel as compressed columns of
bytes, so a pair of words takes a few bytes wherever it goes.

Defined cases: null and empty texts have one token, the end; repeated rows
count as often as they occur; without any training document every token is unseen
and has a probability of 1; a null doc_id is not held out; a very long text is a
block of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, partitions
from .words import Words, mix, row_slices, split, text_bytes

#: Byte classes as contexts: a-z, digits, other ASCII, three of UTF-8 parts, word start.
CLASSES = 32
EDGE = 31
#: Symbols that spell words: 256 bytes, end of word, end of text.
SYMBOLS, END_WORD, END_TEXT = 258, 256, 257

#: Discounts and strengths.
WORD_D, WORD_S = 0.75, 50.0
CONTEXT_D, CONTEXT_S = 0.8, 10.0
SPELL_D, SPELL_S = (0.3, 0.4, 0.5, 0.6), 1.0
#: Sweeps after the start from one table a dish; seatings that are averaged at the end.
SWEEPS = 2
SPELL_SWEEPS = 6
SEATINGS = 3
#: Customers of a dish up to which tables are drawn exactly.
EXACT = 128
#: Bytes of text that a block codes, and that a bucket stands for.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20

#: The word number of the start of a text; words follow from 1.
START = 0

_class = np.full(256, 27, dtype=np.int64)
_class[97:123] = np.arange(26)
_class[48:58] = 26
_class[0x80:0xA0], _class[0xA0:0xC0], _class[0xC0:] = 28, 29, 30


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed columns of bytes, the lowest first."""
    import zstandard

    v = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    import zstandard

    columns = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((columns.shape[1], 8), np.uint8)
    out[:, : raw[0]] = columns.T
    return out.view("<i8").ravel()


def pack_rising(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_rising(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))


def pack_words(words: Words, order: np.ndarray) -> tuple[bytes, bytes]:
    """Bytes of words one after another, compressed, and their sizes."""
    import zstandard

    sizes = (words.ends - words.starts)[order]
    ends = np.cumsum(sizes)
    at = np.repeat(words.starts[order] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    return zstandard.compress(words.data[at].tobytes(), 1), pack(sizes)


def unpack_words(raw: list[bytes], sizes: list[bytes]) -> Words:
    import zstandard

    data = np.frombuffer(b"".join(zstandard.decompress(r) for r in raw), np.uint8)
    size = np.concatenate([unpack(x) for x in sizes])
    ends = np.cumsum(size)
    return Words(data, ends - size, ends, np.arange(len(size)), np.arange(len(size) + 1))


def seat(count: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``count`` customers each; a customer opens a
    table with weight ``pull`` against the customers seated less the discounts."""
    tables = np.minimum(count, 1).astype(np.int64)
    seated, live = 1, np.flatnonzero(count > 1)
    while len(live):
        step = max(1, seated // 8)
        n, a, t = np.minimum(step, count[live] - seated), pull[live], tables[live]
        tables[live] = t + rng.binomial(n, a / (a + np.maximum(seated - discount * t, 1e-9)))
        seated += step
        live = live[count[live] > seated]
    return tables


_stirling: dict[float, np.ndarray] = {}


def log_stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers, by customers and tables up to ``EXACT``."""
    if discount not in _stirling:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[1, 1] = 0.0
        for n in range(1, EXACT):
            t = np.arange(1, n + 1)
            out[n + 1, 1 : n + 1] = out[n, 1 : n + 1] + np.log(n - t * discount)
            out[n + 1, 1:] = np.logaddexp(out[n + 1, 1:], out[n, :-1])
        _stirling[discount] = out
    return _stirling[discount]


def tables_of(count: np.ndarray, chance: np.ndarray, others: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``count`` customers each, drawn given the parent's
    probability of the dish and the restaurant's tables of other dishes."""
    tables = np.minimum(count, 1).astype(np.int64)
    big = np.flatnonzero(count > EXACT)
    if len(big):
        tables[big] = seat(count[big], (strength + discount * others[big]) * chance[big], discount, rng)
    small = np.flatnonzero((count > 1) & (count <= EXACT))
    small = small[np.argsort(count[small], kind="stable")]
    ns, first = np.unique(count[small], return_index=True)
    ways = log_stirling(discount)
    for n, lo, hi in zip(ns.tolist(), first.tolist(), [*first[1:].tolist(), len(small)]):
        step = max(1, (1 << 19) // n)
        for a in range(lo, hi, step):
            at = small[a : min(hi, a + step)]
            i = np.arange(n)
            w = np.cumsum(np.log(strength + discount * (others[at][:, None] + i)) + np.log(chance[at])[:, None], axis=1) + ways[n, 1 : n + 1]
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + (rng.random(len(at))[:, None] * w[:, -1:] > w).sum(axis=1)
    return tables


def spell_cells(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(cell, word) of each symbol that spells the words; a cell is the
    context of three classes and the symbol."""
    length = words.ends - words.starts
    total = length + 1
    word = np.repeat(np.arange(len(length)), total)
    begin = np.cumsum(total) - total
    inner = np.arange(len(word)) - begin[word]
    at = np.minimum(words.starts[word] + inner, max(len(words.data) - 1, 0))
    symbol = np.where(inner < length[word], words.data[at] if len(words.data) else 0, np.where(length[word] == 0, END_TEXT, END_WORD)).astype(np.int64)
    kind = np.where(inner < length[word], _class[np.minimum(symbol, 255)], EDGE)
    context = np.zeros(len(word), dtype=np.int64)
    for back in (3, 2, 1):
        before = np.full(len(word), EDGE, dtype=np.int64)
        has = inner >= back
        before[has] = kind[np.flatnonzero(has) - back]
        context = context * CLASSES + before
    return context * SYMBOLS + symbol, word


class Spelling:
    """Probabilities of symbols after three byte classes.

    Only contexts that were seen have a row of their own; others share the
    row of the longest part of them that was.
    """

    def __init__(self, table: np.ndarray | None = None, row_of: np.ndarray | None = None):
        self.table = np.full((1, SYMBOLS), 1 / SYMBOLS, dtype=np.float32) if table is None else table
        self.row_of = np.zeros(CLASSES**3, dtype=np.int32) if row_of is None else row_of

    def words(self, words: Words) -> np.ndarray:
        """Probability of each word's spelling."""
        cells, word = spell_cells(words)
        chance = self.table[self.row_of[cells // SYMBOLS], cells % SYMBOLS]
        return np.exp(np.bincount(word, weights=np.log(chance), minlength=len(words.starts)))

    @classmethod
    def sample(cls, cells: np.ndarray, counts: np.ndarray, seed: int) -> Spelling:
        """Gibbs sweeps over the byte restaurants; averaged probabilities."""
        rng = np.random.default_rng(seed)
        levels = [(np.asarray(cells, np.int64), np.asarray(counts, np.int64))]
        sizes = [CLASSES ** (3 - i) for i in range(4)]
        tables = [np.full(n * SYMBOLS, 1 / SYMBOLS, np.float32) for n in sizes]
        opened = [np.ones(n) for n in sizes]
        mean, row_of = np.zeros((0, SYMBOLS), np.float32), np.zeros(CLASSES**3, np.int32)
        for sweep in range(SPELL_SWEEPS):
            at, n = levels[0]
            state = []
            for i, size in enumerate(sizes):  # from the leaves up: seat, tables are the parent's customers
                d = SPELL_D[3 - i]
                context, symbol = at // SYMBOLS, at % SYMBOLS
                up = (context % (size // CLASSES)) if i < 3 else np.zeros_like(context)
                base = tables[i + 1][up * SYMBOLS + symbol] if i < 3 else np.full(len(at), 1 / SYMBOLS)
                t = seat(n, (SPELL_S + d * opened[i][context]) * base, d, rng)
                opened[i] = np.bincount(context, weights=t, minlength=size)
                state.append((at, n, t, np.bincount(context, weights=n, minlength=size)))
                if i < 3:
                    at, where = np.unique(up * SYMBOLS + symbol, return_inverse=True)
                    n = np.bincount(where, weights=t, minlength=len(at)).astype(np.int64)
            for i in (3, 2, 1, 0):  # from the root down: predictive probabilities
                at, n, t, seated = state[i]
                d = SPELL_D[3 - i]
                scale = ((SPELL_S + d * opened[i]) / (SPELL_S + seated)).astype(np.float32)
                if i < 3:
                    parent = tables[i + 1].reshape(-1, SYMBOLS)
                    p = tables[i].reshape(CLASSES, -1, SYMBOLS)
                    np.multiply(scale.reshape(CLASSES, -1)[:, :, None], parent[None], out=p)
                else:
                    tables[i][:] = scale[0] / SYMBOLS
                tables[i][at] += ((n - d * t) / (SPELL_S + seated[at // SYMBOLS])).astype(np.float32)
            if sweep >= SPELL_SWEEPS // 2:
                seen = [np.unique(state[i][0] // SYMBOLS) for i in range(3)] + [np.zeros(1, np.int64)]
                rows = np.concatenate([tables[i].reshape(-1, SYMBOLS)[c] for i, c in enumerate(seen)])
                mean = rows if not len(mean) else mean + rows
        first = np.cumsum([0, *[len(c) for c in seen]])
        row_of[:] = first[3]
        for i in (2, 1, 0):  # longer contexts take over from shorter ones
            own = np.full(sizes[i], -1, np.int32)
            own[seen[i]] = first[i] + np.arange(len(seen[i]))
            own = own[np.arange(CLASSES**3) % sizes[i]]
            row_of = np.where(own >= 0, own, row_of)
        return cls(mean / (SPELL_SWEEPS - SPELL_SWEEPS // 2), row_of)


def _word_table(column: pa.Array) -> Words:
    """Each row of a column as one word (empty: the end of a text)."""
    data, offsets = text_bytes(column)
    return Words(data, offsets[:-1], offsets[1:], np.arange(len(column)), np.arange(len(column) + 1))


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    """Rows as a table of a schema of longs, binaries and arrays."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    names, types = zip(*[c.split() for c in schema.split(", ")])
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=names)


def _parts(table: pa.Table, by: str) -> list[dict]:
    """The rows of a group in a fixed order."""
    return sorted(table.to_pylist(), key=lambda r: (r[by] is not None, r[by]))


CODED = "block long, ids array<long>, held binary, sizes binary, codes binary, place binary, words binary, word_sizes binary, counts binary"


def _code(buckets: int):
    """Code texts block by block; words are numbered by falling count, ``place`` is each word's bucket."""

    def block(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        words = split(*text_bytes(table["text"]))
        ends = words.first[1:]
        h = np.insert(words.hashes(), ends, 0)
        index = np.insert(np.arange(len(words.starts)), ends, -1)
        own, first, which, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        code = np.empty(len(own), np.int64)
        code[order] = np.arange(len(own))
        codes = code[which]
        sizes = words.counts() + 1
        held = np.array(table["held_out"].to_pylist(), dtype=bool)
        counts = np.bincount(codes[~np.repeat(held, sizes)], minlength=len(own))
        at = index[first][order]  # the end of a text is a word without bytes
        starts, stops = np.append(words.starts, 0)[at], np.append(words.ends, 0)[at]
        raw, lengths = pack_words(Words(words.data, starts, stops, at, at), np.arange(len(at)))
        place = (own[order] % np.uint64(buckets)).astype(np.int64)
        row = (number, table["doc_id"].to_pylist(), pack(held), pack(sizes), pack(codes), pack(place), raw, lengths, pack(counts))
        return _rows(CODED, [row]).to_batches()[0]

    def run(batches):
        number, parts, size = _task() << 32, [], 0
        for batch in batches:
            for lo, n in row_slices(batch.column(2), BLOCK_BYTES):
                part = batch.slice(lo, n)
                if parts and size + part.nbytes > BLOCK_BYTES:
                    yield block(number, parts)
                    number, parts, size = number + 1, [], 0
                parts.append(part)
                size += part.nbytes
        if parts:
            yield block(number, parts)

    return run


ASKED = "bucket long, block long, words binary, word_sizes binary, counts binary"


def _segments(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, first, last + 1) of the runs of a sorted array."""
    own, first = np.unique(keys, return_index=True)
    return list(zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]))


def _ask_words(batches):
    for batch in batches:
        for r in batch.to_pylist():
            words, place, counts = unpack_words([r["words"]], [r["word_sizes"]]), unpack(r["place"]), unpack(r["counts"])
            order = np.argsort(place, kind="stable")
            yield _rows(ASKED, [(b, r["block"], *pack_words(words, order[i:j]), pack(counts[order[i:j]])) for b, i, j in _segments(place[order])]).to_batches()[0]


VOCABULARY = "bucket long, block long, words binary, word_sizes binary, ranks binary, totals binary, tokens long, seen long"


def _merge_words(table: pa.Table) -> pa.Table:
    """A bucket's words by falling total (block is null), and for each block the ranks and totals of those it asked for."""
    parts = _parts(table, "block")
    words = unpack_words([r["words"] for r in parts], [r["word_sizes"] for r in parts])
    counts = [unpack(r["counts"]) for r in parts]
    _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(counts), minlength=len(first)).astype(np.int64)
    order = np.argsort(-total, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    bucket = parts[0]["bucket"]
    out = [(bucket, None, *pack_words(words, first[order]), None, pack(total[order]), int(total.sum()), int((total > 0).sum()))]
    ends = np.cumsum([len(c) for c in counts])
    for r, end, n in zip(parts, ends.tolist(), map(len, counts)):
        own = which[end - n : end]
        out.append((bucket, r["block"], None, None, pack(rank[own]), pack(total[own]), None, None))
    return _rows(VOCABULARY, out)


class Block:
    """A coded block whose words have their numbers: its distinct pairs in the order in which they are asked for."""

    def __init__(self, row: dict, replies: list[dict], buckets: int, texts: int, limit: float):
        self.held, self.sizes, self.ids = unpack(row["held"]) > 0, unpack(row["sizes"]), row["ids"]
        self.codes, place = unpack(row["codes"]), unpack(row["place"])
        v = len(place)
        number, self.total = np.zeros(v + 1, np.int64), np.zeros(v + 1, np.int64)
        for r in replies:
            at = np.flatnonzero(place == r["bucket"])
            number[at], self.total[at] = 1 + unpack(r["ranks"]) * buckets + r["bucket"], unpack(r["totals"])
        number[v], self.total[v] = START, texts
        before = np.full(len(self.codes), v, np.int64)
        before[1:] = self.codes[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = v
        pair, self.which = np.unique(before * v + self.codes, return_inverse=True)
        c, h = pair // max(v, 1), pair % max(v, 1)
        self.c, self.h, self.c_total = number[c], number[h], self.total[c]
        # contexts with more tokens than a bucket should hold are dealt by the following word
        hot = (self.c_total > limit) | (self.c == START)
        key = mix(self.c.astype(np.uint64)) + np.where(hot, mix(self.h.astype(np.uint64)), 0).astype(np.uint64)
        self.bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((self.h, self.c, self.bucket))
        self.segments = _segments(self.bucket[self.order])


ASKED_PAIRS = "bucket long, block long, c binary, runs binary, c_totals binary, h binary, n binary"


def _runs(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values start, and how long they are."""
    first = np.flatnonzero(np.diff(c, prepend=-1))
    return first, np.diff(first, append=len(c))


def _ask_pairs(buckets: int, texts: int, limit: float):
    def run(coded: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in coded.to_pylist():
            b = Block(row, replies.to_pylist(), buckets, texts, limit)
            n = np.bincount(b.which[~np.repeat(b.held, b.sizes)], minlength=len(b.c))
            for bucket, i, j in b.segments:
                at = b.order[i:j]
                first, runs = _runs(b.c[at])
                out.append((bucket, row["block"], pack_rising(b.c[at][first]), pack(runs), pack(b.c_total[at][first]), pack(b.h[at]), pack(n[at])))
        return _rows(ASKED_PAIRS, out)

    return run


PAIRS = "bucket long, block long, c binary, runs binary, c_totals binary, words binary, h binary, n binary, members binary"


def _merge_pairs(table: pa.Table) -> pa.Table:
    """A bucket's distinct pairs in order (block is null), and for each block which of them it asked for."""
    parts = _parts(table, "block")
    runs = [unpack(r["runs"]) for r in parts]
    c = np.concatenate([np.repeat(unpack_rising(r["c"]), k) for r, k in zip(parts, runs)])
    totals = np.concatenate([np.repeat(unpack(r["c_totals"]), k) for r, k in zip(parts, runs)])
    h, n = np.concatenate([unpack(r["h"]) for r in parts]), np.concatenate([unpack(r["n"]) for r in parts])
    order = np.lexsort((h, c))
    new = np.ones(len(c), bool)
    new[1:] = (np.diff(c[order]) != 0) | (np.diff(h[order]) != 0)
    which = np.empty(len(c), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    n = np.bincount(which, weights=n, minlength=len(first)).astype(np.int64)
    c, h, totals = c[first], h[first], totals[first]
    starts, length = _runs(c)
    words, local = np.unique(h, return_inverse=True)
    bucket = parts[0]["bucket"]
    out = [(bucket, None, pack_rising(c[starts]), pack(length), pack(totals[starts]), pack_rising(words), pack(local), pack(n), None)]
    ends = np.cumsum([int(k.sum()) for k in runs])
    for r, end, k in zip(parts, ends.tolist(), runs):
        out.append((bucket, r["block"], *[None] * 6, pack_rising(which[end - int(k.sum()) : end])))
    return _rows(PAIRS, out)


class Pairs:
    """A bucket's pairs, their tables and their words' probabilities."""

    def __init__(self, row: dict, replies: list[dict], buckets: int, hot: dict[int, int]):
        self.contexts, runs, totals = unpack_rising(row["c"]), unpack(row["runs"]), unpack(row["c_totals"])
        self.words, self.h, self.n = unpack_rising(row["words"]), unpack(row["h"]), unpack(row["n"])
        self.c = np.repeat(np.arange(len(runs)), runs)
        self.customers, self.hot = totals.astype(float), hot
        self.t = np.minimum(self.n, 1)
        self.place, self.rank = (self.words - 1) % buckets, (self.words - 1) // buckets
        self.chance = np.zeros(len(self.words))
        for r in replies:
            if r["word_bucket"] is None:
                self.t[self.n > 1] = unpack(r["tables"])
            else:
                self.chance[self.place == r["word_bucket"]] = unpack(r["tables"]).astype("<u4").view("<f4")

    def opened(self) -> np.ndarray:
        """Tables of each context; contexts dealt over buckets have the last sweep's total."""
        out = np.bincount(self.c, weights=self.t, minlength=len(self.contexts))
        for i in np.flatnonzero(np.isin(self.contexts, list(self.hot))):
            out[i] = self.hot[int(self.contexts[i])]
        return out

    def sweep(self, rng: np.random.Generator) -> None:
        some = np.flatnonzero(self.n > 1)
        others = self.opened()[self.c[some]] - self.t[some]
        self.t[some] = tables_of(self.n[some], self.chance[self.h[some]], np.maximum(others, 0), CONTEXT_D, CONTEXT_S, rng)

    def predict(self) -> np.ndarray:
        scale = CONTEXT_S + self.customers
        left = (CONTEXT_S + CONTEXT_D * self.opened()) / scale
        return (self.n - CONTEXT_D * self.t) / scale[self.c] + left[self.c] * self.chance[self.h]


#: Word bucket null: the tables of a pair bucket; -1: a dealt context's tables there.
SENT = "word_bucket long, bucket long, ranks binary, tables binary, context long, opened long"


def _seat_pairs(buckets: int, hot: dict[int, int] | None, limit: float, seed: int):
    def run(pairs: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in pairs.to_pylist():
            p = Pairs(row, replies.to_pylist(), buckets, hot or {})
            if hot is not None:
                p.sweep(np.random.default_rng([seed, row["bucket"]]))
            sums = np.bincount(p.h, weights=p.t, minlength=len(p.words)).astype(np.int64)
            order = np.argsort(p.place, kind="stable")
            for b, i, j in _segments(p.place[order]):
                out.append((b, row["bucket"], pack_rising(p.rank[order[i:j]]), pack(sums[order[i:j]]), None, None))
            out.append((None, row["bucket"], None, pack(p.t[p.n > 1]), None, None))
            here = np.bincount(p.c, weights=p.t, minlength=len(p.contexts)).astype(np.int64)
            for i in np.flatnonzero((p.customers > limit) | (p.contexts == START)):
                out.append((-1, row["bucket"], None, None, int(p.contexts[i]), int(here[i])))
        return _rows(SENT, out)

    return run


class Model:
    """Totals of the word restaurant and the spelling."""

    def __init__(self, spelling: Spelling, customers: float, opened: float):
        self.spelling, self.customers, self.opened, self.unseen = spelling, customers, opened, 1.0


STATE = "bucket long, words binary, word_sizes binary, totals binary, customers binary, tables binary, peers array<long>, ranks array<binary>"


def _seat_words(model, seed: int):
    """Customers and tables of a bucket's words in the word restaurant, given
    what the pair buckets sent; ``model`` is a broadcast Model or None for one table a word."""

    def run(vocabulary: pa.Table, sent: pa.Table) -> pa.Table:
        out = []
        for row in vocabulary.to_pylist():
            parts = _parts(sent, "bucket")
            customers = np.zeros(len(unpack(row["totals"])), np.int64)
            for r in parts:
                customers[unpack_rising(r["ranks"])] += unpack(r["tables"])
            tables = np.minimum(customers, 1)
            if model is not None:
                m = model.value
                spelled = m.spelling.words(unpack_words([row["words"]], [row["word_sizes"]]))
                tables = tables_of(customers, spelled, np.full(len(customers), m.opened), WORD_D, WORD_S, np.random.default_rng([seed, row["bucket"]]))
            out.append((row["bucket"], row["words"], row["word_sizes"], row["totals"], pack(customers), pack(tables), [r["bucket"] for r in parts], [r["ranks"] for r in parts]))
        return _rows(STATE, out)

    return run


def _learn(state: DataFrame, seed: int) -> Model:
    """Totals and the spelling, from sums that are bounded by the byte contexts."""

    def run(batches):
        cells, sums = np.zeros(CLASSES**3 * SYMBOLS, dtype=np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                tables = unpack(r["tables"])
                sums += unpack(r["customers"]).sum(), tables.sum()
                at, owner = spell_cells(unpack_words([r["words"]], [r["word_sizes"]]))
                np.add.at(cells, at, tables[owner])
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, [-1, -2]]), pa.int64()), pa.array(np.concatenate([cells[used], sums]))], names=["key", "n"])

    rows = state.select("words", "word_sizes", "customers", "tables").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = rows["key"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(key[key >= 0])
    return Model(Spelling.sample(key[key >= 0][order], n[key >= 0][order], seed), float(n[key == -1].sum()), float(n[key == -2].sum()))


def _known_mass(state: DataFrame, spelling: Spelling) -> float:
    """What the spelling gives to all known words together."""
    shared = state.sparkSession.sparkContext.broadcast(spelling)

    def run(batches):
        total = 0.0
        for batch in batches:
            for r in batch.to_pylist():
                total += float(shared.value.words(unpack_words([r["words"]], [r["word_sizes"]]))[unpack(r["totals"]) > 0].sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.float64())], names=["mass"])

    return state.select("words", "word_sizes", "totals").mapInArrow(run, "mass double").agg(F.sum("mass")).first()[0] or 0.0


REPLY = "bucket long, word_bucket long, tables binary"


def _replies(state: DataFrame, model) -> DataFrame:
    """The probabilities of words, to each pair bucket in the order in which it sent them."""

    def run(batches):
        m = model.value
        for batch in batches:
            for r in batch.to_pylist():
                spelled = m.spelling.words(unpack_words([r["words"]], [r["word_sizes"]]))
                spelled = np.where(unpack(r["totals"]) > 0, spelled, m.unseen)
                p = (unpack(r["customers"]) - WORD_D * unpack(r["tables"]) + (WORD_S + WORD_D * m.opened) * spelled) / (WORD_S + m.customers)
                p = np.maximum(p, 1e-37).astype("<f4").view("<u4")
                for peer, ranks in zip(r["peers"], r["ranks"]):
                    yield _rows(REPLY, [(peer, r["bucket"], pack(p[unpack_rising(ranks)]))]).to_batches()[0]

    return state.mapInArrow(run, REPLY)


#: Logarithms travel as multiples of this part of one.
STEP = 1 << 16
PREDICTED = "block long, bucket long, ranks binary, totals binary, chances binary"


def _predict(buckets: int, hot: dict[int, int], seed: int):
    def run(pairs: pa.Table, replies: pa.Table) -> pa.Table:
        rows = _parts(pairs, "block")
        p = Pairs(rows[0], replies.to_pylist(), buckets, hot)
        rng = np.random.default_rng([seed, rows[0]["bucket"]])
        chance = 0.0
        for _ in range(SEATINGS):
            p.sweep(rng)
            chance = chance + p.predict() / SEATINGS
        cost = np.rint(-np.log10(np.clip(chance, 1e-37, 1.0)) * STEP).astype(np.int64)
        return _rows(PREDICTED, [(r["block"], r["bucket"], None, None, pack(cost[unpack_rising(r["members"])])) for r in rows[1:]])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(buckets: int, texts: int, limit: float, total: int, distinct: int):
    def run(coded: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        for row in coded.to_pylist():
            replied = replies.to_pylist()
            b = Block(row, [r for r in replied if r["ranks"] is not None], buckets, texts, limit)
            segment = {bucket: b.order[i:j] for bucket, i, j in b.segments}
            cost = np.zeros(len(b.c))
            for r in replied:
                if r["chances"] is not None:
                    cost[segment[r["bucket"]]] = unpack(r["chances"]) / STEP
            of = np.repeat(np.arange(len(b.sizes)), b.sizes)
            per = lambda x: np.bincount(of, weights=x, minlength=len(b.sizes))
            count = b.total[b.codes]
            base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
            columns = [pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.sizes), pa.array(per(count > 0).astype(np.int64)), pa.array(np.full(len(b.sizes), total)), pa.array(per(base)), pa.array(-per(cost[b.which]))]
            out.append(pa.table(columns, names=[c.split()[0] for c in SCORES.split(", ")]))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, held_out_of: int = 5, held_out: int = 1) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text), learned from those whose
    crc32(doc_id as text) mod ``held_out_of`` is not ``held_out``."""
    spark = docs.sparkSession
    is_held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % held_out_of == held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held_out")).alias("texts")).first()
    buckets = max(min(partitions(spark), 32), math.ceil((size["bytes"] or 0) / BUCKET_BYTES))
    texts = size["texts"]

    coded = cut(rows.mapInArrow(_code(buckets), CODED))
    asked = coded.select("block", "place", "words", "word_sizes", "counts").mapInArrow(_ask_words, ASKED)
    vocabulary = cut(asked.groupBy("bucket").applyInArrow(_merge_words, VOCABULARY))
    totals = vocabulary.agg(F.sum("tokens").alias("tokens"), F.sum("seen").alias("seen")).first()
    tokens, seen = totals["tokens"] or 0, totals["seen"] or 0
    limit = tokens / buckets
    entries = vocabulary.filter("block is null").select("bucket", "words", "word_sizes", "totals")
    numbers = vocabulary.filter("block is not null").select("block", "bucket", "ranks", "totals")
    blocks = coded.select("block", "ids", "held", "sizes", "codes", "place").groupBy("block")

    asked_pairs = blocks.cogroup(numbers.groupBy("block")).applyInArrow(_ask_pairs(buckets, texts, limit), ASKED_PAIRS)
    pairs = cut(asked_pairs.groupBy("bucket").applyInArrow(_merge_pairs, PAIRS))
    main = pairs.filter("block is null").drop("members", "block")
    nothing = spark.createDataFrame([], REPLY)

    model = replies = hot = spelled = None
    for sweep in range(SWEEPS + 1):
        back = nothing if replies is None else replies
        sent = cut(main.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(_seat_pairs(buckets, hot, limit, sweep), SENT))
        dealt = sent.filter("word_bucket = -1").groupBy("context").agg(F.sum("opened").alias("opened")).toArrow()
        hot = dict(zip(dealt["context"].to_pylist(), dealt["opened"].to_pylist()))
        state = cut(entries.groupBy("bucket").cogroup(sent.filter("word_bucket >= 0").groupBy("word_bucket")).applyInArrow(_seat_words(model, sweep), STATE))
        last = _learn(state, sweep)
        spelled = last.spelling.table if spelled is None else spelled + last.spelling.table
        if sweep == SWEEPS:
            last.spelling = Spelling(spelled / (SWEEPS + 1), last.spelling.row_of)
            last.unseen = max(1e-9, 1.0 - _known_mass(state, last.spelling))
        if model is not None:
            model.unpersist()
        model = spark.sparkContext.broadcast(last)
        own = sent.filter("word_bucket is null").select("bucket", "word_bucket", "tables")
        replies = _replies(state, model).unionByName(own)

    predicted = pairs.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_predict(buckets, hot, 99), PREDICTED)
    known = numbers.withColumn("chances", F.lit(None).cast("binary")).unionByName(predicted)
    return blocks.cogroup(known.groupBy("block")).applyInArrow(_score(buckets, texts, limit, int(tokens), int(seen)), SCORES)
