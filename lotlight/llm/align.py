"""Alignment of two tokenizers' ids over the same bytes.

A text is encoded twice; tokens are laid over the bytes of a space and the
text, and every byte offset where tokens of both sides end closes a group.
The ends of each side are a dictionary from end to index; the sorted keys that
both hold slice the two id lists into groups, and the links of a group are all
its pairs of a left and a right token.

Both vocabularies meet at the start of every word: where a space follows
anything but white space, neither makes a token across (the left one's
pre-tokenizer splits there, the right one has no piece with a space mark
inside or at its end after another character, which is checked).  So texts are
aligned word by word, a word's alignment is kept in a bounded cache, and many
words that aren't known yet are encoded in one call.  Words whose bytes don't
come back, and every text that holds one, are aligned as a whole text.

Counts: a pair's count is the number of documents of the whole corpus that
hold it linked.  Documents go in blocks of bounded bytes, each written once
with its distinct pairs.  Blocks, not documents, ask for the counts of their
pairs, so a pair has at most one row a block in any shuffle, however common it
is; nothing about pairs is broadcast or collected.

Defined cases: null and empty texts have no tokens (zeros and an empty
string), and so do texts whose bytes one side can't give back; texts of white
space only are texts like others; a group of any size is counted in full by
its distinct ids; repeated rows and repeated or null ids are documents of
their own; other columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import spans
from .shared import cut
from .words import row_slices

#: Words kept by a worker, and bytes of their groups as text, before the less
#: used go; the longest such text that is kept.
CACHE, CACHE_BYTES, LONGEST = 400_000, 32 << 20, 400
#: Bytes of the texts of a block.
BLOCK = 4 << 20
#: Characters of new words encoded in one call.
CALL = 20_000
#: Links of a group up to which they are expanded one by one.
PLAIN = 1024

#: A word begins with the white space before it.
_word = re.compile(r"(?<=\S)(?=[ \n])")

#: A pair is one number: the left id above, the right id in the low bits.
RIGHT_BITS = 15


class Sides:
    """The two tokenizers and the bytes of their entries."""

    def __init__(self, left: str, right: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(left)
        self.left.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_file=right)
        pieces = [self.right.id_to_piece(i) for i in range(self.right.get_piece_size())]
        if len(pieces) > 1 << RIGHT_BITS or any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("the right vocabulary has too many pieces or pieces across a word's start")
        self.left_bytes = self._left_bytes()
        self.right_bytes = [bytes([int(p[3:5], 16)]) if self.right.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.left_size, self.right_size = (np.array([len(x) for x in of], np.int64) for of in (self.left_bytes, self.right_bytes))

    def _left_bytes(self) -> list[bytes]:
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(moved)}
        entries = sorted(self.left.get_vocab().items(), key=lambda x: x[1])
        return [bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode() for entry, _ in entries]

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of a text that begins with the space which the right side
        adds, or None where the text's bytes don't come back."""
        a, b, raw = self.left.encode(text, add_special_tokens=False).ids, self.right.encode(text[1:]), text.encode()
        whole = b"".join([self.left_bytes[i] for i in a]) == raw == b"".join([self.right_bytes[i] for i in b])
        return (a, b) if whole else None


def slices(left_ends: list[int], right_ends: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Ends that both sides share, and for each the tokens of the left and of the right side up to it."""
    left = {end: k for k, end in enumerate(left_ends, 1)}
    right = {end: k for k, end in enumerate(right_ends, 1)}
    shared = sorted(left.keys() & right.keys())
    return shared, [left[end] for end in shared], [right[end] for end in shared]


#: Decimal digits of numbers below 2 ** 16 from the left, and how many there are.
_digits = np.zeros((1 << 16, 6), np.uint8)
_numbers = np.arange(1 << 16)
_width = 1 + sum((_numbers >= 10**k).astype(np.int64) for k in range(1, 5))
for _k in range(5):
    _has = _width > _k
    _digits[_has, _k] = 48 + _numbers[_has] // 10 ** (_width[_has] - 1 - _k) % 10


@dataclass
class Alignments:
    """Alignments of words: left and right tokens, groups and links of each;
    its groups as text; and its links from ``first`` on in ``pairs`` and
    ``times`` (a pair may come more than once)."""

    facts: np.ndarray
    texts: list[bytes]
    first: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def expand(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair and times of the links of groups that end before the left
    tokens ``i`` and the right tokens ``j``.  Large groups go by their distinct ids."""
    m, n = np.diff(i, prepend=0), np.diff(j, prepend=0)
    size = np.where(m * n <= PLAIN, m * n, 0)
    of = np.repeat(np.arange(len(i)), size)
    turn = spans(np.zeros(len(i), np.int64), size)
    pairs = a[(i - m)[of] + turn // n[of]] << RIGHT_BITS | b[(j - n)[of] + turn % n[of]]
    times = np.ones(len(of), np.int64)
    for g in np.flatnonzero(m * n > PLAIN).tolist():
        x, x_times = np.unique(a[i[g] - m[g] : i[g]], return_counts=True)
        y, y_times = np.unique(b[j[g] - n[g] : j[g]], return_counts=True)
        pairs, times = np.concatenate([pairs, (x[:, None] << RIGHT_BITS | y).ravel()]), np.concatenate([times, np.outer(x_times, y_times).ravel()])
        of = np.concatenate([of, np.full(len(x) * len(y), g)])
    order = np.argsort(of, kind="stable")
    return of[order], pairs[order], times[order]


def written(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Groups as text, each with a semicolon behind, and the ends of their texts."""
    group_a, group_b = (np.repeat(np.arange(len(k)), np.diff(k, prepend=0)) for k in (i, j))
    at_a = np.arange(len(a)) + np.concatenate([[0], j])[group_a]
    at_b = np.arange(len(b)) + i[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[i - 1]], mark[at_b[j - 1]] = ord("|"), ord(";")
    width = _width[ids]
    rows = _digits[ids]
    rows[np.arange(len(ids)), width] = mark
    return rows[np.arange(6) <= width[:, None]].tobytes(), np.cumsum(width + 1)[i + j - 1]


def align(words: list[str], sides: Sides, lead: str = "") -> Alignments | None:
    """Alignments of words that follow one another (behind ``lead``, which is
    no part of the result), or None where bytes don't come back."""
    ids = sides.encode(lead + "".join(words))
    if ids is None:
        return None
    a, b = (np.array(x, np.int64) for x in ids)
    shared, i, j = slices(np.cumsum(sides.left_size[a]).tolist(), np.cumsum(sides.right_size[b]).tolist())
    shared, i, j = (np.array(x, np.int64) for x in (shared, i, j))
    ends = len(lead.encode()) + np.cumsum([len(w.encode()) for w in words])
    skip = int(np.searchsorted(shared, len(lead.encode()), side="right"))
    upto = np.searchsorted(shared, ends, side="right")  # groups up to each word's end
    if (shared[upto - 1] != ends).any() or skip != (1 if lead else 0):
        return None
    if skip:
        a, b, i, j, upto = a[i[0] :], b[j[0] :], i[1:] - i[0], j[1:] - j[0], upto - 1
    group, pairs, times = expand(a, b, i, j)
    raw, stops = written(a, b, i, j)
    stops = stops[upto - 1].tolist()
    first = np.searchsorted(group, np.concatenate([[0], upto]))
    links = np.concatenate([[0], np.cumsum(times)])[first]
    facts = np.stack([np.diff(x, prepend=0) for x in (i[upto - 1], j[upto - 1], upto, links[1:])], axis=1)
    return Alignments(facts, [raw[x : y - 1] for x, y in zip([0, *stops], stops)], first, pairs, times)


class Aligner:
    """Aligns texts by their words and keeps the words' alignments."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.slot: dict[str, int] = {}
        self.kept = Alignments(np.zeros((0, 4), np.int64), [], np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.uses = np.zeros(0, np.int64)
        self.bytes = 0

    def _shrink(self) -> None:
        """Keep words that were used again, at most half of all: the most used."""
        if len(self.kept.texts) <= CACHE and self.bytes <= CACHE_BYTES:
            return
        old, uses = self.kept, self.uses
        fit = np.flatnonzero((uses > 1) & (np.array([len(x) for x in old.texts]) <= LONGEST))
        chosen = np.sort(fit[np.argsort(-uses[fit], kind="stable")[: CACHE // 2]])
        place = np.full(len(uses), -1)
        place[chosen] = np.arange(len(chosen))
        size = np.diff(old.first)[chosen]
        at = spans(old.first[chosen], size)
        self.kept = Alignments(old.facts[chosen], [old.texts[k] for k in chosen.tolist()], np.concatenate([[0], np.cumsum(size)]), old.pairs[at], old.times[at])
        self.uses, self.bytes = np.ones(len(chosen), np.int64), sum(map(len, self.kept.texts))
        where = place.tolist()
        self.slot = {w: where[k] for w, k in self.slot.items() if k >= 0 and where[k] >= 0}

    def _parts(self, words: list[str]):
        """Words with their alignments, or with None where there is none."""
        found = align(words, self.sides, " a")
        if found is not None:
            yield words, found
        elif len(words) == 1:
            yield words, None
        else:
            yield from self._parts(words[: len(words) // 2])
            yield from self._parts(words[len(words) // 2 :])

    def _learn(self, words: list[str]) -> None:
        parts, begin, size = [self.kept], 0, 0
        for k, word in enumerate(words, 1):
            size += len(word)
            if size >= CALL or k == len(words):
                for some, found in self._parts(words[begin:k]):
                    if found is None:
                        self.slot[some[0]] = -1
                        continue
                    n = sum(len(p.texts) for p in parts)
                    self.slot.update(zip(some, range(n, n + len(some))))
                    parts.append(found)
                    self.bytes += sum(map(len, found.texts))
                begin, size = k, 0
        sizes = np.concatenate([np.diff(p.first) for p in parts])
        flat = (np.concatenate([getattr(p, c) for p in parts]) for c in ("pairs", "times"))
        self.kept = Alignments(np.concatenate([p.facts for p in parts]), [x for p in parts for x in p.texts], np.concatenate([[0], np.cumsum(sizes)]), *flat)
        self.uses = np.concatenate([self.uses, np.zeros(len(self.kept.texts) - len(self.uses), np.int64)])

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its facts and its groups as text; and of all texts the
        row, pair and times of each distinct link, in order of row and pair."""
        self._shrink()
        words = [_word.split(" " + t) if t else [] for t in texts]
        known = self.slot
        # words that end in white space end their texts and could join what follows
        new = {w: None for of in words for w in of if w not in known}
        self._learn([w for w in new if not w[-1].isspace()])
        odd = [k for k, of in enumerate(words) if of and (of[-1] not in known or any(known[w] < 0 for w in of))]
        for k in odd:
            words[k] = []
        slots = [[known[w] for w in of] for of in words]
        kept = self.kept
        strings = [b";".join([kept.texts[i] for i in of]) for of in slots]
        n = np.array([len(of) for of in slots], np.int64)
        flat = np.fromiter((i for of in slots for i in of), np.int64, int(n.sum()))
        self.uses += np.bincount(flat, minlength=len(self.uses))
        # distinct words of each row first, then their links
        key, uses = np.unique(np.repeat(np.arange(len(texts)), n) << 32 | flat, return_counts=True)
        row, slot = key >> 32, key & 0xFFFFFFFF
        before = np.searchsorted(row, np.arange(len(texts) + 1))
        facts = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(kept.facts[slot] * uses[:, None], axis=0)])[before], axis=0)
        size = (kept.first[1:] - kept.first[:-1])[slot]
        at = spans(kept.first[slot], size)
        links = [(np.repeat(row, size), kept.pairs[at], kept.times[at] * np.repeat(uses, size))]
        for k in odd:
            whole = align([" " + texts[k]], self.sides)
            if whole is not None:
                facts[k], strings[k] = whole.facts[0], whole.texts[0]
                links.append((np.full(len(whole.pairs), k), whole.pairs, whole.times))
        rows, pairs, times = (np.concatenate(x) for x in zip(*links))
        key = rows << 32 | pairs
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.add.reduceat(times[order], starts) if len(starts) else times
        return facts, strings, key[starts] >> 32, key[starts] & 0xFFFFFFFF, total


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(left: str, right: str) -> Aligner:
    """The worker's aligner for two vocabularies, made once."""
    if (left, right) not in _aligners:
        _aligners[left, right] = Aligner(Sides(left, right))
    return _aligners[left, right]


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, left: str | None = None, right: str | None = None, keep_groups: bool = True) -> DataFrame:
    """Alignments of all texts, in blocks.

    Rows with ``pairs`` and ``times`` per document: doc_id, n_a, n_b,
    n_groups, n_links, groups_sha256 and (``keep_groups``) ``groups`` as text
    ``a1,a2|b1;a3|b2,b3``; ``pairs`` are places in the block's own list.  One
    more row for each ``block`` (``listed`` is true) holds that list and, in
    ``times``, how many of the block's documents have each pair linked.
    """
    default = default_vocabularies()
    paths = left or default[0], right or default[1]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block string, listed boolean, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<int>, times array<int>"

    def run(batches):
        from pyspark import TaskContext

        me, part = aligner(*paths), TaskContext.get().partitionId()
        number = size = 0
        lists: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[tuple] = []

        def block():
            """The block's document rows, then its list."""
            every, docs_of = np.unique(np.concatenate([p for _, p in lists]), return_counts=True) if lists else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            name = f"{part}-{number}"
            for ids, facts, strings, ends, pairs, times in held:
                digests = [sha256(s).hexdigest() if f else "" for s, f in zip(strings, facts[:, 0].tolist())]
                n = len(ids)
                offsets = pa.array(ends, pa.int32())
                columns = [
                    pa.array([name] * n), pa.array([False] * n), ids, *[pa.array(facts[:, c], pa.int64()) for c in range(4)], pa.array(digests, pa.string()), pa.array(strings if keep_groups else [None] * n, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.searchsorted(every, pairs), pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            none = [pa.nulls(1, t) for t in (ids_type[0], *[pa.int64()] * 4, pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([True]), *none, *[pa.array([x.tolist()], pa.list_(pa.int32())) for x in (every, docs_of)]], names=names)

        names, ids_type = [c.split()[0] for c in schema.split(", ")], [None]
        for batch in batches:
            ids_type[0] = batch.schema.field(0).type
            for lo, n in row_slices(batch.column(1), 1 << 20):
                piece = batch.slice(lo, n)
                texts = piece.column(1).to_pylist()
                facts, strings, row, pairs, times = me.align(texts)
                held.append((piece.column(0), facts, strings, np.searchsorted(row, np.arange(n + 1)), pairs, np.minimum(times, 2**31 - 1)))
                lists.append((row, pairs))
                size += sum(map(len, filter(None, texts)))
                if size >= BLOCK:
                    yield from block()
                    number, size, lists, held = number + 1, 0, [], []
        if held:
            yield from block()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def counts(table: DataFrame) -> DataFrame:
    """block, place, pair, count and best (no pair of its left id has more)
    of all blocks' pairs; ``table`` is a written result of ``aligned``."""
    asked = table.filter("listed").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "_x")).select("block", "place", F.col("_x.pairs").alias("pair"), F.col("_x.times").alias("_docs"))
    per = asked.groupBy("pair").agg(F.sum("_docs").alias("count"))
    top = per.groupBy(F.shiftright("pair", RIGHT_BITS).alias("_left")).agg(F.max("count").alias("_top"))
    known = per.withColumn("_left", F.shiftright("pair", RIGHT_BITS)).join(top, "_left").select("pair", "count", (F.col("count") == F.col("_top")).alias("best"))
    return asked.drop("_docs").join(known.hint("merge"), "pair")


def scored(docs: DataFrame, left: str | None = None, right: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    table = cut(aligned(docs, left, right, keep_groups=False))
    reply = counts(table).select("block", F.struct("place", "count", "best").alias("_r")).groupBy("block").agg(F.sort_array(F.collect_list("_r")).alias("_r"))
    reply = reply.select(F.col("block").alias("_block"), F.col("_r.count").alias("_count"), F.col("_r.best").alias("_best"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    facts = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"

    def run(own: pa.Table, answer: pa.Table) -> pa.Table:
        column = own["pairs"].combine_chunks()
        n = np.diff(column.offsets.to_numpy())
        row = np.repeat(np.arange(len(own)), n)
        place = column.flatten().to_numpy()
        times = own["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
        if len(answer):
            count, best = answer["_count"].combine_chunks().flatten().to_numpy(), answer["_best"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        else:
            count, best = np.zeros(0, np.int64), np.zeros(0, bool)
        sums = np.zeros((2, len(own)), dtype=np.int64)
        np.add.at(sums[0], row, times * best[place])
        np.add.at(sums[1], row, times * count[place])
        return own.select(facts).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    mine = table.filter("not listed").select("block", *facts, "pairs", "times")
    done = mine.groupBy("block").cogroup(reply.groupBy("_block")).applyInArrow(run, out)
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
