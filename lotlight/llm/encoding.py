"""Token ids of whole texts with the ``tokenizers`` library.

Random-looking words make the library's own cache useless, so ids are kept
by chunk between ASCII white space (for vocabularies whose pre-tokenizer never
spans white space, which is checked) and only chunks not kept go to the
library.  The cache is a set of arrays: chunks are found by a 64-bit hash in a
sorted array and compared byte by byte.  It has a fixed number of entries and
of bytes; beyond either, the least used half goes.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .words import split, text_bytes

#: Entries and bytes (of chunks and ids) of the cache before half of it goes.
CACHE, CACHE_BYTES = 600_000, 24 << 20
#: Entries of the dictionary of parts of chunks before it is cleared.
PARTS = 150_000

#: Fixed value: the pre-tokenizer's pattern for which encoding by chunk holds.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The same pattern for chunks of printable ASCII and plain Latin letters.
_part = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-ž]+|[0-9]|[^a-z\xdf-\xf6\xf8-ž0-9]+")
_plain = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-ž]+")


def _byte_table() -> dict[int, str]:
    """Characters beyond ASCII as the byte-level alphabet writes their UTF-8."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}
    return {c: "".join(moved.get(b, chr(b)) for b in chr(c).encode()) for c in range(0x80, 0x180)}


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all spans, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Chunks:
    """Ids of chunks by their bytes, held in flat arrays."""

    def __init__(self):
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.raw, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        # first byte, bytes, first id, ids and uses of each slot
        self.facts = np.zeros((0, 5), np.int32)

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Slot of each chunk (given by hash, place and size in ``data``), or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        found = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys):
            return found
        hit = np.flatnonzero(self.keys[at] == keys)
        slot = self.slot[at[hit]]
        hit, slot = hit[self.facts[slot, 1] == sizes[hit]], slot[self.facts[slot, 1] == sizes[hit]]
        n = sizes[hit]
        differ = self.raw[spans(self.facts[slot, 0].astype(np.int64), n)] != data[spans(starts[hit], n)]
        bad = np.zeros(len(hit), dtype=bool)
        bad[np.repeat(np.arange(len(hit)), n)[differ]] = True
        found[hit[~bad]] = slot[~bad]
        self.facts[slot, 4] += 1
        return found

    def add(self, keys: np.ndarray, raw: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Keep new chunks, given in order of their keys; their slots."""
        slots = len(self.facts) + np.arange(len(keys))
        columns = [len(self.raw) + np.cumsum(sizes) - sizes, sizes, len(self.ids) + np.cumsum(counts) - counts, counts, np.ones(len(keys))]
        self.facts = np.concatenate([self.facts, np.stack(columns, axis=1).astype(np.int32)])
        self.raw, self.ids = np.concatenate([self.raw, raw]), np.concatenate([self.ids, ids])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, at, keys), np.insert(self.slot, at, slots)
        return slots

    def shrink(self) -> None:
        """Keep the more used half once there are too many entries or bytes."""
        if len(self.keys) <= CACHE and len(self.raw) + 4 * len(self.ids) <= CACHE_BYTES:
            return
        uses = self.facts[self.slot, 4]
        kept = np.sort(np.argsort(-uses, kind="stable")[: len(uses) // 2])
        old = self.facts[self.slot[kept]].astype(np.int64)
        keys = self.keys[kept]
        raw, ids = self.raw[spans(old[:, 0], old[:, 1])], self.ids[spans(old[:, 2], old[:, 3])]
        self.__init__()
        self.add(keys, raw, old[:, 1], ids, old[:, 3])


class Encoder:
    """Encodes columns of texts; ``end_id`` follows each text if given."""

    def __init__(self, path: str, end_id: int | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.end = [] if end_id is None else [end_id]
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        parts = pre.get("pretokenizers") or [pre]
        self.by_chunk = parts[0].get("type") == "Split" and parts[0]["pattern"].get("Regex") == SPLIT_PATTERN and parts[0].get("invert")
        self.table = _byte_table()
        self.chunks = Chunks()
        self.parts: dict[str, array] = {}

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and the number of each."""
        tokenize, parts, plain, find, table = self.tok.model.tokenize, self.parts, _plain.fullmatch, _part.findall, self.table
        if len(parts) > PARTS:
            parts.clear()
        whole = [c for c in chunks if plain(c) is None or "<|" in c]
        by_library = dict(zip(whole, (e.ids for e in self.tok.encode_batch_fast(whole, add_special_tokens=False))))
        ids = array("I")
        counts = np.empty(len(chunks), dtype=np.int64)
        for i, chunk in enumerate(chunks):
            before = len(ids)
            if chunk in by_library:
                ids.extend(by_library[chunk])
            else:
                for part in find(chunk.lower()):
                    got = parts.get(part)
                    if got is None:
                        got = parts[part] = array("I", [t.id for t in tokenize(part if part.isascii() else part.translate(table))])
                    ids += got
            counts[i] = len(ids) - before
        return np.array(ids, dtype=np.uint32), counts

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = [t or "" for t in column.to_pylist()]
        ids = [e.ids + self.end for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in ids for i in x), np.uint32), np.array([len(x) for x in ids], np.int64)

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another (uint32), and the number of each text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        words = split(*text_bytes(column), lower=False)
        keys, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        size = words.ends - words.starts
        like = first[which]
        if not self.by_chunk or (size != size[like]).any() or (words.data[spans(words.starts, size)] != words.data[spans(words.starts[like], size)]).any():
            return self._whole(column)  # also where two chunks share a hash
        self.chunks.shrink()
        slot = self.chunks.find(keys, words.data, words.starts[first], size[first])
        new = np.flatnonzero(slot < 0)
        if len(new):
            starts, sizes = words.starts[first[new]], size[first[new]]
            raw = words.data[spans(starts, sizes)]
            joined, cut = raw.tobytes(), np.concatenate([[0], np.cumsum(sizes)]).tolist()
            ids, counts = self._learn([joined[a:b].decode() for a, b in zip(cut, cut[1:])])
            slot[new] = self.chunks.add(keys[new], raw, sizes, ids, counts)
        facts = self.chunks.facts[slot[which]].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(facts[:, 3])])[words.first]  # ids of words before each row
        out = self.chunks.ids[spans(facts[:, 2], facts[:, 3])]
        if self.end:
            out = np.insert(out, before[1:], self.end[0])
        return out, np.diff(before) + len(self.end)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    """The worker's encoder for a vocabulary, made once."""
    key = (path, end_id)
    if key not in _encoders:
        _encoders[key] = Encoder(path, end_id)
    return _encoders[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
