import io
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lotlight.llm import encoding, packing, token_files
from lotlight.llm.words import distinct, row_slices, shingles, split, text_bytes

TEXTS = ["The cat, the CAT.\nthe cat", "", None, "  Élan ça\tva\x0bbien ", "a", "x y", "ÀB c d\x1ce", "same words same words same words", "z" * 5000 + " end"]


def words_of(text, lower=True):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_words_match_regex_and_hash_by_content():
    w = split(*text_bytes(pa.array(TEXTS)))
    raw = w.data.tobytes()
    got = [[] for _ in TEXTS]
    for s, e, r in zip(w.starts, w.ends, w.row):
        got[r].append(raw[s:e].decode())
    assert got == [words_of(t) for t in TEXTS]
    flat = [x for t in TEXTS for x in words_of(t)]
    by = {}
    for word, h in zip(flat, w.hashes().tolist()):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_hash_is_alike_across_batches_and_slices():
    a = split(*text_bytes(pa.array(TEXTS))).hashes()
    parts = [split(*text_bytes(pa.array(TEXTS).slice(i, 1))).hashes() for i in range(len(TEXTS))]
    assert (a == np.concatenate(parts)).all()
    assert sum(n for _, n in row_slices(pa.array(TEXTS), 10)) == len(TEXTS)


@pytest.mark.parametrize("k", [1, 3, 4, 5])
def test_shingle_counts(k):
    w = split(*text_bytes(pa.array(TEXTS)))
    sh, row = distinct(*shingles(w, w.hashes(), k))
    want = []
    for t in TEXTS:
        x = words_of(t)
        want.append(len({tuple(x[i : i + k]) for i in range(len(x) - k + 1)} or ({tuple(x)} if x else set())))
    assert np.bincount(row, minlength=len(TEXTS)).tolist() == want


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    path = encoding.default_vocabulary()
    texts = [t or "" for t in TEXTS] + ["don't <|endoftext|> <| 12³ ﬁ İI ΣΑΣ", "été\x1cnul Ünï ×÷ 'S 're", "日本 語 é İ"]
    ref = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    ids, n = encoding.Encoder(path, 7).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids + [7] for e in ref]


@pytest.mark.parametrize("counts", [{}, {2048: 3}, {1: 5000}, {1000: 4, 1048: 3, 600: 9, 3: 1}, {i: 3 * i % 17 for i in range(1, 2049, 7)}])
def test_plan_fills_sequences_without_overlap(counts):
    slots, made = packing.plan(counts)
    seen = {n: 0 for n in counts}
    places = {}
    for length, first_rank, ranks, per, first, offset in slots:
        assert seen[length] == first_rank
        seen[length] += ranks
        for r in range(ranks):
            places.setdefault(first + r // per, []).append((offset + r % per * length, length))
    assert all(seen[n] == counts[n] for n in counts)
    assert len(places) == made
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(k * v for k, v in counts.items())
    assert made <= -(-total // 2048) * 1.25 + 1


ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (50, "word " * 5000), (51, "word " * 5000)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, ids string, piece int").repartition(3)


def encoded(text, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_of_documents(spark):
    from collections import Counter

    packed = packing.pack(docs(spark))
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed.collect())
    want = Counter()
    for d, t in ROWS:
        ids = encoded(t, 0)
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want[(d, p // 2048, p, len(part), crc(part))] += 1
    assert got == want
    held = {}
    for r in packed.collect():
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in held.values():
        assert [o for o, _ in sorted(x)] == np.cumsum([0] + [n for _, n in sorted(x)])[:-1].tolist()
    assert {len(r.ids) // 4 for r in packing.sequences(packed).collect()} == {sum(n for _, n in x) for x in held.values()}
    assert packing.pack(docs(spark, [])).count() == 0


def test_token_files_round_trip(spark):
    back = token_files.write_and_read(docs(spark)).collect()
    assert len(back) == len(ROWS)
    at = 0
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(back, key=lambda r: r.start)] == sorted(d for d, _ in ROWS)
    text = dict(ROWS)
    assert all(crc(encoded(text[r.doc_id], 2)) == zlib.crc32(r.ids) for r in back)
    assert token_files.write_and_read(docs(spark, [])).count() == 0


def test_reader_opens_only_wanted_frames_and_checks_them():
    out = io.BytesIO()
    w = token_files.FileWriter(out, frame_ids=10)
    ids = {d: np.arange(d, 3 * d + 1, dtype="<u4").tobytes() for d in range(1, 12)}
    for d, x in ids.items():
        w.add(d, x)
    w.finish()
    import zstandard

    data = out.getvalue()
    plain = b"".join(token_files.FileReader(io.BytesIO(data)).frame(k) for k in range(len(w.frames)))
    assert plain == b"".join(ids.values())
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == plain
    reader = token_files.FileReader(io.BytesIO(data))
    opened = []
    frame = reader.frame
    reader.frame = lambda k: opened.append(k) or frame(k)
    assert [(d, x) for d, _, x in reader.read({5})] == [(5, ids[5])] and len(opened) == 1
    bad = bytearray(data)
    bad[12] ^= 0xFF
    with pytest.raises(Exception):
        list(token_files.FileReader(io.BytesIO(bytes(bad))).read())


def test_documents_without_an_id_are_kept_first(spark):
    from lotlight.llm import token_files

    rows = [(3, "three words here"), (None, "no id"), (-5, "minus"), (None, None), (0, "zero")]
    got = token_files.write_and_read(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -5, 0, 3]
    assert [r.start for r in got] == [sum(g.n_tokens for g in got[:i]) for i in range(5)] and min(r.n_tokens for r in got) == 1
