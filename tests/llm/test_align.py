from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from lotlight.llm import align, queries

TEXTS = [
    "The cat sat on the mat.\nThe cat, again.", "The cat sat on the mat.", None, "", " ", "\n", "  two  spaces \n lines\n\n\nend ", "a\tb\x0bc\rd\r\n e", "ünïcödé straße 日本語 текст 🙂🙂", "<|endoftext|> <s> </s> <unk> <0x41>",
    "literal ▁ mark", "▁", "a b c 　 d", "x\x1cy \x1f z\x85w", "don't we'll I'm 's", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "tail  ", "\n\n lead", "word\n" * 300, "12345 67,890.01 #$%&", "The cat sat on the mat.", "cat " * 5000 + "end",
]


@pytest.fixture(scope="module")
def sides():
    return align.Sides(*align.default_vocabularies())


def plain(text, sides):
    """Groups of one text by comparing all ends, or None."""
    if not text:
        return None
    a = sides.left.encode(" " + text, add_special_tokens=False).ids
    b = sides.right.encode(text)
    xa, xb = [sides.left_bytes[i] for i in a], [sides.right_bytes[i] for i in b]
    if b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
        return None
    out, ga, gb, na, nb = [], [], [], 0, 0
    a, b = list(zip(a, xa))[::-1], list(zip(b, xb))[::-1]
    while a or b:
        if na <= nb and a:
            t, x = a.pop()
            ga.append(t)
            na += len(x)
        else:
            t, x = b.pop()
            gb.append(t)
            nb += len(x)
        if na == nb:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def brute(rows, sides):
    done = [(i, plain(t, sides)) for i, t in rows]
    docs_of, every = Counter(), []
    for i, of in done:
        linked = Counter((x, y) for ga, gb in of or [] for x in ga for y in gb)
        docs_of.update(linked.keys())
        every.append((i, of, linked))
    top = defaultdict(int)
    for (x, _), n in docs_of.items():
        top[x] = max(top[x], n)
    out = []
    for i, of, linked in every:
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in of or [])
        out.append((i, sum(len(g[0]) for g in of or []), sum(len(g[1]) for g in of or []), len(of or []), sum(linked.values()), sum(n for p, n in linked.items() if docs_of[p] == top[p[0]]), sum(n * docs_of[p] for p, n in linked.items()), sha256(text.encode()).hexdigest() if of else ""))
    return out


@pytest.mark.parametrize("parts, block", [(1, 4 << 20), (5, 50)])
def test_query_equals_brute_force(spark, sides, tmp_path, monkeypatch, parts, block):
    monkeypatch.setattr(align, "BLOCK", block)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "The mat"), (3, "again the cat")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, block int, pairs string, n_a int").repartition(parts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_tokenizer_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, sides), key=str)


def test_given_documents(spark, sides):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, align.scored(docs).collect())) == sorted(brute(rows, sides))


def test_empty_table(spark):
    assert align.scored(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_groups_as_text(spark, sides):
    docs = spark.createDataFrame([(1, "Alignment of unbelievable tokens")], "doc_id long, text string")
    row = align.aligned(docs).filter("not listed").first()
    assert row["groups"] == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in plain("Alignment of unbelievable tokens", sides))


def test_words_stay_right_when_the_cache_shrinks(sides, monkeypatch):
    monkeypatch.setattr(align, "CACHE", 6)
    me = align.Aligner(sides)
    for _ in range(3):
        for t in TEXTS:
            facts, strings, _, _, times = me.align([t])
            of = plain(t, sides) or []
            assert facts[0].tolist() == [sum(len(g[0]) for g in of), sum(len(g[1]) for g in of), len(of), sum(len(x) * len(y) for x, y in of)]
            assert strings[0].decode() == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in of) and times.sum() == facts[0, 3]


def test_large_groups_go_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 7, 50)
    i, j = np.array([20, 21, 60]), np.array([1, 30, 50])

    def total():
        out = Counter()
        for g, p, t in zip(*(x.tolist() for x in align.expand(a, b, i, j))):
            out[g, p] += t
        return out

    plain_links = total()
    monkeypatch.setattr(align, "PLAIN", 25)
    assert total() == plain_links and sum(plain_links.values()) == 20 + 29 + 39 * 20
