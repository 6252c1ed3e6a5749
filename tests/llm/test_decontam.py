import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from lotlight.llm import decontam


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs, items):
    """Best similarity of each document and item over all windows of the item's size."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            q = words(item)
            if len(q) < 5:
                continue
            g = grams(q)
            for p in range(len(w) - len(q) + 1):
                h = grams(w[p : p + len(q)])
                s = sum((g & h).values()) / sum((g | h).values())
                if s >= 0.8 and s > out.get((d, i), 0) + 1e-12:
                    out[d, i] = s
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 40)))) for i in range(12)]
    items += [(50, "too short item"), (51, None), (52, "a b c d e a b c d e a b c d e")]
    docs = []
    for d in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        if d % 2:
            passage = items[rng.randrange(12)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = "zz"
            at = rng.randint(0, len(text))
            text[at:at] = [p.upper() + "!!" if d % 3 == 0 else p for p in passage]
        docs.append((d, (" | " if d % 5 == 0 else " ").join(text)))
    docs += [(100, None), (101, ""), (102, "x a b c d e a b c d e a b c d e y"), (103, "too short item")]
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.find(df, bench).collect()}
    want = {k: round(v, 9) for k, v in brute(docs, items).items()}
    assert got == want and len(want) > 10
    left = {r.doc_id for r in decontam.clean(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.clean(df, bench).columns == df.columns


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 2)
    items = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(8))) for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "pre " + " ".join(f"w{i}_{j}" for j in range(8))) for i in range(7)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find(docs, items).collect()) == [(i, i) for i in range(5)]
    assert decontam.clean(docs, items).count() == 2
    assert decontam.find(docs, items.filter("false")).count() == 0 and decontam.find(docs.filter("false"), items).count() == 0


@pytest.mark.parametrize("direct", [0, 64])
def test_index_finds_all_within_the_radius(monkeypatch, direct):
    import numpy as np

    monkeypatch.setattr(decontam, "DIRECT", direct)

    rng = np.random.default_rng(1)
    index = decontam.Index([(i, " ".join(f"t{i}_{j}" for j in range(10))) for i in range(20)])
    (size,) = index.by_size
    prints = index.prints.copy()
    for row in prints:
        for b in rng.choice(128, decontam.RADIUS, replace=False):
            row[b // 16] ^= np.uint16(1 << (b % 16))
    found = set(index.near(prints, size))
    want = {(w, i) for w in range(20) for i in range(20) if int(np.bitwise_count(prints[w] ^ index.prints[i]).sum()) <= decontam.RADIUS}
    assert found == want and {(i, i) for i in range(20)} <= found


def test_documents_shorter_than_an_item(spark):
    """A whole document that is an item less some words matches as one window."""
    rng = random.Random(5)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(rng.randint(12, 60)))) for i in range(30)] + [(90, "a b c d e a b c d e a b c d e a b c d e")]
    docs = []
    for i, text in items:
        w = text.split()
        for front, back in ((0, 1), (1, 0), (1, 2), (3, 0), (4, 4), (9, 9)):
            docs.append((len(docs), " ".join(w[front : len(w) - back])))
            docs.append((len(docs), " ".join(["other", *w[front : len(w) - back]])))
    got = {(r.doc_id, r.item_id): r for r in decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want, short = {}, 0
    for d, text in docs:
        w = words(text)
        for i, item in items:
            q = words(item)
            n, g = min(len(w), len(q)), grams(q)
            for p in range(len(w) - n + 1):
                h = grams(w[p : p + n])
                s = sum((g & h).values()) / max(1, sum((g | h).values()))
                if s >= 0.8 - 1e-9 and s > want.get((d, i), 0):
                    want[d, i] = s
            short += (d, i) in want and len(w) < len(q)
    assert {k: round(r.similarity, 9) for k, r in got.items()} == {k: round(s, 9) for k, s in want.items()}
    assert short > 40 and all(r.n_words <= len(words(docs[d][1])) and r.start_word >= 0 for (d, _), r in got.items())


def test_very_long_text_of_item_words_is_read_in_parts():
    item = " ".join(f"q{i}" for i in range(40))
    index = decontam.Index([(1, item), (2, " ".join(f"q{i}" for i in range(20, 60)))])
    text = " ".join(f"q{i % 35}" for i in range(300_000)) + " " + item
    got = {m[1]: m for m in index.matches(pa.array(["no match here at all", text]))}
    assert got[0][0] == 1 and got[0][2] == 1.0 and got[0][3] == 300_000
