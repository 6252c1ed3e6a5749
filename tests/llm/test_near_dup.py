import random
import re

from lotlight.llm import near_dup


def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(rows, k, threshold=80):
    s = {d: sets(t, k) for d, t in rows}
    parent = {d: d for d in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= threshold * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s[d]), find(d)) for d in ids}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for g in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.1:
                base = text  # chains of small changes
            rows.append((at, " ".join(text).upper() if rng.random() < 0.2 else "\n".join(text)))
            at += 1
    return rows + [(at, ""), (at + 1, None), (at + 2, " \t "), (at + 3, "one"), (at + 4, "ONE")]


def check(spark, rows, k):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, rep int, component string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, k).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute(rows, k).items()}


def test_components_match_brute_force(spark):
    check(spark, corpus(1), 4)


def test_one_hot_group_of_near_copies_and_a_shared_passage(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 6])):
            text[rng.randrange(100)] = f"x{rng.random()}"
        rows.append((i, " ".join(text)))
    passage = [f"p{i}" for i in range(40)]
    rows += [(200 + i, " ".join([f"q{i}_{j}" for j in range(20)] + passage)) for i in range(60)]
    rows += [(300 + i, "same text as the others here") for i in range(80)]
    check(spark, rows, 5)


def test_empty_table_and_repeated_rows(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")]
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 2, True), (2, 2, True), (4, 2, False), (4, 2, False)]


def test_estimate_is_close(spark):
    from pyspark.sql import functions as F

    a, b = [f"w{i}" for i in range(900)], [f"w{i}" for i in range(100, 1000)]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    bits = near_dup.sketch(df, 1).select("doc_id", "bits")
    both = bits.filter("doc_id = 1").select(F.col("bits").alias("x")).crossJoin(bits.filter("doc_id = 2").select(F.col("bits").alias("y")))
    assert abs(both.select(near_dup.estimate("x", "y")).first()[0] - 0.8) < 0.14


def test_estimates_rarely_miss_a_pair_at_the_threshold():
    from math import comb

    n, chance = near_dup.HASHES, 1 / (1 << near_dup.BITS)
    equal = 0.8 + 0.2 * chance
    low = [i for i in range(n + 1) if (i / n - chance) / (1 - chance) < 0.8 - near_dup.SLACK]
    assert sum(comb(n, i) * equal**i * (1 - equal) ** (n - i) for i in low) < 1e-5


def test_hot_keys_are_split_and_give_the_same(spark, monkeypatch):
    """With a low bound every key is hot: hubs, classes, bands and shingles."""
    from lotlight.llm import shared

    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base + (f" x{i % 7}" if i % 3 else "")) for i in range(60)] + [(100 + i, f"{i} other text of {i * 31} some words {i % 2} here") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(map(tuple, near_dup.near_duplicates(df).collect()))
    monkeypatch.setattr(shared, "HOT", 2)
    monkeypatch.setattr(near_dup, "HOT", 2)
    assert sorted(map(tuple, near_dup.near_duplicates(df).collect())) == want


def test_very_long_text(spark):
    long = " ".join(str(i * 7919 % 100003) for i in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "short text of five words")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_dup.near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3)]
