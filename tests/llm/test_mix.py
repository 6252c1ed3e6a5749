import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotlight.llm import mix, queries

SCHEMA = "doc_id long, source string, text string"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_of(rows):
    """Targets by resharing one source's excess after another."""
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += size_of(t)
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        all_weights = sum(weight[s] for s in order if s not in capped)
        want = {s: 3 * sizes[s] if s in capped else left * weight[s] / all_weights for s in order}
        above = {s for s in order if s not in capped and want[s] > 3 * sizes[s]}
        if not above:
            return sizes, want
        capped |= above


def made(n, source, words):
    return [(i, source, " ".join(f"w{i}x{j}" for j in range(words(i)))) for i in range(n)]


ROWS = [
    *made(300, "big", lambda i: i % 40), *made(5, "tiny", lambda i: 3), *made(40, "é", lambda i: 100), *made(1, "one", lambda i: 2000), *made(30, None, lambda i: 50), *made(3, "", lambda i: 0), *made(60, "z", lambda i: 7),
    (None, "big", "null id words"), (7, "big", "again\nand\tagain"), (7, "big", "again\nand\tagain"), (8, None, None), (9, "z", "  "), (10, "z", "x " * 30_000),
]


def run(spark, rows, tmp_path, parts=3):
    spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", size long, _line long").repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_source_mix(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("block, shard, stratum, subtree", [(512, 2048, 4096, 1024), (7, 11, 2, 3), (64, 5, 3, 1)])
def test_targets_are_met_to_the_word(spark, tmp_path, monkeypatch, block, shard, stratum, subtree):
    for name, value in (("BLOCK", block), ("SHARD", shard), ("STRATUM", stratum), ("SUBTREE", subtree)):
        monkeypatch.setattr(mix, name, value)
    rows = run(spark, ROWS, tmp_path)
    sizes, want = targets_of(ROWS)
    assert sorted((r[0], r[1]) for r in rows if r[0] is not None) == sorted((i, size_of(t)) for i, _, t in ROWS if i is not None)
    by = defaultdict(lambda: [0, 0, 0.0])
    for _, size, source_size, target, taken in rows:
        assert 0 <= taken <= 3 * size
        by[source_size, round(target, 6)][0] += taken
    assert {k[0] for k in by} == set(sizes.values())
    for (source_size, target), (taken, *_) in by.items():
        assert any(abs(want[s] - target) < 1e-6 and sizes[s] == source_size for s in sizes)
        assert taken == int(target + 0.5)


def test_reruns_and_other_partitions_agree(spark, tmp_path):
    a = sorted(run(spark, ROWS, tmp_path / "a", 1), key=str)
    assert a == sorted(run(spark, ROWS[::-1], tmp_path / "b", 6), key=str)


def test_the_mix_is_whole_and_its_texts_are_the_documents(spark, monkeypatch):
    monkeypatch.setattr(mix, "BLOCK", 16)
    monkeypatch.setattr(mix, "SHARD", 10)
    out, placed, sources = mix.mixed(spark.createDataFrame(ROWS, SCHEMA))
    rows = out.collect()
    where = {(r["_line"], r["_rank"]): r for r in placed.collect()}
    lines = {r["_s"]: r for r in sources.collect()}
    drawn, per_shard = defaultdict(set), defaultdict(set)
    for r in rows:
        doc = where[lines[r["_s"]]["_line"], r["_rank"]]
        found = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", doc["_text"])
        assert r["text"] == "".join(found[r["begin"] : r["begin"] + r["words"]]) and r["doc_id"] == doc["doc_id"]
        drawn[r["_s"], r["draw"]].add((r["shard"], r["block"]))
        per_shard[r["shard"]].add((r["_s"], r["draw"]))
    assert all(len(x) == 1 for x in drawn.values())  # a draw is one block in one shard
    for s in lines:
        mine = sorted(d for of, d in drawn if of == s)
        assert mine == list(range(len(mine)))
        blocks = -(-lines[s]["source_size"] // 16)
        for epoch in range(0, len(mine), max(blocks, 1)):  # no block twice before all came once
            part = [next(iter(drawn[s, d]))[1] for d in mine[epoch : epoch + blocks]]
            assert len(set(part)) == len(part)
    sizes = [len(x) for x in per_shard.values()]
    assert max(sizes) <= 10 and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("rows", [[], [(1, "a", None), (2, None, "")], [(1, "a", "one")]])
def test_small_tables(spark, tmp_path, rows):
    got = run(spark, rows, tmp_path)
    assert sorted(r[4] for r in got) == sorted(size_of(t) for _, _, t in rows) and len(got) == len(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutations(n):
    i, size, key = np.arange(n), np.full(n, n), np.full(n, 12345)
    out = mix.permuted(i, size, key)
    assert sorted(out.tolist()) == list(range(n))
    assert (mix.permuted(out, size, key, back=True) == i).all()


def test_splits_are_exact_and_near_their_share():
    quota = np.array([5, 0, 700, 40, 3000])
    total = np.zeros(5)
    for k in range(200):
        own = mix.split(mix.seeded(k), quota, 1000)
        assert own.sum() == 1000 and (own <= quota).all()
        total += own
    assert np.abs(total / 200 - quota * 1000 / quota.sum()).max() < 3
    big = np.array([3_000_000_000, 2_000_000_000, 17])
    own = mix.split(mix.seeded(1), big, 2_500_000_000)
    assert own.sum() == 2_500_000_000 and (own <= big).all() and abs(own[0] - 1_500_000_000) < 300_000


def test_large_draws_follow_the_distribution(monkeypatch):
    small = np.random.default_rng(3).hypergeometric(600_000_000, 300_000_000, 400, 4000)
    rng = np.random.default_rng(4)
    large = np.array([mix.hypergeometric(rng, 1_200_000_000, 600_000_000, 400) for _ in range(4000)])
    assert abs(small.mean() - large.mean()) < 1 and abs(small.std() - large.std()) < 0.5


def test_write_keeps_each_shard_in_one_file(spark, tmp_path):
    out, *_ = mix.mixed(spark.createDataFrame(ROWS, SCHEMA))
    mix.write(out, f"{tmp_path}/mix")
    back = spark.read.parquet(f"{tmp_path}/mix")
    files = back.select("shard", F.input_file_name().alias("file")).distinct().groupBy("shard").count().collect()
    assert files and all(r["count"] == 1 for r in files) and back.count() == out.count()
