import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lotlight.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text=None):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return h(*[field(v) for v in (row[0], row[1], row[2], row[3], row[4] if text is None else text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        first = i - i % 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def brute(rows):
    """What the contract asks for, tree by tree with plain lists."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = levels([leaf_of(r) for r in by[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            bad = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            x = leaf_of(r, r[4].replace("\n", "")) if bad else leaf_of(r)
            for left, right in path:
                x = h(*left, x, *right)
            proof = h(*[d for left, right in path for d in left + right])
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], proof, x, x == top[-1][0]))
    return out


def made(n, source):
    return [(i * 7 % 1009 - 3, source, [None, "de", "fr"][i % 3], None if i % 11 == 0 else i, None if i % 13 == 0 else f"läne {i}\n" * (i % 4)) for i in range(n)]


ROWS = [*made(101, "b"), *made(9, None), *made(1, "a"), *made(27, "ä"), *made(4, ""), *made(28, "z"), (None, "b", None, None, None), (None, None, "x", 5, "\n"), (5, "b", "de", 1, "x"), (5, "b", "de", 1, "x"), (5, "b", "fr", 1, "x\n"), (2**63 - 1, "a", "", 0, ""), (7, "q", "de", 3, "long\n" * 50_000)]


def run(spark, rows, tmp_path, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({"_tree": F.lit(1), "leaf": F.lit("x"), "_rank": F.lit(0), "path": F.lit(2)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle_manifest(spark, str(tmp_path))
    return got, [tuple(r)[:7] for r in got.collect()]


@pytest.mark.parametrize("levels_of_a_block, parts", [(1, 3), (2, 7), (7, 1)])
def test_equals_plain_trees(spark, tmp_path, monkeypatch, levels_of_a_block, parts):
    monkeypatch.setattr(merkle, "LEVELS", levels_of_a_block)
    got, rows = run(spark, ROWS, tmp_path, parts)
    assert got.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(rows, key=str) == sorted(brute(ROWS), key=str)
    assert {r[6] for r in rows} == {True, False}


@pytest.mark.parametrize("rows", [made(1, None), made(3, "a"), [r for s in "abcdefghijk" for r in made(1, s)]])
def test_small_tables(spark, tmp_path, rows):
    assert sorted(run(spark, rows, tmp_path)[1], key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path)[1] == []


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 9, 10, 26, 27, 28, 80, 81, 82, 100])
def test_positions_follow_completion(leaves):
    levels_above = merkle.height(leaves)
    log = merkle.append_all([h(str(i)) for i in range(leaves)], levels_above)
    tree = levels([h(str(i)) for i in range(leaves)])
    assert len(log) == sum(map(len, tree))
    for level, nodes in enumerate(tree):
        assert [log[merkle.position(level, i, leaves)] for i in range(len(nodes))] == nodes


def test_log_is_contiguous_and_ends_in_the_roots(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    docs = spark.createDataFrame(made(100, "b") + made(9, "c"), SCHEMA)
    rows, tiers = merkle.manifest(docs)
    log = [tuple(r) for r in merkle.log_rows(tiers).collect()]
    assert len(tiers) == 3 and len(log) == len(set(r[:3] for r in log))
    for tree in ("+b", "+c"):
        for tier in range(3):
            at = sorted(r[2] for r in log if r[:2] == (tree, tier))
            assert at == list(range(len(at)))
    ends = {r["_tree"]: r["root"] for r in merkle.roots(tiers).collect()}
    plain = {t: levels([leaf_of(r) for r in sorted(rows, key=lambda r: r[0])])[-1][0] for t, rows in (("+b", made(100, "b")), ("+c", made(9, "c")))}
    assert ends == plain
