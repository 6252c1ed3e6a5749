"""Sealed tables: altered rows are located, equal tables agree."""

import hashlib

import pytest

from lotlight.operators import sealed

COLUMNS = ["k", "v"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def by_hand(rows, width):
    """Leaves and nodes in plain Python, for keys of one height."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = {}
    for k, v in rows:
        parts = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (k, v)]
        level.setdefault(k // width, []).append(sha("|".join(parts)))
    nodes = {n: (len(ds), sha(":".join(map(str, [len(ds), *[sum(int(d[8 * i : 8 * i + 8], 16) for d in ds) for i in range(8)]])))) for n, ds in level.items()}
    out, depth = {(0, n): x for n, x in nodes.items()}, 0
    while depth == 0 or max(nodes) > 0:
        depth, up = depth + 1, {}
        for n, x in sorted(nodes.items()):
            up.setdefault(n // 16, []).append((n, *x))
        nodes = {p: (sum(c[1] for c in cs), sha("|".join([str(sum(c[1] for c in cs)), *[f"{c[0]}:{c[2]}" for c in cs]]))) for p, cs in up.items()}
        out |= {(depth, n): x for n, x in nodes.items()}
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i * 3 % 997, None if i % 11 == 0 else f"é{i}") for i in range(600)] + [(5, "twice"), (5, "twice")]


def test_tree_equals_one_by_hand_on_any_partitions(spark, rows):
    want = by_hand(rows, 4)
    for n in (1, 7):
        got = {(r["level"], r["node"]): (r["n_rows"], r["digest"]) for r in sealed.tree(frame(spark, rows).repartition(n), "k", COLUMNS, 4).collect()}
        assert got == want


def test_one_altered_row_is_found(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    sealed.seal(frame(spark, rows), path, "k", COLUMNS, 4)
    altered = [(k, "forged" if (k, v) == rows[100] else v) for k, v in rows]
    ranges = sealed.unsealed(frame(spark, altered), path)
    assert [tuple(r) for r in ranges.collect()] == [(rows[100][0] // 4, *[sum(k // 4 == rows[100][0] // 4 for k, _ in rows)] * 2)]
    back = spark.read.parquet(path + "/rows")
    changes = sorted(tuple(r) for r in sealed.changed_rows(back, frame(spark, altered), ranges, "k", COLUMNS, 4).collect())
    assert changes == [("GONE", *rows[100], 1), ("NEW", rows[100][0], "forged", 1)]
    assert sealed.unsealed(frame(spark, rows[::-1]), path).count() == 0


def test_lost_copies_new_heights_and_null_keys(spark, rows):
    tree = lambda r: sealed.tree(frame(spark, r), "k", COLUMNS, 4)
    told = tree([*rows, (None, "a")])
    changed = lambda r: {x["node"] for x in sealed.changed_ranges(told, tree(r)).collect()}
    assert changed([*rows[:-1], (None, "a")]) == {1}
    assert changed([*rows, (None, "b")]) == {-1}
    assert changed([*rows, (None, "a"), (10**6, "far")]) == {10**6 // 4}
    assert changed([]) == {k // 4 for k, _ in rows} | {-1}
    assert sealed.changed_ranges(tree([]), tree([])).count() == 0
    with pytest.raises(Exception, match="negative key"):
        tree([(-5, "x")])


def test_empty_tables_and_an_altered_tree(spark, rows, tmp_path):
    path = str(tmp_path / "e")
    assert sealed.seal(frame(spark, []), path, "k", COLUMNS, 4).count() == 0
    assert sealed.unsealed(frame(spark, []), path).count() == 0
    assert [r["node"] for r in sealed.unsealed(frame(spark, [(9, "new")]), path).collect()] == [2]
    sealed.tree(frame(spark, rows), "k", COLUMNS, 4).write.mode("overwrite").parquet(f"{path}/tree")
    with pytest.raises(ValueError, match="sealed"):
        sealed.unsealed(frame(spark, rows), path)
