"""Merkle manifest of a table: an append log of tree nodes and proofs from it.

Every row is a leaf.  Leaves of one source, in order of their ids, form a tree
of runs of three; the sources' roots, in order of the sources, form the tree
above.  No tree is built by one task: *aligned builders* each take ``FAN **
LEVELS`` consecutive leaves of one source and append their nodes in order of
completion (postorder), so each builder's segment of the log is contiguous and
all but a source's last have the same size.  The builders' roots are the
leaves of the next tier.  A node's place in a segment follows from subtree
sizes alone (``position``), so proofs address siblings without any pointers.

Log rows: ``_tree`` (source), ``_tier``, ``_block``, ``_leaves`` (of the
segment), ``_height`` and ``_nodes``, the digests in order of completion;
``log_rows`` gives one row a node with its position.

Places of leaves come from a range sort on (source, id, digest), which is
written, and running counts of the sorted partitions: a source that holds most
rows is spread like all others.

Defined cases: a null column is written ``-``, an empty text ``0:``; a null
source is a source of its own and the first; null ids come first within their
source; rows with the same id go by their leaf's digest (equal rows have equal
digests, so their order doesn't matter to any root); a lone leaf is its
source's root and a lone source's root is the root, with the empty proof; very
long texts are hashed whole inside the JVM; other columns are ignored,
whatever their names; an empty table gives an empty log and no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, numbered

#: Children of a node, and levels of an aligned builder's subtree.
FAN, LEVELS = 3, 7

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def widths(leaves: int, height: int) -> list[int]:
    """Nodes of each level over so many leaves."""
    return [-(-leaves // FAN**level) for level in range(height + 1)]


def height(leaves: int) -> int:
    """Levels above the leaves of a whole tree."""
    level = 0
    while FAN**level < leaves:
        level += 1
    return level


def position(level: int, i: int, leaves: int) -> int:
    """Place in the log of node ``i`` of a level: the nodes that the leaves
    before its subtree complete, and the subtree's own size."""
    first = i * FAN**level
    own = min(leaves - first, FAN**level)
    before, x = 0, first
    while x:
        before, x = before + x, x // FAN
    return before + sum(widths(own, level)) - 1


def append_all(leaves: list[str], levels: int) -> list[str]:
    """Nodes over ``leaves`` in order of completion."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def close(level: int) -> None:
        parent = digest(*open_runs[level])
        open_runs[level].clear()
        log.append(parent)
        open_runs[level + 1].append(parent)

    for leaf in leaves:
        log.append(leaf)
        open_runs[0].append(leaf)
        level = 0
        while level < levels and len(open_runs[level]) == FAN:
            close(level)
            level += 1
    for level in range(levels):  # the last runs may be short
        if open_runs[level]:
            close(level)
    return log


def siblings(nodes: list[str], leaves: int, levels: int) -> list[list[str]]:
    """For each leaf, what stands left and right of it on each level."""
    rows = [[nodes[position(level, i, leaves)] for i in range(width)] for level, width in enumerate(widths(leaves, levels)[:-1])]
    sides = []  # of each level, by node
    for row in rows:
        runs = [row[i : i + FAN] for i in range(0, len(row), FAN)]
        sides.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
    return [[s for level, of in enumerate(sides) for s in of[j // FAN**level]] for j in range(leaves)]


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for k in range(0, len(path), 2):
        leaf = digest(path[k], leaf, path[k + 1])
    return leaf


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(fields: dict[str, Column] | None = None) -> Column:
    """A row's digest; ``fields`` replaces some of its columns."""
    given = {c: F.col(c) for c in FIELDS} | (fields or {})
    return F.sha2(F.concat(*[_field(given[c]) for c in FIELDS]).cast("binary"), 256)


def leaves(docs: DataFrame, **more: Column) -> DataFrame:
    """doc_id, leaf, the given columns, ``_tree`` and the leaf's place ``_rank`` among the ``_n`` of its tree."""
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(""))  # null first, then by bytes
    thin = docs.select("doc_id", leaf().alias("leaf"), *[c.alias(k) for k, c in more.items()], tree.alias("_tree"))
    return numbered(cut(thin), "_tree", ["doc_id", "leaf"])


LOG = "_tree string, _tier int, _block long, _blocks long, _leaves int, _height int, _nodes array<string>"


def _segments(rows: DataFrame, tier: int) -> DataFrame:
    """Segments of one tier from its leaves (_tree, _rank, _n, leaf)."""
    size = FAN**LEVELS

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rank")
        n, block = table["_n"][0].as_py(), table["_rank"][0].as_py() // size
        levels = LEVELS if n > size else height(n)
        nodes = append_all(table["leaf"].to_pylist(), levels)
        row = [table["_tree"][0].as_py(), tier, block, -(-n // size), len(table), levels, nodes]
        return pa.table([pa.array([x], t) for x, t in zip(row, KINDS)], names=NAMES)

    keyed = rows.select("_tree", "_rank", "_n", "leaf", F.floor(F.col("_rank") / size).cast("long").alias("_block"))
    return cut(keyed.groupBy("_tree", "_block").applyInArrow(build, LOG))


NAMES = [x.split()[0] for x in LOG.split(", ")]
KINDS = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]


def build(rows: DataFrame) -> list[DataFrame]:
    """The log's tiers over numbered leaves, the lowest first."""
    most = rows.agg(F.max("_n")).first()[0] or 0
    tiers = [_segments(rows, 0)]
    while most > FAN**LEVELS:
        most = -(-most // FAN**LEVELS)
        above = tiers[-1].filter("_blocks > 1")
        tiers.append(_segments(above.select("_tree", F.col("_block").alias("_rank"), F.col("_blocks").alias("_n"), F.element_at("_nodes", -1).alias("leaf")), len(tiers)))
    return tiers


def roots(tiers: list[DataFrame]) -> DataFrame:
    """_tree and root: the last node of the only segment of a tree's last tier."""
    ends = [t.filter("_blocks = 1").select("_tree", F.element_at("_nodes", -1).alias("root")) for t in tiers]
    out = ends[0]
    for end in ends[1:]:
        out = out.unionByName(end)
    return out


def log_rows(tiers: list[DataFrame]) -> DataFrame:
    """The log, one row a node: _tree, _tier, position and node.  A block's
    segment begins at its number times the size of a whole one."""
    whole = sum(widths(FAN**LEVELS, LEVELS))
    rows = [t.select("_tree", "_tier", "_block", F.posexplode("_nodes").alias("_p", "node")) for t in tiers]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("_tree", "_tier", (F.col("_block") * whole + F.col("_p")).alias("position"), "node")


PATHS = "_tree string, _block long, path array<string>, subroot string, root string"


def _paths(tier: DataFrame, above: DataFrame) -> DataFrame:
    """Paths of a tier's leaves (which are blocks of the tier below) to the
    root, from the paths of its segments."""
    size = FAN**LEVELS

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = siblings(row["_nodes"], row["_leaves"], row["_height"])
                n, base = len(own), row["_block"] * size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["_tree"]] * n, pa.string()),
                        pa.array(range(base, base + n), pa.int64()),
                        pa.array([x + row["path"] for x in own], pa.list_(pa.string())),
                        pa.array([row["subroot"]] * n, pa.string()),
                        pa.array([row["root"]] * n, pa.string()),
                    ],
                    names=["_tree", "_block", "path", "subroot", "root"],
                )

    return cut(tier.join(above, ["_tree", "_block"]).select("_tree", "_block", "_leaves", "_height", "_nodes", "path", "subroot", "root").mapInArrow(run, PATHS))


def _ends(tiers: list[DataFrame], k: int, tops: DataFrame) -> DataFrame:
    """Paths of the trees that end with tier ``k``."""
    return tiers[k].filter("_blocks = 1").select("_tree", "_block").join(tops, "_tree")


def _descend(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of the segments of the lowest tier; ``tops`` has those of whole trees (_tree, path, subroot, root)."""
    paths = _ends(tiers, len(tiers) - 1, tops)
    for k in range(len(tiers) - 1, 0, -1):
        paths = _paths(tiers[k], paths).unionByName(_ends(tiers, k - 1, tops))
    return paths


def source_paths(tiers: list[DataFrame]) -> DataFrame:
    """_tree, path, subroot and root of each source: the tree of sources."""
    subroots = cut(roots(tiers).select(F.col("_tree").alias("_source"), F.col("root").alias("leaf"), F.lit("").alias("_tree")))
    order = numbered(subroots, "_tree", ["_source", "leaf"])
    upper = build(order)
    top = roots(upper).select("_tree", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), "root")
    found = _paths(upper[0], _descend(upper, top)).select(F.col("_block").alias("_rank"), "path", "root")
    return cut(order.join(found, "_rank").select(F.col("_source").alias("_tree"), "path", F.col("leaf").alias("subroot"), "root"))


def manifest(docs: DataFrame, **more: Column) -> tuple[DataFrame, list[DataFrame]]:
    """Numbered leaves and the tiers of the log."""
    rows = leaves(docs, **more)
    return rows, build(rows)


def prove(rows: DataFrame, tiers: list[DataFrame], changed: str = "leaf") -> DataFrame:
    """Proofs of all leaves, and the root that each proof and the digest in
    column ``changed`` lead to: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified, and ``path``'s number of digests."""
    size = FAN**LEVELS
    segments = tiers[0].join(_descend(tiers, source_paths(tiers)), ["_tree", "_block"]).select("_tree", "_block", "_leaves", "_height", "_nodes", "path", "subroot", "root")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(own: pa.Table, segment: pa.Table) -> pa.Table:
        s = segment.to_pylist()[0]
        near = siblings(s["_nodes"], s["_leaves"], s["_height"])
        own = own.sort_by("_rank")
        paths = [x + s["path"] for x in near]
        folded = [fold(x, path) for x, path in zip(own["_changed"].to_pylist(), paths)]
        n = len(own)
        return pa.table(
            {
                "doc_id": own["doc_id"], "leaf": own["leaf"], "subroot": pa.array([s["subroot"]] * n, pa.string()), "root": pa.array([s["root"]] * n, pa.string()),
                "proof_sha256": pa.array([digest(*path) for path in paths], pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == s["root"] for x in folded], pa.bool_()),
                "n_siblings": pa.array([sum(map(len, path)) // 64 for path in paths], pa.int32()),
            }
        )

    keyed = rows.select("doc_id", "leaf", F.col(changed).alias("_changed"), "_tree", "_rank", F.floor(F.col("_rank") / size).cast("long").alias("_block"))
    out = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_siblings int"
    return keyed.groupBy("_tree", "_block").cogroup(segments.groupBy("_tree", "_block")).applyInArrow(run, out)


def tampered() -> Column:
    """The leaf of a row as a copy would give it that has lost the line feeds
    of texts whose id has an even CRC-32; the leaf itself for all others."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even & F.contains(F.col("text"), F.lit("\n")), leaf({"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))})).otherwise(leaf())
