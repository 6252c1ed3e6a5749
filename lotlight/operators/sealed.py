"""Sealed tables: a tree of digests over ranges of an integer key.

A leaf is a range of ``width`` key values; a node above it covers ``FAN``
ranges below.  A leaf adds up its rows' SHA-256 digests in eight lanes, so it
is a mergeable sum that neither sorts nor gathers rows: a range with a third
of all rows is added up before the shuffle like any other.  Repeated rows
count as often as they occur.  A node's digest is that of its number of rows
and its children, so two tables differ where their roots do, and the way down
leads to the changed ranges.

Rows without a key belong to range -1, which is a child of no node but the
root.  Negative keys have no range: they raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

FAN = 16
LANES = 8
#: Nodes: level 0 are the leaves, the root is the only node of the highest level.
NODES = "level int, node long, n_rows long, digest string"


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: every value as its length in bytes and its text, a dash for a null."""
    one = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *one), 256)


def _range(key: str, width: int) -> Column:
    place = F.expr(f"cast(`{key}` div {width} as long)")
    return F.when(F.col(key).isNull(), F.lit(-1)).when(F.col(key) < 0, F.raise_error(F.lit("negative key")).cast("long")).otherwise(place)


def leaves(rows: DataFrame, key: str, columns: list[str], width: int) -> DataFrame:
    """One row a range that has rows: level 0, node, n_rows, digest."""
    digest = rows.select(_range(key, width).alias("node"), row_digest(columns).alias("_d"))
    lanes = [F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("long").alias(f"_{i}") for i in range(LANES)]
    # a lane is below 2^32, so its sum holds for 2^31 rows of a range
    added = digest.select("node", *lanes).groupBy("node").agg(F.count("*").alias("n_rows"), *[F.sum(f"_{i}").alias(f"_{i}") for i in range(LANES)])
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ("n_rows", *(f"_{i}" for i in range(LANES)))])
    return added.select(F.lit(0).alias("level"), "node", "n_rows", F.sha2(text, 256).alias("digest"))


def tree(rows: DataFrame, key: str, columns: list[str], width: int = 1024) -> DataFrame:
    """All nodes of a table's tree.  An empty table has none.

    A level is a sixteenth of the one below; as many levels are made as the
    largest key asks for, and each is one grouped aggregate of at most ``FAN``
    children a node (one more at the root)."""
    level = written(leaves(rows, key, columns, width))
    highest = level.agg(F.max("node")).first()[0]
    if highest is None:
        return level
    out, depth, top = level, 0, max(highest, 0)
    while top or depth == 0:
        depth, top = depth + 1, top // FAN
        # range -1 waits until the root
        parent = F.when(F.col("node") == -1, F.lit(-1 if top else 0)).otherwise(F.expr(f"node div {FAN}")).cast("long")
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        made = level.groupBy(parent.alias("_p")).agg(F.sum("n_rows").alias("n_rows"), children.alias("_c"))
        text = F.concat_ws("|", F.col("n_rows").cast("string"), F.array_join(F.transform("_c", lambda c: F.concat_ws(":", c.node.cast("string"), c.digest)), "|"))
        # where it only waits, range -1 keeps its digest
        digest = F.when((F.col("_p") == -1), F.col("_c")[0].digest).otherwise(F.sha2(text, 256))
        level = written(made.select(F.lit(depth).alias("level"), F.col("_p").alias("node"), "n_rows", digest.alias("digest")))
        out = out.unionByName(level)
    return out


def changed_ranges(sealed: DataFrame, now: DataFrame) -> DataFrame:
    """Leaves that differ between two trees of the same width: node, and the
    rows then and now (0 where a range is gone or new).

    From the root down, only children of differing nodes are compared, so
    equal tables end at their roots.  Trees of different height differ above
    the lower root and are compared by their leaves."""
    a, b = (t.agg(F.max("level")).first()[0] for t in (sealed, now))
    suspects = None
    for level in range(a, -1, -1) if a is not None and a == b else [0]:
        old = sealed.filter(F.col("level") == level).select("node", F.col("n_rows").alias("rows_then"), F.col("digest").alias("_a"))
        new = now.filter(F.col("level") == level).select("node", F.col("n_rows").alias("rows_now"), F.col("digest").alias("_b"))
        both = old.join(new, "node", "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
        if suspects is not None:
            up = F.when(F.col("node") == -1, F.lit(-1 if level < a - 1 else 0)).otherwise(F.expr(f"node div {FAN}")).cast("long")
            both = both.withColumn("_up", up).join(suspects.select(F.col("node").alias("_up")), "_up", "left_semi")
        suspects = written(both.select("node", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("rows_then", "rows_now")]))
    return suspects


def changed_rows(then: DataFrame, now: DataFrame, ranges: DataFrame, key: str, columns: list[str], width: int = 1024) -> DataFrame:
    """Rows of changed ranges that only one of the tables has: change (GONE or
    NEW), the columns and how often.  Equal rows cancel one by one."""

    def of(rows: DataFrame, sign: int) -> DataFrame:
        inside = rows.withColumn("_n", _range(key, width)).join(ranges.select(F.col("node").alias("_n")), "_n", "left_semi")
        return inside.select(*columns, F.lit(sign).alias("_s"))

    balance = of(then, -1).unionByName(of(now, 1)).groupBy(*columns).agg(F.sum("_s").alias("_s")).filter("_s <> 0")
    return balance.select(F.when(F.col("_s") > 0, "NEW").otherwise("GONE").alias("change"), *columns, F.abs("_s").alias("times"))


def _root(nodes: DataFrame) -> str:
    """Digest of the highest node; empty for a table without rows."""
    return nodes.agg(F.max_by("digest", "level")).first()[0] or ""


def seal(rows: DataFrame, path: str, key: str, columns: list[str], width: int = 1024) -> DataFrame:
    """Write a table's rows in ranges and order of their key, its tree beside
    them, and a manifest of one row: key, width, columns, root.  Returns the
    tree as written.  Parts hold whole ranges."""
    spark = rows.sparkSession
    place = rows.select(*columns).withColumn("_n", _range(key, width))
    place.repartitionByRange("_n").sortWithinPartitions("_n", *columns).drop("_n").write.option("compression", "zstd").parquet(f"{path}/rows")
    tree(rows, key, columns, width).write.parquet(f"{path}/tree")
    nodes = spark.read.schema(NODES).parquet(f"{path}/tree")
    told = spark.range(1).select(F.lit(key).alias("key"), F.lit(width).alias("width"), F.array(*map(F.lit, columns)).alias("columns"), F.lit(_root(nodes)).alias("root"))
    told.write.json(f"{path}/manifest")
    return nodes


def unsealed(rows: DataFrame, path: str) -> DataFrame:
    """Ranges in which ``rows`` differs from what was sealed at ``path``; a
    tree that doesn't end in the manifest's root raises."""
    spark = rows.sparkSession
    told = spark.read.schema("key string, width int, columns array<string>, root string").json(f"{path}/manifest").first()
    nodes = spark.read.schema(NODES).parquet(f"{path}/tree")
    if _root(nodes) != told["root"]:
        raise ValueError("the tree is not the sealed one")
    return changed_ranges(nodes, written(tree(rows, told["key"], list(told["columns"]), told["width"])))
