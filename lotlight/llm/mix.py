"""Mixing sources to target weights, with exact quotas of blocks.

The documents of a source lie end to end, in an order that depends on their
ids only, and make a line of words that is cut into blocks.  A source's target
is met to the word: every block is drawn as often as the target holds the
whole source, then blocks in a keyed order until the rest is reached, the last
of them in part.  A draw is one block of one source.

Draws are dealt to output shards of equal numbers of draws by a splitting
tree: a node's quotas go to its left half by one multivariate hypergeometric
draw and the rest goes right, so every shard's quotas are whole numbers that
add up exactly, and any part of the tree can be made anywhere from its node's
quotas and a seed.  A shard takes the next draws of each source's sequence.
These are disjoint, and a keyed bijection of block numbers says which blocks
they are.  Within a shard, draws are put in a keyed random order.

No task holds all sources or all shards: quotas are split for groups of
``STRATUM`` sources first, then within each group (the same distribution), then
each subtree of ``SUBTREE`` shards on its own.

Defined cases: a null text has no words; documents without words are taken
zero times; a null source is a source of its own, the last; null ids come first
and rows with the same id are taken by their size (equal rows are alike);
very long documents span many blocks; a source above three times its size
leaves the excess to the others; an empty table, and one without any words,
gives targets of zero; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, numbered, small_join
from .words import mix as scramble

#: Words of a block, draws of a shard, and how often a source may be taken.
BLOCK, SHARD, MOST = 512, 2048, 3
#: Sources of a group and shards of a subtree of the splitting tree.
STRATUM, SUBTREE = 4096, 1024
#: Weights by the place of a source.
WEIGHTS = (1, 2, 3)
SEED = 20

#: The characters that end a word, as a class.
SPACE = r"\x20\x09-\x0D"
ROUNDS = 6


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def documents(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Documents on their sources' lines: ``_before`` words lie ahead."""
    line = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit(","))  # by code point, null last
    thin = docs.select("doc_id", words(F.col("text")).alias("size"), line.alias("_line"), F.xxhash64(F.lit(SEED), F.col("doc_id")).alias("_turn"), *[F.col("text").alias("_text")] * keep_text)
    return cut(numbered(cut(thin), "_line", ["_turn", "doc_id", "size"] + ["_text"] * keep_text, "size"))


def targets(placed: DataFrame) -> DataFrame:
    """_line, source_size, target and the source's place ``_s``.

    Shares go by weight until no source is above ``MOST`` times its size; each
    round is one aggregate, and only its sums reach the driver."""
    sizes = placed.groupBy("_line").agg(F.sum("size").alias("source_size"))
    sources = numbered(cut(sizes.withColumn("_all", F.lit(0))), "_all", ["_line"]).select("_line", "source_size", F.col("_rank").alias("_s"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_s") % len(WEIGHTS) + 1).cast("int"))
    sources = cut(sources.withColumn("_weight", weight))
    share, above = 0.0, -1
    while True:
        full = F.col("_weight") * F.lit(share) > MOST * F.col("source_size") if above >= 0 else F.lit(False)
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, MOST * F.col("source_size")).otherwise(0)).alias("taken"),
            F.sum(F.when(full, 0).otherwise(F.col("_weight"))).alias("weight"), F.count_if(full).alias("above"),
        ).first()
        if row["above"] == above or not row["weight"]:
            break
        share, above = ((row["all"] or 0) - (row["taken"] or 0)) / row["weight"], row["above"]
    return sources.withColumn("target", F.least(F.col("_weight") * F.lit(share), F.col("source_size") * float(MOST))).drop("_weight")


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A keyed bijection of 0 .. n - 1 (a Feistel network that is walked until
    it is inside); ``back`` inverts it."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = i.astype(np.uint64), np.arange(len(i))
    while len(todo):
        x, h, m = out[todo], half[todo], mask[todo]
        left, right = x >> h, x & m
        for r in range(ROUNDS)[:: -1 if back else 1]:
            k = key[todo].astype(np.uint64) + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)
            if back:
                left, right = right ^ (scramble(left ^ scramble(k)) & m), left
            else:
                left, right = right, left ^ (scramble(right ^ scramble(k)) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def epoch_key(key: np.ndarray, epoch: np.ndarray) -> np.ndarray:
    return scramble(key.astype(np.uint64) ^ scramble(epoch.astype(np.uint64) + np.uint64(SEED)))


PLAN = "_s long, _blocks long, _short long, _key long, _quota long, _last long"


def quotas(sources: DataFrame) -> DataFrame:
    """Draws of each source: its number of blocks, the words of its short
    block, its number of draws and the words of the last of them."""

    def run(batches):
        for batch in batches:
            s, size, target, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            words = np.floor(target + 0.5).astype(np.int64)
            blocks = -(-size // BLOCK)
            short = size - (blocks - 1) * BLOCK
            epochs, rest = np.divmod(words, np.maximum(size, 1))
            place = permuted(blocks - 1, blocks, epoch_key(key, epochs), back=True)  # of the short block in the last order
            draws = -(-rest // BLOCK)
            draws += (place < draws) & (draws * BLOCK - (BLOCK - short) < rest)
            ahead = np.maximum(draws - 1, 0)
            last = rest - (ahead * BLOCK - np.where(place < ahead, BLOCK - short, 0))
            columns = [s, blocks, short, key, epochs * blocks + draws, np.where(draws > 0, last, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PLAN.split(", ")])

    key = F.xxhash64(F.lit(SEED), F.lit("line"), F.col("_line"))
    return cut(sources.filter("target >= 0.5").select("_s", "source_size", "target", key.alias("_key")).mapInArrow(run, PLAN))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """One draw; beyond the library's range by inversion around the mode."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    reach = 12 * math.isqrt(max(1, int(n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))))) + 50
    k = np.arange(max(low, mode - reach), min(high, mode + reach), dtype=np.float64)  # steps from k to k + 1
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    chance = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(chance - chance.max()))
    return max(low, mode - reach) + int(np.searchsorted(chance, rng.random() * chance[-1], side="right"))


def split(rng: np.random.Generator, quota: np.ndarray, n: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``n`` from ``quota``."""
    total = int(quota.sum())
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(quota, n, method="marginals")
    out = np.zeros_like(quota)
    for k, q in enumerate(quota.tolist()):
        out[k] = hypergeometric(rng, q, total - q, n)
        total, n = total - q, n - int(out[k])
    return out


def seeded(*parts: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(sha256(repr((SEED, *parts)).encode()).digest()[:16]))


def tree(quota: np.ndarray, first: np.ndarray, low: int, high: int, ends, width: int):
    """Nodes of at most ``width`` shards below a node that holds the shards
    ``low`` up to ``high``: their shards, quotas, and where these begin in
    each source's sequence.  ``ends(k)`` counts the draws of the shards before ``k``."""
    if high - low <= width:
        yield low, high, quota, first
        return
    middle = low + width * max(1, (high - low) // width // 2)
    left = split(seeded(low, high, width), quota, ends(middle) - ends(low))
    yield from tree(left, first, low, middle, ends, width)
    yield from tree(quota - left, first + left, middle, high, ends, width)


QUOTA = "_low long, _high long, _of long, _quota long, _first long"


def _rows(found) -> pa.Table:
    """Rows of ``QUOTA`` from (low, high, members, quotas, firsts), without zeros."""
    columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
    for low, high, of, quota, first in found:
        has = np.flatnonzero(quota)
        for c, x in zip(columns, (np.full(len(has), low), np.full(len(has), high), of[has], quota[has], first[has])):
            c.append(x)
    return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in columns], names=[c.split()[0] for c in QUOTA.split(", ")])


def shards(plan: DataFrame) -> DataFrame:
    """Quotas of every shard (shard, _s, _quota, _first) by the splitting tree."""
    total = plan.agg(F.sum("_quota")).first()[0] or 0
    count = -(-total // SHARD)
    subtree = SUBTREE

    def ends(k: int) -> int:
        return k * total // count

    def numbers(table: pa.Table, key: str, *names: str) -> list[np.ndarray]:
        table = table.sort_by(key)
        return [table[c].to_numpy() for c in names]

    def top(table: pa.Table) -> pa.Table:
        of, quota = numbers(table, "_stratum", "_stratum", "_quota")
        return _rows((low, high, of, q, f) for low, high, q, f in tree(quota, np.zeros_like(quota), 0, count, ends, subtree))

    def members(table: pa.Table, given: pa.Table) -> pa.Table:
        of, quota = numbers(table, "_s", "_s", "_quota")
        first = np.zeros_like(quota)

        def found():
            nonlocal quota, first
            for low, high, n in zip(*(x.tolist() for x in numbers(given, "_low", "_low", "_high", "_quota"))):
                own = split(seeded(int(of[0]), low, 1), quota, n)
                yield low, high, of, own, first
                quota, first = quota - own, first + own

        return _rows(found())

    def leaves(table: pa.Table) -> pa.Table:
        of, quota, first = numbers(table, "_of", "_of", "_quota", "_first")
        low, high = table["_low"][0].as_py(), table["_high"][0].as_py()
        return _rows((a, b, of, q, f) for a, b, q, f in tree(quota, first, low, high, ends, 1))

    strata = plan.withColumn("_stratum", F.floor(F.col("_s") / STRATUM).cast("long"))
    per = strata.groupBy("_stratum").agg(F.sum("_quota").alias("_quota")).withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(top, QUOTA)
    below = strata.select("_stratum", "_s", "_quota").groupBy("_stratum").cogroup(per.groupBy("_of")).applyInArrow(members, QUOTA)
    return below.groupBy("_low").applyInArrow(leaves, QUOTA).select(F.col("_low").alias("shard"), F.col("_of").alias("_s"), "_quota", "_first")


DRAWS = "shard long, _s long, draw long, block long, words long"


def draws(plan: DataFrame, quota: DataFrame, sources: int) -> DataFrame:
    """One row a draw: its shard, its number in its source's sequence, its
    block and how many of the block's words it takes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                shard, s, n, first, blocks, short, key, all_draws, last = (batch.slice(at, 256).column(k).to_numpy() for k in range(9))
                of = np.repeat(np.arange(len(n)), n)
                draw = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                epoch, i = np.divmod(draw, blocks[of])
                block = permuted(i, blocks[of], epoch_key(key[of], epoch))
                words = np.where(block == blocks[of] - 1, short[of], BLOCK)
                words = np.where(draw == all_draws[of] - 1, np.minimum(words, last[of]), words)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (shard[of], s[of], draw, block, words)], names=[c.split()[0] for c in DRAWS.split(", ")])

    known = plan.withColumnRenamed("_quota", "_draws")
    joined = small_join(quota, known, ["_s"], sources).select("shard", "_s", "_quota", "_first", "_blocks", "_short", "_key", "_draws", "_last")
    return joined.mapInArrow(run, DRAWS)


def pieces(placed: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """Parts of documents by block: _s, block, _rank, doc_id, the first word
    of the part in the block (``_from``) and in the document (``begin``), and its ``_words``."""
    end = F.col("_before") + F.col("size")
    rows = small_join(placed.filter("size > 0"), sources.select("_line", "_s"), ["_line"], count)
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("_before") / BLOCK), F.floor((end - 1) / BLOCK))))
    at = F.col("block") * BLOCK
    rows = rows.withColumn("_from", F.greatest(F.col("_before"), at) - at).withColumn("_words", F.least(end, at + BLOCK) - at - F.col("_from"))
    return rows.withColumn("begin", at + F.col("_from") - F.col("_before"))


def mixed(docs: DataFrame, keep_text: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix, the placed documents and the sources with their targets.

    The mix has one row for each part of a document in a draw: shard, place
    (order in the shard), _s, draw, doc_id, _rank, begin (first word) and
    words, and ``text`` (``keep_text``): the part as written, with the white
    space behind each word."""
    placed = documents(docs, keep_text)
    sources = cut(targets(placed))
    count = sources.count()
    plan = quotas(sources)
    every = cut(draws(plan, shards(plan), count))
    parts = pieces(placed, sources, count).select("_s", "block", "doc_id", "_rank", "begin", "_from", "_words", *["_text"] * keep_text)
    taken = F.least(F.col("_words"), F.col("words") - F.col("_from"))
    out = every.join(parts, ["_s", "block"]).withColumn("words", taken).filter("words > 0")
    out = out.withColumn("turn", F.xxhash64(F.lit(SEED), "shard", "_s", "draw"))
    columns = ["shard", "turn", "_s", "draw", "block", "doc_id", "_rank", "begin", "words", "_from"]
    if keep_text:
        own = F.slice(F.regexp_extract_all("_text", F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0)), (F.col("begin") + 1).cast("int"), F.col("words").cast("int"))
        out = out.withColumn("text", F.array_join(own, ""))
        columns.append("text")
    return out.select(*columns), placed, sources


#: The order of a shard's rows: draws at random, parts of a block as they lie.
ORDER = ["turn", "_s", "draw", "_from"]


def write(mix: DataFrame, path: str) -> None:
    """Write the mix by shard, each in its order; no shard is larger than ``SHARD * BLOCK`` words."""
    mix.repartition("shard").sortWithinPartitions("shard", *ORDER).write.parquet(path)


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, from the mix's rows."""
    mix, placed, sources = mixed(docs, keep_text=False)
    count = sources.count()
    sums = mix.groupBy("_s", "_rank").agg(F.sum("words").alias("taken"))
    known = small_join(placed.select("doc_id", "size", "_line", "_rank"), sources, ["_line"], count)
    out = known.join(sums, ["_s", "_rank"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
