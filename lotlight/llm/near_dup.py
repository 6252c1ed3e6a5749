"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

One pass makes a sketch of each document: the size and a 128-bit fingerprint
of its shingle set, band keys of its minima, and a packed signature of the
low two bits of every minimum.  Documents of equal sets form a class, and only
one representative of a class goes on.  Representatives that share a band key
are candidates; bit counts of packed signatures, corrected for chance
collisions, estimate their similarity; what may reach the threshold is
confirmed on the whole shingle sets.

A band key that many representatives share is never expanded into all pairs.
Every representative is compared with two pivots of the keys it has, and
connected components are found.  Keys, pivots, hubs, classes and shingles that hold
very many rows are counted, and joined by broadcast or in parts.  Within a component further links change
nothing, so only keys with members of different components go on.  For their
members a prefix filter finds every pair across components that can still
reach the threshold: with all shingles in one order, rare ones first, two sets
of that similarity have their first common one so early in each that as many
as they need to share can follow.  What it finds is estimated and confirmed
as before, so components are exact but for the links missed.

Missed links: two documents at the threshold of 0.8 share no band with
probability (1 - 0.8 ** 6) ** 32, some 6.0e-5, and their estimate lies more than
``SLACK`` below it with a probability of 2.3e-6 (binomial), which holds for pairs
of the prefix filter too; together some 6.2e-5, and less above the threshold.

Defined cases: a null or empty text, or one without words, has no shingles and
is linked with nothing; a text shorter than a shingle is one shingle;
repeated rows stay and share their component; a null doc_id is kept, unlinked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import HOT, cut, hot_keys, skew_join
from .words import distinct, mix, odd, row_slices, shingles, split, text_bytes

BANDS = 32
ROWS = 6
HASHES = BANDS * ROWS
BITS = 2
#: The estimate's standard deviation at 0.8 is 0.035; nearly five of them are allowed for.
SLACK = 0.17
#: Counters of the shingle order (bounded, whatever the corpus).
SLOTS = 1 << 16
#: Tasks over which a hot shingle is dealt.
SALTS = 32

SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"


def _sketch_part(column: pa.Array, k: int) -> tuple:
    words = split(*text_bytes(column))
    sh, row = distinct(*shingles(words, words.hashes(), k))
    n = np.bincount(row, minlength=len(column)).astype(np.int64)
    full = np.flatnonzero(n)
    begins = (np.cumsum(n) - n)[full]
    set_a = np.zeros(len(column), np.uint64)
    set_b = np.zeros(len(column), np.uint64)
    minima = np.zeros((len(column), HASHES), np.uint32)
    if len(full):
        set_a[full] = np.add.reduceat(mix(sh), begins)
        set_b[full] = np.add.reduceat(mix(sh ^ np.uint64(0x5851F42D4C957F2D)), begins)
        low = (sh >> np.uint64(32)).astype(np.uint32)
        for j, a in enumerate((odd(HASHES, 5) >> np.uint64(16)).astype(np.uint32) | np.uint32(1)):
            minima[full, j] = np.minimum.reduceat(low * a, begins)
    bands = np.zeros((len(column), BANDS), np.uint64)
    scale = odd(ROWS, 23)
    for j in range(ROWS):
        bands += minima[:, j::ROWS].astype(np.uint64) * scale[j]
    bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = (mix(minima.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    spread = ((low[:, :, None] >> np.arange(BITS, dtype=np.uint8)) & 1).transpose(0, 2, 1).reshape(len(column), -1)
    bits = np.packbits(spread, axis=1, bitorder="little").view("<i8")
    return n, set_a.view(np.int64), set_b.view(np.int64), bands.view(np.int64), bits


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """One sketch per row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for lo, n in row_slices(batch.column(1)):
                part = batch.slice(lo, n)
                count, a, b, bands, bits = _sketch_part(part.column(1), k)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1))) for x in (bands, bits)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), pa.array(a), pa.array(b), *lists], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures: the share of equal ``BITS``-bit
    values, less what chance gives.  Bit planes lie one after another, so a
    value is equal where no plane differs."""
    per = HASHES // 64
    equal = sum(
        (F.bit_count(F.bitwise_not(_any([F.col(f"{a}")[p * per + i].bitwiseXOR(F.col(f"{b}")[p * per + i]) for p in range(BITS)]))) for i in range(per)),
        F.lit(0),
    )
    chance = 1 / (1 << BITS)
    return (equal / F.lit(float(HASHES)) - chance) / (1 - chance)


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def confirm(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have 100 * common >= threshold * union.

    Pairs are dealt in chunks of one ``a`` and a bounded number of ``b``; a
    chunk receives the text of its ``a`` once and that of each ``b``.
    ``texts`` is (id, text).
    """
    pairs = cut(pairs)
    most = pairs.groupBy("a").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, math.ceil(most / 64))
    chunked = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    wanted = chunked.select("a", "salt", F.col("b").alias("id")).unionByName(chunked.select("a", "salt", F.col("a").alias("id")).distinct())
    dealt = wanted.join(texts.hint("merge"), "id").repartition(F.col("a"), F.col("salt"))
    dealt = dealt.select("a", "salt", "id", (F.col("a") != F.col("id")).alias("other"), "text").sortWithinPartitions("a", "salt", "other")

    def run(batches):
        base, members = None, None
        for batch in batches:
            for lo, n in row_slices(batch.column(4)):
                part = batch.slice(lo, n)
                words = split(*text_bytes(part.column(4)))
                sh, row = distinct(*shingles(words, words.hashes(), k))
                at = np.searchsorted(row, np.arange(n + 1))
                found = []
                for i, (a, b, other) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist())):
                    own = sh[at[i] : at[i + 1]]
                    if not other:
                        base, members = a, own.copy()
                        continue
                    if base != a or not len(members) or not len(own):
                        continue
                    where = np.minimum(np.searchsorted(members, own), len(members) - 1)
                    common = int(np.count_nonzero(members[where] == own))
                    if 100 * common >= threshold * (len(own) + len(members) - common):
                        found.append((a, b))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of all linked nodes.

    Smallest labels pass along links and then jump to the label of the label,
    until nothing changes; every round is written, so lineage stays short.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = hot_keys(edges, ["b"])
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = skew_join(edges, labels.toDF("b", "component"), ["b"], hubs).groupBy("a").agg(F.min("component").alias("m"))
        passed = cut(labels.join(near.hint("merge"), labels["node"] == near["a"]).select("node", F.least("component", "m").alias("component"), F.col("component").alias("was")))
        up = passed.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = cut(skew_join(passed, up, ["component"]).select("node", F.col("next").alias("component"), (F.col("next") != F.col("was")).alias("moved")))
        labels = jumped.select("node", "component")
        if not jumped.filter("moved").take(1):
            return labels


def _slots(texts: DataFrame, k: int) -> np.ndarray:
    """How many shingles of all texts fall into each of ``SLOTS`` slots."""

    def run(batches):
        n = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for lo, m in row_slices(batch.column(0)):
                words = split(*text_bytes(batch.column(0).slice(lo, m)))
                sh, _ = distinct(*shingles(words, words.hashes(), k))
                n += np.bincount((sh % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["slot", "n"])

    got = texts.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, dtype=np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def prefixes(texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """id, each shingle of its set's prefix in the order of (slot count, hash),
    its place there, the one before it and the size of the set."""
    counts = texts.sparkSession.sparkContext.broadcast(_slots(texts, k))

    def run(batches):
        for batch in batches:
            for lo, m in row_slices(batch.column(1)):
                part = batch.slice(lo, m)
                words = split(*text_bytes(part.column(1)))
                sh, row = distinct(*shingles(words, words.hashes(), k))
                order = np.lexsort((sh, counts.value[(sh % np.uint64(SLOTS)).astype(np.int64)], row))
                sh, row = sh[order], row[order]
                n = np.bincount(row, minlength=m)
                place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                keep = place <= (n - -(-threshold * n // 100))[row]
                before = pa.array(np.roll(sh, 1)[keep].view(np.int64), mask=place[keep] == 0)
                columns = [part.column(0).take(pa.array(row[keep])), pa.array(sh[keep].view(np.int64)), before, pa.array(place[keep]), pa.array(n[row[keep]])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "shingle", "before", "place", "size"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingle long, before long, place long, size long")


def across(texts: DataFrame, named: DataFrame, k: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components that share a prefix shingle after
    which as many can follow in both as the threshold asks for.

    ``named`` is (id, component).  Per shingle, rows outside its largest
    component meet all rows; rows within it never meet each other.  Where the
    shingles before are equal too, the pair has met there already.
    """
    rows = cut(prefixes(texts, k, threshold).join(named.hint("merge"), "id"))
    held = rows.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    mixed = held.groupBy("shingle").agg(F.max_by("component", "n").alias("major"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    rows = cut(rows.join(cut(mixed).hint("merge"), "shingle"))
    own = lambda c, x: F.col(c).alias(f"{c}_{x}")
    minor = rows.filter("component != major").select("shingle", F.col("id").alias("a"), F.col("component").alias("ca"), own("place", "a"), own("size", "a"), own("before", "a"))
    other = rows.select("shingle", F.col("id").alias("b"), F.col("component").alias("cb"), "major", own("place", "b"), own("size", "b"), own("before", "b"))
    apart = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("a") < F.col("b")))
    need = F.ceil(threshold * (F.col("size_a") + F.col("size_b")) / (100 + threshold) - 1e-9)
    follow = (F.col("place_a") + need <= F.col("size_a")) & (F.col("place_b") + need <= F.col("size_b"))
    new = F.coalesce(F.col("before_a") != F.col("before_b"), F.lit(True))
    # a shingle of very many rows is dealt over several tasks by its other rows
    hot = F.broadcast(hot_keys(rows, ["shingle"]).withColumn("_hot", F.lit(True)))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    minor = minor.join(hot, "shingle", "left").withColumn("_salt", F.explode(salts)).drop("_hot")
    other = other.join(hot, "shingle", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    met = minor.join(other.hint("merge"), ["shingle", "_salt"]).filter(apart & follow & new)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    ``docs`` (doc_id, text) is read more than once and must be stable.
    Merge joins are asked for where both sides grow with the corpus, so that
    the plan is the same at every size.
    """
    sk = cut(sketch(docs, k))
    key = ["set_a", "set_b", "n_shingles"]
    real = sk.filter("n_shingles > 0 and doc_id is not null")
    groups = cut(real.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    reps = sk.filter("n_shingles > 0").join(groups.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    reps = reps.select(F.col("doc_id").alias("rep"), "bands", "bits")
    banded = reps.select("rep", F.explode("bands").alias("band"))
    shared = cut(banded.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("n")).filter("low < high"))
    # bands and classes of very many rows; one in 20,000 rows or more, so few
    total = sk.count()
    hot = cut(shared.filter(F.col("n") > max(HOT, BANDS * total // 20_000)).select("band"))
    members = cut(skew_join(banded, shared.drop("n"), ["band"], hot))
    star = cut(members.groupBy("rep").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    ids = star.select(F.col("rep").alias("id"))
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi"))
    bits = cut(sk.select(F.col("doc_id").alias("id"), "bits").join(ids.hint("merge"), "id", "left_semi"))

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs whose estimate may reach the threshold; many may have the same ``a``."""
        with_b = cut(pairs.join(bits.toDF("b", "bits_b").hint("merge"), "b"))
        both = skew_join(with_b, bits.toDF("a", "bits_a"), ["a"])
        return both.filter(estimate("bits_a", "bits_b") >= threshold / 100 - SLACK).select("a", "b").distinct()

    near = star.select(F.col("low").alias("a"), F.col("rep").alias("b")).unionByName(star.select(F.col("high").alias("a"), F.col("rep").alias("b")))
    links = cut(confirm(likely(near.filter("a != b").distinct()), texts, k, threshold))
    found = components(links)

    named = members.select("band", F.col("rep").alias("id")).join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    named = cut(named.withColumn("component", F.coalesce("component", "id")))
    mixed = cut(named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band"))
    rest = cut(skew_join(named, mixed, ["band"], hot).select("id", "component").distinct())
    open_texts = cut(texts.join(rest.select("id").hint("merge"), "id", "left_semi"))
    more = cut(confirm(likely(across(open_texts, rest, k, threshold)), open_texts, k, threshold))
    if more.take(1):
        found = components(links.unionByName(more))
    labels = found.select(F.col("node").alias("doc_id"), F.col("component").alias("label"))
    classes = groups.filter("n > 1").join(labels.withColumnRenamed("doc_id", "rep").hint("merge"), "rep", "left").withColumn("of_class", F.coalesce("label", "rep"))
    hot = cut(groups.filter(F.col("n") > max(HOT, total // 20_000)).select(*key))
    out = skew_join(sk.select("doc_id", *key), classes.select(*key, "of_class"), key, hot, how="left")
    out = out.join(labels.hint("merge"), "doc_id", "left")
    component = F.coalesce("of_class", "label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
