"""Exact nearest neighbours of a stated query set among all vectors.

Queries are taken in blocks of about ``BLOCK``, dealt by a hash, so that the driver
never holds more than one; each block is one pass over all vectors, in which every task keeps its best ``k`` per query, and the tasks'
bests are merged.  No pair of rows is ever emitted beyond these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BLOCK = 2000
#: Vectors that a task compares with a block at a time, which bounds its memory
#: (some 60 MB) whatever the size of a batch.
SLICE = 1024
NEAR = "query long, vec_id long, cosine double"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest other vectors of each query by cosine, ties by id."""
    spark = vectors.sparkSession
    asked = queries.filter("embedding is not null").select("vec_id", "embedding")
    blocks = math.ceil(asked.count() / BLOCK)
    parts = None
    for number in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).orderBy("vec_id").toArrow()
        if not block.num_rows:
            continue
        q = _matrix(block["embedding"].combine_chunks())
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((block["vec_id"].to_numpy(), q / np.where(norm > 0, norm, 1)))

        def run(batches, shared=shared):
            name, unit = shared.value
            # the best of each query so far: its place among the queries, cosine and vector
            at, score, who = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
            for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
                v = _matrix(batch.column(1))
                size = np.linalg.norm(v, axis=1, keepdims=True)
                own = batch.column(0).to_numpy()
                near = (v / np.where(size > 0, size, 1)) @ unit.T
                near[own[:, None] == name[None, :]] = -np.inf
                rounded = np.round(near, 9)
                least = np.partition(rounded, max(len(v) - k, 0), axis=0)[max(len(v) - k, 0)]
                row, query = np.nonzero((rounded >= least) & np.isfinite(near))  # all ties with the last one
                at, score, who = np.concatenate([at, query]), np.concatenate([score, near[row, query]]), np.concatenate([who, own[row]])
                order = np.lexsort((who, -np.round(score, 9), at))
                at, score, who = at[order], score[order], who[order]
                best = np.arange(len(at)) - np.searchsorted(at, at) < k
                at, score, who = at[best], score[best], who[best]
            yield pa.RecordBatch.from_arrays([pa.array(name[at]), pa.array(who), pa.array(score)], names=["query", "vec_id", "cosine"])

        rows = vectors.filter("embedding is not null").select("vec_id", "embedding").mapInArrow(run, NEAR)
        parts = rows if parts is None else parts.unionByName(rows)
    if parts is None:
        return spark.createDataFrame([], NEAR + ", place int")
    order = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 9)), "vec_id")
    return parts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


#: Dates up to which every item is taken for every date.
DATES = 16
#: Lists of an index at most, vectors of a part of a list, and lists probed first.
LISTS, PART, FIRST = 4096, 20_000, 3
_EPS = 1e-7

_LISTS = "list int, key string, first_seen date, angle double, unit array<double>"
_PAIRS = "query long, as_of date, list int, least double, embedding array<float>"
_FOUND = "query long, as_of date, key string, cosine double"


def _units(column: pa.Array) -> np.ndarray:
    m = _matrix(column)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def _nested(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1] or 1), pa.int32()), pa.array(m.ravel()))


class AsOfIndex:
    """Lists of vectors around centroids, each vector with its angle to the
    centroid and the date it was first seen.

    The centroids are a bounded sample of the vectors (the root of their
    number, at most ``LISTS``); every vector is in the index.  A list is cut
    into parts of about ``PART`` vectors, so one that holds most vectors is
    still many tasks.  Search is exact: by the triangle inequality of angles, a
    list whose centroid is further from a query than the best ``k`` so far and
    the list's radius holds no better one; lists first seen at or after the
    query's date are never read.
    """

    def __init__(self, vectors: DataFrame):
        """vectors: key, embedding, first_seen; rows without any of them are left out."""
        spark = vectors.sparkSession
        held = vectors.dropna(subset=["key", "embedding", "first_seen"]).select("key", "first_seen", "embedding")
        wanted = min(LISTS, max(1, math.isqrt(held.count())))
        sample = held.select("embedding", F.xxhash64("key").alias("h"), "key").orderBy("h", "key").limit(wanted).toArrow()
        self.centroids = spark.sparkContext.broadcast(_units(sample["embedding"].combine_chunks()) if sample.num_rows else np.zeros((0, 1)))
        centroids = self.centroids

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    unit = _units(batch.column(2))
                    near = unit @ centroids.value.T
                    best = near.argmax(axis=1)
                    angle = np.arccos(np.clip(near[np.arange(len(best)), best], -1, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), batch.column(0), batch.column(1), pa.array(angle), _nested(unit)], names=[c.split()[0] for c in _LISTS.split(", ")])

        lists = written(held.select("key", "first_seen", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(assign, _LISTS))
        # at most LISTS rows
        facts = lists.groupBy("list").agg(F.max("angle").alias("radius"), F.min("first_seen").alias("since"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        self.facts = written(facts)
        self.lists = lists.join(F.broadcast(self.facts.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")

    def _probe(self, queries: DataFrame, chosen) -> DataFrame:
        """Queries (query, as_of, embedding, least) with the lists that
        ``chosen(angles, bounds, least)`` marks, among those seen before the date."""
        centroids, kept = self.centroids, self.facts.select("list", "radius", "since").orderBy("list").toArrow()

        def run(batches):
            number, radius, since = kept["list"].to_numpy(), kept["radius"].to_numpy(), kept["since"].to_numpy()
            for batch in batches:
                if not batch.num_rows or not len(number):
                    continue
                unit = _units(batch.column(2))
                angle = np.arccos(np.clip(unit @ centroids.value[number].T, -1, 1))
                angle[since[None, :] >= batch.column(1).to_numpy(zero_copy_only=False)[:, None]] = np.inf
                row, at = np.nonzero(chosen(angle, angle - radius, batch.column(3).to_numpy()) & np.isfinite(angle))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(number[at], pa.int32()), batch.column(3).take(pa.array(row)), batch.column(2).take(pa.array(row))], names=["query", "as_of", "list", "least", "embedding"])

        pairs = _PAIRS.replace("array<float>", dict(queries.dtypes)["embedding"])  # as given: floats are half as long
        return queries.select("query", "as_of", "embedding", "least").mapInArrow(run, pairs)

    def _scan(self, pairs: DataFrame, k: int) -> DataFrame:
        """The best ``k`` of each query in each part of its lists; none that
        is worse than ``least``, the worst of ``k`` that are known."""

        def run(asked: pa.Table, held: pa.Table) -> pa.Table:
            names = [c.split()[0] for c in _FOUND.split(", ")]
            if not len(asked) or not len(held):
                return pa.table([pa.array([], t) for t in (pa.int64(), pa.date32(), pa.string(), pa.float64())], names=names)
            held = held.sort_by("key")
            v, seen = _matrix(held["unit"].combine_chunks()), held["first_seen"].to_numpy()
            q, dates, least = _units(asked["embedding"].combine_chunks()), asked["as_of"].to_numpy(), asked["least"].to_numpy()
            rows, places, scores = [], [], []
            for lo in range(0, len(q), 512):
                near = np.where(seen[None, :] < dates[lo : lo + 512, None], q[lo : lo + 512] @ v.T, -np.inf)
                order = np.argsort(-np.round(near, 9), axis=1, kind="stable")[:, :k]  # ties by key
                row = np.repeat(np.arange(len(near)), order.shape[1])
                score = near[row, order.ravel()]
                good = np.isfinite(score) & (score >= least[lo + row] - 2e-9)  # ties are to nine digits
                rows, places, scores = [*rows, lo + row[good]], [*places, order.ravel()[good]], [*scores, score[good]]
            row, place = pa.array(np.concatenate(rows)), pa.array(np.concatenate(places))
            return pa.table([asked["query"].take(row), asked["as_of"].take(row), held["key"].take(place), pa.array(np.concatenate(scores))], names=names)

        parts = pairs.join(F.broadcast(self.facts.select("list", "parts")), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return parts.groupBy("list", "part").cogroup(self.lists.groupBy("list", "part")).applyInArrow(run, _FOUND)

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: query, as_of, embedding.  The ``k`` nearest keys of each
        query among those first seen before its date: query, as_of, key,
        cosine and rank (by cosine to nine digits, then key)."""
        order = Window.partitionBy("query", "as_of").orderBy(F.desc(F.round("cosine", 9)), "key")

        def best(rows: DataFrame) -> DataFrame:
            return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        asked = queries.dropna(subset=["as_of", "embedding"]).select("query", "as_of", "embedding")
        first = lambda angle, bound, least: angle <= np.partition(angle, min(FIRST, angle.shape[1]) - 1, axis=1)[:, [min(FIRST, angle.shape[1]) - 1]]
        near = written(best(self._scan(self._probe(asked.withColumn("least", F.lit(-2.0)), first), k)))
        worst = near.groupBy("query", "as_of").agg(F.when(F.count("*") >= k, F.min("cosine")).alias("least"))
        told = asked.join(worst, ["query", "as_of"], "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
        rest = lambda angle, bound, least: ~first(angle, bound, least) & (bound <= np.arccos(np.clip(least, -1, 1))[:, None] + _EPS)
        return best(near.drop("rank").unionByName(self._scan(self._probe(told, rest), k)))


def newest_items(found: DataFrame, texts: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """The newest visible items of the found texts: found (query, as_of, key,
    cosine, rank) with the text's hash as key, texts (key, text), items
    (lot_id, part, text, publish_date).  Texts meet by their hash and must
    then be equal, so texts that share a hash stay apart.

    A text's newest items at a date are cut once, before the queries that
    found it meet them: many queries may find a text that many items have."""
    found = written(found)
    asked = found.select("key", "as_of").distinct().join(texts, "key").select("text", "key", "as_of")
    dates = found.select("as_of").distinct()
    if dates.count() <= DATES:  # each task cuts its items before any is moved
        rows = items.crossJoin(F.broadcast(dates)).filter(F.col("publish_date") < F.col("as_of"))
    else:
        rows = items.join(asked.select("text", "as_of").distinct(), "text").filter(F.col("publish_date") < F.col("as_of"))
    order = Window.partitionBy("as_of", "text").orderBy(F.desc("publish_date"), "lot_id", "part")
    newest = rows.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= limit).join(asked, ["as_of", "text"])
    return found.join(newest.select("key", "as_of", "text", "lot_id", "part"), ["key", "as_of"]).select("query", "as_of", "lot_id", "part", "cosine", "rank")


def restricted(semantic: DataFrame, k: int) -> DataFrame:
    """The same search with a smaller number of texts."""
    return semantic.filter(F.col("rank") <= k)
