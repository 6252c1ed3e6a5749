"""Best-fit packing of token sequences by a plan over length counts.

Documents are never sorted or gathered to be packed.  Their pieces are
counted by length (at most ``max_len`` counts, however large the corpus);
best-fit decreasing runs over these counts and gives planned slots; then each
piece takes the slot that equals its rank within its length.  Ranks are made
within salted sub-groups of a length plus a running offset, so a length that
holds a third of all pieces is still spread over many tasks.

Defined cases: a null or empty text is one piece of one end id; a text with
more than ``max_len`` ids (end id included) is cut into full pieces and one
rest; repeated rows are packed separately; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import default_vocabulary, encoder
from .shared import cut, partitions
from .words import row_slices

MAX_LEN = 2048
END_ID = 0


def pieces(docs: DataFrame, vocabulary: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit)."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        enc = encoder(path, end_id)
        for batch in batches:
            for lo, n in row_slices(batch.column(1)):
                part = batch.slice(lo, n)
                ids, count = enc.encode(part.column(1))
                per = -(-count // max_len)
                doc = np.repeat(np.arange(n), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * max_len
                length = np.minimum(max_len, count[doc] - start)
                at = (np.cumsum(length) - length) * 4
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(doc)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([raw[a : a + m] for a, m in zip(at.tolist(), (length * 4).tolist())], pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], max_len: int = MAX_LEN) -> tuple[list[tuple], int]:
    """Best-fit decreasing over counts by length.

    Returns slots and the number of sequences.  A slot
    ``(length, first_rank, ranks, per_sequence, first_sequence, offset)`` says
    that the pieces of this length with ranks ``first_rank`` up to
    ``first_rank + ranks`` go, ``per_sequence`` each, into the sequences from
    ``first_sequence`` on, at ``offset``.

    Sequences that hold the same lengths form one group, so the work depends
    on the number of lengths, not of documents.  A step splits at most one
    group and a group's free space at least halves when it takes pieces, so
    there are at most ``2 * max_len`` groups and ``log2(max_len)`` times as many slots.
    """
    slots: list[tuple] = []
    free: dict[int, list[list[int]]] = {}  # free space -> [first sequence, sequences]
    made = 0
    for length in sorted((k for k, v in counts.items() if v > 0), reverse=True):
        left, rank = counts[length], 0
        for space in sorted(s for s in free if s >= length):
            if not left:
                break
            fit = space // length
            groups, keep = free.pop(space), []
            for first, n in groups:
                full = min(n, left // fit)
                if full:
                    slots.append((length, rank, full * fit, fit, first, max_len - space))
                    free.setdefault(space - fit * length, []).append([first, full])
                    rank, left, first, n = rank + full * fit, left - full * fit, first + full, n - full
                if n and 0 < left < fit:
                    slots.append((length, rank, left, left, first, max_len - space))
                    free.setdefault(space - left * length, []).append([first, 1])
                    rank, left, first, n = rank + left, 0, first + 1, n - 1
                if n:
                    keep.append([first, n])
            if keep:
                free.setdefault(space, []).extend(keep)
        if left:
            fit = max_len // length
            full, rest = divmod(left, fit)
            if full:
                slots.append((length, rank, full * fit, fit, made, 0))
                free.setdefault(max_len - fit * length, []).append([made, full])
                made, rank = made + full, rank + full * fit
            if rest:
                slots.append((length, rank, rest, rest, made, 0))
                free.setdefault(max_len - rest * length, []).append([made, 1])
                made += 1
    return slots, made


SLOTS = "length long, first_rank long, ranks long, per_sequence long, first_sequence long, slot_offset long"


def assign(table: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Add sequence_id and offset to a table of doc_id, piece, length, ...

    The table is read twice and must be stable (written, or a plain scan).
    """
    spark = table.sparkSession
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(counts, max_len)
    total = sum(counts.values())
    size = max(256, total // (4 * partitions(spark)))
    salts = max(1, math.ceil(max(counts.values(), default=0) / size))
    salted = table.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        salted.groupBy("length", "_salt")
        .agg(F.count("*").alias("_n"))
        .select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inner = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = (
        salted.withColumn("_row", F.row_number().over(inner))
        .join(base, ["length", "_salt"])
        .withColumn("_rank", F.col("_base") + F.col("_row") - 1)
    )
    where = (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("first_rank") + F.col("ranks"))
    planned = F.broadcast(spark.createDataFrame(slots, SLOTS).withColumnRenamed("length", "_length"))
    turn = F.col("_rank") - F.col("first_rank")
    return ranked.join(planned, (F.col("length") == F.col("_length")) & where).select(
        *table.columns,
        (F.col("first_sequence") + F.floor(turn / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + turn % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, vocabulary: str | None = None, max_len: int = MAX_LEN, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Packed pieces: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    table = pieces(docs, vocabulary, max_len, end_id).withColumn("ids_crc32", F.crc32("ids"))
    return assign(cut(table if keep_ids else table.drop("ids")), max_len)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence in one binary value (needs ``ids``)."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
        .select("sequence_id", F.expr("aggregate(_p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
    )
