"""Token-id files of independent zstandard frames with a trailing seek table.

Layout of a file: data frames, each holding the little-endian unsigned 32-bit
ids of consecutive documents; one skippable frame with the document index
(doc_id, frame, first id in the frame, ids; itself compressed; the frame of a
document without an id is stored as -1 - frame, and its doc_id as 0); last a
skippable frame with the seek table: for each data frame its compressed size,
decompressed size and the low 32 bits of the XXH64 of its content, then the
footer (frame count, descriptor, magic number).  Any zstandard decoder reads
the file as a whole; a reader that wants some documents decompresses only
their frames and checks each against its sum.

Defined cases: null and empty texts are documents of one end id; null doc_ids
come first and stay null; repeated
doc_ids stay separate documents, next to each other; an empty table gives no
file and no rows.  Every task attempt writes files of its own name, and only those
of successful attempts are in the manifest, so a lost executor leaves at most
files that nobody reads.
"""

from __future__ import annotations

import io
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import default_vocabulary, encoder
from .shared import cut, partitions, shared_dir
from .words import row_slices

#: Fixed values of the seekable zstandard format.
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
#: Another skippable frame, for the document index.
INDEX_MAGIC = 0x184D2A5D
CHECKED = 0x80

FRAME_IDS = 1 << 16
FILE_IDS = 1 << 25
LEVEL = 3
END_ID = 2

MANIFEST = "path string, first_doc long, n_docs long, n_ids long"


class FileWriter:
    """Writes documents' ids to one file; memory holds one frame at a time."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        import zstandard

        self.out, self.frame_ids = out, frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held: list[bytes] = []
        self.held_ids = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, frame = len(ids) // 4, len(self.frames)
        self.docs.append((0, -1 - frame, self.held_ids, n) if doc_id is None else (doc_id, frame, self.held_ids, n))
        self.held.append(ids)
        self.held_ids += n
        self.n_ids += n
        if self.held_ids >= self.frame_ids:
            self._frame()

    def _frame(self) -> None:
        import xxhash

        if not self.held:
            return
        raw = b"".join(self.held)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.held_ids = [], 0

    def finish(self) -> None:
        self._frame()
        index = self.packer.compress(np.array(self.docs, dtype="<i8").tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKED, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + len(footer)) + table + footer)


class FileReader:
    """Random access to a token file through any seekable binary file."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor()
        size = file.seek(0, io.SEEK_END)
        n, kind, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or kind != CHECKED:
            raise ValueError("not a token file: its footer is missing")
        table_at = size - 9 - 12 * n
        self.frames = np.frombuffer(self._at(table_at, 12 * n), dtype="<u4").reshape(-1, 3)
        sizes = self.frames[:, 0].astype(np.int64)
        self.where = np.concatenate([[0], np.cumsum(sizes)])
        magic, n_index = struct.unpack("<II", self._at(int(self.where[-1]), 8))
        if magic != INDEX_MAGIC:
            raise ValueError("not a token file: its index is missing")
        self.docs = np.frombuffer(self.unpack.decompress(self._at(int(self.where[-1]) + 8, n_index)), dtype="<i8").reshape(-1, 4)

    def _at(self, where: int, n: int) -> bytes:
        self.file.seek(where)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash

        raw = self.unpack.decompress(self._at(int(self.where[k]), int(self.frames[k, 0])))
        if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw

    def read(self, doc_ids: set[int | None] | None = None):
        """(doc_id, first id in the file, ids) of all documents or those
        asked for; frames without a document asked for are not read."""
        begins = np.concatenate([[0], np.cumsum(self.docs[:, 3])])
        open_frame, raw = -1, b""
        for (doc, k, at, n), start in zip(self.docs.tolist(), begins.tolist()):
            if k < 0:
                doc, k = None, -1 - k
            if doc_ids is not None and doc not in doc_ids:
                continue
            if k != open_frame:
                open_frame, raw = k, self.frame(k)
            yield doc, start, raw[4 * at : 4 * (at + n)]


def write(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = END_ID, frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files below ``folder`` in ascending
    doc_id order; returns the manifest, one row per file.

    The texts are dealt by ranges of doc_id once, before they are encoded;
    each task streams its range into files of at most about ``file_ids`` ids.
    ``folder`` is any address that pyarrow's file systems open, shared by all machines.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    path = vocabulary or default_vocabulary()
    fs, top = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    fs.create_dir(top, recursive=True)

    def run(batches):
        enc = encoder(path, end_id)
        files, top = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        out = writer = name = None

        def close():
            writer.finish()
            out.close()
            return pa.RecordBatch.from_pylist([{"path": name, "first_doc": None if writer.docs[0][1] < 0 else writer.docs[0][0], "n_docs": len(writer.docs), "n_ids": writer.n_ids}])

        for batch in batches:
            for lo, n in row_slices(batch.column(1)):
                part = batch.slice(lo, n)
                ids, count = enc.encode(part.column(1))
                raw, at = ids.astype("<u4").tobytes(), 0
                for doc, m in zip(part.column(0).to_pylist(), (count * 4).tolist()):
                    if writer is None:
                        name = f"{top}/{uuid.uuid4().hex}.ids.zst"
                        out = files.open_output_stream(name, compression=None)
                        writer = FileWriter(out, frame_ids)
                    writer.add(doc, raw[at : at + m])
                    at += m
                    if writer.n_ids >= file_ids:
                        yield close()
                        writer = None
        if writer is not None:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return cut(ordered.mapInArrow(run, MANIFEST))


def read(manifest: DataFrame, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the manifest's files.

    ``start`` counts the ids of all earlier files (column ``base`` of
    ``with_starts``; without it 0) and those before it in its own.
    """
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches):
        files, _ = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with files.open_input_file(name) as file:
                    held, size = [], 0
                    for doc, start, ids in FileReader(file).read(wanted):
                        held.append((doc, base + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 1 << 21:
                            yield _rows(held)
                            held, size = [], 0
                    if held:
                        yield _rows(held)

    base = F.col("base") if "base" in manifest.columns else F.lit(0).cast("long").alias("base")
    return manifest.select("path", base).repartition(partitions(manifest.sparkSession), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=["doc_id", "start", "n_tokens", "ids"])


def with_starts(manifest: DataFrame) -> DataFrame:
    """Add ``base``, the number of ids in all earlier files.  One row per file
    of some 128 MB; the running sum is over those few rows."""
    before = Window.orderBy(F.asc_nulls_first("first_doc"), "path").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def write_and_read(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Round trip: doc_id, start (ids of all documents before it), n_tokens, ids."""
    folder = folder or shared_dir(docs.sparkSession)
    manifest = write(docs, folder, vocabulary, end_id)
    return read(with_starts(manifest), folder)
