"""Token-id files of independent zstandard frames (operator 4).

Layout of a file (all integers little-endian):

* frames: zstandard, each of up to ``frame_ids`` ids as unsigned 32-bit integers, cut without
  regard to documents;
* directory: a skippable frame (magic 0x184D2A50) whose payload is a zstandard frame of, for
  each document in order, doc_id (int64), validity of doc_id (uint8), number of ids (uint64),
  as three arrays one behind the other;
* seek table: the skippable frame of the zstandard seekable format (magic 0x184D2A5E): for each
  frame its compressed size, decompressed size and checksum (low 32 bits of XXH64 of the
  decompressed bytes), then the number of frames, the descriptor 0x80 and the magic 0x8F92EAB1.

The directory also counts as a frame of decompressed size 0 in the seek table, so any reader of
the seekable format finds its way.  Files hold documents in ascending order of doc_id, file
after file.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import new_path, small_batches, stage
from .tokens import default_tokenizer, encoded
from .words import batches_of

DIRECTORY_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FRAME_IDS = 1 << 16


class TokenFileWriter:
    """Writes documents, in the order given, to a binary stream; holds one frame at a time."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3):
        self.out, self.frame_bytes, self.zstd = out, 4 * frame_ids, zstandard.ZstdCompressor(level)
        self.held, self.held_bytes, self.seek = [], 0, []
        self.doc_ids, self.valid, self.counts = [], bytearray(), []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= self.frame_bytes:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.held)
        n = len(data) if last else len(data) - len(data) % self.frame_bytes
        for i in range(0, n, self.frame_bytes):
            self._frame(data[i : min(n, i + self.frame_bytes)])
        self.held, self.held_bytes = [data[n:]], len(data) - n

    def _frame(self, raw: bytes) -> None:
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.seek.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush(True)
        raw = np.array(self.doc_ids, "<i8").tobytes() + bytes(self.valid) + np.array(self.counts, "<u8").tobytes()
        packed = self.zstd.compress(raw)
        self.out.write(struct.pack("<II", DIRECTORY_MAGIC, len(packed)) + packed)
        self.seek.append(struct.pack("<III", len(packed) + 8, 0, 0))
        table = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class TokenFileReader:
    """Reads the seek table and the directory; then only the frames that a request touches."""

    def __init__(self, source, size: int):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        n, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or descriptor != 0x80:
            raise ValueError("not a token file: its seek table is missing")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.checks = table[:, :2], table[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.offsets = np.concatenate([[0], np.cumsum(table[: n - 1, 1])])
        raw = self.zstd.decompress(self._at(int(self.starts[n - 1]) + 8, int(table[n - 1, 0]) - 8))
        docs = len(raw) // 17
        self.doc_ids, self.valid = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "u1", docs, 8 * docs)
        self.counts = np.frombuffer(raw, "<u8", docs, 9 * docs).astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        self.last = (-1, b"")

    def _at(self, position: int, length: int) -> bytes:
        self.source.seek(position)
        return self.source.read(length)

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            raw = self.zstd.decompress(self._at(int(self.starts[i]), int(self.sizes[i, 0])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[i]:
                raise ValueError(f"frame {i} is damaged: its checksum differs")
            self.last = (i, raw)
        return self.last[1]

    def ids(self, k: int) -> bytes:
        """The ids of the file's k-th document, as bytes."""
        at, end = 4 * int(self.firsts[k]), 4 * int(self.firsts[k + 1])
        i, out = int(np.searchsorted(self.offsets, at, "right")) - 1, []
        while at < end:
            raw, base = self.frame(i), int(self.offsets[i])
            out.append(raw[at - base : end - base])
            at, i = base + len(raw), i + 1
        return b"".join(out)

    def find(self, doc_id: int) -> list[int]:
        """Places of the documents with this doc_id; the valid ids ascend."""
        skip = int((self.valid == 0).sum())
        lo, hi = (int(np.searchsorted(self.doc_ids[skip:], doc_id, side)) + skip for side in ("left", "right"))
        return list(range(lo, hi))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write(folder: str, tokenizer: str, end_id: int, frame_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, store, out, writer, n = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:8]}.tok", None, None, None, 0
        for batch, ids in encoded(batches, tokenizer, end_id):
            if writer is None:
                store, at = _open(folder)
                store.create_dir(at, recursive=True)
                out = store.open_output_stream(f"{at}/{path.rpartition('/')[2]}")
                writer = TokenFileWriter(out, frame_ids)
            for doc_id, x in zip(batch.column(0).to_pylist(), ids):
                writer.add(doc_id, x)
                n += len(x) // 4
        if writer is not None:
            writer.close()
            out.close()
            yield from batches_of(
                iter([(part, path, len(writer.counts), n)]),
                pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    return run


def write_token_files(
    documents: DataFrame, end_id: int = 1, tokenizer: str | None = None, folder: str | None = None, frame_ids: int = FRAME_IDS
) -> DataFrame:
    """Write the ids of ``documents(doc_id, text)`` in ascending doc_id; returns the manifest.

    Manifest, one row per file: part, path, n_docs, n_ids, start (ids in all files before it).
    A file that a lost attempt of a task left is in no manifest.  Null texts are empty (only the
    end id is written); null doc_ids come first; rows that share a doc_id are ordered by
    a hash of the text, then by text, and repeated rows are all written.  Other columns are ignored; an empty table gives no file.
    """
    spark = documents.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "token-files")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]  # ranges are cut in this order too, by ids and hashes alone
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    write = _write(folder, tokenizer or default_tokenizer(), end_id, frame_ids)
    files = stage(rows.mapInArrow(write, "part int, path string, n_docs long, n_ids long"), "manifest")
    # one row per file: a file holds a partition, so their number is bounded by the partitions
    starts, total = [], 0
    for row in files.select("part", "n_ids").orderBy("part").collect():
        starts.append((row.part, total))
        total += row.n_ids
    return files.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, at = _open(path)
                with store.open_input_file(at) as source:
                    reader = TokenFileReader(source, source.size())
                    for k in range(len(reader.counts)):
                        doc_id = int(reader.doc_ids[k]) if reader.valid[k] else None
                        yield doc_id, start + int(reader.firsts[k]), int(reader.counts[k]), reader.ids(k)

    yield from batches_of(rows(), schema, 500)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of the files; ids as unsigned 32-bit bytes."""
    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(documents: DataFrame, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Write, read back, and digest: ``doc_id, start, n_tokens, ids_crc32``."""
    back = read_token_files(write_token_files(documents, end_id, tokenizer))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def read_bytes(data: bytes) -> TokenFileReader:
    """A reader over a file held in memory."""
    return TokenFileReader(io.BytesIO(data), len(data))


def crc_of(ids: bytes) -> int:
    return zlib.crc32(ids)
