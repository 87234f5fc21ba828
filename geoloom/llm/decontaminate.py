"""Benchmark decontamination by a prefix-filtered set join (operator 9).

A window is 13 consecutive words of a benchmark item.  Its shingles (four words) are ordered by
their frequency in the documents; containment must be exact, so one shingle, the rarest, is the
whole prefix that a document has to hold.  A document's shingles are looked up among these
prefixes; a hit at position p of a shingle that stands at offset o of its window says where the
window would start (positional bound) and that it must fit (length bound), and the words there
are then compared as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import small_batches, stage
from .words import U64, WordHashes, shingles, signed, slices, texts

WINDOW, SHINGLE = 13, 4
#: Windows that one pass over the documents looks for; more are done in further passes.
BLOCK = 50_000
#: bytes.translate table: A-Z in lower case, and every other ASCII byte but 0-9 and a-z to a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def item_words(text: bytes) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_FOLD).split()


def _windows(size: int, k: int):
    """Items -> their distinct windows with the hashes of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), texts(batch)):
                words = item_words(text)
                held = dict.fromkeys(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else ()
                rows += [(item, b" ".join(w), signed(shingles(known.of(list(w)), min(k, len(w)))).tolist()) for w in held]
            items, windows, hashes = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(windows, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["item_id", "window", "shingles"],
            )

    return run


class Found:
    """Sorted hashes behind a bit table, for a fast test of which values are among them."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(U64))
        bits = max(10, min(24, int(len(self.values) * 32).bit_length()))
        self.shift = U64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.values >> self.shift] = True

    def positions(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.table[h >> self.shift])
        if len(at) and len(self.values):
            k = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
            return at[self.values[k] == h[at]]
        return at[:0]


def _lengths(shingle: int, lengths: set[int]) -> list[int]:
    """The shingle sizes in use: shorter windows have shorter shingles."""
    return sorted({min(shingle, n) for n in lengths})


def _frequencies(index, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sizes = index.value
        known, total = WordHashes(), np.zeros(len(found.values), np.int64)
        for batch in slices(batches):
            for text in texts(batch):
                h = known.of(item_words(text))
                for s in sizes:
                    if len(h) >= s:
                        g = shingles(h, s)
                        total += np.bincount(np.searchsorted(found.values, g[found.positions(g)]), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(signed(found.values[seen])), pa.array(total[seen])], names=["shingle", "n"])

    return run


def _scan(index):
    """Documents -> doc_id and, for each document with a window, its hit words and its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, by_prefix, sizes = index.value
        known = WordHashes()
        for batch in slices(batches):
            counts, spans, items = [], [], []
            for text in texts(batch):
                words = item_words(text)
                h, hit, seen = known.of(words), [], set()
                for s in sizes:
                    if len(h) < s:
                        continue
                    g = shingles(h, s)
                    for p in found.positions(g).tolist():
                        for offset, window, of in by_prefix.get((s, int(g[p])), ()):
                            at = p - offset
                            if at >= 0 and at + len(window) <= len(words) and words[at : at + len(window)] == window:
                                hit.append((at, at + len(window)))
                                seen.update(of)
                counts.append(len(words))
                spans.append([x for s in sorted(set(hit)) for x in s])
                items.append(sorted(seen))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=["uid", "doc_id", "text_crc32", "n_words", "spans", "items"],
            )

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and items of all passes -> the numbers per document."""
    for batch in slices(batches):
        n_hit, n_items, digests = [], [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
            n, end = 0, 0
            for a, b in sorted(zip(spans[::2], spans[1::2])):
                n += max(0, b - max(a, end))
                end = max(end, b)
            n_hit.append(n)
            held = sorted(set(items))
            n_items.append(len(held))
            digests.append(hashlib.sha256(",".join(held).encode()).hexdigest())
        n_words = batch.column("n_words")
        bad = [h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words.to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_crc32"), n_words, pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests), pa.array(bad, pa.bool_())],
            names=["doc_id", "text_crc32", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


JUDGED = "doc_id long, text_crc32 long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``doc_id, text_crc32, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``documents``.

    documents(doc_id, text), benchmark(item_id, text).  An item of fewer words than a window is
    one window; an item without words, or a null item_id, has none.  A null text has no words.
    contaminated: at least one word in twenty stands inside an occurrence of a window.  Rows are
    judged one by one, so null or repeated doc_ids and repeated rows all come back; items with
    one text all count.  With an empty benchmark nothing is hit.  Other columns are ignored.

    The windows are looked for in blocks of ``block``, each sent to the tasks (under 100 MB); every further block is a further pass over the documents.
    """
    spark = documents.sparkSession
    small_batches(spark)
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    listed = items.mapInArrow(_windows(window, shingle), "item_id string, window binary, shingles array<long>")
    # of equal windows, one; with the items that hold it
    windows = listed.groupBy("window").agg(F.first("shingles").alias("shingles"), F.collect_set("item_id").alias("items"))
    windows = stage(windows, "windows")
    blocks = -(-windows.count() // block)
    windows = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(max(1, blocks))))
    docs = documents.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.col("text").cast("string")).alias("text_crc32"), F.col("text").cast("string").alias("text")
    )
    if blocks > 1:
        docs = stage(docs, "documents")
    passes = [_pass(docs, windows.where(F.col("block") == b).collect(), shingle) for b in range(blocks)] or [_pass(docs, [], shingle)]
    if len(passes) == 1:
        return passes[0].drop("uid").mapInArrow(_judge, JUDGED)
    both = passes[0]
    for more in passes[1:]:
        more = more.toDF("uid", "doc_id2", "text_crc322", "n_words2", "spans2", "items2")
        both = both.join(more, "uid").select(
            "uid", "doc_id", "text_crc32", "n_words", F.concat("spans", "spans2").alias("spans"), F.concat("items", "items2").alias("items")
        )
    return both.drop("uid").mapInArrow(_judge, JUDGED)


def _pass(docs: DataFrame, rows: list[T.Row], shingle: int) -> DataFrame:
    """One block of windows against all documents."""
    spark = docs.sparkSession
    windows = [(r.window.split(b" "), np.array(r.shingles, np.int64).view(U64), list(r["items"])) for r in rows]
    sizes = _lengths(shingle, {len(w) for w, _, _ in windows})
    every = np.unique(np.concatenate([s for _, s, _ in windows])) if windows else np.empty(0, U64)
    counts: dict[int, int] = {}
    if windows:
        index = spark.sparkContext.broadcast((Found(every), sizes))
        sums = docs.select("text").mapInArrow(_frequencies(index, shingle), "shingle long, n long")
        # as many rows as the block has shingles, at most
        counts = {r.shingle: r.n for r in sums.groupBy("shingle").agg(F.sum("n").alias("n")).collect()}
    by_prefix: dict[tuple, list] = {}
    for words, hashes, items in windows:
        rarity = [counts.get(h, 0) for h in hashes.view(np.int64).tolist()]
        offset = min(range(len(rarity)), key=rarity.__getitem__)
        if rarity[offset]:  # else no document holds that shingle, and so none holds the window
            by_prefix.setdefault((min(shingle, len(words)), int(hashes[offset])), []).append((offset, words, items))
    found = Found(np.array([h for _, h in by_prefix], U64))
    index = spark.sparkContext.broadcast((found, by_prefix, sizes))
    return docs.mapInArrow(_scan(index), "uid long, doc_id long, text_crc32 long, n_words long, spans array<int>, items array<string>")
