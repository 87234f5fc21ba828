"""Operator 12: ranked lexical search turned round: the items' inverted index goes to the documents.

The terms of the items (of a bounded block of them) are broadcast with their postings; every task
streams its documents' term counts through it and keeps one bounded heap an item.  The heaps are
merged in two steps, by item and salt, then by item.

Nulls: a text without terms, or a null one, takes no part in the statistics and has no hits; a null
doc_id is ranked behind the others of its score.  Rows that repeat are documents of their own and get
ranks of their own; rows of ``items`` that share an item_id as well, each with its own list.  Empty
tables give no rows.  Of the tables only ids and texts are read, so further columns clash with nothing.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import small_batches
from .words import slices, texts

#: What a text is cut by: every ASCII byte but letters and digits becomes a space, A-Z lower case.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Postings of a block of items: its index is broadcast, some 100 MB at most.
POSTINGS = 500_000
#: Heaps of an item are merged in so many parts first.
SALTS = 32
LAST = 2**63 - 1


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


class Index:
    """Postings of items' terms: of term number t the places ``items[first[t] : first[t + 1]]``."""

    def __init__(self, items: list[set[bytes]]):
        self.number: dict[bytes, int] = {}
        pairs = [(self.number.setdefault(t, len(self.number)), k) for k, words in enumerate(items) for t in sorted(words)]
        pairs.sort()
        of = np.array([t for t, _ in pairs], np.int64)
        self.items = np.array([k for _, k in pairs], np.int64)
        self.first = np.searchsorted(of, np.arange(len(self.number) + 1))
        self.size = len(items)

    def counts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the index's terms in a document, and how often each occurs."""
        known = [t for t in map(self.number.get, words) if t is not None]
        return np.unique(np.array(known, np.int64), return_counts=True)

    def scores(self, found: np.ndarray, tf: np.ndarray, weights: np.ndarray, m: int) -> np.ndarray:
        """Every item's score for a document."""
        parts = weights[found] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        n = self.first[found + 1] - self.first[found]
        at = np.arange(n.sum()) + np.repeat(self.first[found] - np.cumsum(n) + n, n)
        out = np.zeros(self.size, np.int64)
        np.add.at(out, self.items[at], np.repeat(parts, n))
        return out


def _blocks(items: DataFrame, most: int) -> Iterator[tuple[list, list[set[bytes]]]]:
    """Items in blocks of at most ``most`` postings (an item of more is a block of its own): ids, terms."""
    ids, words, n = [], [], 0
    for item_id, text in items.select("item_id", F.col("text").cast("string")).toLocalIterator():
        some = set(terms((text or "").encode()))
        if n and n + len(some) > most:
            yield ids, words
            ids, words, n = [], [], 0
        if some:
            ids.append(item_id)
            words.append(some)
            n += len(some)
    if n:
        yield ids, words


def _statistics(docs: DataFrame, index) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and in how many documents each term of the index is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = index.value
        df, n, total = np.zeros(len(idx.number), np.int64), 0, 0
        for batch in slices(batches):
            for text in texts(batch):
                words = terms(text)
                n, total = n + bool(words), total + len(words)
                df[idx.counts(words)[0]] += 1
        at = np.flatnonzero(df)
        keys = np.concatenate([[-2, -1], at])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate([[n, total], df[at]]), pa.int64())], ["key", "n"])

    counted = docs.select("text").mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = {k: n for k, n in counted.collect()}  # at most one row a term of the index
    df = np.zeros(len(index.value.number), np.int64)
    for k, n in found.items():
        if k >= 0:
            df[k] = n
    return found.get(-2, 0), found.get(-1, 0), df


def _search(docs: DataFrame, index, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The heaps of all tasks: place of the item, doc_id, score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = index.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in range(idx.size)]
        least = np.ones(idx.size, np.int64)  # what a score has to reach
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch)):
                words = terms(text)
                found, tf = idx.counts(words)
                if not len(found):
                    continue
                scores = idx.scores(found, tf, weights, 10 + 90 * len(words) * n_docs // n_terms)
                for i in np.flatnonzero(scores >= least).tolist():
                    entry, heap = (int(scores[i]), -(LAST if doc_id is None else doc_id)), heaps[i]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        least[i] = heap[0][0]
        rows = [(i, None if d == -LAST else -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        for a in range(0, len(rows), 20_000):
            columns = zip(*rows[a : a + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return docs.mapInArrow(work, "item long, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, postings: int = POSTINGS) -> DataFrame:
    """Per row of ``items`` its ``k`` documents of highest score above 0: item_id, rank, doc_id, score.

    A block of items costs two passes over the documents: one for their terms' statistics, one for the
    heaps.  ``postings`` bounds what a block broadcasts; more items make more blocks.
    """
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for ids, words in _blocks(items, postings):
        index = spark.sparkContext.broadcast(Index(words))
        n_docs, n_terms, df = _statistics(docs, index)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        best = _search(docs, index, weights, n_docs, n_terms, k)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for part in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], ["item"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"item long, item_id {kind}")
        found.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)
