"""Packing documents into windows by non-negative least squares (operator 5).

A document longer than the window gives full windows and a remainder.  Only the histogram of
remainder lengths (fewer bins than the window has tokens, whatever the corpus) reaches the
driver.  There: shallow combinations of lengths that fill a window exactly are enumerated,
their repeat counts solved against the histogram by non-negative least squares and rounded,
and what is left over is packed greedily, one cut closing each window.  The plan speaks of
"the r-th document of remainder length L"; the tasks turn ranks into places.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import small_batches, stage
from .tokens import default_tokenizer, encoded, forget
from .words import batches_of, slices

#: Parts into which the ranking of one length is split, so that no length meets in one task.
SALTS = 64


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int, common: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Exact fillings of up to three distinct lengths: (indices, multiplicities), -1 and 0 as padding.

    a times l; a times l and one m; and l, m, n for l, m among the ``common`` most frequent.
    """
    at = {int(x): i for i, x in enumerate(lengths)}
    found: dict[tuple, None] = {}
    for length in map(int, lengths):
        for a in range(1, window // length + 1):
            rest = window - a * length
            if rest == 0:
                found[((at[length], a),)] = None
            elif rest in at and rest != length:
                found[tuple(sorted(((at[length], a), (at[rest], 1))))] = None
    top = sorted(map(int, lengths[np.argsort(-counts, kind="stable")[:common]]))
    for i, x in enumerate(top):
        for y in top[i + 1 :]:
            if (z := window - x - y) in at and z not in (x, y):
                found[tuple(sorted((at[v], 1) for v in (x, y, z)))] = None
    index, times = np.full((len(found), 3), -1), np.zeros((len(found), 3))
    for k, combo in enumerate(found):
        for j, (i, a) in enumerate(combo):
            index[k, j], times[k, j] = i, a
    return index, times


def non_negative_least_squares(index: np.ndarray, times: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that makes A x close to ``counts``; A has ``times[k, j]`` at row ``index[k, j]``, column k.

    Multiplicative updates, which keep x non-negative and lower the squared error every round.
    """
    flat = np.where(index < 0, len(counts), index)
    h = np.append(counts.astype(float), 0.0)
    up = (times * h[flat]).sum(axis=1)
    x = np.full(len(index), counts.sum() / max(1.0, times.sum()))
    for _ in range(rounds):
        made = np.bincount(flat.ravel(), (times * x[:, None]).ravel(), minlength=len(h))
        x *= up / np.maximum((times * made[flat]).sum(axis=1), 1e-12)
    return x


class Pool:
    """Pieces not placed yet, by length, as runs of equal documents: (L, start, lo, hi)."""

    def __init__(self, histogram: dict[int, int]):
        self.runs = {n: [(n, 0, 0, c)] for n, c in histogram.items() if n and c}
        self.left = {n: c for n, c in histogram.items() if n and c}
        self.sorted = sorted(self.left)

    def take(self, length: int, m: int) -> list[tuple]:
        out, runs = [], self.runs[length]
        self.left[length] -= m
        while m:
            n, start, lo, hi = runs.pop()
            k = min(m, hi - lo)
            out.append((n, start, lo, lo + k))
            if lo + k < hi:
                runs.append((n, start, lo + k, hi))
            m -= k
        if not self.left[length]:
            del self.left[length], self.runs[length]
            self.sorted.pop(bisect_left(self.sorted, length))
        return out

    def put(self, length: int, run: tuple) -> None:
        if length not in self.left:
            self.left[length], self.runs[length] = 0, []
            insort(self.sorted, length)
        self.left[length] += run[3] - run[2]
        self.runs[length].append(run)


def make_plan(histogram: dict[int, int], window: int, first: int) -> tuple[dict, int]:
    """Places of all remainders: {L: (los, [[(start, length, lo, sequence, offset)]])}, next sequence id.

    For a document of remainder length L and rank r, the last ``los`` not above r gives its pieces;
    the one of ``sequence`` s at ``lo`` lies in sequence s + r - lo.
    """
    pool, slots, sequence = Pool(histogram), defaultdict(list), first

    def lay(runs: list[tuple], length: int, offset: int) -> None:
        at = sequence
        for n, start, lo, hi in runs:
            slots[n].append((lo, hi, start, length, at, offset))
            at += hi - lo

    lengths = np.array(pool.sorted, int)
    counts = np.array([pool.left[n] for n in pool.sorted], int)
    if len(lengths):
        index, times = combinations(lengths, counts, window)
        if len(index):
            x, left = non_negative_least_squares(index, times, counts), counts.copy()
            for k in np.argsort(-x, kind="stable"):
                parts = [(int(i), int(a)) for i, a in zip(index[k], times[k]) if i >= 0]
                m = min(int(x[k] + 0.5), *(int(left[i]) // a for i, a in parts))
                if m > 0:
                    offset = 0
                    for i, a in parts:
                        left[i] -= m * a
                        for _ in range(a):
                            lay(pool.take(int(lengths[i]), m), int(lengths[i]), offset)
                            offset += int(lengths[i])
                    sequence += m
    while pool.sorted:
        parts, gap, used = [], window, {}
        while gap and (k := bisect_right(pool.sorted, gap)):
            while k and pool.left[pool.sorted[k - 1]] <= used.get(pool.sorted[k - 1], 0):
                k -= 1
            if not k:
                break
            n = pool.sorted[k - 1]
            used[n] = a = min(gap // n, pool.left[n])
            parts.append((n, a))
            gap -= n * a
        m = min(pool.left[n] // a for n, a in parts) if parts else 1
        source = next((n for n in pool.sorted if n > gap and pool.left[n] > used.get(n, 0)), None) if gap else None
        if gap and source is None:
            # nothing left to cut: the last tokens go into sequences of powers of two, which need no padding
            sequence = _last(pool, parts, slots, sequence)
            continue
        if source is not None:
            m = min(m, pool.left[source] // (used.get(source, 0) + 1))
        offset = 0
        for n, a in parts:
            for _ in range(a):
                lay(pool.take(n, m), n, offset)
                offset += n
        if source is not None:
            runs = pool.take(source, m)
            lay(runs, gap, offset)
            for n, start, lo, hi in runs:
                pool.put(source - gap, (n, start + gap, lo, hi))
        sequence += m
    return {n: _segments(found) for n, found in slots.items()}, sequence


def _last(pool: Pool, parts: list[tuple], slots: dict, sequence: int) -> int:
    total = sum(n * a for n, a in parts)
    sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    room, offset = sizes.pop(0), 0
    for n, a in parts:
        for length, start, lo, hi in pool.take(n, a):
            for r in range(lo, hi):
                at = 0
                while at < n:
                    k = min(n - at, room)
                    slots[length].append((r, r + 1, start + at, k, sequence, offset))
                    at, room, offset = at + k, room - k, offset + k
                    if not room:
                        sequence, offset, room = sequence + 1, 0, sizes.pop(0) if sizes else 0
    return sequence


def _segments(found: list[tuple]) -> tuple[list[int], list[list[tuple]]]:
    edges = sorted({x for s in found for x in s[:2]})
    pieces: list[list[tuple]] = [[] for _ in edges]
    for lo, hi, start, length, sequence, offset in found:
        for k in range(bisect_left(edges, lo), bisect_left(edges, hi)):
            pieces[k].append((start, length, lo, sequence, offset))
    return edges, [sorted(p) for p in pieces]


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded(batches, tokenizer, end_id):
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n, pa.array(ids, pa.binary())], names=["uid", "doc_id", "n", "ids"])

    return run


PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _place(plan, window: int):
    schema = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in PIECE.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        forget()
        segments = plan.value
        for batch in slices(batches, 200):
            for doc_id, n, ids, rank, base in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "rank", "base"))):
                full = n // window
                for k in range(full):
                    yield doc_id, k * window, window, ids[4 * k * window : 4 * (k + 1) * window], n, base + k, 0
                if n % window:
                    los, pieces = segments[n % window]
                    for start, length, lo, sequence, offset in pieces[bisect_right(los, rank) - 1]:
                        at = full * window + start
                        yield doc_id, at, length, ids[4 * at : 4 * (at + length)], n, sequence + rank - lo, offset

    return lambda batches: batches_of(rows(batches), schema, 500)


def _local(spark: SparkSession, base: list[tuple[int, int]]) -> DataFrame:
    """(r, first) as a table; by Arrow, as a list of rows would start further Python workers on every executor."""
    r, first = zip(*base) if base else ((), ())
    return spark.createDataFrame(pa.table({"r": pa.array(r, pa.int64()), "first": pa.array(first, pa.int64())}))


def pack_documents(documents: DataFrame, window: int = 4096, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    Each document of ``documents(doc_id, text)`` becomes its ids with ``end_id`` behind, and each
    id lies in exactly one piece.  Null texts count as empty; every row is packed by itself, so
    null or repeated doc_ids and repeated rows are all kept.  Every sequence is full but the
    last few, whose lengths are powers of two.  Other columns are ignored; an empty table gives
    no piece.
    """
    spark = documents.sparkSession
    small_batches(spark)
    rows = documents.select(
        F.monotonically_increasing_id().alias("uid"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")
    )
    held = stage(rows.mapInArrow(_encode(tokenizer or default_tokenizer(), end_id), "uid long, doc_id long, n long, ids binary"), "ids")
    held = held.withColumns({"r": F.col("n") % window, "full": F.floor(F.col("n") / window), "salt": F.pmod(F.xxhash64("uid"), F.lit(SALTS))})
    # per remainder length and salt: how many documents and full windows; at most window * SALTS rows
    groups = stage(held.groupBy("r", "salt").agg(F.count("*").alias("docs"), F.sum("full").alias("windows")), "histogram")
    histogram, base, first = {}, [], 0
    for row in groups.groupBy("r").agg(F.sum("docs").alias("docs"), F.sum("windows").alias("windows")).orderBy("r").collect():
        histogram[row.r] = row.docs
        base.append((row.r, first))
        first += row.windows
    plan, _ = make_plan(histogram, window, first)
    before = Window.partitionBy("r").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        groups.withColumns({"docs_before": F.coalesce(F.sum("docs").over(before), F.lit(0)), "windows_before": F.coalesce(F.sum("windows").over(before), F.lit(0))})
        .join(F.broadcast(_local(spark, base)), "r")
        .select("r", "salt", "docs_before", (F.col("first") + F.col("windows_before")).alias("windows_before"))
    )
    order = Window.partitionBy("r", "salt").orderBy("uid")
    ranked = held.withColumns(
        {"k": F.row_number().over(order) - 1, "w": F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    )
    placed = ranked.join(bases, ["r", "salt"]).select(
        "doc_id", "n", "ids", (F.col("docs_before") + F.col("k")).alias("rank"), (F.col("windows_before") + F.col("w")).alias("base")
    )
    return placed.mapInArrow(_place(spark.sparkContext.broadcast(plan), window), PIECE)
