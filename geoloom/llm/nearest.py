"""Approximate nearest neighbours by an inverted multi-index (operator 3).

Either half of a vector is quantised by its own centroids, so an entry lies in one of K * K
cells.  A query walks the cells in order of the summed distance of their two centroids, with a
heap, until they hold enough entries; these are reranked by the exact distance.

The index is a table of entries with their cells, and cells are dealt to groups.  Queries become
rows, one for each group in which they visit cells, and meet its entries in a join by group and
salt: the salt deals a group's entries over several tasks, so that a full cell is no one task's
work.  A task computes, cell by cell, distances of the queries that visit the cell and of its
entries only, in blocks, and keeps the k nearest of each query; the final order is taken over these.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage
from .words import slices

#: Centroids of each half; vectors they are fitted on at most.
CENTROIDS, SAMPLE = 64, 20_000
#: Share of all entries that a query's cells hold at least.
SHARE = 0.5
#: Groups of cells; entries of one salt of a group, about; entries and queries of a distance matrix.
GROUPS, SALTED, BLOCK = 64, 20_000, 1024


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    c = x[np.random.default_rng(3).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_centroid(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells (i * K + j) in order of ``first[i] + second[j]`` until they hold ``enough`` entries."""
    a, b, k = np.argsort(first, kind="stable"), np.argsort(second, kind="stable"), len(second)
    heap, cells, held, done = [(first[a[0]] + second[b[0]], 0, 0)], [], 0, np.zeros(len(first), int)
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * k + int(b[j])
        cells.append(cell)
        held += int(counts[cell])
        done[i] = j + 1
        if j + 1 < k and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (first[a[i + 1]] + second[b[j]], i + 1, j))
    return cells


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("vector")
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), -1)


def _assign(c1: np.ndarray, c2: np.ndarray, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                cell = nearest_centroid(x[:, :half], c1) * len(c2) + nearest_centroid(x[:, half:], c2)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["uid", "vec_id", "vector", "cell"])

    return run


def _routes(c1: np.ndarray, c2: np.ndarray, half: int, counts: np.ndarray, enough: int):
    """Queries -> a row for each group of cells, with the cells that the query visits there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            of, groups, cells = [], [], []
            for n, v in enumerate(_matrix(batch) if batch.num_rows else ()):
                found = np.array(visit(((c1 - v[:half]) ** 2).sum(axis=1), ((c2 - v[half:]) ** 2).sum(axis=1), counts, enough))
                found = found[counts[found] > 0]
                for g in np.unique(found % GROUPS).tolist():
                    of.append(n)
                    groups.append(g)
                    cells.append(found[found % GROUPS == g])
            rows = batch.take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(groups, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=["uid", "vec_id", "vector", "group", "cells"])

    return run


def nearest_of(queries: tuple[np.ndarray, ...], entries: tuple[np.ndarray, ...], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query uid, query id, entry id, distance) of the k nearest entries of each query, without itself; by blocks.

    Either side is (uid, id, matrix).  Distances come from products first; what rounding cannot
    tell from the k-th is then measured exactly.
    """
    (q_uid, q_id, q), (uid, own, x) = queries, entries
    q2 = (q**2).sum(axis=1)
    for e in range(0, len(uid), BLOCK):
        some, some_id, some_uid = x[e : e + BLOCK], own[e : e + BLOCK], uid[e : e + BLOCK]
        x2 = (some**2).sum(axis=1)
        for s in range(0, len(q_uid), BLOCK):
            d = q2[s : s + BLOCK, None] + x2[None] - 2 * q[s : s + BLOCK] @ some.T
            slack = 1e-9 * (1 + q2[s : s + BLOCK, None] + x2[None].max())
            d[q_uid[s : s + BLOCK, None] == some_uid[None]] = np.inf
            near = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] + slack if d.shape[1] > k else np.isfinite(d)
            row, at = np.nonzero(near & np.isfinite(d))
            exact = np.sqrt(((some[at] - q[s + row]) ** 2).sum(axis=1))
            order = np.lexsort((some_uid[at], some_id[at], exact, row))
            row, at, exact = row[order], at[order], exact[order]
            first = np.searchsorted(row, row, "left")
            kept = np.arange(len(row)) - first < k
            yield q_uid[s + row[kept]], q_id[s + row[kept]], some_id[at[kept]], exact[kept]


def _search(k: int):
    """The queries and the entries of one salt of one group of cells -> for each query the k nearest of its cells."""

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pylist([], schema=_FOUND)
        side = lambda t: (t.column("uid").to_numpy(), t.column("vec_id").to_numpy(), np.asarray(t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(t.num_rows, -1))
        queries, entries = side(left), side(right)
        lists = left.column("cells").combine_chunks()
        visitor, visited = np.repeat(np.arange(left.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        order = np.argsort(visited, kind="stable")
        visitor, visited = visitor[order], visited[order]
        cell = right.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        held, cuts = np.unique(cell[order], return_index=True)
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for c, rows in zip(held, np.split(order, cuts[1:])):
            q = visitor[np.searchsorted(visited, c, "left") : np.searchsorted(visited, c, "right")]
            if len(q):
                near = nearest_of(tuple(x[q] for x in queries), tuple(x[rows] for x in entries), k)
                found = _first(k, *(np.concatenate(x) for x in zip(found, *near)))
        return pa.Table.from_arrays([pa.array(c) for c in found], schema=_FOUND)

    return run


def _first(k: int, uid: np.ndarray, query: np.ndarray, own: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
    """The k nearest of each query among the found."""
    order = np.lexsort((own, score, uid))
    uid = uid[order]
    kept = order[np.arange(len(uid)) - np.searchsorted(uid, uid, "left") < k]
    return [x[kept] for x in (uid[np.argsort(order)], query, own, score)]


_FOUND = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest_neighbours(
    embeddings: DataFrame, k: int = 10, every: int = 100, centroids: int = CENTROIDS, share: float = SHARE, sample: int = SAMPLE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query, by Euclidean distance.

    embeddings(vec_id, embedding).  Queries are the rows whose vec_id is divisible by ``every``;
    candidates all other rows, those with the query's vec_id included.  Rows whose vec_id or
    vector is null, or whose vector is empty, zero, holds a null or non-finite component, or has
    not the most frequent length, take no part.  Ties go to the smaller vec_id; equal vectors are
    all candidates, repeated rows count once each, and each row of a vec_id is a query of its own.
    An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    v = F.col("embedding").cast("array<double>")
    good = F.size(v).__gt__(0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good)
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    half, rows = max(1, size.n // 2), rows.where(F.size("vector") == size.n)
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toPandas()
    x = np.stack(fitted["vector"].to_numpy()).astype(float)
    c1, c2 = k_means(x[:, :half], centroids), k_means(x[:, half:], centroids) if size.n > 1 else np.zeros((1, 0))
    index = stage(rows.mapInArrow(_assign(c1, c2, half), "uid long, vec_id long, vector array<double>, cell int"), "index")
    counts = np.zeros(len(c1) * len(c2), np.int64)
    for r in index.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        counts[r.cell] = r["count"]
    salts = -(-np.bincount(np.arange(len(counts)) % GROUPS, counts, GROUPS).astype(np.int64) // SALTED)
    queries = index.where(F.col("vec_id") % every == 0).select("uid", "vec_id", "vector")
    enough = max(k + 1, int(np.ceil(share * counts.sum())))  # k candidates besides the query itself, if there are so many
    routed = queries.mapInArrow(_routes(c1, c2, half, counts, enough), "uid long, vec_id long, vector array<double>, group int, cells array<int>")
    # a row a group
    of_group = F.broadcast(spark.createDataFrame([(int(g), int(salts[g])) for g in np.flatnonzero(salts)], "group int, salts int"))
    # queries are dealt to turns: each meets every entry of its cells, so no task holds more of them than of entries
    turns = max(1, -(-queries.count() // SALTED))
    visits = routed.join(of_group, "group").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    visits = visits.withColumn("turn", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(turns)).cast("int"))
    entries = index.withColumn("group", F.col("cell") % GROUPS).join(of_group, "group").withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int"))
    entries = entries.select("uid", "vec_id", "vector", "cell", F.col("group").alias("of"), F.col("salt").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("again"))
    near = visits.groupBy("group", "salt", "turn").cogroup(entries.groupBy("of", "part", "again")).applyInArrow(_search(k), "uid long, query_id long, vec_id long, score double")
    order = Window.partitionBy("uid").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
