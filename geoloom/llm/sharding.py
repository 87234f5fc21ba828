"""Sharding by k-d tree partitioning at distributed weighted medians (operator 6).

Every document is a point whose coordinates are 16-bit metadata dimensions (size on a log
scale, a hash of the language, and characters per byte) and whose weight is its size.  A node that has to
give k shards is split along its widest dimension so that k // 2 of k parts of its bytes go
left; the children are split again until each leaf is one shard.  The split point is found
exactly by refining histograms: all nodes of a level share each Spark aggregation, and only
bin sums reach the driver (at most 2048 per node).  Equal coordinates are told apart by the
text's hash first, so copies of a text stay together unless the boundary cuts through them,
and then by doc_id, so the bytes of the shards come out equal whatever the ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

#: Key of a row along a dimension: 16 bits of the dimension, 17 of the text's hash, 17 of the doc_id's, 12 of the row's.
KEY_BITS, BIN_BITS = 62, 11
#: Bytes by which a split may miss its goal, relative to one shard, before copies of a text are taken apart.
TOLERANCE = 5e-3
#: Parts into which the numbering of a shard is split, so that no shard meets in one task.
SALTS = 64


@dataclass
class Node:
    name: int
    shards: int
    first: int
    dim: int = 0
    lo: int = 0
    shift: int = KEY_BITS - BIN_BITS
    goal: float = 0.0
    below: int = 0
    split: int | None = None
    children: list = field(default_factory=list)


def dimensions(documents: DataFrame, size: Column) -> list[Column]:
    """The metadata as integers of 16 bits; a missing column or null counts as 0."""
    chars = F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0))
    lang = F.crc32(F.coalesce(F.col("lang").cast("string"), F.lit(""))).bitwiseAND(0xFFFF) if "lang" in documents.columns else F.lit(0)
    out = [F.least(F.floor(F.log1p(size.cast("double")) * 1500), F.lit(65535)), lang, F.floor(65535.0 * chars / size)]
    return [c.cast("long") for c in out]


def _place(node: Node, keys: list[np.ndarray], at: np.ndarray, out: np.ndarray, what: str) -> np.ndarray:
    """For the rows ``at``: the name, or the first shard, of the node of the tree they lie in."""
    if node.split is None:
        out[at] = getattr(node, what)
    else:
        left = keys[node.dim][at] <= node.split
        _place(node.children[0], keys, at[left], out, what)
        _place(node.children[1], keys, at[~left], out, what)
    return out


def _columns(batch: pa.RecordBatch, n_dims: int) -> tuple[list[np.ndarray], np.ndarray]:
    return [batch.column(f"key{i}").to_numpy() for i in range(n_dims)], np.arange(batch.num_rows)


def _widths(root: Node, n_dims: int):
    """Per task: bytes, and least and greatest value of each dimension, of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = _columns(batch, n_dims)
            node, size = _place(root, keys, rows, np.zeros(len(rows), np.int64), "name"), batch.column("size").to_numpy()
            names = np.unique(node)
            some = [node == n for n in names]
            cols = [names, [int(size[m].sum()) for m in some]]
            for k in keys:
                cols += [[int(f(k[m]) >> (KEY_BITS - 16)) for m in some] for f in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f"c{i}" for i in range(len(cols))])

    return run


def _bins(root: Node, open_: list[Node], n_dims: int):
    """Per task: bytes in each bin of each open node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = _columns(batch, n_dims)
            node, size = _place(root, keys, rows, np.zeros(len(rows), np.int64), "name"), batch.column("size").to_numpy()
            names, bins, sums = [], [], []
            for n in open_:
                mine = np.flatnonzero(node == n.name)
                b = (keys[n.dim][mine] - n.lo) >> n.shift
                inside = (b >= 0) & (b < 1 << BIN_BITS)
                held, which = np.unique(b[inside], return_inverse=True)
                total = np.zeros(len(held), np.int64)
                np.add.at(total, which, size[mine][inside])
                names.append(np.full(len(held), n.name))
                bins.append(held)
                sums.append(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (names, bins, sums)], names=["node", "bin", "size"])

    return run


def kd_tree(points: DataFrame, n_dims: int, shards: int) -> Node:
    """Split ``points(size, key0, ...)`` into a tree of ``shards`` leaves."""
    root = Node(1, shards, 0)
    level, wide = [root], ", ".join(f"lo{i} long, hi{i} long" for i in range(n_dims))
    edges = [f(f"{e}{i}").alias(f"{e}{i}") for i in range(n_dims) for f, e in ((F.min, "lo"), (F.max, "hi"))]
    while level := [n for n in level if n.shards > 1]:
        parts = points.mapInArrow(_widths(root, n_dims), f"node long, size long, {wide}")
        found = {r.node: r for r in parts.groupBy("node").agg(F.sum("size").alias("size"), *edges).collect()}
        open_ = []
        for n in level:
            if r := found.get(n.name):
                n.dim = max(range(n_dims), key=lambda i: r[f"hi{i}"] - r[f"lo{i}"])
                n.goal = r.size * (n.shards // 2) / n.shards
                open_.append(n)
        splits = _split(points, root, open_, n_dims)
        for n in level:
            half = n.shards // 2
            n.split = splits.get(n.name, -1)
            n.children = [Node(2 * n.name, half, n.first), Node(2 * n.name + 1, n.shards - half, n.first + half)]
        level = [c for n in level for c in n.children]
    return root


def _split(points: DataFrame, root: Node, open_: list[Node], n_dims: int) -> dict[int, int]:
    """Each node's split: the largest key of its left part."""
    splits = {}
    while open_:
        sums: dict[int, list[tuple]] = {}
        parts = points.mapInArrow(_bins(root, open_, n_dims), "node long, bin long, size long")
        for r in parts.groupBy("node", "bin").agg(F.sum("size").alias("size")).collect():
            sums.setdefault(r.node, []).append((r.bin, r.size))
        still = []
        for n in open_:
            total, b, size = n.below, 0, 0
            for b, size in sorted(sums[n.name]):
                if total + size > n.goal:
                    break
                total += size
            else:
                total -= size
            # bin b straddles the goal: to its left lie ``total`` bytes
            if n.shift == 0 or size <= TOLERANCE * n.goal / max(1, n.shards // 2):
                nearer = total + size - n.goal < n.goal - total
                splits[n.name] = n.lo + ((b + nearer) << n.shift) - 1
            else:
                n.below, n.lo, n.shift = total, n.lo + (b << n.shift), max(0, n.shift - BIN_BITS)
                still.append(n)
        open_ = still
    return splits


def _assign(root: Node, n_dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = _columns(batch, n_dims)
            shard = _place(root, keys, rows, np.zeros(len(rows), np.int32), "first")
            names = ["doc_id", "size", "text_crc32", "uid"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(shard)], names=[*names, "shard"])

    return run


def shard_documents(documents: DataFrame, shards: int | None = 40, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``documents``.

    The law is ``bytes``: the sizes of the shards (UTF-8 bytes of the text plus 16 each) are near
    equal.  Either ``shards`` or ``target_bytes`` says how many.  slot numbers the rows of a shard
    from 0 without gaps; grown_shard is null, since adding a shard moves boundaries.  Null texts
    count no bytes; a null lang and null doc_ids are values like others; repeated rows are
    placed one by one.  Columns other than doc_id, text and lang are ignored.  An empty
    table gives an empty result; with fewer rows than shards some shards stay empty.
    """
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")))
    dims = dimensions(documents, size)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("uid"),
        *[d.alias(f"dim{i}") for i, d in enumerate(dims)],
    )
    rows = stage(rows, "metadata")
    tie = (
        F.shiftleft(F.shiftright("text_crc32", 15), 29)
        .bitwiseOR(F.shiftleft(F.xxhash64("doc_id").bitwiseAND((1 << 17) - 1), 12))
        .bitwiseOR(F.xxhash64("uid").bitwiseAND((1 << 12) - 1))
    )
    points = rows.select("*", *[F.shiftleft(f"dim{i}", KEY_BITS - 16).bitwiseOR(tie).alias(f"key{i}") for i in range(len(dims))])
    if target_bytes:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    root = kd_tree(points.select("size", *[f"key{i}" for i in range(len(dims))]), len(dims), shards)
    placed = points.mapInArrow(_assign(root, len(dims)), "doc_id long, size long, text_crc32 long, uid long, shard int")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)))
    # numbers within (shard, salt), and before each salt the rows of the salts before it
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "salt").agg(F.count("*").alias("n")).select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "salt").orderBy("doc_id", "uid")
    return (
        placed.withColumn("k", F.row_number().over(order) - 1)
        .join(base, ["shard", "salt"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("k")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
