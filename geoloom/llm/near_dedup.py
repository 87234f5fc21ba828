"""MinHash near-duplicate detection by a multi-index Hamming join (operator 2).

Signature: 32 min-hashes, each cut to 16 bits, held as eight 64-bit chunks of four symbols.
Two signatures within distance 15 (of 32 symbols) agree, by the pigeonhole principle, on some
chunk up to one symbol; so each chunk is indexed under its four keys that leave one symbol
out, and every pair within that distance shares a key.  Texts of Jaccard similarity 0.8 lie
within that distance or share a key anyway with probability 1 - 1e-6 and more; the similarity
itself is then computed on the full shingle sets.

Skew: equal sets are one node from the start.  Pairs inside a bucket are not all made: first
every node is confirmed against one representative of its buckets; nodes of its buckets that
end in different components meet again only over a shingle that similar sets must share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .staging import drop, small_batches, stage
from .words import U64, _odd, shingles, signed, slices, texts, word_hashes

CHUNKS, SYMBOLS, BITS = 8, 4, 16
_MULTIPLY, _ADD = _odd(CHUNKS * SYMBOLS, 21), _odd(CHUNKS * SYMBOLS, 22)
_SIG = [f"sig{i}" for i in range(CHUNKS)]


def signature(distinct: np.ndarray) -> np.ndarray:
    """Eight 64-bit chunks, each of four 16-bit min-hash symbols."""
    with np.errstate(over="ignore"):
        low = np.full(CHUNKS * SYMBOLS, np.iinfo(np.uint64).max, U64)
        for i in range(0, len(distinct), 4096):
            low = np.minimum(low, (distinct[None, i : i + 4096] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1))
    return low.astype(np.uint16).view(np.uint64)


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, sets, sigs = [], [], []
            for text in texts(batch):
                s = np.unique(shingles(word_hashes(text), k))
                n.append(len(s))
                with np.errstate(over="ignore"):
                    sets.append((s.sum(dtype=U64), ((s ^ (s >> U64(29))) * _MULTIPLY[0]).sum(dtype=U64)))
                sigs.append(signature(s))
            h, g = np.array(sets, U64).reshape(-1, 2), np.array(sigs, U64).reshape(-1, CHUNKS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64())]
                + [pa.array(signed(np.ascontiguousarray(h[:, i]))) for i in range(2)]
                + [pa.array(signed(np.ascontiguousarray(g[:, i]))) for i in range(CHUNKS)],
                names=["doc_id", "text_crc32", "n_shingles", "set1", "set2", *_SIG],
            )

    return run


def chunk_keys(node: str = "node") -> list:
    """The 32 keys of a signature: chunk i without symbol e, in 48 bits, below the number 4 * i + e."""
    keys = []
    for i, name in enumerate(_SIG):
        for e in range(SYMBOLS):
            low = F.col(name).bitwiseAND((1 << BITS * e) - 1)
            high = F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(name, BITS * e), BITS), BITS * e)
            keys.append(low.bitwiseOR(high).bitwiseOR(F.lit((SYMBOLS * i + e) << 48)))
    return keys


class Sets(dict):
    """Shingle sets by node, for as many texts as fit in a bounded number of shingles."""

    def __init__(self, k: int, most: int = 4_000_000):
        self.k, self.most, self.held = k, most, 0

    def of(self, node: int, text: bytes) -> np.ndarray:
        if (s := self.get(node)) is None:
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[node] = s = np.unique(shingles(word_hashes(text), self.k))
            self.held += len(s)
        return s


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(k)
        for batch in slices(batches):
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, "text_a"), texts(batch, "text_b")):
                s, t = sets.of(a, x), sets.of(b, y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(documents: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_crc32`` for every row of ``documents(doc_id, text)``.

    Links join documents whose sets of k-word shingles have a Jaccard similarity of at least
    ``percent`` / 100; component_id is the smallest doc_id reachable over links.  Fewer than k
    words: the whole sequence is the one shingle.  Null or empty texts, or texts of white space:
    n_shingles 0, linked with nothing.  A null doc_id has no link: component_id null, kept true.
    Repeated rows fall in one component; of texts that share a doc_id each is linked by itself,
    and text_crc32 tells them apart.  Other columns are ignored.  An empty table gives an empty
    result.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.crc32(F.col("text").cast("string")).alias("text_crc32")
    )
    longs = ", ".join(f"{s} long" for s in ("set1", "set2", *_SIG))
    profile = stage(docs.mapInArrow(_profile(k), f"doc_id long, text_crc32 long, n_shingles long, {longs}"), "profile")
    sets = (
        profile.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set1", "set2")
        .agg(F.min(F.struct("doc_id", "text_crc32")).alias("first"), F.max("n_shingles").alias("n"), *[F.max(s).alias(s) for s in _SIG])
        .select("set1", "set2", "first.*", "n", *_SIG)
    )
    # a node is named by its smallest doc_id, or by a hash where that has several texts
    several = sets.groupBy(F.col("doc_id").alias("named")).agg(F.count("*").alias("sets")).where("sets > 1")
    name = F.when(F.col("sets").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "set1", "set2")).alias("node")
    nodes = stage(sets.join(several, F.col("doc_id") == F.col("named"), "left").select(name, *sets.columns), "nodes")
    placed = nodes.join(_link(docs, nodes, k, percent), "node", "left").select("set1", "set2", "doc_id", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = placed.join(least, "component").select(F.col("set1").alias("s1"), F.col("set2").alias("s2"), "component_id")
    joined = profile.join(of_set, (F.col("set1") == F.col("s1")) & (F.col("set2") == F.col("s2")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), kept, "text_crc32")


def _link(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) over all confirmed links between the nodes."""
    keys = nodes.select("node", F.explode(F.array(*chunk_keys())).alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    buckets = stage(keys.join(shared, "key"), "buckets")
    # the texts that any candidate pair can need, once
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_crc32")
    held = stage(docs.join(wanted, ["doc_id", "text_crc32"]).select("node", "text").dropDuplicates(["node"]), "candidates")
    sizes = nodes.select("node", "n")

    def confirmed(pairs: DataFrame) -> DataFrame:
        close = (
            pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
            .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
            .select("a", "b")
        )
        texts_of = close.join(held.toDF("a", "text_a"), "a").join(held.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
        return stage(texts_of.mapInArrow(_confirm(k, percent), "a long, b long"), "links")

    # first, every node against the representative with which it shares most keys
    star = (
        buckets.where("node != low").select(F.col("node").alias("a"), F.col("low").alias("b"))
        .unionAll(buckets.where("node != high").select(F.col("node").alias("a"), F.col("high").alias("b")))
        .groupBy("a", "b").agg(F.count("*").alias("n"))
    )
    best = star.groupBy("a").agg(F.max(F.struct("n", F.negative("b").alias("b"))).alias("m")).select("a", F.negative("m.b").alias("b"))
    links = confirmed(best)
    components = connected_components(links)
    # then, whatever shares a key and is not connected yet
    placed = buckets.select("key", "node").join(components, "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("component")
    )
    apart = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 != c1").select("key")
    open_ = stage(placed.join(apart, "key").select("node", "component").distinct(), "open")
    more = confirmed(_prefix_pairs(open_, held, k, percent))
    if not more.isEmpty():
        components = connected_components(links.unionAll(more))
    drop(open_, more, links, buckets, held)
    return components


def _prefix_pairs(open_: DataFrame, held: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can be similar enough, among ``open_(node, component)``.

    Two exact bounds, which lose no pair.  Only shingles that occur in two components can be
    shared; with these ordered from rare to frequent behind a set's other shingles, similar sets
    of size n share one of their first n - ceil(percent * n / 100) + 1.  And from the first one
    shared on, both sets must hold as many more as the similarity needs.  Texts changed in many
    places have shingles of their own in front, so they make no pairs within a large group.
    """
    sets = held.join(open_, "node").mapInArrow(_sets(k), "node long, component long, n long, shingles array<long>")
    each = stage(sets.select("node", "component", "n", F.explode("shingles").alias("shingle")), "shingles")
    frequency = each.groupBy("shingle").agg(F.count("*").alias("f"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    common = each.join(frequency.where("c0 != c1").select("shingle", "f"), "shingle")
    by_node = Window.partitionBy("node")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = (
        common.withColumns({"m": F.count("*").over(by_node), "rank": F.row_number().over(by_node.orderBy("f", "shingle"))})
        .where(F.col("rank") <= prefix - F.col("n") + F.col("m"))
        .select("shingle", "node", "component", "n", (F.col("m") - F.col("rank") + 1).alias("left"))
    )
    x, y = first.toDF("shingle", "a", "ca", "na", "ma"), first.toDF("shingle", "b", "cb", "nb", "mb")
    enough = (100 + percent) * F.least("ma", "mb") >= percent * (F.col("na") + F.col("nb"))
    pairs = x.join(y, "shingle").where((F.col("ca") < F.col("cb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & enough)
    return pairs.select("a", "b").distinct()


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingles(word_hashes(t), k)) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("component"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))],
                names=["node", "component", "n", "shingles"],
            )

    return run
