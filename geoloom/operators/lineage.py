"""Rules between files as tables of edges: staleness, closures, order, cleanup."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import drop, stage


def needs_regen(outputs: DataFrame, inputs: DataFrame, by: str, mtime: str = "mtime") -> DataFrame:
    """Per rule: whether an input is at least as new as an output, or an output is missing (null mtime)."""
    o = outputs.groupBy(by).agg(F.min(mtime).alias("oldest"), F.max(F.col(mtime).isNull()).alias("gone"))
    i = inputs.groupBy(by).agg(F.max(mtime).alias("newest"))
    return o.join(i, by, "left").select(by, (F.col("gone") | F.coalesce(F.col("newest") >= F.col("oldest"), F.lit(False))).alias("stale"))


#: Rounds whose nodes are put together into one table, so that the plan of a deep closure stays short.
ROUNDS = 16


def _held(edges: DataFrame, by: str) -> DataFrame:
    """Edges dealt by one end, in order, and kept on the executors: rounds that join on that end do not move them again."""
    n = max(32, 4 * edges.sparkSession.sparkContext.defaultParallelism)
    return edges.repartition(n, by).sortWithinPartitions(by).persist(StorageLevel.MEMORY_AND_DISK)


def closure(edges: DataFrame, start: DataFrame, src: str = "src", dst: str = "dst", node: str = "node", most: int | None = None) -> DataFrame:
    """All nodes reachable from ``start(node)``, themselves included, with the fewest steps.

    Breadth first: the edges are dealt once by where they begin, and each round joins only the nodes that
    the last one found, until it finds none.  Null ends of edges lead nowhere.  More than ``most`` steps, where
    it is given, are an error.
    """
    hops = stage(edges.select(F.col(src).alias("_from"), F.col(dst).alias("_next")).where("_next IS NOT NULL").distinct(), "hops")
    dealt = _held(hops, "_from")
    try:
        return _spread(dealt, start, node, most)
    finally:
        dealt.unpersist()
        drop(hops)


def _spread(hops: DataFrame, start: DataFrame, node: str, most: int | None) -> DataFrame:
    front = stage(start.select(node).distinct().withColumn("depth", F.lit(0)), "front")
    seen, depth = [front], 0
    while True:
        depth += 1
        known = reduce(DataFrame.unionAll, seen)
        found = front.join(hops, front[node] == hops["_from"]).select(F.col("_next").cast(front.schema[node].dataType).alias(node)).distinct()
        front = stage(found.join(known.select(node), node, "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            drop(front)
            return known
        if most is not None and depth > most:
            raise ValueError(f"nodes are more than {most} steps away")
        seen.append(front)
        if len(seen) > ROUNDS:
            parts, seen = seen, [stage(reduce(DataFrame.unionAll, seen), "seen")]
            drop(*parts[:-1])  # the last one is the front


def intermediates(edges: DataFrame, targets: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """What the targets are made from, without the targets: the files that a cleanup may remove."""
    return closure(edges, targets, src, dst).join(targets, "node", "left_anti")


def levels(edges: DataFrame, times: DataFrame, src: str = "src", dst: str = "dst", node: str = "node", mtime: str = "mtime") -> DataFrame:
    """(node, level, mtime, newest) of every node of ``edges`` (src is made from dst) and of ``times(node, mtime)``.

    ``level`` is the number of edges on the longest way down to a node that is made from nothing (0),
    so sorting by it puts inputs before what is made from them.  ``newest`` is the greatest mtime of all
    that a node is made from, over all levels.  Nodes are peeled: a round joins the nodes of the last
    level to the edges that end in them, and a node is next when all its edges have been counted.  The
    edges carry what is known of their upper node and stay where they are; a round rewrites only nodes of
    which some edges are counted, not all that wait.
    Nodes on a cycle, or above one, are a ValueError.  Edges with a null end are left out.
    """
    pairs = edges.select(F.col(src).alias("_src"), F.col(dst).alias("_dst")).where("_src IS NOT NULL AND _dst IS NOT NULL").distinct()
    hops = stage(pairs, "hops")
    known = times.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("_at")).agg(F.max(mtime).alias("_time"))
    names = hops.select(F.col("_src").alias("_node")).union(hops.select("_dst")).union(known.select("_at")).distinct()
    needs = hops.groupBy("_src").agg(F.count("*").alias("_needs"))
    nodes = names.join(needs, F.col("_node") == F.col("_src"), "left").join(known, F.col("_node") == F.col("_at"), "left")
    nodes = stage(nodes.select("_node", F.coalesce("_needs", F.lit(0)).alias("_needs"), "_time"), "nodes")
    up = nodes.select(F.col("_node").alias("_of"), "_needs", F.col("_time").alias("_own"))
    dealt = _held(hops.join(up, F.col("_src") == F.col("_of")).select("_dst", "_src", "_needs", "_own"), "_dst")
    try:
        out = _peeled(nodes, dealt)
    finally:
        dealt.unpersist()
    stuck = []
    if out.count() < nodes.count():
        stuck = [r[0] for r in nodes.join(out.select("_node"), "_node", "left_anti").select("_node").orderBy("_node").limit(10).collect()]
    drop(hops, nodes)
    if stuck:
        raise ValueError(f"nodes that are made from themselves, or from such: {stuck}")
    return out.select(F.col("_node").alias(node), F.col("_level").alias("level"), F.col("_time").alias(mtime), F.col("_newest").alias("newest"))


def _peeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(_node, _level, _time, _newest) of the nodes that are on no cycle and above none."""
    nothing = F.lit(None).cast(nodes.schema["_time"].dataType)
    front = stage(nodes.where("_needs = 0").select("_node", F.lit(0).alias("_level"), "_time", nothing.alias("_newest")), "level")
    done, level, partly = [], 0, None
    while not front.isEmpty():
        done.append(front)
        if len(done) > ROUNDS:
            parts, done = done, [stage(reduce(DataFrame.unionAll, done), "levels")]
            drop(*parts[:-1])  # the last one is the front
        level += 1
        came = edges.join(front, F.col("_dst") == F.col("_node")).groupBy("_src").agg(
            F.count("*").alias("_came"), F.max(F.greatest("_time", "_newest")).alias("_new"), F.max("_needs").alias("_needs"), F.max("_own").alias("_own")
        )
        if partly is not None:
            both = partly.where("_came < _needs").unionByName(came)
            came = both.groupBy("_src").agg(F.sum("_came").alias("_came"), F.max("_new").alias("_new"), F.max("_needs").alias("_needs"), F.max("_own").alias("_own"))
        counted = stage(came, "counted")
        if partly is not None:
            drop(partly)
        partly = counted
        front = stage(counted.where("_came = _needs").select(F.col("_src").alias("_node"), F.lit(level).alias("_level"), F.col("_own").alias("_time"), F.col("_new").alias("_newest")), "level")
    if partly is not None:
        drop(partly)
    return reduce(DataFrame.unionAll, done) if done else front


def build_order(edges: DataFrame, targets: DataFrame, times: DataFrame, src: str = "src", dst: str = "dst", node: str = "node", mtime: str = "mtime") -> DataFrame:
    """What the targets are made from, themselves included, inputs first: (node, level, mtime, newest, stale, build).

    A node that is made is stale where it has no mtime or an older one than something at any level
    below it.  ``build`` marks the stale nodes to which a way of stale nodes leads from a target: what
    is needed only for something that is kept as it is need not be made.  A node that is made from
    nothing, has no mtime, and is a target or an input of one to build, is an error.
    """
    ends = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    reach = closure(ends, targets.select(node), node=node).select(node)
    inner = stage(ends.join(reach, F.col("src") == F.col(node), "left_semi").distinct(), "inner")
    held = times.select(node, mtime).join(reach, node, "left_semi")
    alone = reach.select(node, F.lit(None).cast(times.schema[mtime].dataType).alias(mtime))
    ranked = stage(levels(inner, held.unionByName(alone), "src", "dst", node, mtime), "ranked")
    stale = (F.col("level") > 0) & (F.col(mtime).isNull() | F.coalesce(F.col(mtime) < F.col("newest"), F.lit(False)))
    ranked = ranked.withColumn("stale", stale)
    old = ranked.where("stale").select(node)
    down = inner.join(old, F.col("src") == F.col(node), "left_semi")
    visited = closure(down, targets.select(node), node=node).select(F.col(node).alias("_seen"))
    out = ranked.join(visited, F.col(node) == F.col("_seen"), "left").withColumn("build", F.col("stale") & F.col("_seen").isNotNull())
    gone = [r[0] for r in out.where(f"level = 0 AND {mtime} IS NULL AND _seen IS NOT NULL").select(node).limit(10).collect()]
    if gone:
        raise ValueError(f"nothing makes these nodes, and they are not there: {gone}")
    return out.drop("_seen").orderBy("level", node)
