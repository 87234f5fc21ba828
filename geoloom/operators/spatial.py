"""Spatial and interval joins: equality on grid cells or bins first, the exact test behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import running_total

#: A ring is array<struct<x double, y double>>, not closed; the last point joins the first.
RING = "array<struct<x:double,y:double>>"


def ring_of(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def _edges(ring: Column) -> Column:
    """Edges as (a, b), by rotating the ring by one."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), turned.alias("b"))


def crossings(x: Column, y: Column, ring: Column) -> Column:
    """How many edges of a ring the ray from the point to the right crosses; lower ends of edges count, upper ones do not."""

    def crossing(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] == a["y"], F.lit(1.0)).otherwise(b["y"] - a["y"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(_edges(ring), F.lit(0), lambda n, e: n + crossing(e))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether the point lies inside the ring or on it; a null ring holds nothing."""

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        within = x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        return (cross == 0) & within

    return F.coalesce((crossings(x, y, ring) % 2 == 1) | F.exists(_edges(ring), on), F.lit(False))


def bbox(ring: Column) -> dict[str, Column]:
    """Least and greatest coordinates of a ring."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)}


def _bins(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


#: Least number of parts that a join by cells is dealt to.
PARTS = 64


def parts_of(spark: SparkSession) -> int:
    """How many parts work is dealt to whose size the bytes of its input do not tell: a number given to
    ``repartition`` is kept by adaptive execution, which else makes one task of many small rows."""
    return max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float | tuple[float, float], x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of points(x, y, ...) and boxes(x0, x1, y0, y1, ...) whose box holds the point, edges included.

    Each box is listed under the grid cells it touches, each point under its one cell; ``cell`` is their
    size, or their width and height.  Pairs can be many more than the rows of either side, so both are dealt
    by cell to a number of parts that adaptive execution does not join again.
    """
    w, h = cell if isinstance(cell, tuple) else (cell, cell)
    n = parts_of(points.sparkSession)
    listed = boxes.withColumn("_ci", F.explode(_bins(F.col("x0"), F.col("x1"), w))).withColumn("_cj", F.explode(_bins(F.col("y0"), F.col("y1"), h)))
    placed = points.withColumns({"_ci": F.floor(F.col(x) / w), "_cj": F.floor(F.col(y) / h)})
    inside = F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))
    placed, listed = (df.repartition(n, "_ci", "_cj") for df in (placed, listed))
    return placed.join(listed, ["_ci", "_cj"]).where(inside).drop("_ci", "_cj")


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float | tuple[float, float], ring: str = "ring", x: str = "x", y: str = "y") -> DataFrame:
    """Pairs of points and polygons(ring, ...): bounding boxes by grid cells, then the ray test, edges included."""
    boxes = polygons.where(F.col(ring).isNotNull()).withColumns(bbox(F.col(ring)))
    pairs = points_in_boxes(points, boxes, cell, x, y)
    return pairs.where(in_ring(F.col(x), F.col(y), F.col(ring))).drop("x0", "x1", "y0", "y1")


def fraction_inside(points: DataFrame, by: str, inside: Column, threshold: float = 0.95) -> DataFrame:
    """Per group of points: how many, how many inside, and whether the share is above the threshold."""
    n = points.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.when(inside, 1).otherwise(0)).alias("n_inside"))
    return n.withColumn("matched", F.col("n_inside") > threshold * F.col("n"))


def box_pairs(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """Pairs of rows whose boxes (x0, x1, y0, y1) meet; ``a`` keeps its columns, those of ``b`` begin with ``b_``.

    Boxes are listed under the grid cells they touch; a pair counts in the first cell that both touch.
    """

    def listed(df: DataFrame, p: str) -> DataFrame:
        x0, x1, y0, y1 = (F.col(p + c) for c in ("x0", "x1", "y0", "y1"))
        return df.withColumn("_ci", F.explode(_bins(x0, x1, cell))).withColumn("_cj", F.explode(_bins(y0, y1, cell)))

    pairs = listed(a, "").join(listed(b.toDF(*[f"b_{c}" for c in b.columns]), "b_"), ["_ci", "_cj"])
    meets = (F.col("x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("x1")) & (F.col("y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("y1"))
    first = lambda c: F.floor(F.greatest(F.col(f"{c}0"), F.col(f"b_{c}0")) / cell)
    return pairs.where(meets & (F.col("_ci") == first("x")) & (F.col("_cj") == first("y"))).drop("_ci", "_cj")


def boxes_meeting(boxes: DataFrame, query: DataFrame, cell: float) -> DataFrame:
    """Rows of ``boxes`` whose box meets some box of ``query`` (a semi join on bounding boxes)."""
    pairs = box_pairs(boxes, query.select("x0", "x1", "y0", "y1"), cell)
    row = F.struct(*boxes.columns).alias("_row")
    return pairs.select(row).distinct().select("_row.*")


def _side(p: Column, q: Column, r: Column) -> Column:
    """The sign of the turn p, q, r."""
    return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))


def _between(p: Column, q: Column, r: Column) -> Column:
    """Whether r, on the line through p and q, lies between them."""
    return r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))


def segments_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the segments a-b and c-d share a point, ends included."""
    s1, s2, s3, s4 = _side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)
    touch = [(s == 0) & _between(*t) for s, t in ((s1, (a, b, c)), (s2, (a, b, d)), (s3, (c, d, a)), (s4, (c, d, b)))]
    return ((s1 != s2) & (s3 != s4)) | touch[0] | touch[1] | touch[2] | touch[3]


def line_meets_ring(line: Column, ring: Column) -> Column:
    """Whether a line (array of points) meets the area of a ring: its first point lies inside, or it crosses an edge."""
    steps = F.arrays_zip(F.slice(line, 1, F.size(line) - 1).alias("a"), F.slice(line, 2, F.size(line) - 1).alias("b"))
    crossed = F.exists(steps, lambda s: F.exists(_edges(ring), lambda e: segments_meet(s["a"], s["b"], e["a"], e["b"])))
    start = F.get(line, F.lit(0))
    return F.when(F.size(line) < 1, F.lit(False)).otherwise(F.coalesce(in_ring(start["x"], start["y"], ring) | ((F.size(line) > 1) & crossed), F.lit(False)))


def lines_in_polygons(lines: DataFrame, polygons: DataFrame, cell: float, line: str = "line", ring: str = "ring") -> DataFrame:
    """Pairs of lines and polygons that meet: bounding boxes by grid cells, then the exact test; columns as in ``box_pairs``."""
    a = lines.where(F.size(line) > 0).withColumns(bbox(F.col(line)))
    b = polygons.where(F.col(ring).isNotNull()).withColumns(bbox(F.col(ring)))
    kept = [*lines.columns, *[f"b_{c}" for c in polygons.columns]]
    return box_pairs(a, b, cell).where(line_meets_ring(F.col(line), F.col(f"b_{ring}"))).select(*kept)


def overlapping(a: DataFrame, b: DataFrame, size: float, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """All pairs of intervals that overlap or touch, with r0, r1 of the overlap.

    a and b have distinct column names but for lo and hi.  Intervals are listed under the bins they
    touch; a pair counts in the first bin that both touch.
    """
    bins = lambda df, p: df.withColumns({f"_{p}lo": F.col(lo), f"_{p}hi": F.col(hi)}).drop(lo, hi).withColumn(
        "_bin", F.explode(_bins(F.col(f"_{p}lo"), F.col(f"_{p}hi"), size))
    )
    first = F.greatest(F.floor(F.col("_alo") / size), F.floor(F.col("_blo") / size))
    pairs = bins(a, "a").join(bins(b, "b"), "_bin").where((F.col("_alo") <= F.col("_bhi")) & (F.col("_blo") <= F.col("_ahi")) & (F.col("_bin") == first))
    return pairs.select(
        *[c for c in (*a.columns, *b.columns) if c not in (lo, hi)], F.greatest("_alo", "_blo").alias("r0"), F.least("_ahi", "_bhi").alias("r1")
    )


def index_slices(values: DataFrame, value: str, ranges: DataFrame) -> DataFrame:
    """For ranges(id, v0, v1): i0, i1, the half-open slice of the sorted values in [v0, v1).

    Values and bounds are sorted together, a bound before equal values; the place of a bound is the
    running count of the values before it, so neither side is broadcast.
    """
    counts = values.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    bound = lambda k: F.struct(F.col(f"v{k}").cast("double").alias("v"), F.lit(k).alias("end"))
    bounds = ranges.select("id", F.explode(F.array(bound(0), bound(1))).alias("b")).select("id", "b.*")
    rows = bounds.select("id", "end", "v", F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind")).unionByName(
        counts.withColumns({"id": F.lit(None), "end": F.lit(None).cast("int"), "kind": F.lit(1)})
    )
    placed = running_total(rows, [], ["v", "kind"], F.col("n"), "at").where("kind = 0")
    at = lambda k: F.max(F.when(F.col("end") == k, F.col("at"))).alias(f"i{k}")
    return placed.groupBy("id").agg(at(0), at(1))


def common_slices(a: DataFrame, b: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """For two axes of one direction: the slices (a0, a1, b0, b1) that cover their common range of values.

    An axis covers [first, last + last step), of ascending values; slices of ``descending`` axes
    count from their greatest value.
    """

    def extent(df: DataFrame) -> tuple[Column, Column]:
        top = df.select(value).distinct().orderBy(F.desc(value)).limit(2)
        return df.agg(F.min(value)).scalar(), top.agg(2 * F.max(value) - F.min(value)).scalar()

    (alo, ahi), (blo, bhi) = extent(a), extent(b)
    v0, v1 = F.greatest(alo, blo), F.least(ahi, bhi)

    def count(df: DataFrame, p: str) -> list[DataFrame]:
        below = lambda bound: F.sum(F.when(F.col(value) < bound, 1).otherwise(0))
        # of values in descending order, those from v on stand before
        first, last = (F.count("*") - below(v1), F.count("*") - below(v0)) if descending else (below(v0), below(v1))
        return [df.agg(first).scalar().alias(f"{p}0"), df.agg(last).scalar().alias(f"{p}1")]

    return a.sparkSession.range(1).select(*count(a, "a"), *count(b, "b"))
