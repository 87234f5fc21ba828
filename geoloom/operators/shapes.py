"""Shapes of points: hulls and rotated rectangles, vectors, longer lines, margins, regions cut from rasters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid, rasterize
from .spatial import bbox, line_meets_ring, parts_of

# ---- vectors: structs of x and y


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def length(v: Column) -> Column:
    return F.hypot(v["x"], v["y"])


def unit(a: Column, b: Column) -> Column:
    """The direction from a to b; null where they are equal."""
    d = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    return F.when(d > 0, point((b["x"] - a["x"]) / d, (b["y"] - a["y"]) / d))


def orthogonal(v: Column) -> Column:
    """v turned left by a right angle."""
    return point(-v["y"], v["x"])


def rotated(p: Column, center: Column, angle: Column) -> Column:
    """p turned left around the centre; the angle in radians."""
    dx, dy, c, s = p["x"] - center["x"], p["y"] - center["y"], F.cos(angle), F.sin(angle)
    return point(center["x"] + dx * c - dy * s, center["y"] + dx * s + dy * c)


# ---- hulls


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, turning left from the least point; points on its edges are left out."""
    xy = np.unique(xy, axis=0)
    if len(xy) < 3:
        return xy

    def chain(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(xy) + chain(xy[::-1]))


def hull_points(points: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """(by, x, y): of each group those points that can be corners of its convex hull.

    Every batch of rows leaves the corners of its own groups, before and behind a shuffle by group
    and salt, so a group of any size arrives as corners only.  Points without a coordinate do not count.
    """
    kind = points.schema[by].dataType.simpleString()

    def corners(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, g in pdf.groupby(by, dropna=False, sort=False):
                c = hull(g[["x", "y"]].to_numpy(float))
                yield pd.DataFrame({by: pd.Series([None if pd.isna(name) else name] * len(c), dtype=object), "x": c[:, 0], "y": c[:, 1]})

    def cut(df: DataFrame) -> DataFrame:
        return df.mapInPandas(corners, f"`{by}` {kind}, x double, y double")

    rows = points.select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    salted = cut(rows).withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(64)))
    return cut(salted.repartition(by, "_salt").sortWithinPartitions(by).drop("_salt"))


RECTANGLE = "area double, along double, across double, cx double, cy double, ux double, uy double, corners array<struct<x:double,y:double>>"


def bounding_rectangles(points: DataFrame, by: str, x: str = "x", y: str = "y") -> DataFrame:
    """Per group the rectangle of least area, in any direction, that holds all points.

    area; along and across: the lengths of its sides, along (ux, uy) and across it; centre (cx, cy);
    corners.  One side lies on an edge of the hull; of equal areas the first edge's counts.  Groups
    with fewer than three points, or all on a line, have no row.
    """
    kind = points.schema[by].dataType.simpleString()

    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        c = hull(pdf[["x", "y"]].to_numpy(float))
        columns = [by, *[f.split()[0] for f in RECTANGLE.split(", ")]]
        if len(c) < 3:
            return pd.DataFrame(columns=columns)
        edges = np.roll(c, -1, axis=0) - c
        u = edges / np.hypot(*edges.T)[:, None]
        best = None
        for ux, uy in u:  # one pass over the corners for each edge
            p, q = c @ (ux, uy), c @ (-uy, ux)
            lo, hi = (p.min(), q.min()), (p.max(), q.max())
            area = (hi[0] - lo[0]) * (hi[1] - lo[1])
            if best is None or area < best[0]:
                best = area, lo, hi, ux, uy
        area, lo, hi, ux, uy = best

        def back(p: float, q: float) -> tuple[float, float]:
            return p * ux - q * uy, p * uy + q * ux

        four = [dict(zip("xy", back(p, q))) for p, q in ((hi[0], hi[1]), (hi[0], lo[1]), (lo[0], lo[1]), (lo[0], hi[1]))]
        cx, cy = back((lo[0] + hi[0]) / 2, (lo[1] + hi[1]) / 2)
        name = pdf[by].iloc[0]
        return pd.DataFrame([[None if pd.isna(name) else name, area, hi[0] - lo[0], hi[1] - lo[1], cx, cy, ux, uy, four]], columns=columns)

    return hull_points(points, by, x, y).groupBy(by).applyInPandas(least, f"`{by}` {kind}, {RECTANGLE}")


def with_margin(corners: Column, margin: float) -> Column:
    """A rectangle of four corners, in order, with its sides moved outward by the margin."""

    def moved(p: Column, k: Column) -> Column:
        before, after = F.get(corners, (k + 3) % 4), F.get(corners, (k + 1) % 4)
        a, b = unit(before, p), unit(after, p)
        return point(p["x"] + margin * (a["x"] + b["x"]), p["y"] + margin * (a["y"] + b["y"]))

    return F.transform(corners, moved)


# ---- lines


def extended(line: Column, by: float) -> Column:
    """A line made longer by a length at either end, in the direction of its first and last segment."""
    n = F.size(line)
    first, second, last, before = F.get(line, F.lit(0)), F.get(line, F.lit(1)), F.get(line, n - 1), F.get(line, n - 2)

    def beyond(p: Column, d: Column) -> Column:
        return point(p["x"] + by * d["x"], p["y"] + by * d["y"])

    return F.when(n < 2, line).otherwise(F.concat(F.array(beyond(first, unit(second, first))), line, F.array(beyond(last, unit(before, last)))))


def flat_points(lines: Column) -> Column:
    """The points of all parts of a shape, one behind the other."""
    return F.flatten(lines)


def point_at_distance(start: Column, direction: Column, distance: Column, measure: Callable[[Column, Column], Column], steps: int = 60) -> Column:
    """The point from ``start`` in a direction at which ``measure(start, point)`` is the distance.

    The measure grows along the line.  Doubling steps find a bound, halving ones the place, to
    2^-``steps`` of it; an error for a distance that is not positive or no direction.
    """

    def at(t: Column) -> Column:
        return point(start["x"] + t * direction["x"], start["y"] + t * direction["y"])

    far = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.1), lambda t, _: F.when(measure(start, at(t)) < distance, t * 2).otherwise(t))

    def halved(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        short = measure(start, at(middle)) < distance
        return F.struct(F.when(short, middle).otherwise(s["lo"]).alias("lo"), F.when(short, s["hi"]).otherwise(middle).alias("hi"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), far.alias("hi")), halved, lambda s: (s["lo"] + s["hi"]) / 2)
    good = (distance > 0) & (length(direction) > 0)
    return F.when(good, at(ends)).otherwise(F.raise_error(F.lit("a positive distance and a direction are needed")).cast("struct<x:double,y:double>"))


# ---- regions and rasters


def tiles_meeting(polygons: DataFrame, grid: Grid, ring: str = "ring", margin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Pairs of a polygon (without its ring) and a tile (idom, jdom, x0, x1, y0, y1) that share a point.

    Candidates are the tiles of the polygon's bounding box; the box given back is widened by the margin.
    Few bytes of polygons may meet many tiles, so they are dealt to many tasks before.
    """
    box = bbox(F.col(ring))
    polygons = polygons.repartition(parts_of(polygons.sparkSession))
    df = polygons.where(F.col(ring).isNotNull()).withColumns({f"_{k}": v for k, v in box.items()})
    (ia, ja), (ib, jb) = grid.to_ij(F.col("_x0"), F.col("_y0")), grid.to_ij(F.col("_x1"), F.col("_y1"))

    def span(a: Column, b: Column, n: int) -> Column:
        # a box that ends on a border touches the tile before, too
        lo, hi = F.greatest(F.least(a, b) - 1, F.lit(0)), F.least(F.greatest(a, b), F.lit(n - 1))
        return F.when(lo <= hi, F.sequence(lo, hi))

    df = df.withColumn("_i", F.explode(span(ia, ib, grid.nx))).withColumn("_j", F.explode(span(ja, jb, grid.ny)))
    (xa, ya), (xb, yb) = grid.to_xy(F.col("_i"), F.col("_j"), center=False), grid.to_xy(F.col("_i") + 1, F.col("_j") + 1, center=False)
    df = df.withColumns({"_xa": F.least(xa, xb), "_xb": F.greatest(xa, xb), "_ya": F.least(ya, yb), "_yb": F.greatest(ya, yb)})
    corners = F.array(*[point(F.col(f"_x{a}"), F.col(f"_y{b}")) for a, b in ("aa", "ba", "bb", "ab", "aa")])
    first = F.get(ring, F.lit(0))
    within = first["x"].between(F.col("_xa"), F.col("_xb")) & first["y"].between(F.col("_ya"), F.col("_yb"))
    hit = df.where(within | line_meets_ring(corners, F.col(ring)))
    kept = [c for c in polygons.columns if c != ring]
    return hit.select(
        *kept, F.col("_i").alias("idom"), F.col("_j").alias("jdom"),
        (F.col("_xa") - margin[0]).alias("x0"), (F.col("_xb") + margin[0]).alias("x1"), (F.col("_ya") - margin[1]).alias("y0"), (F.col("_yb") + margin[1]).alias("y1"),
    )


def cut_out(cells: DataFrame, polygons: DataFrame, grid: Grid, ring: str = "ring", fill: float | None = None) -> DataFrame:
    """A raster (j, i, v) of which only cells within some polygon keep their value; the others are ``fill``."""
    inside = rasterize(polygons.select(ring), grid, ring).select("j", "i").distinct().withColumn("_in", F.lit(True))
    return cells.join(inside, ["j", "i"], "left").select("j", "i", F.when(F.col("_in"), F.col("v")).otherwise(F.lit(fill).cast("double")).alias("v"))


def reprojected_extent(x0: Column, x1: Column, y0: Column, y1: Column, project: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The box around the four projected corners of a box."""
    xs, ys = zip(*[project(x, y) for x in (x0, x1) for y in (y0, y1)])
    return F.struct(F.least(*xs).alias("x0"), F.greatest(*xs).alias("x1"), F.least(*ys).alias("y0"), F.greatest(*ys).alias("y1"))


# ---- axes


def axis_from_centers(centers: Column) -> Column:
    """n, low and high edge, and signed step of an axis of evenly spaced centres, in either direction."""
    n, first, last = F.size(centers), F.get(centers, F.lit(0)), F.element_at(centers, -1)
    step = F.get(centers, F.lit(1)) - first
    half = F.abs(step) / 2
    return F.struct(n.alias("n"), (F.least(first, last) - half).alias("low"), (F.greatest(first, last) + half).alias("high"), step.alias("step"))


def mean_spacing(axis: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Per line of a grid the mean difference of neighbours: what the ends differ by, over the steps."""
    ends = axis.groupBy(by).agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"), (F.count("*") - 1).alias("_n"))
    return ends.select(by, F.try_divide(F.col("_last") - F.col("_first"), F.col("_n")).alias("spacing"))


def largest_error(df: DataFrame, a: str, b: str, most: float | None = None) -> DataFrame:
    """One row with the greatest difference of two columns; beyond ``most`` it is an error."""
    worst = F.max(F.abs(F.col(a) - F.col(b))).alias("error")
    out = df.agg(worst)
    if most is None:
        return out
    message = F.concat(F.lit("the greatest error is "), F.col("error").cast("string"))
    return out.select(F.when(F.col("error") > most, F.raise_error(message).cast("double")).otherwise(F.col("error")).alias("error"))
