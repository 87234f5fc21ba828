"""Polygons of several parts with holes: rings sorted into shells and their holes, points within them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .spatial import _bins, _edges, bbox, crossings, in_ring, parts_of, points_in_boxes

#: Pairs of polygons and points that a task looks at in one step.
AT_ONCE = 1 << 17
#: array<struct<shell, holes>> of open rings.
POLYGONS = "array<struct<shell:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>>>"


def opened(ring: Column) -> Column:
    """A ring without the repeated first point at its end."""
    n = F.size(ring)
    return F.when((n > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, n - 1)).otherwise(ring)


def signed_area(ring: Column) -> Column:
    """The area within a ring, counter-clockwise positive."""
    origin = F.element_at(ring, 1)
    # relative to one of its points: large coordinates do not cost digits

    def part(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return (a["x"] - origin["x"]) * (b["y"] - origin["y"]) - (b["x"] - origin["x"]) * (a["y"] - origin["y"])

    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + part(e)) / 2


def _holds(outer: Column, inner: Column) -> Column:
    """Whether a ring holds all corners of another one (rings of a layer do not cross)."""
    return F.forall(inner, lambda p: in_ring(p["x"], p["y"], outer))


def polygons_of(parts: Column, outer: str = "clockwise") -> Column:
    """Rings as polygons, array<struct<shell, holes>>: by orientation, or ``outer="nesting"`` by containment alone.

    By orientation, rings that run clockwise are shells (as shapefiles have it) and the others holes, each
    of the smallest shell that holds it; a hole that no shell holds is a shell.  By nesting, a ring within an
    even number of others is a shell.  Rings of fewer than three corners or without an area are left out.
    """
    rings = F.transform(F.filter(parts, lambda r: F.size(r) > 2), opened)
    rings = F.filter(F.transform(rings, lambda r: F.struct(r.alias("ring"), signed_area(r).alias("area"))), lambda r: (r["area"] != 0) & (F.size(r["ring"]) > 2))
    numbered = F.transform(rings, lambda r, k: F.struct(k.alias("k"), r["ring"].alias("ring"), F.abs(r["area"]).alias("size"), (r["area"] < 0).alias("outer")))

    def above(r: Column, others: Column) -> Column:
        """The rings that hold r, the smallest first; of equal rings the earlier one holds the later."""
        larger = lambda o: (o["size"] > r["size"]) | ((o["size"] == r["size"]) & (o["k"] < r["k"]))
        around = F.filter(others, lambda o: larger(o) & _holds(o["ring"], r["ring"]))
        return F.array_sort(F.transform(around, lambda o: F.struct(o["size"].alias("size"), o["k"].alias("k"))))

    if outer == "nesting":
        shell = lambda r, around: F.size(around) % 2 == 0
        parent = lambda around, of: F.get(around, F.lit(0))["k"]
        ranked = F.transform(numbered, lambda r: F.struct(r["k"].alias("k"), r["ring"].alias("ring"), above(r, numbered).alias("around")))
    else:
        shells = F.filter(numbered, lambda r: r["outer"])
        ranked = F.transform(numbered, lambda r: F.struct(r["k"].alias("k"), r["ring"].alias("ring"), F.when(r["outer"], F.array().cast("array<struct<size:double,k:int>>")).otherwise(above(r, shells)).alias("around")))
        shell = lambda r, around: F.size(around) == 0
        parent = lambda around, of: F.get(around, F.lit(0))["k"]
    return F.transform(
        F.filter(ranked, lambda r: shell(r, r["around"])),
        lambda s: F.struct(
            s["ring"].alias("shell"),
            F.transform(F.filter(ranked, lambda h: ~shell(h, h["around"]) & (parent(h["around"], h) == s["k"])), lambda h: h["ring"]).alias("holes"),
        ),
    )


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Whether a point is in a struct<shell, holes>; the border of the shell and of the holes counts as in."""

    def strictly_in(ring: Column) -> Column:
        on = F.exists(_edges(ring), lambda e: _on(x, y, e["a"], e["b"]))
        return in_ring(x, y, ring) & ~on

    return in_ring(x, y, polygon["shell"]) & ~F.exists(polygon["holes"], strictly_in)


def in_polygon_by_ray(x: Column, y: Column, polygon: Column) -> Column:
    """Whether the ray from a point to the right crosses the rings of a struct<shell, holes> an odd number of times."""
    holes = F.aggregate(polygon["holes"], F.lit(0), lambda n, h: n + crossings(x, y, h))
    return (crossings(x, y, polygon["shell"]) + holes) % 2 == 1


def odd_crossings(x: np.ndarray, y: np.ndarray, ends: np.ndarray, edges: tuple[np.ndarray, ...], origin: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(polygon, point) numbers of ``in_polygon_by_ray``, a block of points at a time.

    ``edges``: ax, ay, bx, by of all polygons' edges, one polygon behind the other, of which each ends at
    ``ends``; points are measured from each polygon's ``origin``.  Edges that no ray of these points
    can cross go first, and of those to the right of all points only the heights are compared.
    """
    ox, oy = origin
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    ax, ay, bx, by = edges
    left, right, low, high = x.min() - ox[of], x.max() - ox[of], y.min() - oy[of], y.max() - oy[of]
    slack = 1e-9 * (np.abs(ax) + np.abs(bx))  # far more than the rounding of a crossing
    some = np.flatnonzero(~((np.maximum(ay, by) <= low) | (np.minimum(ay, by) > high) | (np.maximum(ax, bx) + slack < left)))
    beyond = (np.minimum(ax, bx) - slack > right)[some]
    of, ax, ay, bx, by = of[some], ax[some], ay[some], bx[some], by[some]
    # the polygons with most edges first: the k-th edges are those of the first ones
    n = np.bincount(of, minlength=len(ends))
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    order = order[: np.count_nonzero(n)]
    if not len(order):
        return
    n, first = n[order], first[order]
    steps = []
    for k in range(n[0]):
        m = int(np.searchsorted(-n, -k))  # those with more than k edges
        e = first[:m] + k
        near = np.flatnonzero(~beyond[e])
        f = e[near]
        rise = np.where(by[f] == ay[f], 1.0, by[f] - ay[f])
        steps.append((m, ay[e, None], by[e, None], near if len(near) < m else slice(None), *(z[:, None] for z in (ax[f], ay[f], bx[f] - ax[f], rise))))
    ox, oy, size = ox[order, None], oy[order, None], max(1, AT_ONCE // len(order))
    for at in range(0, len(x), size):
        px, py = x[at : at + size] - ox, y[at : at + size] - oy
        odd = np.zeros(px.shape, bool)
        for m, a, b, near, fx, fy, run, rise in steps:
            spans = (a > py[:m]) != (b > py[:m])
            if len(fx):
                spans[near] &= px[:m][near] < fx + (py[:m][near] - fy) * run / rise
            odd[:m] ^= spans
        polygon, point = np.nonzero(odd)
        yield order[polygon], point + at


def _met(fields: list[str], point_columns: list[str]):
    """Rows of one cell behind one another, polygons before points -> the pairs of ``odd_crossings``, in ``fields``."""

    def pairs(layer: list[pa.RecordBatch], points: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(layer).combine_chunks().to_batches()[0] if len(layer) > 1 else layer[0]
        layer[:] = [batch]
        number = lambda b, c: b.column(c).to_numpy(zero_copy_only=False)
        rings = batch.column("edges")
        edges = tuple(z.to_numpy(zero_copy_only=False) for z in rings.flatten().flatten())
        ends = np.cumsum(rings.value_lengths().to_numpy(zero_copy_only=False))
        of = {True: points.column("point"), False: batch.column("other")}
        columns = [of[c in point_columns].field(of[c in point_columns].type.get_field_index(c)) for c in fields]
        for polygon, point in odd_crossings(number(points, "x"), number(points, "y"), ends, edges, (number(batch, "x"), number(batch, "y"))):
            if len(point):
                at = {True: pa.array(point), False: pa.array(polygon)}
                yield pa.RecordBatch.from_arrays([v.take(at[c in point_columns]) for c, v in zip(fields, columns)], names=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, layer = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("ci", "cj", "kind")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                ci, cj, kind = keys[:, i].tolist()
                if (ci, cj) != cell:
                    cell, layer = (ci, cj), []
                if kind == 0:
                    layer.append(batch.slice(i, j - i))
                elif layer:
                    yield from pairs(layer, batch.slice(i, j - i))

    return run


def _points_by_ray(points: DataFrame, polygons: DataFrame, cell: tuple[float, float], x: str, y: str, ox: Column, oy: Column, box: dict[str, Column], keep: list[str]) -> DataFrame:
    """Points and polygons dealt by cell, the polygons of a cell first: a task holds these, and the points stream by."""
    n = parts_of(points.sparkSession)
    at = lambda lo, hi, size: F.explode(_bins(box[lo], box[hi], size))
    rings = F.concat(F.array(F.col("polygon.shell")), F.col("polygon.holes"))
    flat = F.flatten(F.transform(rings, lambda r: F.transform(_edges(r), lambda e: F.struct(e["a"]["x"].alias("ax"), e["a"]["y"].alias("ay"), e["b"]["x"].alias("bx"), e["b"]["y"].alias("by")))))
    own, other = [c for c in keep if c in points.columns], [c for c in keep if c not in points.columns]
    struct = lambda columns: F.struct(*columns) if columns else F.struct(F.lit(None).cast("int").alias("_none"))
    listed = polygons.withColumns({"_edges": flat, "_ox": ox.cast("double"), "_oy": oy.cast("double")}).withColumn("ci", at("x0", "x1", cell[0])).withColumn("cj", at("y0", "y1", cell[1]))
    # of a long ring only the edges beside the cell and to its right; the bounds are wider than any rounding
    wide = lambda a, b, o: 1e-9 * (F.abs(a) + F.abs(b) + F.abs(F.col(o)))
    over = lambda e, c, o, k, size: F.greatest(e[f"a{c}"], e[f"b{c}"]) + F.col(o) + wide(e[f"a{c}"], e[f"b{c}"], o) >= F.col(k) * F.lit(size) * (1 - F.signum(k) * 1e-9)
    under = lambda e: F.least(e["ay"], e["by"]) + F.col("_oy") - wide(e["ay"], e["by"], "_oy") <= (F.col("cj") + 1) * F.lit(cell[1]) * (1 + F.signum(F.col("cj") + 1) * 1e-9)
    edges = F.filter("_edges", lambda e: over(e, "y", "_oy", "cj", cell[1]) & under(e) & over(e, "x", "_ox", "ci", cell[0])).alias("edges")
    listed = listed.select("ci", "cj", F.lit(0).alias("kind"), F.col("_ox").alias("x"), F.col("_oy").alias("y"), edges, struct(other).alias("other"))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    placed = points.where(~F.isnan(px) & ~F.isnan(py))  # null is neither
    placed = placed.select(F.floor(px / cell[0]).alias("ci"), F.floor(py / cell[1]).alias("cj"), F.lit(1).alias("kind"), px.alias("x"), py.alias("y"), struct(own).alias("point"))
    both = listed.unionByName(placed, allowMissingColumns=True).repartition(n, "ci", "cj").sortWithinPartitions("ci", "cj", "kind")
    of = {**{f.name: f for f in polygons.schema.fields}, **{f.name: f for f in points.schema.fields}}
    schema = ", ".join(f"`{c}` {of[c].dataType.simpleString()}" for c in keep)
    return both.mapInArrow(_met(keep, own), schema)


def _on(x: Column, y: Column, a: Column, b: Column) -> Column:
    cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    return (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def area(polygon: Column) -> Column:
    """The area of a struct<shell, holes>."""
    return F.abs(signed_area(polygon["shell"])) - F.aggregate(polygon["holes"], F.lit(0.0), lambda s, h: s + F.abs(signed_area(h)))


def exploded(layer: DataFrame, parts: str = "parts", outer: str = "clockwise") -> DataFrame:
    """One row per polygon of a layer: its other columns, ``part`` (from 0) and ``polygon``."""
    kept = [c for c in layer.columns if c != parts]
    return layer.select(*kept, F.posexplode(polygons_of(F.col(parts), outer)).alias("part", "polygon"))


def exteriors(layer: DataFrame, parts: str = "parts", outer: str = "clockwise") -> DataFrame:
    """All polygons of a layer as one region, exterior rings only: a table (part, ring) of its outlines."""
    return exploded(layer.select(parts), parts, outer).select("part", F.col("polygon.shell").alias("ring"))


def points_in_parts(
    points: DataFrame, layer: DataFrame, cell: float | tuple[float, float], parts: str = "parts", outer: str = "clockwise",
    x: str = "x", y: str = "y", origin: tuple[str, str] | None = None, border: bool = True,
    keep: list[str] | None = None,
) -> DataFrame:
    """Pairs of points and polygons of a layer, holes left out: polygons are listed by the cells of their shell's
    box under a number only, points meet boxes by cell, and the rings come back by that number.

    ``origin`` names columns of the layer from which its rings are measured: points are moved there for the
    exact test, as moved rings would lose digits.  Without ``border`` a point on an edge counts by the ray to
    the right alone, so that of polygons side by side just one holds it; this test is made for whole
    blocks of points of a cell.  ``keep`` names the columns of the result; without it, all.
    """
    cell = cell if isinstance(cell, tuple) else (cell, cell)
    polygons = exploded(layer if border else layer.repartition(parts_of(points.sparkSession)), parts, outer)
    keep = keep or [*points.columns, *polygons.columns]
    ox, oy = (F.col(c) for c in origin) if origin else (F.lit(0.0), F.lit(0.0))
    box = bbox(F.col("polygon.shell"))
    if origin:  # a box that is moved is a little wider than its rounding
        for c, o in (("x", ox), ("y", oy)):
            lo, hi = box[f"{c}0"] + o, box[f"{c}1"] + o
            slack = (F.abs(o) + F.greatest(F.abs(box[f"{c}0"]), F.abs(box[f"{c}1"]))) * 1e-12
            box[f"{c}0"], box[f"{c}1"] = lo - slack, hi + slack
    if not border:
        return _points_by_ray(points, polygons, cell, x, y, ox, oy, box, keep)
    polygons = stage(polygons.withColumn("_polygon", F.monotonically_increasing_id()), "polygons")
    box = polygons.select("_polygon", *[c.alias(n) for n, c in box.items()])
    near = points_in_boxes(points, box, cell, x, y).drop("x0", "x1", "y0", "y1")
    return near.join(polygons, "_polygon").where(in_polygon(F.col(x) - ox, F.col(y) - oy, F.col("polygon"))).select(*keep)
