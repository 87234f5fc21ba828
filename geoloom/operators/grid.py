"""Regular grids: affine index arithmetic as column expressions, domains, tiles, rasterisation."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import wkt_of
from ..functions.projections import Projection
from .spatial import bbox, in_ring, parts_of


def invert_geotransform(gt: tuple[float, ...]) -> tuple[float, ...]:
    """The inverse of x = g0 + i*g1 + j*g2, y = g3 + i*g4 + j*g5; ValueError if there is none."""
    g0, g1, g2, g3, g4, g5 = gt
    if g2 == 0 and g4 == 0 and g1 and g5:
        return (-g0 / g1, 1 / g1, 0.0, -g3 / g5, 0.0, 1 / g5)
    det, size = g1 * g5 - g2 * g4, max(abs(g1), abs(g2)) * max(abs(g4), abs(g5))
    if abs(det) <= 1e-10 * size or det == 0:
        raise ValueError("the geotransform has no inverse")
    return ((g2 * g3 - g0 * g5) / det, g5 / det, -g2 / det, (g0 * g4 - g1 * g3) / det, -g4 / det, g1 / det)


@dataclass(frozen=True)
class Grid:
    """nx by ny cells; geotransform maps (i, j) corners to (x, y)."""

    nx: int
    ny: int
    gt: tuple[float, ...]
    wkt: str = ""

    @property
    def dx(self) -> float:
        return self.gt[1]

    @property
    def dy(self) -> float:
        return self.gt[5]

    @property
    def nxy(self) -> int:
        return self.nx * self.ny

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """x0, x1, y0, y1 in ascending order."""
        xs, ys = (self.gt[0], self.gt[0] + self.nx * self.dx), (self.gt[3], self.gt[3] + self.ny * self.dy)
        return min(xs), max(xs), min(ys), max(ys)

    def to_ij(self, x: Column, y: Column) -> tuple[Column, Column]:
        """The cell that holds a point (floor); of a north-up grid i is known without y, and j without x."""
        v = invert_geotransform(self.gt)
        at = lambda o, a, b: o + x * a + y * b if a and b else o + (x * a if a else y * b)
        return F.floor(at(*v[:3])).cast("int"), F.floor(at(*v[3:])).cast("int")

    def to_xy(self, i: Column, j: Column, center: bool = True) -> tuple[Column, Column]:
        """The centre or the corner of a cell."""
        h, g = (0.5 if center else 0.0), self.gt
        return g[0] + (i + h) * g[1] + (j + h) * g[2], g[3] + (i + h) * g[4] + (j + h) * g[5]

    def inside(self, i: Column, j: Column) -> Column:
        return (i >= 0) & (i < self.nx) & (j >= 0) & (j < self.ny)

    def index(self, i: Column, j: Column) -> Column:
        """Row-major cell number."""
        return (j.cast("long") * self.nx + i).cast("long")

    def flipped(self) -> Grid:
        """The same cells with rows counted from the other end; j becomes ny - 1 - j."""
        g = self.gt
        return replace(self, gt=(g[0], g[1], g[2], g[3] + g[5] * self.ny, g[4], -g[5]))

    def subgrid(self, i0: int, j0: int, nx: int, ny: int) -> Grid:
        g = self.gt
        return replace(self, nx=nx, ny=ny, gt=(g[0] + i0 * g[1] + j0 * g[2], g[1], g[2], g[3] + i0 * g[4] + j0 * g[5], g[4], g[5]))

    def offset_from(self, other: Grid) -> tuple[int, int]:
        """Cells by which this grid's origin lies right of and below the other's, for aligned grids."""
        return round((self.gt[0] - other.gt[0]) / other.dx), round((self.gt[3] - other.gt[3]) / other.dy)

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells (i, j), made by the executors."""
        return spark.range(self.nxy).select((F.col("id") % self.nx).cast("int").alias("i"), F.floor(F.col("id") / self.nx).cast("int").alias("j"))

    def box_ring(self) -> list[tuple[float, float]]:
        x0, x1, y0, y1 = self.extent
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def domain_grid(x0: float, x1: float, y0: float, y1: float, size: tuple[float, float], wkt: str = "") -> Grid:
    """North-up grid of tiles of a size: left and top borders are whole tiles at or below those of the box
    (so up to a tile at the top is left out), right and bottom borders lie at or beyond them."""
    dx, dy = size[0], -size[1]
    left, top = dx * math.floor(x0 / dx), dy * math.ceil(y1 / dy)
    return Grid(math.ceil((x1 - left) / dx), math.ceil((y0 - top) / dy), (left, dx, 0.0, top, 0.0, dy), wkt)


def tiles(spark: SparkSession, grid: Grid, margin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Tiles (idom, jdom, x0, x1, y0, y1), each widened by the margin."""
    x, y = grid.to_xy(F.col("i"), F.col("j"), center=False)
    xs, ys = (x, x + grid.dx), (y, y + grid.dy)
    return grid.cells(spark).select(
        F.col("i").alias("idom"), F.col("j").alias("jdom"),
        (F.least(*xs) - margin[0]).alias("x0"), (F.greatest(*xs) + margin[0]).alias("x1"),
        (F.least(*ys) - margin[1]).alias("y0"), (F.greatest(*ys) + margin[1]).alias("y1"),
    )


def tiles_hit(points: DataFrame, grid: Grid, x: str = "x", y: str = "y", beyond: bool = False) -> DataFrame:
    """Tiles that hold points, with their number: the tile is computed, not searched.

    With ``beyond``, points outside the grid count in the tiles that go on there (numbers below 0 or from nx
    and ny on), and those without a coordinate in null ones.
    """
    i, j = grid.to_ij(F.col(x), F.col(y))
    placed = points.select(i.alias("idom"), j.alias("jdom"))
    placed = placed if beyond else placed.where(grid.inside(F.col("idom"), F.col("jdom")))
    return placed.groupBy("idom", "jdom").agg(F.count("*").alias("n"))


def rasterize(polygons: DataFrame, grid: Grid, ring: str = "ring") -> DataFrame:
    """Cells (i, j, cell) of every polygon whose centre the ring holds, with the polygon's other columns.

    Candidates are the cells of the polygon's bounding box, clipped to the grid.
    """
    box = bbox(F.col(ring))
    polygons = polygons.repartition(parts_of(polygons.sparkSession))  # few bytes may have many cells
    df = polygons.where(F.col(ring).isNotNull()).withColumns({f"_{k}": v for k, v in box.items()})
    ia, ja = grid.to_ij(F.col("_x0"), F.col("_y0"))
    ib, jb = grid.to_ij(F.col("_x1"), F.col("_y1"))
    span = lambda a, b, n: F.when((F.least(a, b) < n) & (F.greatest(a, b) >= 0), F.sequence(F.greatest(F.least(a, b), F.lit(0)), F.least(F.greatest(a, b), F.lit(n - 1))))
    df = df.withColumns({"_is": span(ia, ib, grid.nx), "_js": span(ja, jb, grid.ny)})
    df = df.withColumn("i", F.explode("_is")).withColumn("j", F.explode("_js"))
    x, y = grid.to_xy(F.col("i"), F.col("j"))
    df = df.withColumns({"_x": x, "_y": y}).where(in_ring(F.col("_x"), F.col("_y"), F.col(ring)))
    kept = [c for c in polygons.columns if c != ring]
    return df.select(*kept, "i", "j", grid.index(F.col("i"), F.col("j")).alias("cell"))


def axis(lo: float, step: float, n: int) -> Column:
    """n evenly spaced values from lo."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: lo + k * step)


def lonlat_grid(nlon: int, nlat: int) -> Grid:
    """The whole globe in nlon by nlat cells, latitudes ascending."""
    return Grid(nlon, nlat, (-180.0, 360.0 / nlon, 0.0, -90.0, 0.0, 180.0 / nlat))


def infer_grid(centers: DataFrame, system: Projection, tolerance: float = 1e-4) -> Grid:
    """The grid of ``system`` whose cells (j, i) have their centres at the given lon and lat, in degrees.

    x and y are fitted as origin + step * index over all cells: the sums of the normal equations are one
    aggregate, taken about the middle of the indices and the first coordinates so that they keep their
    digits.  The grid has to give every centre back within ``tolerance`` degrees by the inverse
    projection, and no two centres may be one cell's; else, or with fewer than two rows or columns, a
    ValueError.
    """
    x, y = system.forward(F.col("lon").cast("double"), F.col("lat").cast("double"))
    cells = centers.where("j IS NOT NULL AND i IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL").select("j", "i", "lon", "lat", x.alias("_x"), y.alias("_y"))
    about = cells.agg(*[f(c).alias(f"{n}{c}") for c in ("i", "j") for n, f in (("a", F.min), ("b", F.max))], F.avg("_x").alias("x"), F.avg("_y").alias("y"), F.count("*").alias("n")).first()
    if not about["n"] or about["ai"] == about["bi"] or about["aj"] == about["bj"]:
        raise ValueError("a grid needs two rows and two columns of centres")
    if about["ai"] < 0 or about["aj"] < 0:
        raise ValueError("indices of cells begin at 0")
    mi, mj = (about["ai"] + about["bi"]) / 2, (about["aj"] + about["bj"]) / 2
    terms = {"1": F.lit(1.0), "i": F.col("i") - mi, "j": F.col("j") - mj}
    right = {"x": F.col("_x") - about["x"], "y": F.col("_y") - about["y"]}
    sums = cells.agg(*[F.sum(terms[a] * b).alias(f"{a}{n}") for a in terms for n, b in [*terms.items(), *right.items()]]).first()
    normal = np.array([[sums[a + b] for b in terms] for a in terms])
    (x0, xi, xj), (y0, yi, yj) = (np.linalg.solve(normal, np.array([sums[a + c] for a in terms])).tolist() for c in "xy")
    # north-up grids have no terms across; what the fit leaves of them is rounding
    size = max(abs(xi), abs(yj))
    xj, yi = (0.0 if abs(v) * max(about["bi"], about["bj"]) < 1e-3 * size else v for v in (xj, yi))
    left, top = about["x"] + x0 - xi * (mi + 0.5) - xj * (mj + 0.5), about["y"] + y0 - yi * (mi + 0.5) - yj * (mj + 0.5)
    grid = Grid(about["bi"] + 1, about["bj"] + 1, (left, xi, xj, top, yi, yj), wkt_of(system))
    lon, lat = system.inverse(*grid.to_xy(F.col("i"), F.col("j")))
    turn = F.abs(lon - F.col("lon"))
    off = cells.agg(F.max(F.least(turn, F.abs(360 - turn))).alias("lon"), F.max(F.abs(lat - F.col("lat"))).alias("lat")).first()
    if off["lon"] is None or max(off["lon"], off["lat"]) > tolerance:
        raise ValueError(f"the cells are no grid of this system: centres are off by {off['lon']} degrees of longitude and {off['lat']} of latitude")
    return grid
