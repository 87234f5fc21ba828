"""Mosaics: many rasters of one lattice as one, of which only the tiles that a window touches are read."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid

#: Cells along a side of a file of cells.
SIDE = 1024


def add_tiles(cells: DataFrame, manifest: DataFrame, path: str, grid: Grid) -> None:
    """Add tiles to the mosaic at ``path``: ``manifest(tile, i0, j0, nx, ny)`` places them on the lattice of ``grid``,
    ``cells(tile, j, i, v)`` are their cells counted from their own corner.

    Cells lie in folders by tile; the manifest is a table of its own, with the lattice in its metadata.
    """
    about = {"grid": json.dumps({"gt": list(grid.gt), "wkt": grid.wkt})}
    rows = manifest.select(F.col("tile").cast("string").alias("tile", metadata=about), *[F.col(c).cast("long").alias(c) for c in ("i0", "j0", "nx", "ny")])
    cells.select("tile", "j", "i", "v").repartition("tile", F.floor(F.col("j") / SIDE)).write.partitionBy("tile").mode("append").parquet(f"{path}/cells")
    rows.write.mode("append").parquet(f"{path}/manifest")


def open_mosaic(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """The manifest, and the grid that holds all tiles."""
    manifest = spark.read.parquet(f"{path}/manifest")
    about = json.loads(manifest.schema["tile"].metadata["grid"])
    box = manifest.agg(F.min("i0"), F.min("j0"), F.max(F.col("i0") + F.col("nx")), F.max(F.col("j0") + F.col("ny"))).first()
    if box[0] is None:
        raise ValueError(f"the mosaic at {path} has no tile")
    lattice = Grid(0, 0, tuple(about["gt"]), about["wkt"])
    return manifest, lattice.subgrid(box[0], box[1], box[2] - box[0], box[3] - box[1])


def tiles_of(manifest: DataFrame, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The tiles that a window (i0, j0, nx, ny) of the lattice touches; without a window, all."""
    if window is None:
        return manifest
    i0, j0, nx, ny = window
    return manifest.where((F.col("i0") < i0 + nx) & (F.col("i0") + F.col("nx") > i0) & (F.col("j0") < j0 + ny) & (F.col("j0") + F.col("ny") > j0))


def read_mosaic(spark: SparkSession, path: str, extent: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, Grid]:
    """The cells (j, i, v) of a mosaic within an extent (x0, x1, y0, y1), and their grid.

    The tiles that the extent touches come from the manifest, and only their folders are read.  Where tiles
    overlap, the last by name that has a value counts.  The extent is widened to whole cells and cut to
    the mosaic; one beside it is a ValueError.
    """
    manifest, whole = open_mosaic(spark, path)
    lattice = Grid(0, 0, tuple(json.loads(manifest.schema["tile"].metadata["grid"])["gt"]))
    i0, j0 = whole.offset_from(lattice)
    window = (i0, j0, whole.nx, whole.ny)
    if extent:
        x0, x1, y0, y1 = extent
        (dx, dy), (gx, gy) = (lattice.dx, lattice.dy), (lattice.gt[0], lattice.gt[3])
        us, vs = sorted([(x0 - gx) / dx, (x1 - gx) / dx]), sorted([(y0 - gy) / dy, (y1 - gy) / dy])
        a, b = max(i0, int(us[0] // 1)), min(i0 + whole.nx, int(-(-us[1] // 1)))
        c, d = max(j0, int(vs[0] // 1)), min(j0 + whole.ny, int(-(-vs[1] // 1)))
        if a >= b or c >= d:
            raise ValueError("the extent lies beside the mosaic")
        window = (a, c, b - a, d - c)
    i0, j0, nx, ny = window
    hit = tiles_of(manifest, window)
    # names of the tiles that are hit: the list of files that the scan needs on the driver anyway
    names = [r[0] for r in hit.select("tile").distinct().collect()]
    cells = spark.read.schema("j int, i int, v double, tile string").parquet(f"{path}/cells").where(F.col("tile").isin(names))
    places = hit.select("tile", F.col("i0").alias("_i"), F.col("j0").alias("_j"))
    placed = cells.where("v IS NOT NULL").join(places, "tile").select((F.col("j") + F.col("_j") - j0).cast("int").alias("j"), (F.col("i") + F.col("_i") - i0).cast("int").alias("i"), "v", "tile")
    grid = replace(whole, nx=nx, ny=ny, gt=lattice.subgrid(i0, j0, nx, ny).gt)
    inside = placed.where(grid.inside(F.col("i"), F.col("j")))
    return inside.groupBy("j", "i").agg(F.max_by("v", "tile").alias("v")), grid
