"""Sparse matrices as (row, col, v): overlap, elevation classes, scaling, products."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("row").agg(F.sum("v").alias("w"))


def col_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("col").agg(F.sum("v").alias("w"))


def reciprocal(w: Column) -> Column:
    """1 / w, and 0 for 0."""
    return F.when(w == 0, 0.0).otherwise(1.0 / F.when(w == 0, 1.0).otherwise(w))


def diagonal(weights: DataFrame, index: str, w: str = "w") -> DataFrame:
    return weights.select(F.col(index).alias("row"), F.col(index).alias("col"), F.col(w).alias("v"))


def scale(m: DataFrame) -> DataFrame:
    """Each row divided by its sum; a row of sum 0 becomes 0.  Sums are combined, then joined back."""
    return m.join(row_sums(m), "row").select("row", "col", (F.col("v") * reciprocal(F.col("w"))).alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product, zero entries left out."""
    left, right = a.toDF("row", "k", "a"), b.toDF("k", "col", "b")
    return left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("a") * F.col("b")).alias("v")).where("v != 0")


def compact(m: DataFrame) -> DataFrame:
    """Entries of one place added up, zeros left out."""
    return m.groupBy("row", "col").agg(F.sum("v").alias("v")).where("v != 0")


def overlap(fine: DataFrame, fine_grid: Grid, coarse_grid: Grid, mask: DataFrame | None = None) -> DataFrame:
    """IuA for cells(i, j) of the fine grid: each belongs to the coarse cell that holds its centre.

    v is the signed area dx * dy of a fine cell; cells outside the coarse grid have no entry, nor
    have those that ``mask(i, j, inside)`` does not hold, where it is given.
    """
    if mask is not None:
        fine = fine.join(mask.where("inside").select("i", "j").distinct(), ["i", "j"], "left_semi")
    x, y = fine_grid.to_xy(F.col("i"), F.col("j"))
    ai, aj = coarse_grid.to_ij(x, y)
    placed = fine.select(fine_grid.index(F.col("i"), F.col("j")).alias("row"), ai.alias("_i"), aj.alias("_j"))
    placed = placed.where(coarse_grid.inside(F.col("_i"), F.col("_j")))
    return placed.select("row", coarse_grid.index(F.col("_i"), F.col("_j")).alias("col"), F.lit(float(fine_grid.dx * fine_grid.dy)).alias("v"))


def elevation_matrix(iua: DataFrame, elevation: DataFrame, levels: list[float]) -> DataFrame:
    """IuE: every entry is shared between the two elevation classes around its cell's elevation.

    elevation(row, e) with levels[0] <= e < levels[-1], else an error; column numbers are
    col * len(levels) + class.  An elevation on a level belongs to the interval above it.
    """
    grid, n = F.array(*[F.lit(float(x)) for x in levels]), len(levels)
    upper = F.size(F.filter(grid, lambda x: x <= F.col("e")))
    df = iua.join(elevation.select("row", F.col("e").cast("double").alias("e")), "row")
    inside = (F.col("e") >= levels[0]) & (F.col("e") < levels[-1])
    df = df.withColumn("_u", F.when(inside, upper).otherwise(F.raise_error(F.lit("an elevation lies outside the levels")).cast("int")))
    lo, hi = F.get(grid, F.col("_u") - 1), F.get(grid, F.col("_u"))
    df = df.withColumn("_w", (hi - F.col("e")) / (hi - lo))
    part = lambda k, w: F.struct((F.col("col") * n + k).cast("long").alias("col"), (F.col("v") * w).alias("v"))
    both = df.select("row", F.explode(F.array(part(F.col("_u") - 1, F.col("_w")), part(F.col("_u"), 1.0 - F.col("_w")))).alias("_p"))
    return compact(both.select("row", "_p.col", "_p.v"))


def unpack(index: Column, n_classes: int) -> tuple[Column, Column]:
    """Coarse cell and class of an index of the elevation grid."""
    return F.floor(index / n_classes).cast("long"), F.pmod(index, F.lit(n_classes)).cast("long")


class MatrixSet:
    """The regridding matrices between fine grid I, coarse grid A and elevation grid E; all lazy."""

    def __init__(self, iua: DataFrame, elevation: DataFrame, levels: list[float]):
        self.iua, self.elevation, self.levels = iua, elevation, levels

    @cached_property
    def iue(self) -> DataFrame:
        return elevation_matrix(self.iua, self.elevation, self.levels)

    @property
    def iva(self) -> DataFrame:
        return scale(self.iua)

    @property
    def avi(self) -> DataFrame:
        return scale(transpose(self.iua))

    @property
    def ive(self) -> DataFrame:
        return scale(self.iue)

    @property
    def evi(self) -> DataFrame:
        return scale(transpose(self.iue))

    @property
    def eva(self) -> DataFrame:
        return multiply(self.evi, self.iva)

    @property
    def ave(self) -> DataFrame:
        return multiply(self.avi, self.ive)
