"""Vector layers with their coordinate system: shapefiles read into one system, layers moved to another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import projection_of
from ..functions.projections import Projection, transformer
from ..operators.polygons import exteriors
from .shapefile import ShapefileSource, crs_of


def transformed(parts: Column, transform: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Parts of shapes (arrays of points) in another system."""

    def point(p: Column) -> Column:
        x, y = transform(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(parts, lambda part: F.transform(part, point))


def reprojected(layer: DataFrame, source: Projection | str | None, target: Projection | str, shape: str = "shape") -> DataFrame:
    """A layer with its shapes in another coordinate system, every other column as it is.

    Systems are projections or their WKT.  A layer without a system is taken to be in the target's already.
    """
    if source is None:
        return layer
    source, target = (projection_of(s) if isinstance(s, str) else s for s in (source, target))
    if source == target:
        return layer
    moved = F.struct(F.col(f"{shape}.kind").alias("kind"), transformed(F.col(f"{shape}.parts"), transformer(source, target)).alias("parts"))
    return layer.withColumn(shape, F.when(F.col(shape).isNotNull(), moved))


def read_layer(spark: SparkSession, path: str, target: Projection | str | None = None, rename: dict[str, str] | None = None, drop: tuple[str, ...] = (), **options) -> DataFrame:
    """A shapefile (or a folder or archive of them) with fid and attributes; with ``target``, reprojected into it
    from the system of its .prj file.  ``rename`` and ``drop`` are for its columns."""
    spark.dataSource.register(ShapefileSource)
    layer = spark.read.format("shapefile").options(**options).load(path)
    if target is not None and "shape" in layer.columns:
        layer = reprojected(layer, crs_of(path.removeprefix("file://")), target)
    return layer.withColumnsRenamed(rename or {}).drop(*drop)


def copy_reprojected(spark: SparkSession, path: str, out: str, target: str) -> None:
    """Write the layer at ``path`` into the system of the WKT ``target``, attributes and all."""
    read_layer(spark, path, target).write.format("shapefile").mode("overwrite").option("wkt", target).save(out)


def region_of(layer: DataFrame, outer: str = "clockwise") -> DataFrame:
    """All polygons of a layer as one region: a table (part, ring) of their exterior rings."""
    polygons = layer.where(F.col("shape.kind") == "polygon").select(F.col("shape.parts").alias("parts"))
    return exteriors(polygons, "parts", outer)
