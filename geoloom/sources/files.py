"""GeoJSON, palettes, rasters and listings."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import hsv_to_rgb
from ..operators.grid import Grid

_FEATURE = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: properties, kind, coordinates (as JSON text)."""
    return features_of(spark.read.text(path, wholetext=True), "value")


def features_of(docs: DataFrame, text: str) -> DataFrame:
    """One row per feature of the feature collections in a text column; other texts have none."""
    docs = docs.select(F.col(text).alias("value"))
    features = docs.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), f"array<struct<{_ddl(_FEATURE)}>>")).alias("f"))
    return features.select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def _ddl(fields: str) -> str:
    return ",".join(":".join(f.split(" ", 1)) for f in fields.split(", "))


def geojson_traces(spark: SparkSession, path: str, project=None) -> DataFrame:
    """(date, line) of LineString features with a date property; ``project`` maps (x, y) columns."""
    project = project or (lambda x, y: (x, y))
    lines = geojson_features(spark, path).where("kind = 'LineString'")
    pts = F.from_json("coordinates", "array<array<double>>")

    def point(p):
        x, y = project(p[0], p[1])
        return F.struct(x.alias("x"), y.alias("y"))

    return lines.select(F.to_date(F.element_at("properties", "date")).alias("date"), F.transform(pts, point).alias("line"))


def read_palette(spark: SparkSession, path: str, reverse: bool = False, scale: float = 1.0) -> DataFrame:
    """Lines of eight numbers ``v0 a b c v1 a b c`` as (v0, r0, g0, b0, v1, r1, g1, b1), by v0.

    A line ``# COLOR_MODEL = HSV`` says that colours are hue, saturation and value; they become red, green and blue.
    """
    number = r"\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    pattern = "^" + number * 8 + r"\s*$"
    names = ["v0", "r0", "g0", "b0", "v1", "r1", "g1", "b1"]
    text = spark.read.text(path)
    hsv = not text.where(F.col("value").rlike(r"^#\s*COLOR_MODEL\s*=\s*HSV\s*$")).isEmpty()
    lines = text.where(F.col("value").rlike(pattern))
    rows = lines.select(*[F.regexp_extract("value", pattern, k + 1).cast("double").alias(n) for k, n in enumerate(names)])
    if hsv:
        colour = {k: hsv_to_rgb(F.col(f"r{k}"), F.col(f"g{k}"), F.col(f"b{k}")) for k in "01"}
        rows = rows.select("v0", "v1", *[c[x].cast("double").alias(f"{x}{k}") for k, c in colour.items() for x in "rgb"]).select(*names)
    rows = rows.withColumns({"v0": F.col("v0") * scale, "v1": F.col("v1") * scale})
    if reverse:
        ends = rows.agg(F.min("v0").alias("lo"), F.max("v1").alias("hi"))
        rows = rows.join(F.broadcast(ends)).select(  # one row
            (F.col("lo") + F.col("hi") - F.col("v1")).alias("v0"), *[F.col(f"{c}1").alias(f"{c}0") for c in "rgb"],
            (F.col("lo") + F.col("hi") - F.col("v0")).alias("v1"), *[F.col(f"{c}0").alias(f"{c}1") for c in "rgb"],
        )
    return rows.orderBy("v0")


def discrete_colors(palette: DataFrame, n: int, keep: int | None = None) -> DataFrame:
    """The first ``keep`` of ``n`` colours evenly spaced over a palette: (k, r, g, b), components in 0..1.

    A segment of the palette lists the numbers that fall into it, and mixes its two colours there; where two
    segments meet, the upper one counts.
    """
    ends = palette.agg(F.min("v0").alias("lo"), F.max("v1").alias("hi"))
    steps = max(n - 1, 1)
    placed = palette.join(F.broadcast(ends))  # one row
    at = lambda v: (F.col(v) - F.col("lo")) / (F.col("hi") - F.col("lo")) * steps
    first, last = F.ceil(F.round(at("v0"), 9)), F.least(F.floor(F.round(at("v1"), 9)), F.lit((keep or n) - 1))
    listed = placed.where(first <= last).select("v0", at("v0").alias("_a"), at("v1").alias("_b"), *[f"{c}{k}" for c in "rgb" for k in "01"], F.explode(F.sequence(first, last)).alias("k"))
    share = F.coalesce(F.try_divide(F.col("k") - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))
    mixed = F.struct(*[((F.col(f"{c}0") + share * (F.col(f"{c}1") - F.col(f"{c}0"))) / 255).alias(c) for c in "rgb"])
    return listed.groupBy(F.col("k").cast("int").alias("k")).agg(F.max_by(mixed, "v0").alias("_c")).select("k", "_c.*")


def write_raster(cells: DataFrame, grid: Grid, path: str, nodata: float | None = None) -> None:
    """(j, i, v) as Parquet with the grid in the column's metadata; nulls as nodata if one is given."""
    v = F.coalesce("v", F.lit(nodata)) if nodata is not None else F.col("v")
    about = {"grid": json.dumps({"nx": grid.nx, "ny": grid.ny, "gt": list(grid.gt), "wkt": grid.wkt, "nodata": nodata})}
    cells.select("j", "i", v.alias("v", metadata=about)).write.mode("overwrite").parquet(path)


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """The cells, nodata as null, and the grid."""
    df = spark.read.parquet(path)
    about = json.loads(df.schema["v"].metadata["grid"])
    grid = Grid(about["nx"], about["ny"], tuple(about["gt"]), about["wkt"])
    v = F.col("v") if about["nodata"] is None else F.when(F.col("v") != about["nodata"], F.col("v"))
    return df.select("j", "i", v.alias("v")), grid


def list_files(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Files of a folder whose name matches (from its start), with the pattern's groups as columns."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("path", "modificationTime", "length")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    files = files.withColumn("name", name).where(F.col("name").rlike("^(?:" + pattern + ")"))
    return files.select("*", *[F.regexp_extract("name", pattern, k + 1).alias(n) for k, n in enumerate(names)]).orderBy(*(names or ["name"]))


def first_found(wanted: DataFrame, files: DataFrame, name: str, path: str, sep: str = ":") -> DataFrame:
    """``wanted(name, path)`` with the first folder of the search path, in ``files(folder, name)``, that holds the name; else null."""
    folders = wanted.select("*", F.posexplode(F.split(path, sep)).alias("_at", "folder"))
    hits = folders.join(files.select("folder", name).distinct(), ["folder", name])
    best = hits.groupBy(*[F.col(c) for c in (name, path)]).agg(F.min_by("folder", "_at").alias("folder"))
    return wanted.join(best, [name, path], "left")


def list_globs(spark: SparkSession, globs: list[str]) -> DataFrame:
    """Files that match any of several globs, each once, by path."""
    files = [spark.read.format("binaryFile").load(g).select("path", "modificationTime", "length") for g in globs]
    return reduce(DataFrame.union, files).distinct().orderBy("path")
