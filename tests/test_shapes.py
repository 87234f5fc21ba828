import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import raster, shapes, spatial, tables
from geoloom.sources import files


def test_hull_and_rectangle_of_a_turned_box(spark):
    rng = np.random.default_rng(3)
    inner = rng.uniform(-1, 1, (400, 2)) * (5, 2)
    box = np.vstack([inner, [[5, 2], [5, -2], [-5, -2], [-5, 2]]])
    turn = np.array([[math.cos(0.7), -math.sin(0.7)], [math.sin(0.7), math.cos(0.7)]])
    rows = [("a", *map(float, p)) for p in box @ turn.T] + [("b", 0.0, 0.0), ("b", 1.0, 1.0), ("c", 1.0, None), (None, 0.0, 0.0), (None, 1.0, 0.0), (None, 0.0, 1.0)]
    points = spark.createDataFrame(rows, "k string, x double, y double").repartition(7)
    got = {r["k"]: r for r in shapes.bounding_rectangles(points, "k").collect()}
    assert set(got) == {"a", None}
    assert got["a"]["area"] == pytest.approx(40) and got[None]["area"] == pytest.approx(1)
    assert sorted((got["a"]["along"], got["a"]["across"])) == pytest.approx([4, 10])
    assert (got["a"]["cx"], got["a"]["cy"]) == pytest.approx((0, 0), abs=1e-9)
    assert len(got["a"]["corners"]) == 4
    assert shapes.bounding_rectangles(points.limit(0), "k").count() == 0


def test_lines_and_ring(spark):
    ring = spatial.ring_of([(0, 0), (4, 0), (4, 4), (0, 4)])
    lines = {"inside": [(1, 1), (2, 2)], "through": [(-1, 2), (5, 2)], "touching": [(4, 4), (6, 6)], "beside": [(5, 0), (5, 9)], "point": [(2, 2)], "none": []}
    df = spark.createDataFrame([(k, [tuple(map(float, p)) for p in v]) for k, v in lines.items()], f"k string, line {spatial.RING}")
    got = {r["k"] for r in df.where(spatial.line_meets_ring(F.col("line"), ring)).collect()}
    assert got == {"inside", "through", "touching", "point"}


def test_distance_needs_a_direction(spark):
    one = spark.range(1)
    measure = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    zero = shapes.point(F.lit(0), F.lit(0))
    with pytest.raises(Exception, match="positive distance"):
        one.select(shapes.point_at_distance(zero, zero, F.lit(3.0), measure)).collect()


def test_moving_average_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(raster, "POINTS", 5)
    rows = [(k, float(i), float(i * i % 17)) for k in ("a", "b") for i in range(33)] + [("c", 0.0, 1.0)]
    got = raster.moving_average(spark.createDataFrame(rows, "k string, x double, y double"), 4, by=["k"]).collect()
    want = {(k, float(i)): sum(j * j % 17 for j in range(i - 3, i + 1)) / 4 for k in ("a", "b") for i in range(3, 33)}
    assert {(r["k"], r["x"]): r["ma"] for r in got} == pytest.approx(want)


def test_overrides_must_be_unique(spark):
    base = spark.createDataFrame([(1, 2.0)], "k int, v double")
    over = spark.createDataFrame([(1, 3.0), (1, 4.0)], "k int, v double")
    with pytest.raises(tables.JoinError):
        tables.override_cols(base, over, "k", [("v",)])


def test_globs_and_texts_that_are_no_collections(spark, tmp_path):
    for name in ("a1.txt", "a2.txt", "b1.txt"):
        (tmp_path / name).write_text("x")
    got = [r["path"][-6:] for r in files.list_globs(spark, [f"{tmp_path}/a*", f"{tmp_path}/*1.txt"]).collect()]
    assert got == ["a1.txt", "a2.txt", "b1.txt"]
    texts = spark.createDataFrame([("{",), (None,), ('{"features": []}',)], "t string")
    assert files.features_of(texts, "t").count() == 0
