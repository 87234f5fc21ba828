"""Known cases, properties, and equivalence of the binned joins with the naive ones."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import paths, projections, timeunits, values
from geoloom.operators import grid as gr
from geoloom.operators import matrix as mx
from geoloom.operators import raster as ra
from geoloom.operators import shapes as sh
from geoloom.operators import spatial as sp
from geoloom.operators import tables as tb
from geoloom.plans.catalog import QUERIES


def entries(df):
    return sorted((r["row"], r["col"], round(r["v"], 9)) for r in df.collect())


def test_elevation_classes(spark):
    coarse, fine = gr.Grid(1, 2, (0, 2, 0, 4, 0, -2)), gr.Grid(2, 4, (0, 1, 0, 4, 0, -1))
    cells = fine.cells(spark).where("NOT (j = 1 AND i = 1)")
    iua = mx.overlap(cells, fine, coarse)
    assert [(r, c) for r, c, _ in entries(iua)] == list(zip((0, 1, 2, 4, 5, 6, 7), (0, 0, 0, 1, 1, 1, 1)))
    assert {v for _, _, v in entries(iua)} == {-1.0}  # signed area of a north-up grid
    elevation = spark.range(8).select(F.col("id").alias("row"), F.col("id").cast("double").alias("e"))
    m = mx.MatrixSet(iua, elevation, [0.0, 1.5, 5.5, 8.0])
    assert {v for _, _, v in entries(m.eva)} == {1.0}
    sums = {r.row: r.w for r in mx.row_sums(m.evi).collect()}
    assert all(abs(w - 1) < 1e-12 for w in sums.values()) and 3 not in sums and 4 not in sums


def test_elevation_outside_fails(spark):
    iua = spark.createDataFrame([(0, 0, 1.0)], "row long, col long, v double")
    with pytest.raises(Exception, match="outside the levels"):
        mx.elevation_matrix(iua, spark.createDataFrame([(0, 9.0)], "row long, e double"), [0.0, 8.0]).collect()


@given(st.tuples(*[st.floats(-100, 100) for _ in range(6)]))
@settings(max_examples=100, deadline=None)
def test_affine_inverse(gt):
    try:
        v = gr.invert_geotransform(gt)
    except ValueError:
        return
    if abs(gt[1] * gt[5] - gt[2] * gt[4]) < 1e-3:
        return
    i, j = 3.5, -2.25
    x, y = gt[0] + i * gt[1] + j * gt[2], gt[3] + i * gt[4] + j * gt[5]
    assert math.isclose(v[0] + x * v[1] + y * v[2], i, abs_tol=1e-4) and math.isclose(v[3] + x * v[4] + y * v[5], j, abs_tol=1e-4)


def test_centres_come_back(spark):
    g = gr.Grid(7, 5, (-3.0, 0.7, 0.0, 11.0, 0.0, -0.3))
    x, y = g.to_xy(F.col("i"), F.col("j"))
    back = g.cells(spark).select("i", "j", x.alias("x"), y.alias("y"))
    i, j = g.to_ij(F.col("x"), F.col("y"))
    assert back.where((i != F.col("i")) | (j != F.col("j"))).count() == 0
    assert g.flipped().flipped() == g or g.flipped().gt[5] == -g.gt[5]


def test_spiral(spark):
    x, y = values.ulam_xy(F.col("id"))
    df = spark.range(3000).select("id", x.alias("x"), y.alias("y"))
    assert df.where(values.ulam_n(F.col("x"), F.col("y")) != F.col("id")).count() == 0
    assert [tuple(r) for r in df.where("id < 5").select("x", "y").collect()] == [(0, 0), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def test_binned_overlap_is_the_naive_one(spark):
    rng = np.random.default_rng(1)
    mk = lambda n, key: spark.createDataFrame([(k, float(a), float(a + w)) for k, (a, w) in enumerate(zip(rng.integers(0, 60, n), rng.integers(0, 25, n)))], f"{key} long, lo double, hi double")
    a, b = mk(60, "a"), mk(50, "b")
    got = {(r.a, r.b, r.r0, r.r1) for r in sp.overlapping(a, b, 7.0).collect()}
    x, y = a.collect(), b.collect()
    want = {(p.a, q.b, max(p.lo, q.lo), min(p.hi, q.hi)) for p in x for q in y if max(p.lo, q.lo) <= min(p.hi, q.hi)}
    assert got == want and sp.overlapping(a, b, 7.0).count() == len(want)


def test_points_on_the_edge_match(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 1.0, 1.0), (3, 3.0, 3.0), (4, 0.5, 0.25)], "id long, x double, y double")
    polys = spark.createDataFrame([(9, [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]), (8, None)], f"pid long, ring {sp.RING}")
    assert {r.id for r in sp.points_in_polygons(pts, polys, 1.0).collect()} == {0, 1, 2, 4}


def test_boxes_meeting(spark):
    boxes = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (2, 5.0, 6.0, 5.0, 6.0), (3, 1.0, 9.0, 1.0, 2.0)], "id long, x0 double, x1 double, y0 double, y1 double")
    query = spark.createDataFrame([(0.5, 1.0, 0.5, 1.0)], "x0 double, x1 double, y0 double, y1 double")
    assert {r.id for r in sp.boxes_meeting(boxes, query, 2.0).collect()} == {1, 3}


def test_duplicates_rules(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    assert {r.v for r in tb.duplicates(df, ["k"]).collect()} == {"a", "b", "d", "e"}
    assert {r.v for r in tb.check_unique(df, ["k"], ignore=True).collect()} == {"c"}
    with pytest.raises(tb.JoinError) as e:
        tb.check_unique(df, ["k"])
    assert e.value.rows.count() == 4


def test_overrides_displace_matches(spark):
    left = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "lk int, name string")
    right = spark.createDataFrame([(10, "x"), (20, "y")], "rk int, val string")
    links = spark.createDataFrame([(1, 10), (2, 10), (2, 20)], "lk int, rk int")
    match = tb.Match(left, right, "lk", "rk", links)
    with pytest.raises(tb.JoinError):
        match.left_join()
    over = spark.createDataFrame([(2, 20), (3, None)], "lk int, rk int")
    assert {(r.lk, r.val) for r in match.left_join(over).collect()} == {(1, "x"), (2, "y"), (3, None)}
    with pytest.raises(tb.JoinError):
        match.left_join(spark.createDataFrame([(1, 10), (1, 20)], "lk int, rk int"), ignore_dups=True)
    assert {(r.lk, r.val) for r in match.left_join(ignore_dups=True).collect()} == {(1, "x"), (2, None), (3, None)}


def test_override_null_falls_back(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, v double")
    over = spark.createDataFrame([(1, None), (2, 9.0)], "k int, v double")
    assert {(r.k, r.v) for r in tb.override_cols(df, over, "k", [("v",)]).collect()} == {(1, 5.0), (2, 9.0)}


def test_split_na_counts_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "v double")
    have, gone = tb.split_na(df, "v")
    assert (have.count(), gone.count()) == (1, 2)


def dense(df, ny, nx):
    out = np.full((ny, nx), np.nan)
    for r in df.collect():
        out[r.j, r.i] = r.v
    return out


def test_stencil_is_a_convolution(spark):
    rng = np.random.default_rng(2)
    ny, nx = 6, 7
    a = rng.integers(-9, 9, (ny, nx)).astype(float)
    cells = spark.createDataFrame([(j, i, float(a[j, i])) for j in range(ny) for i in range(nx)], "j int, i int, v double")
    kernel = {(p - 2, q - 2): float(ra.GRADIENT_X[p][q]) for p in range(5) for q in range(5)}
    padded = np.pad(a, 2, mode="symmetric")
    want = sum(w * padded[2 - dj : 2 - dj + ny, 2 - di : 2 - di + nx] for (dj, di), w in kernel.items())
    assert np.allclose(dense(ra.stencil(cells, kernel, nx, ny), ny, nx), want)


def test_extend_keeps_what_is_there(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (5, 5, 3.0)], "j int, i int, v double")
    out = dense(ra.extend_raster(cells, 12, 12), 12, 12)
    assert out[0, 0] == 1.0 and out[5, 5] == 3.0 and np.isfinite(out[1, 1]) and np.nanmin(out) > 1 - 1e-9 and np.nanmax(out) < 3 + 1e-9


def test_spline_goes_through_points():
    x, y = np.array([0.0, 1.0, 2.5, 4.0]), np.array([1.0, 3.0, -2.0, 0.5])
    assert np.allclose(ra.natural_spline(x, y, x), y)


def test_two_days(spark):
    v = timeunits.convert_steps(F.lit(2.0), "days since 2000-01-01", "seconds since 2000-01-01")
    assert spark.range(1).select(v).first()[0] == 172800
    with pytest.raises(ValueError):
        timeunits.parse_reference("days since 2000-01-01", "360_day")


def test_projections_at_known_places(spark):
    at = lambda f: tuple(spark.range(1).select(*f).first())
    x, y = at(projections.polar_stereographic(F.lit(-45.0), F.lit(90.0), 70.0, -45.0))
    assert abs(x) < 1e-6 and abs(y) < 1e-6
    # worked examples of the published formulas
    x, y = at(projections.lambert_conformal(F.lit(-75.0), F.lit(35.0), 33.0, 45.0, 23.0, -96.0, (1.0, 0.0)))
    assert math.isclose(x, 0.2966785, abs_tol=1e-6) and math.isclose(y, 0.2462112, abs_tol=1e-6)
    x, y = at(projections.albers(F.lit(-75.0), F.lit(35.0), 29.5, 45.5, 23.0, -96.0, (1.0, 0.0)))
    assert math.isclose(x, 0.2952720, abs_tol=1e-6) and math.isclose(y, 0.2416774, abs_tol=1e-6)


def test_typed_fields_raise(spark):
    df = spark.createDataFrame([("maybe",)], "s string")
    with pytest.raises(Exception, match="not a boolean"):
        df.select(values.parse_bool(F.col("s"))).collect()
    with pytest.raises(Exception, match="not one of"):
        df.select(values.parse_enum(F.col("s"), ["a"])).collect()


def test_colours_round_trip(spark):
    hsv = spark.range(1).select(values.rgb_to_hsv(F.lit(200), F.lit(40), F.lit(90)).alias("c")).select("c.*")
    rgb = hsv.select(values.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v")).alias("c")).select("c.*").first()
    assert all(abs(a - b) <= 1 for a, b in zip(rgb, (200, 40, 90)))


def test_spiral_walks_and_comes_back(spark):
    n = spark.range(2000)
    x, y = values.ulam_xy(F.col("id"))
    rows = n.select("id", x.alias("x"), y.alias("y")).select("*", values.ulam_n(F.col("x"), F.col("y")).alias("n")).orderBy("id").collect()
    assert all(r.id == r.n for r in rows) and [(r.x, r.y) for r in rows[:10]] == [(0, 0), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (1, 2)]
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:]))
    far = spark.createDataFrame([(k,) for k in (2**52 + 1, 2**60 + 12345, (2 * 10**9 + 1) ** 2, (2 * 10**9 + 1) ** 2 - 1)], "id long")
    x, y = values.ulam_xy(F.col("id"))
    assert all(r.id == r.n for r in far.select("id", values.ulam_n(x, y).alias("n")).collect())


def test_checksum_of_maps_in_any_order(spark):
    kind = "struct<m:map<string,map<int,array<double>>>,s:string>"
    one, two = {"a": {1: [1.0], 2: None}, "b": {}}, {"b": {}, "a": {2: None, 1: [1.0]}}
    rows = [((one, "x"),), ((two, "x"),), ((one, "y"),), (({"a": {1: [1.5], 2: None}, "b": {}}, "x"),), ((None, "x"),), (None,)]
    df = spark.createDataFrame(rows, f"v {kind}")
    sums = [r[0] for r in df.coalesce(1).select(values.checksum_of(df, "v")).collect()]
    assert sums[0] == sums[1] and len(set(sums)) == 5


def test_speeds_are_rounded_by_their_binary_value(spark):
    ties = [0.25, 0.75, 0.15, 0.35, 1.45, -0.25, -0.04, -0.0, 1023.95, 5e-324, 700.05]
    just = [math.nextafter(k / 20, way) for k in range(1, 200, 2) for way in (-1, 1e9)]
    plain = [*ties, *just, *[k / 40 for k in range(400)]]
    large = [(v * 1024**k, f"{v:.1f}{unit}") for k, unit in ((1, "kB/s"), (2, "MB/s"), (3, "GB/s")) for v in (1.25, 7.0625, 2.75, 9.35)]
    want = [(v, f"{v:.1f}B/s") for v in plain] + large
    rows = spark.createDataFrame(list(enumerate(v for v, _ in want)), "k int, v double")
    got = rows.select("k", paths.human_speed(F.col("v")).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == [s for _, s in want]


def test_many_pairs_of_few_rows_are_many_tasks(spark):
    points = spark.range(600).select("id", (F.col("id") * 7 % 100).cast("double").alias("x"), (F.col("id") * 13 % 90).cast("double").alias("y"))
    x0, y0 = (F.col("id") * 11 % 80).cast("double"), (F.col("id") * 5 % 70).cast("double")
    boxes = spark.range(200).select(F.col("id").alias("box"), x0.alias("x0"), (x0 + 60).alias("x1"), y0.alias("y0"), (y0 + 8).alias("y1"))
    got = sp.points_in_boxes(points, boxes, (10.0, 4.0)).select("id", "box", F.spark_partition_id().alias("part")).collect()
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    assert sorted((r.id, r.box) for r in got) == sorted(map(tuple, points.join(boxes, inside).select("id", "box").collect()))
    parts = [r.part for r in got]
    assert len(set(parts)) > 30 and max(map(parts.count, set(parts))) < len(parts) / 8


def test_tiles_beyond_the_domain_count(spark, tmp_path):
    rows = [(1, -2000.0), (2, 10499.995), (3, 12001.0), (4, 50.0), (1000, 50.0), (5, None)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = {(r.idom, r.jdom): r.n for r in QUERIES["q_domain_tiles"](spark, str(tmp_path)).collect()}
    assert got == {(-1, 4): 1, (7, 4): 1, (9, 4): 1, (1, 4): 2, (None, 4): 1}


def test_polygons_are_dealt_before_their_tiles(spark):
    one = spark.range(0, 500, 1, 1).select("id", sp.ring_of([(0.1, 0.1), (3.9, 0.2), (2.0, 3.8)]).alias("ring"))
    grid = gr.Grid(4, 4, (0.0, 1.0, 0.0, 4.0, 0.0, -1.0))
    for found in (sh.tiles_meeting(one, grid), gr.rasterize(one, grid)):
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 30
