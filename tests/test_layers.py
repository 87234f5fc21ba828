"""Projections and their inverses, WKT, warps, filled holes, inferred grids, mosaics, shapefiles in folders and archives."""

import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import crs
from geoloom.functions import projections as pj
from geoloom.operators import fill, polygons
from geoloom.operators import grid as gr
from geoloom.operators import raster as ra
from geoloom.operators.spatial import RING
from geoloom.plans.layer_queries import LONLAT_WKT, NORTH_WKT
from geoloom.sources import layers, mosaic
from geoloom.sources.shapefile import SHAPE, ShapefileSource, places_of

SYSTEMS = [
    pj.Projection("stere", (70.0, -45.0)), pj.Projection("stere", (-71.0, 0.0), x_0=10.0, y_0=-5.0), pj.Projection("stere", (90.0, 10.0)),
    pj.Projection("lcc", (33.0, 45.0, 39.0, -96.0), pj.SPHERE), pj.Projection("lcc", (64.0, 64.0, 64.0, -152.0)), pj.Projection("lcc", (-30.0, -50.0, -40.0, 20.0)),
    pj.Projection("aea", (29.5, 45.5, 23.0, -96.0)), pj.Projection("aea", (-10.0, -40.0, -20.0, 100.0), pj.SPHERE, unit=0.3048), pj.Projection("longlat"),
]


@pytest.mark.parametrize("p", SYSTEMS, ids=lambda p: f"{p.kind}{p.parameters}")
def test_there_and_back_again(spark, p):
    south = bool(p.parameters) and p.parameters[0] < 0
    lat = (F.col("id") * 0.37) % 88 + 1.5
    points = spark.range(5000).select(((F.col("id") * 7.3) % 360 - 180).alias("lon"), (-lat if south else lat).alias("lat"))
    x, y = p.forward(F.col("lon"), F.col("lat"))
    points = points.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    turn = F.pmod(lon - F.col("lon") + 180, F.lit(360.0)) - 180
    off = points.agg(F.max(F.abs(turn)).alias("lon"), F.max(F.abs(lat - F.col("lat"))).alias("lat"), F.count(lat).alias("n")).first()
    assert off.n == 5000 and off.lon < 1e-9 and off.lat < 1e-9


def test_points_that_have_no_latitude(spark):
    lon, lat = SYSTEMS[6].inverse(F.lit(1e9), F.lit(1e9))
    assert spark.range(1).select(lat).first()[0] is None
    pole = SYSTEMS[0].inverse(F.lit(0.0), F.lit(0.0))
    assert [round(v, 9) for v in spark.range(1).select(*pole).first()] == [-45.0, 90.0]


@pytest.mark.parametrize("p", SYSTEMS, ids=lambda p: f"{p.kind}{p.parameters}")
def test_wkt_round_trip(p):
    q = crs.projection_of(crs.wkt_of(p))
    assert (q.kind, q.parameters, q.x_0, q.y_0, q.unit) == (p.kind, p.parameters, p.x_0, p.y_0, p.unit)
    assert q.ellipsoid == pytest.approx(p.ellipsoid, abs=1e-12)


def test_wkt_grammar():
    assert crs.parse_wkt('A["x ""y""", 1.5e3, B(2), NORTH]') == ("A", ['x "y"', 1500.0, ("B", [2.0]), "NORTH"])
    for bad in ("", "A[", 'A["x"', "A[1 2]", "A[1]]", "A[1)", "7", "A[?]"):
        with pytest.raises(ValueError):
            crs.parse_wkt(bad)
    albers = LONLAT_WKT.join(['PROJCS["a",', ',PROJECTION["Albers"],PARAMETER["Central_Meridian",-154],PARAMETER["Standard_Parallel_1",55],PARAMETER["Standard_Parallel_2",65],PARAMETER["Latitude_Of_Origin",50],UNIT["US survey foot",0.3048006096012192]]'])
    assert crs.projection_of(albers).parameters == (55.0, 65.0, 50.0, -154.0) and crs.projection_of(albers).unit == 0.3048006096012192
    for wrong in (NORTH_WKT.replace("Polar_Stereographic", "Mercator"), NORTH_WKT.replace("false_easting", "azimuth"), NORTH_WKT.replace('"Greenwich",0', '"Paris",2.3'), 'LOCAL_CS["x"]'):
        with pytest.raises(ValueError):
            crs.projection_of(wrong)


def test_warp_at_a_lattice_stays_within_its_error(spark):
    source, target = gr.Grid(60, 40, (-70.0, 0.5, 0.0, 58.0, 0.0, 0.5)), gr.Grid(70, 50, (-1500000.0, 40000.0, 0.0, -500000.0, 0.0, -60000.0))
    move = pj.transformer(SYSTEMS[0], pj.Projection("longlat"))
    exact = {(r.j, r.i): (r._u, r._v) for r in ra.places(spark, source, target, move).collect()}
    for bound in (0.01, 4.0):
        near = {(r.j, r.i): (r._u, r._v) for r in ra.places(spark, source, target, move, bound).collect()}
        assert near.keys() == exact.keys() and len(exact) == 3500
        off = max(max(abs(a - b) for a, b in zip(near[k], exact[k])) for k in exact)
        assert off < bound and (bound < 0.1 or off > 0)


def test_warp_without_systems_is_as_before(spark):
    cells = spark.createDataFrame([(j, i, float(10 * j + i)) for j in range(4) for i in range(6)], "j int, i int, v double")
    source, target = gr.Grid(6, 4, (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)), gr.Grid(3, 2, (0.0, 2.0, 0.0, 0.0, 0.0, 2.0))
    got = {(r.j, r.i): r.v for r in ra.regrid(cells, source, target, "average").collect()}
    assert got == {(j, i): 20 * j + 2 * i + 5.5 for j in range(2) for i in range(3)}
    same = ra.regrid(cells, source, target, "nearest", (SYSTEMS[0], SYSTEMS[0])).collect()
    assert {(r.j, r.i): r.v for r in same} == {(j, i): 10.0 * (2 * j + 1) + 2 * i + 1 for j in range(2) for i in range(3)}


def means(w):
    """The mean of every cell's neighbours."""
    wide, there = np.pad(w, 1), np.pad(np.ones_like(w), 1)
    around = lambda x: x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:]
    return around(wide) / around(there)


@pytest.mark.parametrize("tile", [64, 16])
def test_holes_are_filled_by_laplace(spark, tile):
    rng = np.random.default_rng(0)
    ny, nx = 37, 29
    v = rng.normal(size=(ny, nx)).cumsum(0) + 50
    holes = rng.random((ny, nx)) < 0.3
    holes[10:22, 5:25] = True
    rows = [(j, i, None if holes[j, i] else float(v[j, i])) for j in range(ny) for i in range(nx) if not holes[j, i] or (i + j) % 2]
    out = fill.fill_holes(spark.createDataFrame(rows + [(-1, 0, 1e9), (0, nx, 1e9)], "j int, i int, v double"), nx, ny, 1e-5, tile=tile).toPandas()
    w = np.full((ny, nx), np.nan)
    w[out.j, out.i] = out.v
    assert len(out) == ny * nx and np.array_equal(w[~holes], v[~holes])
    assert np.abs(means(w) - w)[holes].max() <= 1e-5
    want = np.where(holes, v[~holes].mean(), v)
    for _ in range(20_000):
        want[holes] = means(want)[holes]
    assert np.abs(w - want).max() < 1e-3


def test_rasters_that_cannot_be_filled(spark):
    cells = spark.createDataFrame([(0, 0, None)], "j int, i int, v double")
    with pytest.raises(ValueError):
        fill.fill_holes(cells, 3, 3)
    one = fill.fill_holes(cells.select("j", "i", F.lit(2.0).alias("v")), 3, 2).collect()
    assert sorted((r.j, r.i, r.v) for r in one) == [(j, i, 2.0) for j in range(2) for i in range(3)]


def test_grid_from_centres(spark):
    want = gr.Grid(40, 30, (-80000.0, 4000.0, 0.0, -3000000.0, 0.0, -4000.0))
    lon, lat = SYSTEMS[0].inverse(*want.to_xy(F.col("i"), F.col("j")))
    centres = want.cells(spark).select("j", "i", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))
    for some in (centres, centres.where("(i * 7 + j * 3) % 4 = 0 OR i = 39 OR j = 29"), centres.unionAll(spark.createDataFrame([(None, 1, 2.0, 3.0)], "j int, i int, lon double, lat double"))):
        got = gr.infer_grid(some, SYSTEMS[0])
        assert (got.nx, got.ny) == (40, 30) and got.gt == pytest.approx(want.gt, abs=2.0)
        assert crs.projection_of(got.wkt).parameters == (70.0, -45.0)
    # another system, one centre that is off, too few centres: no grid
    for system, wrong in ((SYSTEMS[4], centres), (SYSTEMS[0], centres.withColumn("lat", F.col("lat") + F.when((F.col("i") == 3) & (F.col("j") == 3), 0.01).otherwise(0.0))), (SYSTEMS[0], centres.where("i = 3"))):
        with pytest.raises(ValueError):
            gr.infer_grid(wrong, system)


SQUARE = lambda x, y, s, clockwise=True: [(x, y), (x, y + s), (x + s, y + s), (x + s, y), (x, y)][:: 1 if clockwise else -1]


def test_rings_become_polygons(spark):
    rings = [SQUARE(2.0, 2.0, 6.0, False), SQUARE(0.0, 0.0, 10.0), SQUARE(20.0, 0.0, 4.0), SQUARE(4.0, 4.0, 2.0), SQUARE(21.0, 1.0, 1.0, False), SQUARE(50.0, 50.0, 1.0, False), [(0.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]]
    df = spark.createDataFrame([(1, rings), (2, []), (3, None)], "id int, parts array<array<struct<x:double,y:double>>>")
    for outer in ("clockwise", "nesting"):
        got = polygons.exploded(df, outer=outer).withColumn("area", polygons.area(F.col("polygon"))).collect()
        found = sorted((min(p.x for p in r.polygon.shell), len(r.polygon.holes), r.area) for r in got)
        assert found == [(0.0, 1, 64.0), (4.0, 0, 4.0), (20.0, 1, 15.0), (50.0, 0, 1.0)]  # an island in a hole is a polygon of its own
        assert all(len(r.polygon.shell) == 4 and r.id == 1 for r in got)
        assert polygons.exteriors(df, outer=outer).count() == 4
    places = {(1.0, 1.0): 1, (3.0, 3.0): 0, (5.0, 5.0): 1, (2.0, 5.0): 1, (0.0, 5.0): 1, (21.5, 1.5): 0, (20.5, 0.5): 1, (50.5, 50.5): 1, (-1.0, 0.0): 0, (30.0, 1.0): 0}
    points = spark.createDataFrame([p for p in places], "x double, y double")
    hits = polygons.points_in_parts(points, df, 3.0).groupBy("x", "y").count().collect()
    assert {(r.x, r.y): r["count"] for r in hits} == {p: n for p, n in places.items() if n}


def test_mosaic_reads_only_what_it_needs(spark, tmp_path):
    lattice = gr.Grid(0, 0, (100.0, 2.0, 0.0, 50.0, 0.0, -1.0), "W")
    tiles = [("a", 0, 0), ("b", 3, 0), ("c", 8, 8)]
    cells = [(t, j, i, float(100 * k + 10 * j + i) if (t, j, i) != ("b", 0, 0) else None) for k, (t, _, _) in enumerate(tiles) for j in range(4) for i in range(4)]
    df = spark.createDataFrame(cells, "tile string, j int, i int, v double")
    places = spark.createDataFrame([(t, i0, j0, 4, 4) for t, i0, j0 in tiles], "tile string, i0 long, j0 long, nx long, ny long")
    path = str(tmp_path / "m")
    for some in ("tile = 'b'", "tile <> 'b'"):
        mosaic.add_tiles(df.where(some), places.where(some), path, lattice)
    got, grid = mosaic.read_mosaic(spark, path)
    assert (grid.nx, grid.ny, grid.gt[0], grid.gt[3]) == (12, 12, 100.0, 50.0)
    want = {}
    for t, j, i, v in cells:
        i0, j0 = next((a, b) for n, a, b in tiles if n == t)
        if v is not None:
            want[j + j0, i + i0] = v  # b is laid over a, but its missing cell lets a through
    assert {(r.j, r.i): r.v for r in got.collect()} == want
    part, small = mosaic.read_mosaic(spark, path, (104.5, 108.0, 47.2, 50.0))
    assert (small.nx, small.ny, small.gt[0], small.gt[3]) == (2, 3, 104.0, 50.0)
    assert {(r.j, r.i): r.v for r in part.collect()} == {(j, i - 2): v for (j, i), v in want.items() if j < 3 and 2 <= i < 4}
    plan = mosaic.read_mosaic(spark, path, (100.0, 108.0, 48.0, 50.0))[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [tile" in plan and "IN (a,b)" in plan  # the folder of c is not read
    with pytest.raises(ValueError):
        mosaic.read_mosaic(spark, path, (0.0, 1.0, 0.0, 1.0))


def boxes(spark, n, parts):
    rows = [(f"n{k}", k, ("polygon", [SQUARE(float(k), 60.0, 0.5)])) for k in range(n)]
    return spark.createDataFrame(rows, f"name string, k long, shape {SHAPE}").repartition(parts)


def header_box(path):
    with open(path, "rb") as f:
        raw = f.read(100)
    assert struct.unpack(">i", raw[24:28])[0] * 2 == os.path.getsize(path)
    return struct.unpack("<4d", raw[36:68])


def test_shapefile_parts_are_whole_files(spark, tmp_path):
    spark.dataSource.register(ShapefileSource)
    folder = str(tmp_path / "out")
    df = boxes(spark, 23, 4)
    df.write.format("shapefile").mode("overwrite").option("wkt", NORTH_WKT).save(folder)
    names = sorted(n for n in os.listdir(folder) if n.endswith(".shp"))
    assert len(names) == 4 and not [n for n in os.listdir(folder) if n.startswith(".shapefile")]
    found = [header_box(os.path.join(folder, n)) for n in names]
    assert (min(b[0] for b in found), max(b[2] for b in found), {b[1] for b in found}) == (0.0, 22.5, {60.0})
    back = layers.read_layer(spark, folder)
    assert sorted((r.name, r.k) for r in back.collect()) == [(f"n{k}", k) for k in sorted(range(23), key=str)]
    assert sorted(r.fid for r in back.collect()) == list(range(23))
    df.where("k < 3").write.format("shapefile").mode("overwrite").save(folder)
    assert layers.read_layer(spark, folder).count() == 3
    df.where("k = 3").write.format("shapefile").mode("append").save(folder)
    assert layers.read_layer(spark, folder).count() == 4


def test_one_shapefile_of_many_tasks(spark, tmp_path):
    spark.dataSource.register(ShapefileSource)
    path = str(tmp_path / "x.shp")
    boxes(spark, 40, 5).write.format("shapefile").mode("overwrite").save(path)
    assert header_box(path) == (0.0, 60.0, 39.5, 60.5) and header_box(path[:-4] + ".shx") == (0.0, 60.0, 39.5, 60.5)
    with open(path, "rb") as f:
        raw = f.read()
    at, numbers = 100, []
    while at < len(raw):
        number, size = struct.unpack_from(">2i", raw, at)
        numbers.append(number)
        at += 8 + 2 * size
    assert numbers == list(range(1, 41))
    back = layers.read_layer(spark, path, records=7).collect()
    assert sorted((r.k, r.shape.parts[0][0].x) for r in back) == [(k, float(k)) for k in range(40)]
    mixed = spark.createDataFrame([("a", ("polygon", [SQUARE(0.0, 0.0, 1.0)])), ("b", ("point", [[(1.0, 2.0)]]))], f"name string, shape {SHAPE}")
    with pytest.raises(Exception, match="one kind of shape"):
        mixed.coalesce(1).write.format("shapefile").mode("overwrite").save(str(tmp_path / "y.shp"))


def test_shapefiles_in_archives(spark, tmp_path):
    spark.dataSource.register(ShapefileSource)
    for name, n in (("a", 30), ("b", 5)):
        boxes(spark, n, 2).write.format("shapefile").mode("overwrite").option("wkt", LONLAT_WKT).save(str(tmp_path / f"{name}.shp"))
    for kind in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        archive = str(tmp_path / f"z{kind}.zip")
        with zipfile.ZipFile(archive, "w", kind) as z:
            for name, where in (("a", "in/a"), ("b", "b")):
                for ext in (".shp", ".shx", ".dbf", ".prj"):
                    z.write(str(tmp_path / f"{name}{ext}"), where + ext)
        assert [p.stem for p in places_of(archive)] == ["b", "in/a"]
        every = layers.read_layer(spark, archive, records=7)
        # stored members are read by ranges, compressed ones by one task each
        assert every.rdd.getNumPartitions() == (6 if kind == zipfile.ZIP_STORED else 2)
        assert sorted(r.fid for r in every.collect()) == list(range(35))
        one = layers.read_layer(spark, f"{archive}/in/a.shp", NORTH_WKT, rename={"k": "number"}, drop=("name",))
        assert one.columns == ["fid", "number", "shape"] and one.count() == 30
        assert one.agg(F.max(F.abs(F.col("shape.parts")[0][0]["x"]))).first()[0] > 1000
        assert layers.read_layer(spark, f"{archive}/in").count() == 30
    for gone in (str(tmp_path / "z0.zip/none.shp"), str(tmp_path / "none.zip"), str(tmp_path / "none.shp")):
        with pytest.raises(FileNotFoundError):
            places_of(gone)


def test_layers_move_between_systems(spark, tmp_path):
    spark.dataSource.register(ShapefileSource)
    boxes(spark, 6, 1).write.format("shapefile").mode("overwrite").option("wkt", LONLAT_WKT).save(str(tmp_path / "a.shp"))
    layers.copy_reprojected(spark, str(tmp_path / "a.shp"), str(tmp_path / "b.shp"), NORTH_WKT)
    back = layers.read_layer(spark, str(tmp_path / "b.shp"), LONLAT_WKT).orderBy("k").collect()
    assert [r.name for r in back] == [f"n{k}" for k in range(6)]
    assert all(abs(p.x - x) < 1e-9 and abs(p.y - y) < 1e-9 for r in back for p, (x, y) in zip(r.shape.parts[0], SQUARE(float(r.k), 60.0, 0.5)))
    plain = layers.read_layer(spark, str(tmp_path / "a.shp"))
    assert layers.reprojected(plain, None, NORTH_WKT) is plain and layers.reprojected(plain, LONLAT_WKT, LONLAT_WKT) is plain
    assert layers.region_of(plain).count() == 6


def test_points_on_edges_by_the_ray_and_from_an_origin(spark):
    square = [(-300.0, -40.0), (-300.0, 40.0), (300.0, 40.0), (300.0, -40.0)]
    hole = [(0.0, -30.0), (200.0, 0.0), (0.0, 30.0), (-200.0, 0.0)]
    layer = spark.createDataFrame([(k, ox, 0.0, [square, hole]) for k, ox in enumerate((0.0, 1.1, 8123.47))], f"id int, ox double, oy double, parts array<{RING}>")
    local = [(-300.0, 7.0), (300.0, 7.0), (300.0, -40.0), (0.0, -30.0), (200.0, 0.0), (-200.0, 0.0), (250.0, 40.0), (250.0, -40.0), (299.0, 1.0)]
    points = spark.createDataFrame([(k, n, ox + x, y) for k, ox in enumerate((0.0, 1.1, 8123.47)) for n, (x, y) in enumerate(local)], "k int, n int, x double, y double")
    found = polygons.points_in_parts(points, layer, (100.0, 20.0), origin=("ox", "oy"), border=False).where("k = id")
    got = {(r.k, r.n) for r in found.collect()}

    def odd(x, y):
        edges = [(a, b) for ring in (square, hole) for a, b in zip(ring, ring[1:] + ring[:1])]
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in edges) % 2 == 1

    assert got == {(k, n) for k, ox in enumerate((0.0, 1.1, 8123.47)) for n, (x, y) in enumerate(local) if odd(ox + x - ox, y)}


def test_whole_blocks_of_points_by_the_ray(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(polygons, "AT_ONCE", 50)
    ring = lambda n, r: [(float(r * np.cos(k * 2 * np.pi / n)), float(r * np.sin(k * 2 * np.pi / n))) for k in range(n)]
    shapes = [[ring(4, 6.0), ring(5, 2.0)], [ring(7, 3.0)], [[(-4.0, -4.0), (-4.0, 4.0), (4.0, 4.0), (4.0, -4.0)]]]
    origins = rng.integers(-9, 9, (12, 2)).astype(float).tolist()
    layer = spark.createDataFrame([(k, x, y, shapes[k % 3]) for k, (x, y) in enumerate(origins)], f"id int, ox double, oy double, parts array<{RING}>")
    places = [*rng.uniform(-14, 14, (150, 2)).tolist(), *rng.integers(-9, 9, (60, 2)).astype(float).tolist()]
    points = spark.createDataFrame([*enumerate(list(map(float, p)) for p in places)], "n int, p array<double>").select("n", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    points = points.unionByName(spark.createDataFrame([(900, None, 1.0), (901, float("nan"), 1.0), (902, 1.0, float("nan"))], points.schema))
    found = polygons.points_in_parts(points, layer, 5.0, outer="nesting", origin=("ox", "oy"), border=False, keep=["n", "id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "_polygon" not in plan  # before: a row per point and box, and a join of each with its rings
    every = points.where("n < 900").crossJoin(polygons.exploded(layer, outer="nesting"))
    want = every.where(polygons.in_polygon_by_ray(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"), F.col("polygon"))).select("n", "id")
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 200
