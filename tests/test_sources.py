import json

from pyspark.sql import functions as F

from geoloom.operators.grid import Grid
from geoloom.sources import files
from geoloom.sources.shapefile import SHAPE, ShapefileSource, crs_of


def test_shapefile_round_trip(spark, tmp_path):
    spark.dataSource.register(ShapefileSource)
    rows = [
        ("a", 1, 1.5, True, ("polygon", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]])),
        ("é", None, -2.25, False, ("polygon", [[(2.0, 2.0), (3.0, 2.0), (2.0, 3.0), (2.0, 2.0)], [(5.0, 5.0), (6.0, 5.0), (5.0, 6.0), (5.0, 5.0)]])),
        (None, 3, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"name string, n long, v double, ok boolean, shape {SHAPE}").coalesce(1)
    path = str(tmp_path / "x.shp")
    df.write.format("shapefile").mode("append").option("wkt", "LOCAL_CS[]").option("zip", str(tmp_path / "x.zip")).save(path)
    back = spark.read.format("shapefile").option("records", 1).load(path).orderBy("fid").collect()
    assert [(r.name, r.n, r.v, r.ok) for r in back] == [r[:4] for r in rows[:2]]  # null shapes are skipped
    assert [[[(p.x, p.y) for p in part] for part in r["shape"].parts] for r in back] == [rows[0][4][1], rows[1][4][1]]
    assert spark.read.format("shapefile").option("shapes", "false").load(path).count() == 3
    assert crs_of(path) == "LOCAL_CS[]" and (tmp_path / "x.zip").exists()


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"date": "2020-01-02"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}},
        {"type": "Feature", "properties": {"date": "2020-01-03"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rows = files.geojson_traces(spark, str(tmp_path / "a.json"), lambda x, y: (x * 10, y)).collect()
    assert len(rows) == 1 and str(rows[0].date) == "2020-01-02" and [(p.x, p.y) for p in rows[0].line] == [(10, 2), (30, 4)]


def test_palette(spark, tmp_path):
    (tmp_path / "p.cpt").write_text("# c\n0 1 2 3 1 4 5 6\n1 4 5 6 2.5e0 7 8 9\nB 0 0 0\n")
    rows = [tuple(r) for r in files.read_palette(spark, str(tmp_path / "p.cpt")).collect()]
    assert rows == [(0, 1, 2, 3, 1, 4, 5, 6), (1, 4, 5, 6, 2.5, 7, 8, 9)]
    back = [tuple(r) for r in files.read_palette(spark, str(tmp_path / "p.cpt"), reverse=True).collect()]
    assert back == [(0, 7, 8, 9, 1.5, 4, 5, 6), (1.5, 4, 5, 6, 2.5, 1, 2, 3)]


def test_hsv_palette_and_discrete_colours(spark, tmp_path):
    (tmp_path / "h.cpt").write_text("# COLOR_MODEL = HSV\n0 0 1 1 1 120 1 1\n1 120 1 1 3 240 0.5 1\n")
    palette = files.read_palette(spark, str(tmp_path / "h.cpt"), scale=2.0)
    assert [tuple(r) for r in palette.collect()] == [(0, 255, 0, 0, 2, 0, 255, 0), (2, 0, 255, 0, 6, 127, 127, 255)]
    colours = [tuple(r) for r in files.discrete_colors(palette, 4).orderBy("k").collect()]
    assert [c[0] for c in colours] == [0, 1, 2, 3] and colours[0][1:] == (1, 0, 0) and colours[1][1:] == (0, 1, 0)
    assert colours[3][1:] == (127 / 255, 127 / 255, 1) and colours[2][3] == 0.5
    assert files.discrete_colors(palette, 4, keep=2).count() == 2 and files.discrete_colors(palette, 1).first().r == 1


def test_raster_file(spark, tmp_path):
    g = Grid(2, 1, (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), "WKT")
    cells = spark.createDataFrame([(0, 0, 1.5), (0, 1, None)], "j int, i int, v double")
    files.write_raster(cells, g, str(tmp_path / "r"), -9999.0)
    df, grid = files.read_raster(spark, str(tmp_path / "r"))
    assert grid == g and {(r.i, r.v) for r in df.collect()} == {(0, 1.5), (1, None)}
    assert spark.read.parquet(str(tmp_path / "r")).where(F.col("v") == -9999).count() == 1


def test_listing(spark, tmp_path):
    for n in ("b_2.txt", "a_1.txt", "x.csv"):
        (tmp_path / n).write_text("1")
    rows = files.list_files(spark, str(tmp_path), r"(\w)_(\d)\.txt", ["k", "n"]).collect()
    assert [(r.k, r.n) for r in rows] == [("a", "1"), ("b", "2")]
