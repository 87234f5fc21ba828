"""Queries over lines, rectangles, regions and axes, and the other matrices between grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projections as pj
from ..functions import values as vl
from ..operators import grid as gr
from ..operators import matrix as mx
from ..operators import shapes as sh
from ..operators import spatial as sp
from ..sources import files
from .registry import query, table
from .spatial_queries import _EDGES, _IUA, _IUE, COARSE, FINE, SUPPLIER_EDGES, TRIANGLES, _matrices, _named, event_cells, supplier_rings


def _triangles(spark):
    return spark.createDataFrame([(k, [tuple(p) for p in ring]) for k, ring in TRIANGLES.items()], f"polygon_id int, ring {sp.RING}")


@query("""
WITH p AS (SELECT DISTINCT c_nationkey AS k, c_acctbal / 10 AS x, CAST(c_custkey % 1000 AS DOUBLE) AS y FROM customer),
e AS (SELECT a.k, a.x AS ax, a.y AS ay, b.x AS gx, b.y AS gy FROM p a JOIN p b ON a.k = b.k AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON c.k = a.k
  GROUP BY ALL HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= 0 AND max((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) > 0),
u AS (SELECT k, (gx - ax) / sqrt((gx - ax) ** 2 + (gy - ay) ** 2) AS ux, (gy - ay) / sqrt((gx - ax) ** 2 + (gy - ay) ** 2) AS uy FROM e),
r AS (SELECT u.k, ux, uy, max(x * ux + y * uy) - min(x * ux + y * uy) AS l, max(y * ux - x * uy) - min(y * ux - x * uy) AS w FROM u JOIN p ON p.k = u.k GROUP BY u.k, ux, uy)
SELECT k AS c_nationkey, round(min(l * w), 3) AS area, round(min_by(greatest(l, w), l * w), 3) AS long_side, round(min_by(least(l, w), l * w), 3) AS short_side FROM r GROUP BY k
""")
def q_min_bbox(spark, d):
    points = table(spark, d, "customer").select("c_nationkey", (F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") % 1000).alias("y"))
    boxes = sh.bounding_rectangles(points, "c_nationkey")
    return boxes.select(
        "c_nationkey", F.round("area", 3).alias("area"), F.round(F.greatest("along", "across"), 3).alias("long_side"), F.round(F.least("along", "across"), 3).alias("short_side")
    )


@query("SELECT n_name AS name, 'Point' AS kind, n_nationkey * 1.5 AS lon, n_regionkey - 0.25 AS lat FROM nation")
def q_geojson_features(spark, d):
    coordinates = F.array(F.col("n_nationkey") * F.lit(1.5), F.col("n_regionkey") - F.lit(0.25))
    geometry = F.struct(F.lit("Point").alias("type"), coordinates.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("name")).alias("properties"), geometry.alias("geometry"))
    texts = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(feature).alias("features"))
    texts = texts.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("text"))
    at = F.from_json("coordinates", "array<double>")
    return files.features_of(texts, "text").select(F.element_at("properties", "name").alias("name"), "kind", F.get(at, F.lit(0)).alias("lon"), F.get(at, F.lit(1)).alias("lat"))


# ---- matrices


def _scaled(name: str, source: str, row: str, col: str, pick) -> None:
    sql = f"SELECT m.{row} AS row, m.{col} AS col, round(m.v / w.w, 9) AS v FROM {source} m JOIN (SELECT {row}, sum(v) AS w FROM {source} GROUP BY {row}) w ON m.{row} = w.{row}"

    def run(spark, d):
        return _named(pick(_matrices(spark, d)))

    run.__name__ = f"q_matrix_{name}"
    query(f"WITH {_IUE} {sql}")(run)


_scaled("IvA", "iua", "r", "c", lambda m: m.iva)
_scaled("AvI", "iua", "c", "r", lambda m: m.avi)
_scaled("IvE", "iue", "r", "c", lambda m: m.ive)
_scaled("EvI", "iue", "c", "r", lambda m: m.evi)


@query("SELECT l_partkey AS col, sum(l_quantity) AS w FROM lineitem GROUP BY 1")
def q_col_sums(spark, d):
    li = table(spark, d, "lineitem")
    return mx.col_sums(li.select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("v")))


@query(f"WITH {_IUA} SELECT r AS row, c AS col, v FROM iua WHERE (r // 24 + r % 24) % 3 <> 0")
def q_masked_overlap(spark, d):
    cells = event_cells(spark, d)
    mask = FINE.cells(spark).withColumn("inside", (F.col("i") + F.col("j")) % 3 != 0)
    return mx.overlap(cells, FINE, COARSE, mask)


# ---- lines and regions

_CROSS = "(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"


def _cross(p: str, q: str, r: str) -> str:
    return _CROSS.format(p=p, q=q, r=r)


_MEET = f"sign({_cross('a', 'g', 'p')}) <> sign({_cross('a', 'g', 'q')}) AND sign({_cross('p', 'q', 'a')}) <> sign({_cross('p', 'q', 'g')})"


@query(f"""
WITH e(id, px, py, qx, qy) AS (VALUES {_EDGES}),
v AS (SELECT vec_id, k, CAST(embedding[2 * k + 1] AS DOUBLE) * 100 AS x, CAST(embedding[2 * k + 2] AS DOUBLE) * 100 AS y FROM embeddings CROSS JOIN range(0, 3) t(k)),
s AS (SELECT a.vec_id, a.x AS ax, a.y AS ay, b.x AS gx, b.y AS gy FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.k = a.k + 1),
crossing AS (SELECT DISTINCT vec_id, id FROM s CROSS JOIN e WHERE {_MEET}),
inside AS (SELECT vec_id, id FROM v CROSS JOIN e GROUP BY vec_id, id, k
  HAVING sum(CASE WHEN (py > y) <> (qy > y) AND x < px + (y - py) * (qx - px) / (qy - py) THEN 1 ELSE 0 END) % 2 = 1)
SELECT vec_id, id AS polygon_id FROM crossing UNION SELECT vec_id, id FROM inside
""")
def q_line_in_polygon(spark, d):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double") * 100
    lines = table(spark, d, "embeddings").select("vec_id", F.array(*[sh.point(at(2 * k), at(2 * k + 1)) for k in range(3)]).alias("line"))
    return sp.lines_in_polygons(lines, _triangles(spark), 10.0).select("vec_id", F.col("b_polygon_id").alias("polygon_id"))


_TILES = gr.Grid(32, 36, (-20.07, 4.1, 0.0, 115.03, 0.0, -3.7))


@query(f"""
WITH {SUPPLIER_EDGES}, t AS (SELECT i, j, -20.07 + i * 4.1 AS x0, -20.07 + (i + 1) * 4.1 AS x1, 115.03 - (j + 1) * 3.7 AS y0, 115.03 - j * 3.7 AS y1 FROM range(0, 32) a(i) CROSS JOIN range(0, 36) b(j)),
s AS (SELECT i, j, x0 AS ax, y0 AS ay, x1 AS gx, y0 AS gy FROM t UNION ALL SELECT i, j, x1, y0, x1, y1 FROM t UNION ALL SELECT i, j, x1, y1, x0, y1 FROM t UNION ALL SELECT i, j, x0, y1, x0, y0 FROM t),
hit AS (SELECT i, j, s_suppkey FROM s JOIN e ON greatest(ax, gx) >= least(px, qx) AND least(ax, gx) <= greatest(px, qx) AND greatest(ay, gy) >= least(py, qy) AND least(ay, gy) <= greatest(py, qy) AND {_MEET}
  UNION SELECT i, j, s_suppkey FROM t JOIN e ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1
  UNION SELECT i, j, s_suppkey FROM s JOIN e ON (py > ay) <> (qy > ay) AND ax < px + (ay - py) * (qx - px) / (qy - py) GROUP BY i, j, s_suppkey, ax, ay HAVING count(*) % 2 = 1)
SELECT s_suppkey, CAST(i AS INTEGER) AS idom, CAST(j AS INTEGER) AS jdom, round(x0 - 0.5, 6) AS x0, round(y1 + 0.25, 6) AS y1 FROM hit JOIN t USING (i, j)
""")
def q_region_tiles(spark, d):
    hit = sh.tiles_meeting(supplier_rings(spark, d), _TILES, margin=(0.5, 0.25))
    return hit.select("s_suppkey", "idom", "jdom", F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"))


@query(f"""
WITH {_IUA}, s AS (SELECT CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, v, i + 0.5 AS x, j + 0.5 AS y FROM c)
SELECT j, i, CASE WHEN x BETWEEN 3 AND 17 AND y BETWEEN 4.2 AND 21.7 THEN v ELSE -1 END AS v FROM s
""")
def q_cut_raster(spark, d):
    ring = [(3.0, 4.2), (17.0, 4.2), (17.0, 21.7), (3.0, 21.7)]
    return sh.cut_out(event_cells(spark, d), spark.createDataFrame([(ring,)], f"ring {sp.RING}"), FINE, fill=-1.0)


@query("""
WITH p AS (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS ax, s_acctbal AS ay, s_nationkey + 3.0 AS gx, s_acctbal + 4.0 AS gy FROM supplier)
SELECT s_suppkey, round(ax - 1.2, 6) AS x0, round(ay - 1.6, 6) AS y0, round(gx + 1.2, 6) AS x1, round(gy + 1.6, 6) AS y1, 4 AS n FROM p
""")
def q_extended_line(spark, d):
    x, y = F.col("s_nationkey"), F.col("s_acctbal")
    line = sh.extended(F.array(sh.point(x, y), sh.point(x + 3, y + 4)), 2.0)
    out = table(spark, d, "supplier").select("s_suppkey", line.alias("l"))
    end = lambda k, c: F.round(F.element_at("l", k)[c], 6)
    return out.select("s_suppkey", end(1, "x").alias("x0"), end(1, "y").alias("y0"), end(-1, "x").alias("x1"), end(-1, "y").alias("y1"), F.size("l").alias("n"))


@query("""
SELECT s_suppkey, round(s_nationkey + 0.6 * (s_suppkey % 50 + 1), 5) AS x, round(s_acctbal + 0.8 * (s_suppkey % 50 + 1), 5) AS y FROM supplier
""")
def q_point_at_distance(spark, d):
    start, direction = sh.point(F.col("s_nationkey"), F.col("s_acctbal")), sh.point(F.lit(3.0), F.lit(4.0))
    far = sh.point_at_distance(start, direction, (F.col("s_suppkey") % 50 + 1).cast("double"), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    return table(spark, d, "supplier").select("s_suppkey", far.alias("p")).select("s_suppkey", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


@query("""
WITH p AS (SELECT s_suppkey, s_nationkey + 1.0 AS w, abs(s_acctbal) + 1 AS h FROM supplier)
SELECT s_suppkey, round((w + 4) * (h + 4), 4) AS area, round(-2.0, 6) AS x0, round(h + 2, 6) AS y1 FROM p
""")
def q_rectangle_margin(spark, d):
    w, h = F.col("s_nationkey") + 1.0, F.abs("s_acctbal") + 1
    zero = F.lit(0.0)
    box = sh.with_margin(F.array(sh.point(zero, zero), sh.point(w, zero), sh.point(w, h), sh.point(zero, h)), 2.0)
    c = lambda k, v: F.get("c", F.lit(k))[v]
    area = (c(1, "x") - c(0, "x")) * (c(2, "y") - c(1, "y"))
    return table(spark, d, "supplier").select("s_suppkey", box.alias("c")).select("s_suppkey", F.round(area, 4).alias("area"), F.round(c(0, "x"), 6).alias("x0"), F.round(c(3, "y"), 6).alias("y1"))


@query("""
WITH p AS (SELECT s_suppkey, s_nationkey + 1.0 AS x, s_acctbal AS y FROM supplier)
SELECT s_suppkey, round(x / sqrt(x * x + y * y), 8) AS ux, round(y / sqrt(x * x + y * y), 8) AS uy, round(-y, 6) AS ox, round(1 - (y - 2), 6) AS rx, round(2 + (x - 1), 6) AS ry FROM p
""")
def q_vectors(spark, d):
    p, zero = sh.point(F.col("s_nationkey") + 1, F.col("s_acctbal")), sh.point(F.lit(0), F.lit(0))
    turned = sh.rotated(p, sh.point(F.lit(1), F.lit(2)), F.acos(F.lit(0.0)))
    out = table(spark, d, "supplier").select("s_suppkey", sh.unit(zero, p).alias("u"), sh.orthogonal(p).alias("o"), turned.alias("r"))
    return out.select("s_suppkey", F.round("u.x", 8).alias("ux"), F.round("u.y", 8).alias("uy"), F.round("o.x", 6).alias("ox"), F.round("r.x", 6).alias("rx"), F.round("r.y", 6).alias("ry"))


_STEREO = """
a AS (SELECT *, radians(lat) AS phi, radians(lon + 45) AS lam, radians(70) AS pc, 0.0818191908426215 AS e FROM p),
t AS (SELECT *, tan(pi() / 4 - phi / 2) / pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2) AS t,
  tan(pi() / 4 - pc / 2) / pow((1 - e * sin(pc)) / (1 + e * sin(pc)), e / 2) AS tc, cos(pc) / sqrt(1 - (e * sin(pc)) ** 2) AS mc FROM a),
xy AS (SELECT *, 6378137.0 * mc * t / tc * sin(lam) AS x, -6378137.0 * mc * t / tc * cos(lam) AS y FROM t)
"""


def _north(lon, lat):
    return pj.polar_stereographic(lon, lat, 70.0, -45.0)


@query(f"WITH p AS (SELECT c_custkey, c_custkey % 360 - 180.0 AS lon, 60 + c_nationkey / 1.0 AS lat FROM customer), {_STEREO} SELECT c_custkey, round(x, 2) + 0.0 AS x, round(y, 2) + 0.0 AS y FROM xy")
def q_projected_points(spark, d):
    x, y = _north(F.col("c_custkey") % 360 - 180.0, 60.0 + F.col("c_nationkey"))
    return table(spark, d, "customer").select("c_custkey", (F.round(x, 2) + 0.0).alias("x"), (F.round(y, 2) + 0.0).alias("y"))


@query(f"""
WITH p AS (SELECT s_suppkey, s_nationkey - 60.0 + a AS lon, 65 + s_nationkey / 5.0 + b AS lat FROM supplier CROSS JOIN (VALUES (0), (5)) u(a) CROSS JOIN (VALUES (0), (2)) w(b)), {_STEREO}
SELECT s_suppkey, round(min(x), 2) AS x0, round(max(x), 2) AS x1, round(min(y), 2) AS y0, round(max(y), 2) AS y1 FROM xy GROUP BY s_suppkey
""")
def q_reprojected_extent(spark, d):
    lon, lat = F.col("s_nationkey") - 60.0, 65 + F.col("s_nationkey") / 5.0
    box = sh.reprojected_extent(lon, lon + 5, lat, lat + 2, _north)
    return table(spark, d, "supplier").select("s_suppkey", box.alias("b")).select("s_suppkey", *[F.round(f"b.{c}", 2).alias(c) for c in ("x0", "x1", "y0", "y1")])


@query("""
WITH b AS (SELECT s_suppkey, s_acctbal AS x0, s_acctbal + 90 AS x1, s_nationkey * 10.0 AS y0, s_nationkey * 10.0 + 12 AS y1 FROM supplier)
SELECT s_suppkey FROM b WHERE EXISTS (SELECT 1 FROM (SELECT p_retailprice * 4 AS qx, p_size * 7.0 AS qy FROM part) WHERE x0 <= qx + 30 AND qx <= x1 AND y0 <= qy + 5 AND qy <= y1)
""")
def q_boxes_meeting(spark, d):
    x, y = F.col("s_acctbal"), F.col("s_nationkey") * 10.0
    boxes = table(spark, d, "supplier").select("s_suppkey", x.alias("x0"), (x + 90).alias("x1"), y.alias("y0"), (y + 12).alias("y1"))
    qx, qy = F.col("p_retailprice") * 4, F.col("p_size") * 7.0
    wanted = table(spark, d, "part").select(qx.alias("x0"), (qx + 30).alias("x1"), qy.alias("y0"), (qy + 5).alias("y1"))
    return sp.boxes_meeting(boxes, wanted, 100.0).select("s_suppkey")


# ---- axes and grids


@query("""
WITH a AS (SELECT DISTINCT floor(p_retailprice) AS v FROM part WHERE p_size < 25), b AS (SELECT DISTINCT floor(p_retailprice) + 40 AS v FROM part WHERE p_size >= 25),
e AS (SELECT greatest((SELECT min(v) FROM a), (SELECT min(v) FROM b)) AS v0, least(
  (SELECT 2 * max(v) - min(v) FROM (SELECT v FROM a ORDER BY v DESC LIMIT 2)), (SELECT 2 * max(v) - min(v) FROM (SELECT v FROM b ORDER BY v DESC LIMIT 2))) AS v1)
SELECT CAST((SELECT count(*) FROM a, e WHERE v >= v1) AS BIGINT) AS a0, CAST((SELECT count(*) FROM a, e WHERE v >= v0) AS BIGINT) AS a1,
       CAST((SELECT count(*) FROM b, e WHERE v >= v1) AS BIGINT) AS b0, CAST((SELECT count(*) FROM b, e WHERE v >= v0) AS BIGINT) AS b1
""")
def q_axis_intersect_desc(spark, d):
    part = table(spark, d, "part")
    a = part.where("p_size < 25").select(F.floor("p_retailprice").alias("v")).distinct()
    b = part.where("p_size >= 25").select((F.floor("p_retailprice") + 40).alias("v")).distinct()
    return sp.common_slices(a, b, "v", descending=True)


@query("""
SELECT n_nationkey, 11 AS n, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey - 0.25 ELSE n_nationkey - 5.25 END AS low,
       CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 5.25 ELSE n_nationkey + 0.25 END AS high, CASE WHEN n_nationkey % 2 = 0 THEN 0.5 ELSE -0.5 END AS step FROM nation
""")
def q_axis_centers(spark, d):
    step = F.when(F.col("n_nationkey") % 2 == 0, 0.5).otherwise(-0.5)
    centers = F.transform(gr.axis(0.0, 1.0, 11), lambda k: F.col("n_nationkey") + k * step)
    return table(spark, d, "nation").select("n_nationkey", sh.axis_from_centers(centers).alias("a")).select("n_nationkey", "a.*")


@query("SELECT o_custkey, round((max_by(o_totalprice, o_orderkey) - min_by(o_totalprice, o_orderkey)) / nullif(count(*) - 1, 0), 9) AS spacing FROM (SELECT o_custkey, o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2) GROUP BY 1")
def q_mean_spacing(spark, d):
    axis = table(spark, d, "orders").groupBy("o_custkey", "o_orderkey").agg(F.max("o_totalprice").alias("v"))
    return sh.mean_spacing(axis, "o_custkey", "o_orderkey", "v").select("o_custkey", F.round("spacing", 9).alias("spacing"))


@query("SELECT round(max(abs(l_extendedprice - l_quantity * 1000)), 4) AS error FROM lineitem")
def q_largest_error(spark, d):
    li = table(spark, d, "lineitem").withColumn("b", F.col("l_quantity") * 1000)
    return sh.largest_error(li, "l_extendedprice", "b", 1e12).select(F.round("error", 4).alias("error"))


@query("""
WITH b AS (SELECT floor(min(c_acctbal) / 700) * 700 AS x0, max(c_acctbal) AS x1, min(c_custkey % 1000) AS y0, floor(max(c_custkey % 1000) / 90.0) * 90 AS y1 FROM customer),
g AS (SELECT *, ceil((x1 - x0) / 700) AS nx, ceil((y1 - y0) / 90.0) AS ny FROM b)
SELECT CAST(i AS INTEGER) AS idom, CAST(j AS INTEGER) AS jdom, x0 + i * 700 - 1.0 AS x0, x0 + (i + 1) * 700 + 1.0 AS x1, y1 - (j + 1) * 90 - 2.0 AS y0, y1 - j * 90 + 2.0 AS y1
FROM g JOIN range(0, 100) a(i) ON i < nx JOIN range(0, 100) c(j) ON j < ny
""")
def q_tiles_margin(spark, d):
    """The tiles that cover all customers, with their margins."""
    y = F.col("c_custkey") % 1000
    box = table(spark, d, "customer").agg(F.min("c_acctbal").alias("x0"), F.max("c_acctbal").alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    return gr.tiles(spark, gr.domain_grid(box.x0, box.x1, box.y0, box.y1, (700.0, 90.0)), (1.0, 2.0))


@query(f"WITH {_IUA} SELECT CAST(29 - j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, v, 29 - j + 0.0 AS y FROM c")
def q_flip_raster(spark, d):
    flipped = FINE.flipped()
    cells = event_cells(spark, d).withColumn("j", F.lit(FINE.ny - 1) - F.col("j"))
    x, y = flipped.to_xy(F.col("i"), F.col("j"))
    return cells.select(F.col("j").cast("int").alias("j"), F.col("i").cast("int").alias("i"), "v", (29.5 - y).alias("y"))


@query(f"WITH {_IUA} SELECT CAST(j - 10 AS INTEGER) AS j, CAST(i - 6 AS INTEGER) AS i, v, i + 0.5 AS x, 6 AS di, 10 AS dj FROM c WHERE i >= 6 AND i < 18 AND j >= 10 AND j < 20")
def q_subgrid(spark, d):
    sub = FINE.subgrid(6, 10, 12, 10)
    di, dj = sub.offset_from(FINE)
    cells = event_cells(spark, d).select((F.col("j") - dj).cast("int").alias("j"), (F.col("i") - di).cast("int").alias("i"), "v")
    x, _ = sub.to_xy(F.col("i"), F.col("j"))
    return cells.where(sub.inside(F.col("i"), F.col("j"))).select("j", "i", "v", x.alias("x"), F.lit(di).alias("di"), F.lit(dj).alias("dj"))


# ---- scalar


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a' || o_orderstatus WHEN 1 THEN 'b' || o_orderpriority ELSE 'c' END AS v FROM orders")
def q_first_value(spark, d):
    k = F.col("o_orderkey") % 3
    m = F.map_from_entries(F.array_compact(F.array(
        F.when(k == 0, F.struct(F.lit("first"), F.concat(F.lit("a"), F.col("o_orderstatus")))),
        F.when(k <= 1, F.struct(F.lit("second"), F.concat(F.lit("b"), F.col("o_orderpriority")))),
        F.struct(F.lit("third"), F.lit("c")),
    )))
    return table(spark, d, "orders").select("o_orderkey", vl.first_value(m, ["first", "second", "third"]).alias("v"))


@query("SELECT s_suppkey AS name, 'd1:d0:d2' AS path, CASE s_suppkey % 4 WHEN 0 THEN 'd0' WHEN 1 THEN 'd1' WHEN 2 THEN 'd2' ELSE NULL END AS folder FROM supplier")
def q_search_path(spark, d):
    s, k = table(spark, d, "supplier").select(F.col("s_suppkey").alias("name")), F.col("name") % 4
    held = s.where(k != 3).select(F.concat(F.lit("d"), k.cast("string")).alias("folder"), "name").unionByName(s.where(k == 0).select(F.lit("d2").alias("folder"), "name"))
    return files.first_found(s.withColumn("path", F.lit("d1:d0:d2")), held, "name", "path")


@query("""
SELECT vec_id, 'float[' || len(embedding) || ']' AS kind, least(greatest((vec_id - 50) / 300.0, 0), 1) AS done, 'run_' || vec_id || '_' || label AS study, CAST(label AS VARCHAR) AS label FROM embeddings
""")
def q_names_and_summaries(spark, d):
    study = vl.study_name(F.lit("run"), F.col("vec_id"), F.col("label"))
    out = table(spark, d, "embeddings").select("vec_id", vl.array_summary(F.col("embedding")).alias("kind"), vl.progress(F.col("vec_id") - 50, F.lit(300.0)).alias("done"), study.alias("study"))
    return out.select("*", vl.parse_study_name(F.col("study"), ["kind", "id", "label"])["label"].alias("label"))


@query("SELECT s_suppkey, round((s_acctbal - 1) / 4.0, 6) AS m, round(s_acctbal - (s_acctbal - 1) / 4.0 * 6, 4) AS b FROM supplier")
def q_line_fit(spark, d):
    fit = vl.line_through_ends(F.array(F.lit(2.0), F.lit(3.0), F.lit(6.0)), F.array(F.lit(1.0), F.lit(9.0), F.col("s_acctbal")))
    return table(spark, d, "supplier").select("s_suppkey", fit.alias("f")).select("s_suppkey", F.round("f.m", 6).alias("m"), F.round("f.b", 4).alias("b"))


@query("SELECT n_nationkey, k, round(3 * cos(-2 * pi() * k / 8) + n_nationkey, 6) + 0.0 AS x, round(2 * sin(-2 * pi() * k / 8) + 1, 6) AS y FROM nation CROSS JOIN (SELECT CAST(k AS INTEGER) AS k FROM range(0, 8) t(k))")
def q_ellipse(spark, d):
    points = table(spark, d, "nation").select("n_nationkey", F.posexplode(vl.ellipse(3.0, 2.0, 0.0, 1.0, 8)).alias("k", "p"))
    return points.select("n_nationkey", "k", F.round(F.col("p.x") + F.col("n_nationkey"), 6).alias("x"), F.round("p.y", 6).alias("y"))
