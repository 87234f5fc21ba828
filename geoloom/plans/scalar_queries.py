"""Queries of scalar functions: time, units, paths, maps, typed fields, numbering; lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as pt
from ..functions import timeunits as tu
from ..functions import values as vl
from ..operators import lineage as ln
from ..operators import tables as tb
from .registry import query, table


def _cust_xy():
    return vl.ulam_xy(F.col("c_custkey"))


#: The spiral, walked leg by leg: up, left, down, right, two legs of each length.
_ULAM = """
WITH RECURSIVE leg AS (SELECT 1 AS q, 0 AS n, 0 AS x, 0 AS y UNION ALL
  SELECT q + 1, n + (q + 1) // 2, x + (CASE q % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END) * ((q + 1) // 2), y + (CASE q % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END) * ((q + 1) // 2)
  FROM leg WHERE n <= (SELECT max(c_custkey) FROM customer)),
w AS (SELECT 0 AS n, 0 AS x, 0 AS y UNION ALL SELECT n + s, x + s * (CASE q % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END), y + s * (CASE q % 4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END)
  FROM leg, unnest(range(1, (q + 1) // 2 + 1)) t(s)),
xy AS (SELECT w.n, x, y FROM w JOIN customer ON c_custkey = w.n)
"""


@query(_ULAM + "SELECT n AS c_custkey, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM xy")
def q_ulam_xy(spark, d):
    x, y = _cust_xy()
    return table(spark, d, "customer").select("c_custkey", x.alias("x"), y.alias("y"))


@query("SELECT c_custkey, c_custkey AS n FROM customer")
def q_ulam_n(spark, d):
    x, y = _cust_xy()
    return table(spark, d, "customer").select("c_custkey", vl.ulam_n(x, y).alias("n"))


@query("""
SELECT o_orderkey, round(year(o_orderdate) + (epoch(o_orderdate) - epoch(make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0))) /
  (epoch(make_timestamp(year(o_orderdate) + 1, 1, 1, 0, 0, 0)) - epoch(make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0))), 9) AS y FROM orders
""")
def q_year_fraction(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(tu.year_fraction(F.col("o_orderdate")), 9).alias("y"))


@query("SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0, 6) AS days FROM events")
def q_cf_time_encode(spark, d):
    return table(spark, d, "events").select("event_id", F.round(tu.encode(F.col("ts"), "days since 2024-01-01"), 6).alias("days"))


@query("SELECT o_orderkey, strftime(TIMESTAMP '2001-02-03' + INTERVAL 1 MINUTE * CAST(o_orderkey * 90 AS INTEGER), '%Y-%m-%d %H:%M:%S') AS t FROM orders")
def q_cf_time_decode(spark, d):
    t = tu.decode(F.col("o_orderkey") * 1.5, "hours since 2001-02-03")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("""
SELECT event_id, round((epoch(CAST(ts AS DATE)) - epoch(DATE '2024-01-10')) / 3600.0, 6) AS hours, 'seconds since 2024-01-10' AS unit FROM events
""")
def q_cf_time_rebase(spark, d):
    day = F.floor(tu.encode(F.col("ts"), "days since 2024-01-01"))
    hours = tu.convert_steps(day.cast("double"), "days since 2024-01-01", "hours since 2024-01-10")
    return table(spark, d, "events").select("event_id", F.round(hours, 6).alias("hours"), tu.rebase(F.lit("days since 2024-01-10")).alias("unit"))


@query("SELECT event_id, round(value * 1000, 4) AS mm, round((value - 32) * 5 / 9, 6) AS degc, round(value / 10, 6) AS kpa FROM events")
def q_unit_convert(spark, d):
    v = F.col("value")
    cols = [F.round(tu.convert(v, "m", "mm"), 4).alias("mm"), F.round(tu.convert(v, "degF", "degC"), 6).alias("degc"), F.round(tu.convert(v, "hPa", "kPa"), 6).alias("kpa")]
    return table(spark, d, "events").select("event_id", *cols)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor((epoch_us(o_orderdate) + epoch_us(l_shipdate)) / 2) AS BIGINT) AS mid_us
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def q_time_midpoint(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    mid = F.unix_micros(tu.midpoint(F.col("o_orderdate"), F.col("l_shipdate")))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", mid.alias("mid_us"))


@query("SELECT p_partkey, p_size % 2 = 1 AS flag FROM part")
def q_parse_bool(spark, d):
    words = F.array(*[F.lit(w) for w in ("No", "YES", "false", "T", "0", "y")])
    return table(spark, d, "part").select("p_partkey", vl.parse_bool(F.get(words, (F.col("p_size") % 6).cast("int"))).alias("flag"))


@query("SELECT p_partkey, CAST(nullif(p_size, 10) AS BIGINT) AS size FROM part")
def q_nullable_int(spark, d):
    text = F.when(F.col("p_size") == 10, ".").otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", vl.parse_nullable_int(text).alias("size"))


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders")
def q_enum(spark, d):
    return table(spark, d, "orders").select("o_orderkey", vl.parse_enum(F.col("o_orderstatus"), ["O", "F", "P"]).alias("status"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS code, o_orderstatus AS back FROM orders")
def q_dict_field(spark, d):
    codes = {"O": 1, "F": 2, "P": 3}
    orders = table(spark, d, "orders").withColumn("code", vl.parse_dict(F.col("o_orderstatus"), codes))
    return orders.select("o_orderkey", "code", vl.format_dict(F.col("code"), codes).alias("back"))


_MAPS = """
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
"""


def _two_maps(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    m = lambda *kv: F.map_from_arrays(F.array(*[F.lit(x) for x in kv[::2]]), F.array(*kv[1::2]))
    return table(spark, d, "events").select("event_id", m("a", k, "b", k + 1, "c", k % 3).alias("x"), m("b", k * 2, "c", k % 3, "d", k % 5).alias("y"))


def _entries(df, m):
    return df.select("event_id", F.explode(m).alias("key", "value"))


@query(_MAPS + "SELECT event_id, key, value FROM (SELECT event_id, 'b' AS key, (k + 1) + k * 2 AS value FROM e UNION ALL SELECT event_id, 'c', 2 * (k % 3) FROM e)")
def q_map_arith(spark, d):
    return _entries(_two_maps(spark, d), vl.map_with(lambda a, b: a + b, F.col("x"), F.col("y")))


@query(_MAPS + "SELECT event_id, key, value FROM (SELECT event_id, 'b' AS key, k + 1 AS value FROM e WHERE k + 1 = k * 2 UNION ALL SELECT event_id, 'c', k % 3 FROM e)")
def q_intersect_dicts(spark, d):
    return _entries(_two_maps(spark, d), vl.equal_entries(F.col("x"), F.col("y")))


@query(_MAPS + "SELECT event_id, key, value FROM (SELECT event_id, 'a' AS key, k AS value FROM e UNION ALL SELECT event_id, 'b', k * 2 FROM e UNION ALL SELECT event_id, 'c', k % 3 FROM e UNION ALL SELECT event_id, 'd', k % 5 FROM e)")
def q_merge_dicts(spark, d):
    return _entries(_two_maps(spark, d), vl.merged(F.col("x"), F.col("y")))


@query(_MAPS + "SELECT event_id, key, value FROM (SELECT event_id, 'b' AS key, k + 1 AS value FROM e UNION ALL SELECT event_id, 'z', 0 FROM e)")
def q_select_kwargs(spark, d):
    defaults = F.create_map(F.lit("b"), F.lit(-1).cast("long"), F.lit("z"), F.lit(0).cast("long"))
    return _entries(_two_maps(spark, d), vl.with_defaults(F.col("x"), defaults))


@query(_MAPS + "SELECT event_id, k AS s_k, k * 2 AS s_t_twice FROM e")
def q_flatten_struct(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    nested = table(spark, d, "events").select("event_id", F.struct(k.alias("k"), F.struct((k * 2).alias("twice")).alias("t")).alias("s"))
    return nested.select(*vl.flat_columns(nested.schema))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def q_json_props(spark, d):
    parsed = F.from_json("props", "k long")
    return table(spark, d, "events").groupBy(parsed["k"].alias("k")).agg(F.count("*").alias("n"))


@query("SELECT left(min(c_name), max(k)) AS prefix FROM (SELECT a AS c_name, k FROM (SELECT min(c_name) AS a, max(c_name) AS b FROM customer) CROSS JOIN range(0, 200) t(k) WHERE k <= least(length(a), length(b)) AND left(a, k) = left(b, k))")
def q_common_prefix(spark, d):
    return pt.common_prefix(table(spark, d, "customer"), "c_name")


@query("SELECT page_id, '/out/' || regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(\\.[^./]*)?$', '_v2\\1') AS path FROM pages")
def q_opath(spark, d):
    return table(spark, d, "pages").select("page_id", pt.output_path(F.col("url"), "/out", "_v2").alias("path"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN '{S}' || substr(url, 7) WHEN starts_with(url, 'http://') THEN '{H}' || substr(url, 6) ELSE url END AS rel, url AS back FROM pages")
def q_roots_relpath(spark, d):
    roots = {"S": "https:", "H": "http:", "T": "https"}
    rel = pt.relative(table(spark, d, "pages"), "url", roots)
    return rel.select("page_id", "rel", pt.system(F.col("rel"), roots).alias("back"))


@query("SELECT n_nationkey, 'x-' || n_name || '-{unknown}-' || n_regionkey AS s FROM nation")
def q_partial_format(spark, d):
    s = pt.partial_format(F.lit("x-{name}-{unknown}-{region}"), {"name": F.col("n_name"), "region": F.col("n_regionkey")})
    return table(spark, d, "nation").select("n_nationkey", s.alias("s"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^https?://([^/]+)')")
def q_regex_listing(spark, d):
    return table(spark, d, "pages").where(F.col("url").rlike("^https?://([^/]+)")).select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("""
SELECT c_custkey, n_name AS label, CAST((n_nationkey * 37) % 256 AS DOUBLE) AS r FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey
""")
def q_lookup_codes(spark, d):
    """Customers' nation codes as labels and colours; the codes of one region are not known."""
    codes = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"), (F.col("n_nationkey") * 37 % 256).cast("double").alias("r"))
    return tb.decode(table(spark, d, "customer"), codes, "c_nationkey", ["label", "r"]).select("c_custkey", "label", "r")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN (SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) ON k = l_orderkey AND n = l_linenumber")
def q_offending_rows(spark, d):
    """The rows that break the uniqueness of a key, as the error that tells of them holds them."""
    lines = table(spark, d, "lineitem")
    try:
        return tb.check_unique(lines, ["l_orderkey", "l_linenumber"]).limit(0).select("l_orderkey", "l_linenumber", "l_partkey")
    except tb.JoinError as e:
        return e.rows.select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT o_orderkey, CASE WHEN v >= 1073741824 THEN printf('%.1fGB/s', v / 1073741824) WHEN v >= 1048576 THEN printf('%.1fMB/s', v / 1048576)
  WHEN v >= 1024 THEN printf('%.1fkB/s', v / 1024) ELSE printf('%.1fB/s', v) END AS speed FROM (SELECT o_orderkey, o_totalprice * (o_orderkey % 5) * (o_orderkey % 11) * 37 / 7 AS v FROM orders)
""")
def q_human_speed(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", pt.human_speed(F.col("o_totalprice") * (k % 5) * (k % 11) * 37 / 7).alias("speed"))


@query("SELECT event_id, true AS same, k % 7 = 0 AS like_seven FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def q_checksum(spark, d):
    """Checksums of maps with the same entries in two orders, and of one whose value may differ."""
    k = F.get_json_object("props", "$.k").cast("long")
    pair = lambda key, v: F.struct(F.lit(key).alias("key"), v.alias("value"))
    maps = table(spark, d, "events").select(
        "event_id", *[F.map_from_entries(F.array(*e)).alias(n) for n, e in (("a", (pair("x", k), pair("y", k % 7))), ("b", (pair("y", k % 7), pair("x", k))), ("c", (pair("x", k), pair("y", F.lit(0).cast("long")))))]
    )
    sums = {n: vl.checksum_of(maps.withColumnRenamed(n, "m"), "m") for n in "abc"}
    each = [maps.withColumnRenamed(n, "m").select("event_id", sums[n].alias(n)) for n in "abc"]
    joined = each[0].join(each[1], "event_id").join(each[2], "event_id")
    return joined.select("event_id", (F.col("a") == F.col("b")).alias("same"), (F.col("a") == F.col("c")).alias("like_seven"))


@query("""
WITH i AS (SELECT l_orderkey AS k, max(l_shipdate) AS newest FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(newest >= oldest, false) OR gone AS stale FROM (
  SELECT o_orderkey, min(nullif(o_orderdate, TIMESTAMP '1995-01-01')) AS oldest, max(CAST(o_orderdate = TIMESTAMP '1995-01-01' AS INTEGER)) = 1 AS gone FROM orders GROUP BY 1) LEFT JOIN i ON k = o_orderkey
""")
def q_needs_regen(spark, d):
    gone = F.lit("1995-01-01").cast("timestamp_ntz")
    outputs = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderdate", gone).alias("mtime"))
    inputs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("mtime"))
    return ln.needs_regen(outputs, inputs, "o_orderkey")


_RULES = """
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_suppkey // 2 AS dst FROM lineitem UNION SELECT DISTINCT p_size * 3, p_size FROM part),
r AS (SELECT CAST(96 AS BIGINT) AS node UNION SELECT e.dst FROM r JOIN e ON r.node = e.src)
"""


def _rules(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.floor(F.col("l_suppkey") / 2).alias("dst"))
    b = table(spark, d, "part").select((F.col("p_size") * 3).cast("long").alias("src"), F.col("p_size").cast("long").alias("dst"))
    return a.unionByName(b).distinct(), spark.range(96, 97).withColumnRenamed("id", "node")


@query(_RULES + "SELECT DISTINCT node FROM r")
def q_rule_closure(spark, d):
    return ln.closure(*_rules(spark, d)).select("node")


@query(_RULES + "SELECT DISTINCT node FROM r WHERE node <> 96")
def q_rule_cleanup(spark, d):
    return ln.intermediates(*_rules(spark, d)).select("node")


@query("""
SELECT p_partkey, round(CASE WHEN mx = mn THEN 0 WHEN mx = r THEN (60 * (g - b) / (mx - mn) + 360) % 360 WHEN mx = g THEN (60 * (b - r) / (mx - mn) + 120) % 360
  ELSE (60 * (r - g) / (mx - mn) + 240) % 360 END, 6) AS h, round(CASE WHEN mx = 0 THEN 0 ELSE (mx - mn) / mx END, 6) AS s, round(mx, 6) AS v
FROM (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM (SELECT p_partkey, (p_partkey % 256) / 255.0 AS r, (p_size * 5 % 256) / 255.0 AS g, (p_partkey * 7 % 256) / 255.0 AS b FROM part))
""")
def q_rgb_hsv(spark, d):
    part = table(spark, d, "part")
    hsv = vl.rgb_to_hsv(F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 7 % 256)
    return part.select("p_partkey", hsv.alias("c")).select("p_partkey", *[F.round(f"c.{k}", 6).alias(k) for k in "hsv"])


@query("SELECT s_suppkey, least(s_acctbal, 500) AS x0, greatest(s_acctbal, 500) AS x1, least(s_nationkey, 10) AS y0, greatest(s_nationkey, 10) AS y1 FROM supplier")
def q_positive_rectangle(spark, d):
    rect = vl.positive_rectangle(F.col("s_acctbal"), F.lit(500.0), F.col("s_nationkey"), F.lit(10))
    return table(spark, d, "supplier").select("s_suppkey", rect.alias("r")).select("s_suppkey", "r.*")
