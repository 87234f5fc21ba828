"""Queries over rasters made from the events (30 days by 24 hours) and over series."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import raster as ra
from .registry import query, table
from .spatial_queries import CELLS, COARSE, FINE, event_cells

NY, NX = 30, 24
_CELLS = CELLS.format(where="")
_HOLES = CELLS.format(where="AND event_type = 'error'")
_AGG = {
    "average": "avg(v)", "sum": "sum(v)", "rms": "sqrt(avg(v * v))", "min": "min(v)", "max": "max(v)",
    "med": "quantile_cont(v, 0.5)", "q1": "quantile_cont(v, 0.25)", "q3": "quantile_cont(v, 0.75)",
}


def _regrid(how: str, sql: str) -> None:
    def run(spark, d):
        return ra.regrid(event_cells(spark, d), FINE, COARSE, how).select("j", "i", F.round("v", 6).alias("v"))

    run.__name__ = f"q_regrid_{how}"
    query(sql)(run)


for _how, _sql in _AGG.items():
    _regrid(_how, f"SELECT CAST(j // 5 AS INTEGER) AS j, CAST(i // 6 AS INTEGER) AS i, round({_sql}, 6) AS v FROM ({_CELLS}) GROUP BY 1, 2")
_regrid("mode", f"""
SELECT j, i, v FROM (SELECT j, i, v, row_number() OVER (PARTITION BY j, i ORDER BY n DESC, v) AS k FROM (
  SELECT CAST(j // 5 AS INTEGER) AS j, CAST(i // 6 AS INTEGER) AS i, v, count(*) AS n FROM ({_CELLS}) GROUP BY 1, 2, 3)) WHERE k = 1
""")
_regrid("nearest", f"""
SELECT CAST(a.j AS INTEGER) AS j, CAST(a.i AS INTEGER) AS i, c.v FROM (SELECT * FROM range(0, 6) x(j) CROSS JOIN range(0, 4) y(i)) a
JOIN ({_CELLS}) c ON c.j = a.j * 5 + 2 AND c.i = a.i * 6 + 3
""")
_regrid("bilinear", f"""
SELECT CAST(a.j AS INTEGER) AS j, CAST(a.i AS INTEGER) AS i, round(avg(c.v), 6) AS v FROM (SELECT * FROM range(0, 6) x(j) CROSS JOIN range(0, 4) y(i)) a
JOIN ({_CELLS}) c ON c.j = a.j * 5 + 2 AND c.i IN (a.i * 6 + 2, a.i * 6 + 3) GROUP BY 1, 2
""")


def _fold(k: str, n: int) -> str:
    return f"CASE WHEN {k} < 0 THEN -1 - ({k}) WHEN {k} >= {n} THEN {2 * n - 1} - ({k}) ELSE {k} END"


def _gauss(src: str, name: str, axis: str, sigma: float, truncate: float) -> str:
    """SQL of one smoothing pass over (j, i, v, w), named."""
    w = ra.gaussian(sigma, truncate)
    kernel = ", ".join(f"({k - len(w) // 2}, CAST({x!r} AS DOUBLE))" for k, x in enumerate(w))
    j, i = ("a.j + k.d", "a.i") if axis == "j" else ("a.j", "a.i + k.d")
    return f"""{name} AS (SELECT a.j, a.i, sum(c.v * k.w) AS v, sum(c.w * k.w) AS w FROM g a CROSS JOIN (VALUES {kernel}) k(d, w)
JOIN {src} c ON c.j = {_fold(j, NY)} AND c.i = {_fold(i, NX)} GROUP BY a.j, a.i)"""


_GRID = f"g AS (SELECT CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i FROM range(0, {NY}) x(j) CROSS JOIN range(0, {NX}) y(i))"


@query(f"""WITH {_GRID}, c AS (SELECT j, i, v, CAST(1 AS DOUBLE) AS w FROM ({_HOLES})), {_gauss('c', 'p', 'j', 1.5, 4.0)}, {_gauss('p', 'q', 'i', 1.5, 4.0)}
SELECT j, i, round(v / w, 6) AS v FROM q WHERE w > 0""")
def q_nanfilter(spark, d):
    return ra.nanfilter(event_cells(spark, d, "event_type = 'error'"), NX, NY, 1.5).select("j", "i", F.round("v", 6).alias("v"))


_FEW = CELLS.format(where="AND event_type = 'error' AND value > 100")
_SIGMAS = [0.25, 0.5, 1.0, 2.0, 4.0]


@query(
    f"WITH {_GRID}, c AS (SELECT j, i, v, CAST(1 AS DOUBLE) AS w FROM ({_FEW})), "
    + ", ".join(f"{_gauss('c', f'p{k}', 'j', s, 2.0)}, {_gauss(f'p{k}', f'q{k}', 'i', s, 2.0)}" for k, s in enumerate(_SIGMAS))
    + " SELECT g.j, g.i, round(coalesce(c.v, "
    + ", ".join(f"q{k}.v / nullif(q{k}.w, 0)" for k in range(5))
    + "), 6) AS v FROM g LEFT JOIN c ON c.j = g.j AND c.i = g.i "
    + " ".join(f"LEFT JOIN q{k} ON q{k}.j = g.j AND q{k}.i = g.i" for k in range(5))
    + " WHERE coalesce(c.v, " + ", ".join(f"q{k}.v / nullif(q{k}.w, 0)" for k in range(5)) + ") IS NOT NULL"
)
def q_extend_raster(spark, d):
    cells = event_cells(spark, d, "event_type = 'error' AND value > 100")
    return ra.extend_raster(cells, NX, NY).select("j", "i", F.round("v", 6).alias("v"))


_KX = ", ".join(f"({a - 2}, {b - 2}, {ra.GRADIENT_X[a][b]}.0)" for a in range(5) for b in range(5))


@query(f"""
WITH {_GRID}, c AS (SELECT CAST(dayofyear(ts) - 1 AS INTEGER) AS j, CAST(hour(ts) AS INTEGER) AS i, CAST(round(sum(value)) AS DOUBLE) AS H, CAST(count(*) AS DOUBLE) AS T FROM events WHERE dayofyear(ts) <= 30 GROUP BY 1, 2),
k(dj, di, w) AS (VALUES {_KX}),
x AS (SELECT a.j, a.i, sum(c.H * k.w) / 960.0 AS hx, sum(c.T * k.w) / 960.0 AS tx FROM g a CROSS JOIN k JOIN c ON c.j = {_fold('a.j - k.dj', NY)} AND c.i = {_fold('a.i - k.di', NX)} GROUP BY a.j, a.i),
y AS (SELECT a.j, a.i, sum(c.H * k.w) / 960.0 AS hy, sum(c.T * k.w) / 960.0 AS ty FROM g a CROSS JOIN k JOIN c ON c.j = {_fold('a.j - k.di', NY)} AND c.i = {_fold('a.i - k.dj', NX)} GROUP BY a.j, a.i)
SELECT x.j, x.i, round(sqrt(hx * hx + hy * hy), 6) AS slope, round((tx * hx + ty * hy) / nullif(hx * hx + hy * hy, 0), 6) AS lapse FROM x JOIN y ON x.j = y.j AND x.i = y.i
""")
def q_lapse(spark, d):
    e = table(spark, d, "events").select((F.dayofyear("ts") - 1).alias("j"), F.hour("ts").alias("i"), "value").where("j < 30")
    cells = e.groupBy("j", "i").agg(F.round(F.sum("value")).alias("H"), F.count("*").cast("double").alias("T"))
    return ra.lapse(cells, NX, NY, 1.0, 1.0).select("j", "i", F.round("slope", 6).alias("slope"), F.round("lapse", 6).alias("lapse"))


@query(f"""
WITH c AS ({_CELLS}), n AS (SELECT j, i, v, lag(v) OVER (PARTITION BY i ORDER BY j) AS jm, lead(v) OVER (PARTITION BY i ORDER BY j) AS jp,
  lag(v) OVER (PARTITION BY j ORDER BY i) AS im, lead(v) OVER (PARTITION BY j ORDER BY i) AS ip FROM c),
t AS (SELECT j, i, CASE WHEN jm IS NULL THEN jp - v WHEN jp IS NULL THEN v - jm ELSE (jp - jm) / 2 END AS gj,
  CASE WHEN im IS NULL THEN ip - v WHEN ip IS NULL THEN v - im ELSE (ip - im) / 2 END AS gi FROM n),
s AS (SELECT j, i, {math.pi / 2!r} - atan(sqrt(gj * gj + gi * gi)) AS slope, atan2(-gj, gi) AS aspect FROM t)
SELECT j, i, round({math.sin(math.pi / 4)!r} * sin(slope) + {math.cos(math.pi / 4)!r} * cos(slope) * cos(0.0 - aspect), 6) AS shade FROM s
""")
def q_hillshade(spark, d):
    return ra.hillshade(event_cells(spark, d)).select("j", "i", F.round("shade", 6).alias("shade"))


@query(f"""
WITH {_GRID}, t AS (SELECT j, i FROM ({CELLS.format(where="AND event_type = 'purchase'")}) WHERE v > 300),
m AS (SELECT g.j, g.i, min(CASE WHEN g.j = t.j AND g.i = t.i THEN 0 ELSE 17 END) AS p FROM g JOIN t ON (g.j - t.j) * (g.j - t.j) + (g.i - t.i) * (g.i - t.i) <= 4 GROUP BY g.j, g.i)
SELECT g.j, g.i, CAST(coalesce(m.p, 2) AS INTEGER) AS proximity FROM g LEFT JOIN m ON m.j = g.j AND m.i = g.i
""")
def q_proximity_buffer(spark, d):
    targets = event_cells(spark, d, "event_type = 'purchase'").where("v > 300")
    return ra.proximity(FINE.cells(spark), targets, FINE, 2.0)


@query("""
WITH s AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice)) AS total FROM orders GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, round(ma, 2) AS ma FROM (SELECT day, avg(total) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma, row_number() OVER (ORDER BY day) AS n FROM s) WHERE n >= 7
""")
def q_moving_average(spark, d):
    days = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.round(F.sum("o_totalprice")).alias("total"))
    return ra.moving_average(days, 7, "day", "total").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("ma", 2).alias("ma"))


@query()
def q_spline_ma(spark, d):
    events = table(spark, d, "events")
    hours = (F.unix_seconds(F.col("ts").cast("timestamp")) / 3600.0).alias("x")
    return ra.spline_average(events.select("event_type", hours, F.col("value").alias("y")), "event_type", 6.0, 24.0)


@query(f"SELECT j, i, v - lag(v) OVER (PARTITION BY j ORDER BY i) AS di, v - lag(v) OVER (PARTITION BY i ORDER BY j) AS dj FROM ({_CELLS})")
def q_first_differences(spark, d):
    cells = event_cells(spark, d)
    return cells.select("j", "i", ra.first_difference("v", "j", "i").alias("di"), ra.first_difference("v", "i", "j").alias("dj"))
