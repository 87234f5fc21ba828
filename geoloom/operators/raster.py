"""Rasters as (j, i, v): stencils, gap-aware smoothing, resampling, proximity, series."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.projections import Projection, transformer
from .grid import Grid, invert_geotransform
from .ranking import running_total

#: 5 x 5 gradient kernel (fixed values).
GRADIENT_X = [
    [-1, -2, 0, 1, 2],
    [-4, -8, 0, 8, 4],
    [-6, -12, 0, 12, 6],
    [-4, -8, 0, 8, 4],
    [-1, -2, 0, 1, 2],
]


def reflected(k: Column, n: int) -> Column:
    """Index k folded into 0 .. n - 1 with the edge cells repeated (half-sample symmetric)."""
    m = F.pmod(k, F.lit(2 * n))
    return F.when(m < n, m).otherwise(2 * n - 1 - m).cast("int")


def stencil(cells: DataFrame, kernel: dict[tuple[int, int], float], nx: int, ny: int, values: Sequence[str] = ("v",), sums: Sequence[str] | None = None) -> DataFrame:
    """Convolution: out[j, i] = sum of kernel[dj, di] * in[j - dj, i - di], edges reflected.

    Every cell sends its weighted values to the cells it counts for; the sums are combined before
    they are shuffled, so the only shuffle is by target cell.  Missing cells send nothing.
    """
    names = sums or values
    reach_j, reach_i = (max(abs(k[a]) for k in kernel) for a in (0, 1))
    sent = []
    # images of a cell: itself, and its mirror images within reach beyond the edges
    images_j = [(F.col("j"), F.lit(True)), (-1 - F.col("j"), F.col("j") < reach_j), (2 * ny - 1 - F.col("j"), F.col("j") >= ny - reach_j)]
    images_i = [(F.col("i"), F.lit(True)), (-1 - F.col("i"), F.col("i") < reach_i), (2 * nx - 1 - F.col("i"), F.col("i") >= nx - reach_i)]
    for jj, jok in images_j:
        for ii, iok in images_i:
            at = F.struct(jj.cast("int").alias("j"), ii.cast("int").alias("i"))
            sent.append(F.when(jok & iok, at))
    weights = F.array(*[F.struct(F.lit(dj).alias("dj"), F.lit(di).alias("di"), F.lit(float(w)).alias("w")) for (dj, di), w in kernel.items() if w])
    images = cells.select(F.explode(F.array_compact(F.array(*sent))).alias("_at"), *values)
    out = images.select("_at", F.explode(weights).alias("_k"), *values)
    out = out.select((F.col("_at.j") + F.col("_k.dj")).alias("j"), (F.col("_at.i") + F.col("_k.di")).alias("i"), *[(F.col(v) * F.col("_k.w")).alias(v) for v in values])
    out = out.where((F.col("j") >= 0) & (F.col("j") < ny) & (F.col("i") >= 0) & (F.col("i") < nx))
    return out.groupBy("j", "i").agg(*[F.sum(v).alias(n) for v, n in zip(values, names)])


def gaussian(sigma: float, truncate: float) -> list[float]:
    """Weights at -r .. r, r = int(truncate * sigma + 0.5), of sum 1."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def nanfilter(cells: DataFrame, nx: int, ny: int, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Gaussian mean of the cells that exist; cells that no existing cell reaches have no row.

    Separable: one pass along each axis over value and weight.
    """
    w = gaussian(sigma, truncate)
    r = len(w) // 2
    both = cells.where("v IS NOT NULL").select("j", "i", "v", F.lit(1.0).alias("w"))
    for axis in (0, 1):
        kernel = {((k - r, 0) if axis == 0 else (0, k - r)): x for k, x in enumerate(w)}
        both = stencil(both, kernel, nx, ny, ("v", "w"))
    return both.where("w > 0").select("j", "i", (F.col("v") / F.col("w")).alias("v"))


def extend_raster(cells: DataFrame, nx: int, ny: int, mask: DataFrame | None = None, max_sigma: float = 4.0) -> DataFrame:
    """Fill missing cells from Gaussian means of the original at sigma 0.25, 0.5, ... max_sigma.

    The first sigma that reaches a cell fills it; with mask(j, i) only the cells listed there.
    All blurs are of the original, so they are independent aggregations, joined by one minimum.
    """
    have = cells.where("v IS NOT NULL").select("j", "i", "v", F.lit(-1).alias("step"))
    filled, sigma, step = have, 0.25, 0
    while sigma <= max_sigma:
        blurred = nanfilter(cells, nx, ny, sigma, 2.0)
        if mask is not None:
            blurred = blurred.join(mask.select("j", "i"), ["j", "i"], "left_semi")
        filled, sigma, step = filled.unionAll(blurred.select("j", "i", "v", F.lit(step).alias("step"))), sigma * 2, step + 1
    return filled.groupBy("j", "i").agg(F.min_by("v", "step").alias("v"))


def gradient(cells: DataFrame, nx: int, ny: int, dx: float, dy: float, values: Sequence[str] = ("v",)) -> DataFrame:
    """For each value: <value>_y and <value>_x, the 5 x 5 gradient with symmetric edges."""
    kx = {(a - 2, b - 2): GRADIENT_X[a][b] / (960.0 * dx) for a in range(5) for b in range(5)}
    ky = {(b - 2, a - 2): GRADIENT_X[a][b] / (960.0 * dy) for a in range(5) for b in range(5)}
    x = stencil(cells, kx, nx, ny, values, [f"{v}_x" for v in values])
    y = stencil(cells, ky, nx, ny, values, [f"{v}_y" for v in values])
    return y.join(x, ["j", "i"])


def lapse(cells: DataFrame, nx: int, ny: int, dx: float, dy: float) -> DataFrame:
    """slope and lapse of T over H for cells(j, i, H, T); null lapse where H is flat."""
    g = gradient(cells, nx, ny, dx, dy, ("H", "T"))
    s2 = F.col("H_x") * F.col("H_x") + F.col("H_y") * F.col("H_y")
    return g.select("j", "i", F.sqrt(s2).alias("slope"), F.try_divide(F.col("T_x") * F.col("H_x") + F.col("T_y") * F.col("H_y"), s2).alias("lapse"))


def first_difference(v: str, by: str, along: str) -> Column:
    """The value less the one before it on its line; null at the first.  One line of the raster is one window."""
    return F.col(v) - F.lag(v).over(Window.partitionBy(by).orderBy(along))


def central_difference(v: str, by: str, along: str) -> Column:
    """Half the difference of the neighbours; at either end the difference to the one neighbour.

    One line of the raster is one window: at most nx or ny cells.
    """
    w = Window.partitionBy(by).orderBy(along)
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    return F.when(before.isNull(), after - F.col(v)).when(after.isNull(), F.col(v) - before).otherwise((after - before) / 2)


def hillshade(cells: DataFrame, altitude: float = math.pi / 4, azimuth: float = math.pi / 2) -> DataFrame:
    """Shaded relief of a dense raster; the gradient is taken along j, then along i."""
    g = cells.withColumns({"gj": central_difference("v", "i", "j"), "gi": central_difference("v", "j", "i")})
    slope = math.pi / 2 - F.atan(F.sqrt(F.col("gj") * F.col("gj") + F.col("gi") * F.col("gi")))
    aspect = F.atan2(-F.col("gj"), F.col("gi"))
    shade = math.sin(altitude) * F.sin(slope) + math.cos(altitude) * F.cos(slope) * F.cos((azimuth - math.pi / 2) - aspect)
    return g.select("j", "i", shade.alias("shade"))


def proximity(cells: DataFrame, targets: DataFrame, grid: Grid, maxdist: float, fixed: int = 17) -> DataFrame:
    """Buffer mask: 0 on target cells, ``fixed`` within maxdist of one, maxdist beyond.

    Each target marks the cells around it, from a list of offsets; no pair further apart is made.
    """
    ri, rj = int(maxdist / abs(grid.dx)), int(maxdist / abs(grid.dy))
    around = [(b, a) for b in range(-rj, rj + 1) for a in range(-ri, ri + 1) if math.hypot(a * grid.dx, b * grid.dy) <= maxdist]
    offsets = F.array(*[F.struct(F.lit(b).alias("dj"), F.lit(a).alias("di"), F.lit(0 if a == b == 0 else fixed).alias("p")) for b, a in around])
    marks = targets.select("j", "i", F.explode(offsets).alias("_o")).select((F.col("j") + F.col("_o.dj")).alias("j"), (F.col("i") + F.col("_o.di")).alias("i"), F.col("_o.p").alias("p"))
    near = marks.groupBy("j", "i").agg(F.min("p").alias("p"))
    return cells.select("j", "i").join(near, ["j", "i"], "left").select("j", "i", F.coalesce("p", F.lit(int(maxdist))).alias("proximity"))


#: Resampling by name: aggregate of the source cells whose centre falls into a target cell.
RESAMPLE = {
    "average": lambda v: F.avg(v),
    "sum": lambda v: F.sum(v),
    "rms": lambda v: F.sqrt(F.avg(F.col(v) * F.col(v))),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
    "med": lambda v: F.percentile(v, F.lit(0.5)),
    "q1": lambda v: F.percentile(v, F.lit(0.25)),
    "q3": lambda v: F.percentile(v, F.lit(0.75)),
}


def regrid(cells: DataFrame, source: Grid, target: Grid, how: str, systems: tuple[Projection, Projection] | None = None, max_error: float = 0.0) -> DataFrame:
    """(j, i, v) on the target grid: nearest, bilinear, mode (least value on ties) or one of RESAMPLE.

    ``systems`` are the coordinate systems of the two grids, where they differ: nearest and bilinear ask
    for every target centre where it lies on the source grid, the others place every source centre on the
    target grid.  ``max_error``, in cells of the source, lets nearest and bilinear compute exact places at
    a lattice only (see ``places``).
    """
    here, there = systems or (None, None)
    if how in ("nearest", "bilinear"):
        return _interpolate(cells, source, target, how, transformer(there, here) if systems else None, max_error)
    x, y = source.to_xy(F.col("i"), F.col("j"))
    if systems:
        x, y = transformer(here, there)(x, y)
    ti, tj = target.to_ij(F.col("_x"), F.col("_y"))
    placed = cells.where("v IS NOT NULL").select("i", "j", "v", x.alias("_x"), y.alias("_y")).where(source.inside(F.col("i"), F.col("j")) if systems else F.lit(True))
    placed = placed.select(tj.alias("j"), ti.alias("i"), "v").where(target.inside(F.col("i"), F.col("j")))
    if how == "mode":
        n = placed.groupBy("j", "i", "v").agg(F.count("*").alias("n"))
        return n.groupBy("j", "i").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    return placed.groupBy("j", "i").agg(RESAMPLE[how]("v").alias("v"))


#: Target cells along a side of a block whose places are interpolated from its corners.
BLOCK = 16


def places(spark: SparkSession, source: Grid, target: Grid, transform: Callable[[Column, Column], tuple[Column, Column]], max_error: float = 0.0) -> DataFrame:
    """(j, i, _u, _v): where the centre of each target cell lies on the source grid, in cells from its corner.

    ``transform`` takes coordinates of the target to those of the source.  With ``max_error`` the target is
    cut into blocks: exact places at the corners of a block, between them bilinear, as long as at the block's
    centre and at the middles of its sides the two differ by less than half of it; else the block is exact.
    """
    inverse = invert_geotransform(source.gt)

    def exact(i: Column, j: Column) -> tuple[Column, Column]:
        x, y = transform(*target.to_xy(i, j))
        return inverse[0] + x * inverse[1] + y * inverse[2], inverse[3] + x * inverse[4] + y * inverse[5]

    if not max_error:
        u, v = exact(F.col("i"), F.col("j"))
        return target.cells(spark).select("j", "i", u.alias("_u"), v.alias("_v"))
    wide, high = -(-target.nx // BLOCK), -(-target.ny // BLOCK)
    blocks = spark.range(wide * high).select((F.col("id") % wide * BLOCK).alias("_i0"), (F.floor(F.col("id") / wide) * BLOCK).alias("_j0"))
    corners, half = (0, BLOCK), BLOCK / 2
    probes = [(half, half), (half, 0), (half, BLOCK), (0, half), (BLOCK, half)]
    at = {(a, b): exact(F.col("_i0") + a, F.col("_j0") + b) for a, b in [(a, b) for a in corners for b in corners] + probes}
    blocks = blocks.select("_i0", "_j0", *[c.alias(f"_{n}{k}") for k, pair in enumerate(at.values()) for n, c in zip("uv", pair)])

    def between(n: str, fi, fj) -> Column:
        c = [F.col(f"_{n}{k}") for k in range(4)]  # (0, 0), (0, B), (B, 0), (B, B)
        return (1 - fi) * ((1 - fj) * c[0] + fj * c[1]) + fi * ((1 - fj) * c[2] + fj * c[3])

    off = [F.abs(between(n, a / BLOCK, b / BLOCK) - F.col(f"_{n}{k + 4}")) for k, (a, b) in enumerate(probes) for n in "uv"]
    known = F.greatest(*off) < max_error / 2  # null, and so exact, where a corner has no place
    steps = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("a")) for b in range(BLOCK) for a in range(BLOCK)])
    cells = blocks.withColumn("_known", F.coalesce(known, F.lit(False))).withColumn("_s", F.explode(steps))
    cells = cells.withColumns({"i": (F.col("_i0") + F.col("_s.a")).cast("int"), "j": (F.col("_j0") + F.col("_s.b")).cast("int")}).where(target.inside(F.col("i"), F.col("j")))
    u, v = exact(F.col("i"), F.col("j"))
    fi, fj = F.col("_s.a") / BLOCK, F.col("_s.b") / BLOCK
    pick = lambda n, e: F.when(F.col("_known"), between(n, fi, fj)).otherwise(e)
    return cells.select("j", "i", pick("u", u).alias("_u"), pick("v", v).alias("_v"))


def _interpolate(cells: DataFrame, source: Grid, target: Grid, how: str, transform: Callable | None = None, max_error: float = 0.0) -> DataFrame:
    want = places(cells.sparkSession, source, target, transform or (lambda x, y: (x, y)), max_error)
    if how == "nearest":
        want = want.select("j", "i", F.floor("_u").cast("int").alias("_i"), F.floor("_v").cast("int").alias("_j"), F.lit(1.0).alias("_w"))
    else:
        want = want.select("j", "i", (F.col("_u") - 0.5).alias("_x"), (F.col("_v") - 0.5).alias("_y"))
        fx, fy = F.col("_x") - F.floor("_x"), F.col("_y") - F.floor("_y")
        four = [
            F.struct((F.floor("_x") + a).cast("int").alias("_i"), (F.floor("_y") + b).cast("int").alias("_j"), ((fx if a else 1 - fx) * (fy if b else 1 - fy)).alias("_w"))
            for a in (0, 1) for b in (0, 1)
        ]
        want = want.select("j", "i", F.explode(F.array(*four)).alias("_s")).select("j", "i", "_s.*").where("_w > 0")
    want = want.where(source.inside(F.col("_i"), F.col("_j")))
    got = want.join(cells.where("v IS NOT NULL").toDF(*[{"j": "_j", "i": "_i"}.get(c, c) for c in cells.columns]), ["_i", "_j"])
    return got.groupBy("j", "i").agg((F.sum(F.col("v") * F.col("_w")) / F.sum("_w")).alias("v"))


def moving_average(series: DataFrame, width: int, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Mean of the last ``width`` values of each series, where there are as many.

    Series are worked on in blocks; the last ``width`` - 1 rows of a block count in the next one too.
    """
    size = max(POINTS, width)
    ranked = running_total(series, by, [x], F.lit(1), "_rank")
    block, at = F.floor(F.col("_rank") / size), F.col("_rank") % size
    blocks = ranked.withColumn("_own", block).withColumn("_block", F.explode(F.array_compact(F.array(block, F.when(at > size - width, block + 1)))))
    w = Window.partitionBy(*by, "_block").orderBy("_rank").rowsBetween(-(width - 1), 0)
    averaged = blocks.withColumn("ma", F.avg(y).over(w)).where((F.col("_block") == F.col("_own")) & (F.col("_rank") >= width - 1))
    return averaged.select(*series.columns, "ma")


def natural_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through the points, at other places."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h, m = np.diff(x), np.zeros(n)
    side, middle, right = h[1:-1].tolist(), (2 * (h[:-1] + h[1:])).tolist(), (6 * np.diff(np.diff(y) / h)).tolist()
    for i, b in enumerate(side):  # a tridiagonal system: down, then up
        f = b / middle[i]
        middle[i + 1] -= f * b
        right[i + 1] -= f * right[i]
    for i in range(n - 3, -1, -1):
        m[i + 1] = (right[i] - (side[i] * m[i + 2] if i < n - 3 else 0.0)) / middle[i]
    k = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    t, u = at - x[k], x[k + 1] - at
    return (m[k] * u**3 + m[k + 1] * t**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * u + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * t


#: Knots of a block; knots on either side that its spline is solved with: a knot's influence at least
#: halves from one to the next.  Resampled points of a block.
KNOTS, HALO, POINTS = 2048, 64, 4096


def spline_average(series: DataFrame, by: str, dx: float, window: float, x: str = "x", y: str = "y") -> DataFrame:
    """Per series: an interpolating spline, resampled at about dx, its moving average over about ``window``.

    Rows (by, x, y) at the trailing ends of the windows.  Points of one x are averaged first; points
    without x or y do not count.  Series are worked on in blocks of knots, then of resampled points.
    """
    points = series.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(x).cast("double").alias("_x")).agg(F.avg(y).cast("double").alias("_y"))
    kind = series.schema[by].dataType.simpleString()
    ranked = running_total(points, ["_by"], ["_x"], F.lit(1), "_rank")
    ends = ranked.groupBy("_by").agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1")).withColumn("_n", F.rint((F.col("_x1") - F.col("_x0")) / dx).cast("long"))
    width = F.rint(window / ((F.col("_x1") - F.col("_x0")) / F.col("_n"))).cast("long")
    ends = ends.where("_n >= 2").withColumn("_w", F.greatest(F.lit(1), F.least("_n", width)))
    block, at = F.floor(F.col("_rank") / KNOTS), F.col("_rank") % KNOTS
    blocks = F.array_compact(F.array(block, F.when((at <= HALO) & (block > 0), block - 1), F.when(at >= KNOTS - HALO, block + 1)))
    knots = ranked.withColumn("_block", F.explode(blocks)).join(ends.withColumnRenamed("_by", "_of"), F.col("_by").eqNullSafe(F.col("_of"))).drop("_of")

    def repeated(names: pd.Series, n: int) -> pd.Series:
        name = names.iloc[0]
        return pd.Series([None if pd.isna(name) else name] * n, dtype=object)

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank")
        xs, rank, k = pdf["_x"].to_numpy(float), pdf["_rank"].to_numpy(), int(pdf["_block"].iloc[0])
        x0, x1, n, w = (pdf[c].iloc[0].item() for c in ("_x0", "_x1", "_n", "_w"))
        own = np.flatnonzero(rank // KNOTS == k)
        i = np.empty(0, np.int64)
        if len(own):
            a, step = xs[own[0]], (x1 - x0) / (n - 1)
            b = xs[own[-1] + 1] if own[-1] + 1 < len(xs) else math.inf
            i = np.arange(max(0, int((a - x0) / step) - 1), min(n, int((min(b, x1) - x0) / step) + 3))
        places = np.where(i == n - 1, x1, x0 + i * ((x1 - x0) / (n - 1)))
        here = (places >= a) & (places < b) if len(own) else np.empty(0, bool)
        i, places = i[here], places[here]
        values = natural_spline(xs, pdf["_y"].to_numpy(float), places) if len(i) else places
        return pd.DataFrame({"_by": repeated(pdf["_by"], len(i)), "_i": i, "_x": places, "_y": values, "_w": w})

    smooth = knots.groupBy("_by", "_block").applyInPandas(resample, f"_by {kind}, _i long, _x double, _y double, _w long")
    # the last _w - 1 points of a block count in the next one too
    size = F.greatest(F.lit(POINTS), F.col("_w"))
    block = F.floor(F.col("_i") / size)
    smooth = smooth.withColumn("_block", F.explode(F.array_compact(F.array(block, F.when(F.col("_i") % size > size - F.col("_w"), block + 1)))))

    def average(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        w = int(pdf["_w"].iloc[0])
        # a last block may hold nothing but the points of the one before
        ma = np.convolve(pdf["_y"].to_numpy(float), np.ones(w), "valid") / w if len(pdf) >= w else np.empty(0)
        at = pdf["_x"].to_numpy(float)
        return pd.DataFrame({by: repeated(pdf["_by"], len(ma)), x: at[len(at) - len(ma) :], y: ma})

    return smooth.groupBy("_by", "_block").applyInPandas(average, f"{by} {kind}, {x} double, {y} double")
