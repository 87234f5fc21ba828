"""Spiral numbering, colours, rectangles, checksums; maps; typed fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

# ---- numbers


def ulam_xy(n: Column) -> tuple[Column, Column]:
    """Place of n on the square spiral around (0, 0): 1 lies above 0, then it turns left.

    Ring k holds (2 k - 1)^2 and the 8 k - 1 numbers behind it: 2 k of them leftward along its top, as
    many down, rightward and up again.  In whole numbers; the root only proposes the ring.
    """
    n = n.cast("long")
    guess = F.floor((F.sqrt(n.cast("double")) + 1) / 2).cast("long")
    begins = lambda k: (2 * k - 1) * (2 * k - 1)
    k = F.when(n == 0, F.lit(0).cast("long")).when(begins(guess) > n, guess - 1).when(begins(guess + 1) <= n, guess + 1).otherwise(guess)
    step = n - begins(k)
    top, left, bottom = step < 2 * k, step < 4 * k, step < 6 * k
    x = F.when(n == 0, k).when(top, k - 1 - step).when(left, -k).when(bottom, step - 5 * k + 1).otherwise(k)
    y = F.when(n == 0, k).when(top, k).when(left, 3 * k - 1 - step).when(bottom, -k).otherwise(step - 7 * k + 1)
    return x.cast("long"), y.cast("long")


def ulam_n(x: Column, y: Column) -> Column:
    """The number at a place of the spiral: the first of its ring, and the steps along the ring's sides."""
    x, y = x.cast("long"), y.cast("long")
    k = F.greatest(F.abs(x), F.abs(y))
    step = F.when((y == k) & (x < k), k - 1 - x).when((x == -k) & (y < k), 3 * k - 1 - y).when((y == -k) & (x > -k), 5 * k - 1 + x).otherwise(7 * k - 1 + y)
    return F.when(k == 0, k).otherwise((2 * k - 1) * (2 * k - 1) + step).cast("long")


def line_through_ends(xs: Column, ys: Column) -> Column:
    """Slope m and intercept b of the line through the first and the last point of two arrays."""
    x1, x2, y1, y2 = F.get(xs, F.lit(0)), F.element_at(xs, -1), F.get(ys, F.lit(0)), F.element_at(ys, -1)
    m = F.try_divide(y2 - y1, x2 - x1)
    return F.struct(m.alias("m"), (y2 - m * x2).alias("b"))


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, saturation and value in 0..1, of components in 0..255."""
    r, g, b = (c / 255.0 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    turn = lambda x, at: F.pmod(60 * F.try_divide(x, d) + at, F.lit(360.0))
    h = F.when(d == 0, 0.0).when(top == r, turn(g - b, 360)).when(top == g, turn(b - r, 120)).otherwise(turn(r - g, 240))
    return F.struct(h.alias("h"), F.when(top == 0, 0.0).otherwise(F.try_divide(d, top)).alias("s"), top.alias("v"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Components in 0..255, cut to whole numbers."""
    h60 = h / 60.0
    k, f = F.floor(h60) % 6, h60 - F.floor(h60)
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    pick = lambda *six: (255 * F.element_at(F.array(*six), (k + 1).cast("int"))).cast("int")
    return F.struct(pick(v, q, p, p, t, v).alias("r"), pick(t, v, v, q, p, p).alias("g"), pick(p, p, t, v, v, q).alias("b"))


def positive_rectangle(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return F.struct(F.least(x0, x1).alias("x0"), F.greatest(x0, x1).alias("x1"), F.least(y0, y1).alias("y0"), F.greatest(y0, y1).alias("y1"))


def checksum(*columns: Column) -> Column:
    """MD5 over the values with their types, stable over runs; maps count with the order of their entries (see ``checksum_of``)."""
    typed = [x for i, c in enumerate(columns) for x in (F.typeof(c).alias(f"t{i}"), c.alias(f"c{i}"))]
    return F.md5(F.to_json(F.struct(*typed), {"ignoreNullFields": "false"}))


def canonical(value: Column, kind: DataType) -> Column:
    """A value whose maps, at any depth, are arrays of their entries in order of the keys."""
    if isinstance(kind, MapType):
        entry = lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value"))
        return F.transform(F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), entry)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, StructType):
        fields = [canonical(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def checksum_of(df: DataFrame, *names: str) -> Column:
    """MD5 over columns of ``df`` with their types; the order in which a map's entries were put in does not matter."""
    typed = [x for n in names for x in (F.lit(df.schema[n].dataType.simpleString()).alias(f"type_{n}"), canonical(F.col(n), df.schema[n].dataType).alias(n))]
    return F.md5(F.to_json(F.struct(*typed), {"ignoreNullFields": "false"}))


def ellipse(a: float, b: float, e: float, n: float, points: int) -> Column:
    """Points on an ellipse around (e, n), clockwise from the right."""
    step = -2 * 3.141592653589793 / points
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.struct((a * F.cos(k * step) + e).alias("x"), (b * F.sin(k * step) + n).alias("y")))


# ---- maps


def map_with(op, a: Column, b: Column) -> Column:
    """op on the values of common keys."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNotNull() & y.isNotNull(), op(x, y)))
    return F.map_filter(both, lambda k, v: v.isNotNull())


def map_each(op, m: Column) -> Column:
    return F.transform_values(m, lambda k, v: op(v))


def equal_entries(*maps: Column) -> Column:
    """Entries that all maps have with one value."""
    return reduce(lambda a, b: F.map_filter(F.map_zip_with(a, b, lambda k, x, y: F.when(x == y, x)), lambda k, v: v.isNotNull()), maps)


def merged(*maps: Column) -> Column:
    """All entries; later maps win, whatever the session's policy for repeated keys."""

    def two(a: Column, b: Column) -> Column:
        return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))

    return reduce(two, maps)


def with_defaults(given: Column, defaults: Column) -> Column:
    """The defaults, with the given values of their keys; other given keys are left out."""
    return F.map_zip_with(defaults, F.map_filter(given, lambda k, v: F.map_contains_key(defaults, k)), lambda k, d, g: F.coalesce(g, d))


def flat_columns(schema, prefix: str = "", sep: str = "_") -> list[Column]:
    """All leaves of nested structs, named by their path."""
    out = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if hasattr(f.dataType, "fields"):
            out += flat_columns(f.dataType, path, sep)
        else:
            out.append(F.col(path).alias(path.replace(".", sep)))
    return out


# ---- typed fields

_BOOL = {**dict.fromkeys(("1", "true", "t", "yes", "y"), True), **dict.fromkeys(("0", "false", "f", "no", "n"), False)}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _known(value: Column, parsed: Column, what: str) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"not {what}: "), value.cast("string")))
    return F.when(value.isNull(), F.lit(None)).when(parsed.isNotNull(), parsed).otherwise(bad)


def parse_bool(s: Column) -> Column:
    """0/1, true/false, t/f, yes/no, y/n in any case; an error otherwise, null for null."""
    return _known(s, F.try_element_at(literal_map(_BOOL), F.lower(s)), "a boolean")


def parse_int(s: Column) -> Column:
    return _known(s, s.try_cast("long"), "an integer")


def parse_nullable_int(s: Column) -> Column:
    """``.`` and null are null."""
    return parse_int(F.nullif(s, F.lit(".")))


def parse_enum(s: Column, allowed: list[str]) -> Column:
    return _known(s, F.when(s.isin(allowed), s), f"one of {allowed}")


def parse_dict(s: Column, values: dict) -> Column:
    return _known(s, F.try_element_at(literal_map(values), s), "a known value")


def format_dict(v: Column, values: dict) -> Column:
    return parse_dict(v, {b: a for a, b in values.items()})


# ---- lookups and summaries


def first_value(m: Column, keys: list[str]) -> Column:
    """The value of the first of the keys that the map holds; an error if it holds none."""
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys], F.raise_error(F.lit(f"none of {keys}")).cast("string"))


def array_summary(values: Column) -> Column:
    """Type of the elements and their number, such as ``float[64]``."""
    kind = F.regexp_extract(F.typeof(values), "^array<(.*)>$", 1)
    return F.concat(kind, F.lit("["), F.size(values).cast("string"), F.lit("]"))


def progress(count: Column, total: Column) -> Column:
    """The share done, from 0 to 1; nothing to do counts as done."""
    return F.coalesce(F.least(F.greatest(F.try_divide(count, total), F.lit(0.0)), F.lit(1.0)), F.lit(1.0))


def study_name(*parts: Column) -> Column:
    """The parts as one name, with ``_`` between them; no part may hold one."""
    bad = F.raise_error(F.lit("a part of a study's name holds _"))
    return F.concat_ws("_", *[F.when(p.cast("string").contains("_"), bad.cast("string")).otherwise(p.cast("string")) for p in parts])


def parse_study_name(name: Column, fields: list[str]) -> Column:
    """The named parts of a study's name; null unless there are as many."""
    parts = F.split(name, "_")
    return F.when(F.size(parts) == len(fields), F.struct(*[F.get(parts, F.lit(i)).alias(f) for i, f in enumerate(fields)]))
