"""Path and string functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dirname(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)/[^/]*$", 1)


def basename(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/]*)$", 1)


def strip_extension(p: Column) -> Column:
    return F.regexp_replace(p, r"\.[^./]*$", "")


def common_prefix(df: DataFrame, name: str) -> DataFrame:
    """The longest common prefix of a column, from its least and greatest value; one row."""
    ends = df.agg(F.min(name).alias("a"), F.max(name).alias("b"))
    same = F.filter(F.sequence(F.lit(0), F.least(F.length("a"), F.length("b"))), lambda n: F.left(F.col("a"), n) == F.left(F.col("b"), n))
    return ends.select(F.left(F.col("a"), F.array_max(same)).alias("prefix"))


def output_path(p: Column, folder: str, suffix: str = "", replace: tuple[str, str] | None = None) -> Column:
    """Another folder, and a suffix before the extension or a replacement in the name."""
    name = basename(p)
    if replace:
        name = F.replace(name, F.lit(replace[0]), F.lit(replace[1]))
    else:
        stem = strip_extension(name)
        name = F.concat(stem, F.lit(suffix), F.substring(name, F.length(stem) + 1, F.length(name)))
    return F.concat(F.lit(folder + "/"), name)


def relative(df: DataFrame, path: str, roots: dict[str, str], name: str = "rel") -> DataFrame:
    """``{KEY}/rest`` under the longest root that is a strict parent; other paths stay as they are."""
    out = F.col(path)
    # later tests win, so the longest roots, then the greatest keys, come last
    for key, root in sorted(roots.items(), key=lambda kv: (len(kv[1]), kv[0])):
        root = root.rstrip("/")
        out = F.when(F.startswith(F.col(path), F.lit(root + "/")), F.concat(F.lit("{" + key + "}"), F.substring(F.col(path), F.lit(len(root) + 1), F.length(path)))).otherwise(out)
    return df.withColumn(name, out)


def system(p: Column, roots: dict[str, str], drive_letters: bool = False) -> Column:
    """The path behind ``{KEY}/rest``; with drive_letters ``C:/x`` becomes ``/c/x``."""
    out = p
    for key, root in roots.items():
        out = F.when(F.startswith(p, F.lit("{" + key + "}/")), F.concat(F.lit(root.rstrip("/")), F.substring(p, F.lit(len(key) + 3), F.length(p)))).otherwise(out)
    if drive_letters:
        out = F.when(out.rlike("^[A-Za-z]:/"), F.concat(F.lit("/"), F.lower(F.left(out, F.lit(1))), F.substring(out, F.lit(3), F.length(out)))).otherwise(out)
    return out


def partial_format(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` replaced where a value is given; others stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def _tenths(v: Column) -> Column:
    """A double rounded to one digit as C's printf does: by its exact binary value, ties to the even digit.

    Spark's format_string rounds the shortest decimal half up instead (0.25 to 0.3, 0.15 to 0.2).  Ten times
    the value may only be rounded to a tie, not across one; by what is told from its two halves, exactly.
    """
    times, high = v * 10, v.cast("float").cast("double")
    off = F.signum((high * 10 - times) + (v - high) * 10)
    near = F.rint(F.when(F.abs(times % 1) == 0.5, times + 0.25 * off).otherwise(times)) / 10
    return F.when(F.abs(v) < 2.0**49, near).otherwise(v)


def human_speed(bytes_per_second: Column) -> Column:
    """Bytes per second with a unit of k, M or G, rounded as printf rounds."""
    v = bytes_per_second
    shown = lambda unit, x: F.format_string(f"%.1f{unit}", _tenths(x.cast("double")))
    return F.when(v >= 1024**3, shown("GB/s", v / 1024**3)).when(v >= 1024**2, shown("MB/s", v / 1024**2)).when(v >= 1024, shown("kB/s", v / 1024)).otherwise(shown("B/s", v))
