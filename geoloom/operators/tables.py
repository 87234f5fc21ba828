"""Keyed tables: prefixes, keys, duplicates, override joins, matches, grouping into lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class JoinError(Exception):
    """A uniqueness rule is broken; ``rows`` holds the offending rows."""

    def __init__(self, message: str, rows: DataFrame):
        super().__init__(message)
        self.rows = rows


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating-point column."""
    c = F.col(name)
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def split_na(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows that have a value in the column, and those that have none."""
    gone = missing(df, name)
    return df.where(~gone), df.where(gone)


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


def common_prefix(df: DataFrame) -> str:
    """The longest prefix that all column names share."""
    low, high = min(df.columns), max(df.columns)
    n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return low[:n]


def with_key(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """A key column: the one column itself, or a struct of several."""
    return df.withColumn(key, F.col(columns[0]) if len(columns) == 1 else F.struct(*columns))


def with_names(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """All name columns as one array."""
    return df.withColumn(name, F.array(*[F.col(c).cast("string") for c in columns]))


def with_point(df: DataFrame, x: Column, y: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """All copies of rows whose key occurs more than once.

    The repeated keys come from a combined count, so a key with very many copies is joined back
    (and its partition split) rather than gathered in one window.
    """
    repeated = df.groupBy(*key).count().where("count > 1").drop("count")
    return _semi(df, repeated, key, "left_semi")


def without_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Without any copy of a repeated key."""
    repeated = df.groupBy(*key).count().where("count > 1").drop("count")
    return _semi(df, repeated, key, "left_anti")


def _semi(df: DataFrame, keys: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    keys = keys.toDF(*[f"_{k}" for k in key])
    return df.join(keys, reduce(lambda a, b: a & b, [df[k].eqNullSafe(keys[f"_{k}"]) for k in key]), how)


def check_unique(df: DataFrame, key: Sequence[str], ignore: bool = False) -> DataFrame:
    """df if no key repeats; else, with ignore, without all copies, or JoinError."""
    if ignore:
        return without_duplicates(df, key)
    bad = duplicates(df, key)
    if not bad.isEmpty():
        raise JoinError(f"repeated key {tuple(key)}", bad.orderBy(*key))
    return df


def merge_nodups(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that keeps the left copy of columns that both sides have."""
    return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in on]), list(on), how)


def merge_addcols(left: DataFrame, right: DataFrame, on: Sequence[str], add: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that takes only the named columns from the right."""
    return left.join(right.select(*on, *add), list(on), how).select(*left.columns, *add)


def merge_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which null keys match each other."""
    r = right.toDF(*[f"_r_{c}" if c in on else c for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[f"_r_{c}"]) for c in on])
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def override_cols(df: DataFrame, overrides: DataFrame, key: str, specs: Sequence[Sequence[str]], checked: bool = True) -> DataFrame:
    """Replace columns by non-null values of a table with the same key.

    A spec is (name,), (base, override), or (base, override, result); a null override leaves the
    base value.  The overrides must be unique on the key, else JoinError; without ``checked`` the
    caller vouches for that and the plan stays lazy.
    """
    if checked:
        overrides = check_unique(overrides, [key])
    full = [(s[0], s[1] if len(s) > 1 else s[0], s[2] if len(s) > 2 else s[0]) for s in specs]
    over = overrides.select(F.col(key).alias("_key"), *[F.col(o).alias(f"_over_{i}") for i, (_, o, _) in enumerate(full)])
    joined = df.join(over, F.col(key).eqNullSafe(F.col("_key")), "left")
    results = {r: F.coalesce(F.col(f"_over_{i}"), df[b]).alias(r) for i, (b, _, r) in enumerate(full)}
    base = {b: r for b, _, r in full}
    kept = [results.pop(base[c]) if c in base else df[c] for c in df.columns]
    return joined.select(*kept, *results.values())


@dataclass
class Match:
    """Links between two keyed tables, and the tables."""

    left: DataFrame
    right: DataFrame
    left_key: str
    right_key: str
    links: DataFrame

    def swapped(self) -> Match:
        return Match(self.right, self.left, self.right_key, self.left_key, self.links)

    def left_join(
        self, overrides: DataFrame | None = None, ignore_dups: bool = False, right_cols: Sequence[str] | None = None, checked: bool = True
    ) -> DataFrame:
        """Each left row with its match; overrides (both keys given, unique on the left) displace matches.

        A left key with two matches raises, or with ignore_dups has none; without ``checked`` the
        caller vouches for uniqueness and the plan stays lazy.
        """
        links = self.links.select(self.left_key, self.right_key)
        if overrides is not None:
            over = overrides.select(self.left_key, self.right_key).na.drop("any")
            if checked:
                over = check_unique(over, [self.left_key])
            links = links.join(over.select(self.left_key), self.left_key, "left_anti")
            links = check_unique(links, [self.left_key], ignore_dups) if checked or ignore_dups else links
            links = over.unionByName(links)
        elif checked or ignore_dups:
            links = check_unique(links, [self.left_key], ignore_dups)
        right = self.right if right_cols is None else self.right.select(*dict.fromkeys([self.right_key, *right_cols]))
        left = self.left.drop(*[c for c in [self.right_key] if c in self.left.columns and c != self.left_key])
        return merge_nodups(left.join(links, self.left_key, "left"), right, [self.right_key], "left")


def group_tuples(df: DataFrame, group: str, named: Sequence[tuple[str, Sequence[str]]], order: Sequence[str]) -> DataFrame:
    """One row per group with, for each name, the list of its tuples in order; null groups are left out."""
    lists = [F.array_sort(F.collect_list(F.struct(*order, F.struct(*cols).alias("_tuple")))).alias(name) for name, cols in named]
    grouped = df.where(F.col(group).isNotNull()).groupBy(group).agg(*lists)
    return grouped.select(group, *[F.transform(name, lambda t: t["_tuple"]).alias(name) for name, _ in named])


def where_all(df: DataFrame, attributes: dict) -> DataFrame:
    """Rows that equal every given attribute."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in attributes.items()], F.lit(True)))


def decode(df: DataFrame, codes: DataFrame, code: str, names: Sequence[str], of: str = "code") -> DataFrame:
    """``df`` with the ``names`` (labels, colours) that a table of codes has for its column ``code``; null for others.

    A code may stand once in ``codes``; more are a JoinError.
    """
    known = check_unique(codes.where(F.col(of).isNotNull()), [of]).select(F.col(of).alias("_code"), *names)
    return df.join(known, F.col(code) == F.col("_code"), "left").drop("_code")


def first_occurrences(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place where each first stands."""
    return df.groupBy(value).agg(F.min(order).alias(order))


def union_many(frames: Sequence[DataFrame], fan_in: int = 30) -> DataFrame:
    """Union by name as a shallow tree of bounded fan-in."""
    frames = list(frames)
    while len(frames) > 1:
        frames = [reduce(DataFrame.unionByName, frames[i : i + fan_in]) for i in range(0, len(frames), fan_in)]
    return frames[0]


def diff_tables(a: DataFrame, b: DataFrame, key: Sequence[str], value: str, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> DataFrame:
    """``key, status``: extra0, extra1 or diff for every key that is on one side only or differs.

    Values are close if abs(a - b) <= atol + rtol * abs(b); null and NaN differ from all, or with
    equal_nan equal each other.
    """
    x, y = F.nanvl(F.col("_a"), F.lit(None).cast("double")), F.nanvl(F.col("_b"), F.lit(None).cast("double"))
    close = F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False)) | (x.isNull() & y.isNull() & F.lit(equal_nan))
    left = a.select(*key, F.col(value).cast("double").alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(*key, F.col(value).cast("double").alias("_b"), F.lit(True).alias("_in_b"))
    both = left.join(right, list(key), "full_outer")
    status = F.when(F.col("_in_b").isNull(), "extra0").when(F.col("_in_a").isNull(), "extra1").when(~close, "diff")
    return both.select(*key, status.alias("status")).where("status IS NOT NULL")


def window_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
