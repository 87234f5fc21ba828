"""Running totals over long orders: no series is one task's work."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of the same ``by`` that come before, in ``order``.

    Rows are dealt by ranges of (by, order) and staged; a task sums its own rows, and the sums of
    the tasks, one row per series and task, are added up behind it.  Rows that tie in all of
    ``order`` are counted in any order.
    """
    sort = [*by, *order]
    ordered = df.withColumn("_amount", amount).repartitionByRange(*sort).sortWithinPartitions(*sort)
    ordered = stage(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_id", 33))
    parts = ordered.groupBy(*by, "_part").agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_in"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by], F.col("_part") == F.col("_in"))
    within = Window.partitionBy("_part", *by).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum("_amount").over(within), F.lit(0))
    return ordered.withColumn("_within", total).join(parts, on).select(*df.columns, (F.col("_before") + F.col("_within")).alias(name))
