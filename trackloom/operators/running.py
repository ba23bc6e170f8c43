"""Running sums over an order that one task could not hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import cut


def running_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str], of: DataFrame | None = None) -> DataFrame:
    """df (without a column ``part``) with, for each name -> column of sums, its sum over the rows of the group up to this one in an order without ties.

    Rows are dealt to parts by ranges of (group, order), so a group of any size is many parts.  Each part sums by itself, and what stands
    before it comes from the parts' totals, a row for each part.  The parts are cut into a table, so they are the same for both.
    of: a row for each group; its columns come with the totals (null where a group has none), as a join by group alone would put a group in one task.
    """
    parts = cut(df.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*group, "part").agg(*(F.sum(c).alias(f"all_{n}") for n, c in sums.items()))
    base = totals.select(*group, "part", *(F.coalesce(F.sum(f"all_{n}").over(earlier), F.lit(0)).alias(f"base_{n}") for n in sums))
    more = [c for c in of.columns if c not in group] if of is not None else []
    if more:
        base = base.join(of, group, "left")
    here = Window.partitionBy(*group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(base, [*group, "part"]).select(*df.columns, *more, *((F.col(f"base_{n}") + F.sum(c).over(here)).alias(n) for n, c in sums.items()))
