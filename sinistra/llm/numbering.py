"""Positions in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch


def numbered(df: DataFrame, group: str, order: list[str], pos: str = "pos", n: str = "n") -> DataFrame:
    """Adds ``pos``, the 0-based position by ``order`` in the row's ``group``
    (never null), and ``n``, the rows of that group.

    Rows are dealt by ranges of (group, order, file position), so a hot group
    or very many equal rows spread over ranges too; a range's rows of a group
    are numbered in their task and moved by the counts of the ranges before.
    Rows that are equal in ``order`` get their positions in any sequence."""
    df = scratch(df, "unnumbered").withColumn("_tie", F.monotonically_increasing_id())
    dealt = df.repartitionByRange(group, *order, "_tie").withColumn("_part", F.spark_partition_id())
    dealt = scratch(dealt, "ranges")  # the ranges are drawn from a sample: fixed here once
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_rows"))
    of_group = Window.partitionBy(group)  # one row a range
    earlier = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(of_group).alias(n))
    here = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order, "_tie"))
    return dealt.join(counts, [group, "_part"]).withColumn(pos, here - 1 + F.col("_before")).drop("_part", "_tie", "_before")
