"""Top-k and ordering operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk(df: DataFrame, k: int, by: Sequence[Column]) -> DataFrame:
    """``orderBy(...).limit(k)``: planned as TakeOrderedAndProject, each task
    keeps its own k best rows, so only k x tasks rows reach the final merge."""
    return df.orderBy(*by).limit(k)


def topn_per_group(df: DataFrame, group: str, k: int, by: Sequence[Column], name: str = "rank") -> DataFrame:
    """Best ``k`` rows per group (row_number over a window partitioned by the
    group). Meant for result tables (one row per variable/level)."""
    w = Window.partitionBy(group).orderBy(*by)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
