"""Joins and counts on the levels of a categorical column, where a few levels
hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: levels whose rows are looked up in a map sent to every task
MAX_MAP = 10_000
#: levels taken out of a shuffled join, the most frequent ones
HEAVY = 1_000


def small_table(df: DataFrame, limit: int = MAX_MAP) -> DataFrame | None:
    """``df`` as a local table when it has at most ``limit`` rows, else None."""
    rows = df.limit(limit + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= limit else None


def split_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``fact`` joined (left, inner, left_semi or left_anti) with a table of one
    row a level of ``key``.

    A table of at most MAX_MAP rows (checked) travels to the tasks, and the fact
    table stays where it is. Of a larger one only the rows of the HEAVY most
    frequent levels do; the other levels, each with at most 1 / HEAVY of the
    rows, meet in a shuffle. Null keys match nothing."""
    small = small_table(dim)
    if small is not None:
        return fact.join(F.broadcast(small), key, how)
    counts = fact.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    heavy = [r[0] for r in counts.orderBy(F.desc("_rows"), F.asc(key)).limit(HEAVY).collect()]
    hot = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    at_home = fact.where(hot).join(F.broadcast(dim.where(F.col(key).isin(heavy))), key, how)
    return at_home.unionByName(fact.where(~hot).join(dim.where(~F.col(key).isin(heavy)), key, how))
