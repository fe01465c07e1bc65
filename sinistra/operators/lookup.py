"""Join-like operators: small dimension tables built from fixed values,
spines that keep empty levels, semi joins and one-row fences.

Every table broadcast here is either built from a fixed list (its size is
the list length) or is a global aggregate (exactly one row)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casting import col_

# Ordered RGA levels and their synonyms (lower case).
RGA_ORDER = ["faible", "moyen", "fort", "maximal"]
RGA_SYNONYMS = {
    "faible": "faible", "bas": "faible",
    "moyen": "moyen", "modere": "moyen", "modéré": "moyen",
    "fort": "fort", "eleve": "fort", "élevé": "fort",
    "tres eleve": "maximal", "très élevé": "maximal", "maximal": "maximal",
}
# RGA exposure score and wall-type vulnerability weights.
RGA_SCORE = {"faible": 0.2, "moyen": 0.5, "fort": 0.8, "maximal": 1.0}
WALL_WEIGHTS = {"parpaing": 0.5, "brique": 0.6, "pierre": 0.7, "bois": 0.55, "béton": 0.45}


def map_expr(mapping: Mapping, c, default=None) -> Column:
    """Dictionary lookup as a codegen'd ``create_map`` literal (no join)."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    m = F.create_map(*kv)
    looked = F.try_element_at(m, col_(c))
    return looked if default is None else F.coalesce(looked, F.lit(default))


def dimension(spark: SparkSession, levels: Sequence, name: str = "level", ord_name: str = "ord") -> DataFrame:
    """Ordered dimension table (level, ord) from a fixed list."""
    return spark.createDataFrame([(lv, i) for i, lv in enumerate(levels)], f"{name} string, {ord_name} int")


def lookup_map(df: DataFrame, c: str, mapping: Mapping, out: str, default=None,
               lower: bool = True) -> DataFrame:
    key = F.lower(F.col(c).cast("string")) if lower else F.col(c)
    return df.withColumn(out, map_expr(mapping, key, default))


def category_spine(stats: DataFrame, dim: DataFrame, key: str, level: str = "level",
                   zero_cols: Sequence[str] = ("count",)) -> DataFrame:
    """Every level of the (broadcast, fixed-size) dimension, with the group
    statistics where they exist and 0 counts where they do not."""
    j = F.broadcast(dim).join(stats, F.col(level) == stats[key], "left").drop(key)
    j = j.withColumnRenamed(level, key)
    for z in zero_cols:
        j = j.withColumn(z, F.coalesce(F.col(z), F.lit(0)).cast("bigint"))
    return j


def month_spine(df: DataFrame, month_col: str = "month") -> DataFrame:
    """All months between the first and last month of ``df`` (one row each).
    Derived from a one-row min/max aggregate, so it never reads the data
    twice for more than two values."""
    mm = df.agg(F.min(month_col).alias("_a"), F.max(month_col).alias("_b"))
    return mm.select(F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias(month_col))


def topn_levels_semi(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows whose level is among the ``n`` most frequent (ties by level)."""
    top = df.groupBy(col).count().orderBy(F.desc("count"), F.asc(col)).limit(n).select(col)
    return df.join(F.broadcast(top), col, "left_semi")


def broadcast_fence(df: DataFrame, fence: DataFrame) -> DataFrame:
    """Attach a one-row aggregate (bounds, quantiles) to every row."""
    return df.crossJoin(F.broadcast(fence))
