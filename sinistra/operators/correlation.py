"""Correlation tables from one wide aggregate (pairwise-complete, guarded)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casting import to_double
from ..functions.stats import pair_corr, strength_label


def corr_with_target(df: DataFrame, target: str, cols: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """Per column: |r| and r with the target (rows where both are present),
    non-null count and missing % of the column, strength band; kept when
    |r| >= threshold."""
    y = to_double(target)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs += [pair_corr(to_double(c), y).alias(f"r{i}"), F.count(to_double(c)).alias(f"n{i}")]
    one = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("variable"), F.col(f"r{i}").alias("correlation"), F.col(f"n{i}").alias("data_count"),
                      F.col("_rows").alias("_rows")) for i, c in enumerate(cols)]
    st = one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    return st.where(F.abs("correlation") >= threshold).select(
        "variable", F.abs("correlation").alias("correlation_abs"), "correlation",
        F.col("data_count").cast("bigint").alias("data_count"),
        F.round((F.col("_rows") - F.col("data_count")) * 100.0 / F.col("_rows"), 2).alias("missing_pct"),
        strength_label("correlation").alias("correlation_strength"),
    )


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All pairs (a <= b) of the numeric columns, pairwise complete, one
    aggregate; long form (var_a, var_b, r)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[pair_corr(to_double(a), to_double(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    parts = [F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
