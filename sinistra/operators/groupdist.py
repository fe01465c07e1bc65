"""Per-group distribution summaries: distribution by level (after global
winsorising), robust summary (median, IQR, trimmed mean) and the two-sided
binary summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import profile, summary


def distribution_by_group(df, target, group, order=None, min_count=20, positive_only=True,
                          winsor=(0.01, 0.99), log1p=False):
    """Per group level: n, mean, median, std, skew, kurt, p05..p99, tail flags
    and concentration, after global winsorising (one fence row) and optional
    log1p; groups below ``min_count`` are dropped; ``order`` gives the level
    order (column ``ord``)."""
    from ..functions.casting import to_double
    from .binning import winsorize

    d = df.select(F.col(group).cast("string").alias("group"), to_double(target).alias("_x")).where(
        F.col("group").isNotNull() & F.col("_x").isNotNull())
    if positive_only:
        d = d.where(F.col("_x") > 0)
    if order is not None:
        d = d.withColumn("group", F.lower("group")).where(F.col("group").isin([str(o).lower() for o in order]))
    if winsor is not None:
        d = winsorize(d, "_x", winsor[0], winsor[1])
    if log1p:
        d = d.withColumn("_x", F.log1p("_x"))
    t = profile.target_distribution(d, "_x", ["group"]).where(F.col("count") >= min_count)
    out = t.select("group", F.col("count").alias("n"), "mean", "median", "std", "skewness", "kurtosis",
                   F.col("p5").alias("p05"), "p50", "p90", "p95", "p99", "heavy_tails", "right_skewed",
                   "concentration_ratio")
    if order is not None:
        from ..functions.casting import col_  # noqa: F401
        m = F.create_map(*[x for i, o in enumerate(order) for x in (F.lit(str(o).lower()), F.lit(i))])
        out = out.withColumn("ord", F.element_at(m, F.col("group")))
    return out


def group_robust_summary(df, group, target, order=None):
    """n, median, IQR, trimmed mean, mean, std per level."""
    d = df.select(F.col(group).cast("string").alias(group), F.col(target).try_cast("double").alias(target)).where(
        F.col(group).isNotNull() & F.col(target).isNotNull())
    s = summary.summarize(d, target, [group], ("count", "mean", "std"), {"median": 0.5, "_q1": 0.25, "_q3": 0.75},
                          trimmed="trimmed_mean")
    return s.select(group, F.col("count").cast("bigint").alias("n"), "median", (F.col("_q3") - F.col("_q1")).alias("iqr"),
                    "trimmed_mean", "mean", "std")


def binary_summary(df, flag, target):
    """Per flag value false/true: n, median, IQR, trimmed mean; then the
    median difference and ratio of means, as one row."""
    d = df.select(F.col(flag).alias("_f"), F.col(target).try_cast("double").alias("_x")).where(
        F.col("_f").isNotNull() & F.col("_x").isNotNull())
    s = summary.summarize(d, "_x", ["_f"], ("count", "mean"), {"median": 0.5, "_q1": 0.25, "_q3": 0.75},
                          trimmed="tm")
    pick = lambda c, v: F.max(F.when(F.col("_f") == F.lit(v), F.col(c)))
    return s.agg(
        pick("count", False).cast("bigint").alias("n_false"), pick("count", True).cast("bigint").alias("n_true"),
        pick("median", False).alias("median_false"), pick("median", True).alias("median_true"),
        (pick("_q3", False) - pick("_q1", False)).alias("iqr_false"), (pick("_q3", True) - pick("_q1", True)).alias("iqr_true"),
        pick("tm", False).alias("mean_trimmed_false"), pick("tm", True).alias("mean_trimmed_true"),
        (pick("median", True) - pick("median", False)).alias("median_diff"),
        F.try_divide(pick("mean", True), F.when(pick("mean", False) > 0, pick("mean", False))).alias("ratio_means"),
    )
