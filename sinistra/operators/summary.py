"""Grouped and global summaries: moments and exact order statistics of all
groups from two scans (:mod:`selection`)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import cv, kurt_g2, skew_g1
from . import ranks

MEASURES = {
    "count": lambda c: F.count(c),
    "mean": lambda c: F.avg(c),
    "std": lambda c: F.stddev_samp(c),
    "var": lambda c: F.var_samp(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "sum": lambda c: F.sum(c),
    "skew": skew_g1,
    "kurt": kurt_g2,
    "cv": cv,
    "missing": lambda c: F.count(F.when(F.col(c).isNull(), F.lit(1))),
    "std_pop": lambda c: F.stddev_pop(c),
}

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def join_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join two per-group results on their keys (null keys match)."""
    keys = list(keys)
    if not keys:
        return a.crossJoin(b) if how == "inner" or how == "left" else a.join(b, how=how)
    r = b
    for k in keys:
        r = r.withColumnRenamed(k, f"_r_{k}")
    cond = [a[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return a.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def summarize(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    measures: Sequence[str] = ("count", "mean", "std", "min", "max"),
    quantiles: Mapping[str, float] | None = None,
    extra: Sequence[Column] = (),
    trimmed: str | None = None,
    mode: str | None = None,
) -> DataFrame:
    """Per group of ``keys``: the named ``measures`` of ``value``, exact
    ``quantiles`` (name -> probability), optional trimmed mean and mode
    (smallest value among the most frequent)."""
    keys = list(keys)
    if not extra and all(m in ranks.MOMENT_MEASURES for m in measures):
        # moments and order statistics of all groups from two scans
        d = df.select(*keys, F.col(value).try_cast("double").alias(value))
        d = d.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
        out = ranks.group_summary(d, value, keys, measures, quantiles, trimmed)
        return join_keys(out, modes(d, value, keys, mode), keys) if mode else out
    aggs = [MEASURES[m](value).alias(m) for m in measures] + list(extra)
    base = df.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("_rows")]))
    if not aggs:
        base = base.drop("_rows")
    if quantiles:
        q = ranks.exact_quantiles(df, value, list(quantiles.values()), keys, names=list(quantiles.keys()))
        base = join_keys(base, q, keys)
    if trimmed:
        base = join_keys(base, ranks.trimmed_means(df, value, keys, name=trimmed), keys)
    if mode:
        base = join_keys(base, modes(df, value, keys, mode), keys)
    return base


def modes(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """Smallest of the most frequent values per group: value counts, combined
    before the shuffle."""
    vc = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    m = vc.groupBy(*keys).agg(F.max(F.struct(F.col("_c"), (-F.col(value)).alias("_nv"))).alias("_m"))
    return m.select(*keys, (-F.col("_m._nv")).alias(name))


def with_share(res: DataFrame, count_col: str = "count", name: str = "percentage",
               digits: int | None = 1, total: DataFrame | None = None) -> DataFrame:
    """Add count / total in percent. The total is a one-row aggregate joined by
    broadcast (from ``total`` - e.g. a count over the input, so the grouped
    plan is not run twice - or from ``res``), so no single-partition window
    is needed however many groups."""
    tot = total.toDF("_tot") if total is not None else res.agg(F.sum(count_col).alias("_tot"))
    v = F.try_divide(F.col(count_col) * 100.0, F.col("_tot"))
    v = F.round(v, digits) if digits is not None else v
    return res.crossJoin(F.broadcast(tot)).withColumn(name, v).drop("_tot")


def group_stats(df: DataFrame, cat: str, target: str, null_group: str | None = None,
                digits: int | None = 2) -> DataFrame:
    """count, mean, median, std, min, max (2 decimals) and share (1 decimal) of
    ``target`` per level of ``cat``. Null levels are dropped, or named
    ``null_group`` (``"nan"`` reproduces the reference)."""
    g = F.col(cat).cast("string")
    if null_group is not None:
        g = F.coalesce(g, F.lit(null_group))
    d = df.select(g.alias(cat), F.col(target).try_cast("double").alias(target)).where(
        F.col(cat).isNotNull() & F.col(target).isNotNull()
    )
    s = summarize(d, target, [cat], ("count", "mean", "std", "min", "max"), {"median": 0.5})
    s = s.select(
        cat,
        F.col("count").cast("bigint").alias("count"),
        *[(F.round(c, digits) if digits is not None else F.col(c)).alias(c)
          for c in ("mean", "median", "std", "min", "max")],
    )
    return with_share(s, total=d.agg(F.count(F.lit(1))))
