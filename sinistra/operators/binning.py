"""Binning, winsorising, clipping, imputation and outlier reports.

Bounds are computed once as a small fence (exact distributed quantiles or
min/max: a few values per column), fetched and inlined as literals, so the
per-row work is a codegen'd ``when`` chain over a plan that reads its input
once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casting import as_double, to_double
from . import ranks
from .levels import split_join
from .profile import column_quantiles


def cut_expr(x: Column, edges: Sequence[float], labels: Sequence[str] | None = None,
             include_lowest: bool = False) -> Column:
    """Right-closed bins (e0, e1], (e1, e2], ... like ``pd.cut``; with
    ``include_lowest`` the first bin also takes e0. Outside -> null."""
    labels = list(labels) if labels else [f"({edges[i]}, {edges[i + 1]}]" for i in range(len(edges) - 1)]
    first = (x >= edges[0]) if include_lowest else (x > edges[0])
    expr = F.when(x.isNull(), F.lit(None))
    for i in range(len(edges) - 1):
        lo_ok = first if i == 0 else (x > edges[i])
        expr = expr.when(lo_ok & (x <= edges[i + 1]), F.lit(labels[i]))
    return expr


def cut_fixed_edges(df: DataFrame, col: str, edges, labels=None, include_lowest=False, out: str | None = None):
    return df.withColumn(out or f"{col}_bin", cut_expr(to_double(col), edges, labels, include_lowest))


def cut_equal_width(df: DataFrame, col: str, k: int = 5, out: str | None = None) -> DataFrame:
    """k equal-width right-closed bins over the observed min..max (min in the
    first bin, a constant column widened by 0.1 %); bin index 1..k."""
    x = to_double(col)
    mn, mx = df.agg(F.min(x), F.max(x)).first()
    if mn is None:
        return df.withColumn(out or f"{col}_bin", F.lit(None).cast("int"))
    lo, hi = (mn - abs(mn) * 0.001, mx + abs(mx) * 0.001) if mn == mx else (mn, mx)
    w = (hi - lo) / k
    b = F.least(F.lit(k), F.greatest(F.lit(1), F.ceil((x - F.lit(lo)) / F.lit(w)))).cast("int")
    return df.withColumn(out or f"{col}_bin", F.when(x.isNotNull(), b))


def qcut_quartiles(df: DataFrame, col: str, q: int = 4, labels: Sequence[str] | None = None,
                   out: str | None = None, drop_duplicates: bool = True) -> DataFrame:
    """Quantile bins like ``pd.qcut``: exact edges at i/q, right-closed, lowest
    included; ties are never split. Duplicate edges are merged (the
    ``duplicates='drop'`` caller) - labels then follow the merged bins."""
    probs = [i / q for i in range(q + 1)]
    e = ranks.quantile_values(df, col, probs)
    x = to_double(col)
    labels = list(labels) if labels else [f"Q{i + 1}" for i in range(q)]
    if e[0] is None:
        return df.withColumn(out or f"{col}_q", F.lit(None).cast("string"))
    # bin i keeps rows with e_i < x <= e_{i+1}; with equal edges the bin is empty
    expr = F.when(x.isNull(), F.lit(None))
    for i in range(q):
        lo_ok = (x >= F.lit(e[0])) if i == 0 else (x > F.lit(e[i]))
        expr = expr.when(lo_ok & (x <= F.lit(e[i + 1])), F.lit(labels[i]))
    return df.withColumn(out or f"{col}_q", expr)


def clip_guarded(x: Column, lo: Column, hi: Column) -> Column:
    """clip that keeps nulls null (``greatest``/``least`` skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def winsorize(df: DataFrame, col: str, lo: float = 0.01, hi: float = 0.99, keys: Sequence[str] = ()) -> DataFrame:
    """Clip ``col`` to its (global, or per-``keys``) lo/hi quantiles."""
    if not keys:
        a, b = ranks.quantile_values(df, col, [lo, hi])
        return df.withColumn(col, clip_guarded(F.col(col), ranks.lit_or_null(a), ranks.lit_or_null(b)))
    f = ranks.exact_quantiles(df, col, [lo, hi], keys, names=["_wlo", "_whi"])
    j = split_join(df, f, keys[0]) if len(keys) == 1 else df.join(f, list(keys), "left")
    return j.withColumn(col, clip_guarded(F.col(col), F.col("_wlo"), F.col("_whi"))).drop("_wlo", "_whi")


def clip_outliers(df: DataFrame, cols: Sequence[str], q_lo: float = 0.01, q_hi: float = 0.99,
                  strategy: str = "clip", min_values: int = 5) -> DataFrame:
    """All ``cols`` clipped to their own q_lo/q_hi (one fence row holding every
    column's bounds, from one unpivot); ``strategy='nan'`` nulls the values
    outside instead; columns with fewer than ``min_values`` values are left
    as they are."""
    if strategy == "none" or not cols:
        return df
    found = column_quantiles(df, cols, {"lo": q_lo, "hi": q_hi})
    sel = []
    for c in df.columns:
        if c not in cols or found[c].n < min_values:
            sel.append(F.col(f"`{c}`"))
            continue
        x = to_double(c)
        lo, hi = (ranks.lit_or_null(found[c].quantile(q)) for q in ("lo", "hi"))
        v = clip_guarded(x, lo, hi) if strategy == "clip" else F.when((x >= lo) & (x <= hi), x)
        sel.append(v.alias(c))
    return df.select(*sel)


def impute_numeric(df: DataFrame, cols: Sequence[str], how: str = "median") -> DataFrame:
    """null -> median (exact) or mean of the column."""
    if how == "median":
        fill = {c: f.quantile("m") for c, f in column_quantiles(df, cols, {"m": 0.5}).items()}
    else:
        row = df.agg(*[F.avg(to_double(c)).alias(c) for c in cols]).first()
        fill = {c: row[c] for c in cols}
    return df.select(*[F.coalesce(to_double(c), ranks.lit_or_null(fill.get(c))).alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


def cleaning_audit(df: DataFrame, cols: Sequence[str], q_lo: float = 0.01, q_hi: float = 0.99) -> DataFrame:
    """Per column: rows below / above the clip bounds and nulls to impute."""
    found = column_quantiles(df, cols, {"lo": q_lo, "hi": q_hi})
    bound = {c: [ranks.lit_or_null(found[c].quantile(q)) for q in ("lo", "hi")] for c in cols}
    aggs = []
    for c in cols:
        x, (lo, hi) = to_double(c), bound[c]
        aggs.append(F.struct(
            F.lit(c).alias("variable"),
            F.count(F.when(x < lo, 1)).cast("bigint").alias("below"),
            F.count(F.when(x > hi, 1)).cast("bigint").alias("above"),
            F.count(F.when(x.isNull(), 1)).cast("bigint").alias("nulls"),
            lo.alias("lower_bound"), hi.alias("upper_bound"),
        ))
    return df.agg(F.array(*aggs).alias("_all")).select(F.explode("_all").alias("_r")).select("_r.*")


def outliers_iqr(df: DataFrame, col: str) -> DataFrame:
    """q1, q3, IQR, fences, outlier count and rate, n, mean, median, std;
    IQR = 0 -> rate 0 and a warning."""
    x = to_double(col)
    d = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    q1, med, q3 = ranks.quantile_values(d, "_x", [0.25, 0.5, 0.75])
    j = d.select("_x", ranks.lit_or_null(q1).alias("q1"), ranks.lit_or_null(med).alias("median"), ranks.lit_or_null(q3).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    out = (F.col("_x") < lo) | (F.col("_x") > hi)
    a = j.groupBy("q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(out, 1)).alias("outlier_count"),
        F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"))
    zero = iqr == 0
    return a.select(
        "q1", "q3", iqr.alias("iqr"), F.when(~zero, lo).alias("lower"), F.when(~zero, hi).alias("upper"),
        F.when(~zero, F.col("outlier_count")).otherwise(0).cast("bigint").alias("outlier_count"),
        F.when(~zero, F.col("outlier_count") / F.col("n")).otherwise(0.0).alias("outlier_rate"),
        F.col("n").cast("bigint").alias("n"), "mean", "median", "std",
        F.when(zero, F.lit("Distribution très concentrée")).alias("warning"),
    )


def outliers_multi(df: DataFrame, col: str) -> DataFrame:
    """IQR, percentile (p5/p95), modified z (MAD) and z-score (population std)
    outlier counts and rates; p99 exceptional mean and ratio to the median;
    severity and action flag from the IQR rate."""
    x = to_double(col)
    d = df.select(x.alias("_x")).where(F.col("_x").isNotNull())
    names = ["p5", "q1", "median", "q3", "p95", "p99"]
    probs = dict(zip(names, [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]))
    # quantiles and moments from one rank pipeline, fetched as one row
    f = ranks.group_summary(d, "_x", (), ("count", "mean", "std_pop"), probs).first()
    if f is None:
        f = {k: None for k in names + ["count", "mean", "std_pop"]}
    j = d.select("_x", *[ranks.lit_or_null(f[n]).alias(n) for n in names],
                 ranks.lit_or_null(f["mean"]).alias("mean"), ranks.lit_or_null(f["std_pop"]).alias("sd0"),
                 F.lit(f["count"]).cast("bigint").alias("n"))
    j = j.withColumn("_ad", F.abs(F.col("_x") - F.col("median")))
    (mad,) = ranks.quantile_values(j, "_ad", [0.5])
    j = j.withColumn("mad", ranks.lit_or_null(mad))
    iqr = F.col("q3") - F.col("q1")
    mz = F.try_divide(0.6745 * (F.col("_x") - F.col("median")), F.col("mad"))
    z = F.try_divide(F.col("_x") - F.col("mean"), F.col("sd0"))
    a = j.groupBy("p5", "q1", "median", "q3", "p95", "p99", "mean", "sd0", "n", "mad").agg(
        F.count(F.when((F.col("_x") < F.col("q1") - 1.5 * iqr) | (F.col("_x") > F.col("q3") + 1.5 * iqr), 1)).alias("iqr_count"),
        F.count(F.when(F.col("_x") > F.col("p95"), 1)).alias("above_p95"),
        F.count(F.when(F.col("_x") < F.col("p5"), 1)).alias("below_p5"),
        F.count(F.when(F.abs(mz) > 3.5, 1)).alias("mad_count"),
        F.count(F.when(F.abs(z) > 3, 1)).alias("z_count"),
        F.avg(F.when(F.col("_x") > F.col("p99"), F.col("_x"))).alias("exceptional_mean"),
        F.count(F.when(F.col("_x") > F.col("p99"), 1)).alias("exceptional_count"),
    )
    rate = F.col("iqr_count") * 100.0 / F.col("n")
    return a.select(
        F.col("n").cast("bigint").alias("n"), "q1", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
        F.when(F.col("q3") > F.col("q1"), F.col("iqr_count")).cast("bigint").alias("iqr_count"),
        F.when(F.col("q3") > F.col("q1"), rate).alias("iqr_rate_pct"),
        F.col("above_p95").cast("bigint").alias("above_p95"), F.col("below_p5").cast("bigint").alias("below_p5"),
        "mad", F.when(F.col("mad") > 0, F.col("mad_count")).cast("bigint").alias("mad_count"),
        F.when(F.col("sd0") > 0, F.col("z_count")).cast("bigint").alias("z_count"),
        F.col("exceptional_count").cast("bigint").alias("exceptional_count"), "exceptional_mean",
        F.try_divide(F.col("exceptional_mean"), F.col("median")).alias("exceptional_ratio"),
        # Severity levels of the outlier recommendation.
        F.when(rate < 2, "low").when(rate < 10, "medium").otherwise("high").alias("severity"),
        (rate > 5).alias("action_needed"),
    )


def clip_and_impute(df: DataFrame, cols: Sequence[str], q_lo: float = 0.01, q_hi: float = 0.99,
                    min_values: int = 5, impute: str = "median") -> DataFrame:
    """``clip_outliers`` then ``impute_numeric`` from ONE selection: the
    clip bounds are quantiles of the raw column, and because clipping is
    monotone the median of the clipped column is the interpolation between
    the clipped order statistics around the middle position - exact, with no
    second pass. (Mean imputation needs the clipped mean: one extra
    aggregate.)"""
    if not cols:
        return df
    fences = column_quantiles(df, cols, {"lo": q_lo, "hi": q_hi, "m": 0.5})
    sel, clipped = [], {}
    for c in df.columns:
        f = fences.get(c)
        if c not in cols or f is None:
            sel.append(F.col(f"`{c}`"))
            continue
        x = as_double(df, c)
        if f.n >= min_values:
            x = clip_guarded(x, F.lit(f.quantile("lo")), F.lit(f.quantile("hi")))
        clipped[c] = x
        sel.append(x.alias(c))
    out = df.select(*sel)
    if impute == "median":
        fill = {}
        for c in clipped:
            f = fences[c]
            if f.n >= min_values and f.n:
                a, b, share = f.marks["m"]
                a, b = (min(max(x, f.quantile("lo")), f.quantile("hi")) for x in (a, b))
                fill[c] = a + share * (b - a)
            else:
                fill[c] = f.quantile("m")
    else:
        row = out.agg(*[F.avg(c).alias(c) for c in clipped]).first()
        fill = {c: row[c] for c in clipped}
    return out.select(*[F.coalesce(F.col(c), ranks.lit_or_null(fill[c])).alias(c) if c in clipped else F.col(f"`{c}`")
                        for c in out.columns])
