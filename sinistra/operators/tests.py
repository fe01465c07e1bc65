"""Rank tests, correlation, effect sizes and regressions on aggregates.

Every test reduces the data with a distributed plan to a handful of result
rows (per group, per pair of groups, or one row) before any p-value is
computed; p-values come from :mod:`sinistra.functions.special` on those
rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casting import to_double
from ..functions.special import chi2_pvalue, f_pvalue, mw_exact_pvalue, norm_pvalue, t_pvalue
from ..functions.stats import kurt_g2, pair_corr, significance_label, skew_g1
from . import ranks
from .levels import split_join
from .pairs import cliffs_delta_pairs, dunn_posthoc  # noqa: F401


def _clean(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    cols = [to_double(value).alias(value)]
    if group:
        cols.insert(0, F.col(group))
    d = df.select(*cols).where(F.col(value).isNotNull())
    return d.where(F.col(group).isNotNull()) if group else d


def rank_sums(df: DataFrame, group: str, value: str, min_n: int = 3,
              keys: Sequence[str] = ()) -> DataFrame:
    """Per group with at least ``min_n`` rows: size ``n_g``, rank sum ``R`` and
    the group's share of the tie term; ranks are average ranks over all kept
    groups together (separately per ``keys``)."""
    keys = list(keys)
    d = df.select(*keys, F.col(group), to_double(value).alias(value)).where(
        F.col(value).isNotNull() & F.col(group).isNotNull())
    if min_n > 1:
        sizes = d.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"))
        few = sizes.where(F.col("_n") < min_n).select(*keys, group)
        d = d.join(few, [*keys, group], "left_anti") if keys else split_join(d, few, group, "left_anti")
    cc = ranks.cumulative_counts(d, value, keys=keys, by=group)
    t = F.col("t").cast("double")
    return cc.groupBy(*keys, group).agg(
        F.sum("cnt").alias("n_g"),
        F.sum(F.col("cnt") * ranks.average_rank()).alias("R"),
        F.sum(F.col("cnt") / t * (t * t * t - t)).alias("tie"),
    )


def kruskal_wallis(df: DataFrame, group: str, value: str, min_n: int = 3) -> DataFrame:
    """H (tie-corrected), p (chi-square, k-1 df), group count, epsilon squared
    over all rows (those of groups below ``min_n`` too), significance label;
    null H with fewer than two groups."""
    every = _clean(df, value, group).agg(F.count(F.lit(1)).cast("double").alias("rows"))
    rs = rank_sums(df, group, value, min_n)
    one = rs.agg(
        F.sum("n_g").cast("double").alias("N"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("R") * F.col("R") / F.col("n_g")).alias("S"),
        F.sum("tie").alias("ties"),
    ).crossJoin(every)
    N = F.col("N")
    h0 = F.lit(12.0) / (N * (N + 1)) * F.col("S") - 3 * (N + 1)
    corr = F.lit(1.0) - F.col("ties") / (N * N * N - N)
    h = F.when(F.col("k") >= 2, F.try_divide(h0, corr))
    out = one.select(
        h.alias("statistic"),
        F.col("k").cast("bigint").alias("groups_count"),
        N.cast("bigint").alias("n"),
        F.try_divide(h - F.col("k") + 1, F.col("rows") - 1).alias("epsilon_sq"),
    )
    out = out.withColumn("p_value", chi2_pvalue("statistic", F.col("groups_count") - 1))
    return out.withColumn("significance", significance_label("p_value")).withColumn(
        "significant", F.col("p_value") < 0.05
    )


def mann_whitney(df: DataFrame, flag: str, value: str, first=True, min_n: int = 3) -> DataFrame:
    """U of the ``first`` sample and its two-sided p - exact null
    distribution when a sample has at most 8 values and there are no ties,
    else normal approximation with continuity and tie correction (scipy's
    ``method='auto'``); Cliff's delta 2U/(n1 n2) - 1 from the same U."""
    rs = rank_sums(df, flag, value, min_n=1)
    one = rs.agg(
        F.sum(F.when(F.col(flag) == F.lit(first), F.col("n_g"))).cast("double").alias("n1"),
        F.sum(F.when(F.col(flag) != F.lit(first), F.col("n_g"))).cast("double").alias("n2"),
        F.sum(F.when(F.col(flag) == F.lit(first), F.col("R"))).alias("R1"),
        F.sum("tie").alias("ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("R1") - n1 * (n1 + 1) / 2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    big = F.greatest(u, n1 * n2 - u)
    z = F.try_divide(big - mu - 0.5, sigma)
    ok = (n1 >= min_n) & (n2 >= min_n)
    out = one.select(
        n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"),
        F.when(ok, u).alias("U"),
        F.when(ok, z).alias("z"),
        F.when(ok, F.try_divide(2 * u, n1 * n2) - 1).alias("cliffs_delta"),
        (((n1 <= 8) | (n2 <= 8)) & (F.col("ties") == 0)).alias("exact"),
    )
    # scipy: p = 2 sf(z) clipped to 1, so a negative z gives 1
    asym = F.when(F.col("z") < 0, F.lit(1.0)).otherwise(norm_pvalue("z"))
    # the function runs before a branch is chosen: other rows pass it a null
    exact = mw_exact_pvalue(F.when(F.col("exact"), F.col("U")), "n1", "n2")
    return out.withColumn("p_value", F.when(F.col("U").isNull(), F.lit(None)).when(F.col("exact"), exact).otherwise(asym))


def pair_ranks(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, cnt, rx, ry): average ranks of x and y over rows where both are
    present, pairs pre-aggregated so repeated (x, y) travel once."""
    d = df.select(to_double(x).alias("_x"), to_double(y).alias("_y")).where(
        F.col("_x").isNotNull() & F.col("_y").isNotNull()
    )
    pc = d.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("cnt"))
    rx = ranks.cumulative_counts(d, "_x").select("_x", ranks.average_rank().alias("rx"), F.col("n"))
    ry = ranks.cumulative_counts(d, "_y").select("_y", ranks.average_rank().alias("ry"))
    return pc.join(rx, "_x").join(ry, "_y")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho (Pearson on average ranks), n and two-sided p (t with n-2 df)."""
    pr = pair_ranks(df, x, y)
    c = (F.col("n") + 1) / 2.0
    cx, cy = F.col("rx") - c, F.col("ry") - c
    w = F.col("cnt")
    one = pr.agg(
        F.sum(w).alias("n"),
        F.sum(w * cx * cy).alias("sxy"),
        F.sum(w * cx * cx).alias("sxx"),
        F.sum(w * cy * cy).alias("syy"),
    )
    rho = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    out = one.select(F.col("n").cast("bigint").alias("n"), rho.alias("rho"))
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    return out.withColumn(
        "p_value",
        F.when(F.abs(F.col("rho")) >= 1, F.lit(0.0)).when(F.col("n") > 2, t_pvalue(t, F.col("n") - 2)),
    )


def effect_label(d) -> Column:
    a = F.abs(F.col(d) if isinstance(d, str) else d)
    # Cliff's delta magnitude thresholds (negligible/small/medium/large).
    return F.when(a.isNull(), None).when(a < 0.147, "negligible").when(a < 0.33, "small").when(
        a < 0.474, "medium").otherwise("large")


def anova_f(df: DataFrame, group: str, value: str, min_n: int = 3, max_levels: int = 10) -> DataFrame:
    """One-way F over groups with at least ``min_n`` rows (when the column has
    at most ``max_levels`` levels); p from the F tail."""
    d = _clean(df, value, group)
    g = d.groupBy(group).agg(F.count(F.lit(1)).alias("ng"), F.avg(value).alias("mg"), F.var_samp(value).alias("vg"))
    lv = g.agg(F.count(F.lit(1)).alias("levels"))
    g = g.where(F.col("ng") >= min_n)
    one = g.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("ng").cast("double").alias("N"),
        F.sum(F.col("ng") * F.col("mg")).alias("sx"),
        F.sum(F.col("ng") * F.col("mg") * F.col("mg")).alias("sxx"),
        F.sum((F.col("ng") - 1) * F.coalesce(F.col("vg"), F.lit(0.0))).alias("ssw"),
    ).crossJoin(lv)
    ssb = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("N")
    f = F.try_divide(ssb / (F.col("k") - 1), F.col("ssw") / (F.col("N") - F.col("k")))
    out = one.select(
        F.col("k").cast("bigint").alias("groups_count"),
        F.col("N").cast("bigint").alias("n"),
        F.when((F.col("k") >= 2) & (F.col("levels") <= max_levels), f).alias("F"),
        (F.col("k") - 1).cast("bigint").alias("df_between"),
        (F.col("N") - F.col("k")).cast("bigint").alias("df_within"),
    )
    return out.withColumn("p_value", f_pvalue("F", "df_between", "df_within"))


def t_test(df: DataFrame, flag: str, value: str, equal_var: bool = True, log1p: bool = False,
           first=True) -> DataFrame:
    """Two-sample t of the ``first`` sample minus the other; Student (pooled)
    or Welch; optional log1p of the values."""
    v = F.log1p(to_double(value)) if log1p else to_double(value)
    d = df.select(F.col(flag).alias("_f"), v.alias("_v")).where(F.col("_f").isNotNull() & F.col("_v").isNotNull())
    one = d.agg(
        F.count(F.when(F.col("_f") == F.lit(first), 1)).cast("double").alias("n1"),
        F.avg(F.when(F.col("_f") == F.lit(first), F.col("_v"))).alias("m1"),
        F.var_samp(F.when(F.col("_f") == F.lit(first), F.col("_v"))).alias("v1"),
        F.count(F.when(F.col("_f") != F.lit(first), 1)).cast("double").alias("n2"),
        F.avg(F.when(F.col("_f") != F.lit(first), F.col("_v"))).alias("m2"),
        F.var_samp(F.when(F.col("_f") != F.lit(first), F.col("_v"))).alias("v2"),
    )
    n1, n2, v1, v2 = F.col("n1"), F.col("n2"), F.col("v1"), F.col("v2")
    if equal_var:
        sp = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
        se = F.sqrt(sp * (1 / n1 + 1 / n2))
        dof = n1 + n2 - 2
    else:
        a, b = v1 / n1, v2 / n2
        se = F.sqrt(a + b)
        dof = F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1))
    t = F.try_divide(F.col("m1") - F.col("m2"), se)
    out = one.select(n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), t.alias("t"), dof.alias("df"))
    return out.withColumn("p_value", t_pvalue("t", "df"))


def jarque_bera(df: DataFrame, value: str) -> DataFrame:
    """JB = n/6 (S^2 + K^2/4) with population skewness and excess kurtosis;
    p = exp(-JB/2) (chi-square, 2 df)."""
    x = to_double(value)
    one = df.agg(F.count(x).alias("n"), F.skewness(x).alias("s"), F.kurtosis(x).alias("k"))
    jb = F.col("n") / 6.0 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4.0)
    return one.select(F.col("n").cast("bigint").alias("n"), jb.alias("jb")).withColumn("p_value", F.exp(-F.col("jb") / 2))


def linear_trend(df: DataFrame, value: str, date: str, min_n: int = 3) -> DataFrame:
    """Slope per day and per year (x 365.25), r^2 and p of value on days since
    the first date (fractional days)."""
    d = df.select(to_double(value).alias("_y"), F.col(date).cast("timestamp_ntz").alias("_d")).where(
        F.col("_y").isNotNull() & F.col("_d").isNotNull()
    )
    from ..functions.dates import wall_seconds

    d0 = d.agg(F.min(wall_seconds("_d"))).first()[0]
    # whole days since the first date (timedelta.days floors)
    days = F.floor((wall_seconds("_d") - F.lit(d0 or 0.0)) / 86400.0)
    x = d.select(days.alias("_x"), "_y")
    one = x.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("_y", "_x").alias("slope_per_day"),
        F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("r"),
    )
    ok = F.col("n") >= min_n
    r = F.col("r")
    t = r * F.sqrt(F.try_divide(F.col("n") - 2, 1 - r * r))
    return one.select(
        F.col("n").cast("bigint").alias("n"),
        F.when(ok, F.col("slope_per_day")).alias("slope_per_day"),
        F.when(ok, F.col("slope_per_day") * 365.25).alias("slope_per_year"),
        F.when(ok, r * r).alias("r_squared"),
        F.when(ok & (F.abs(r) < 1), t_pvalue(t, F.col("n") - 2)).when(ok, F.lit(0.0)).alias("p_value"),
    )


def moments(df: DataFrame, value: str) -> list[Column]:
    x = to_double(value)
    return [F.count(x), F.avg(x), F.stddev_samp(x), skew_g1(x), kurt_g2(x)]


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(pair_corr(to_double(x), to_double(y)).alias("r"),
                  F.count(F.when(to_double(x).isNotNull() & to_double(y).isNotNull(), 1)).alias("n"))
