"""Aggregate expressions with pandas semantics (sample std, bias-corrected
moments, pairwise-complete correlation) that stay valid under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casting import col_


def n_(c) -> Column:
    return F.count(col_(c))


def skew_g1(c) -> Column:
    """Bias-corrected skewness (pandas ``skew``); null below 3 rows."""
    x = col_(c)
    n = F.count(x).cast("double")
    g1 = F.coalesce(F.skewness(x), F.lit(0.0))  # constant column: 0 (pandas)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_g2(c) -> Column:
    """Bias-corrected excess kurtosis (pandas ``kurt``); null below 4 rows."""
    x = col_(c)
    n = F.count(x).cast("double")
    g2 = F.coalesce(F.kurtosis(x), F.lit(-6.0) / (n + 1))  # constant column: G2 = 0 (pandas)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def pair_corr(x, y) -> Column:
    """Pearson r over rows where both are present; null (not an error) when
    either side is constant."""
    xc, yc = col_(x), col_(y)
    both = xc.isNotNull() & yc.isNotNull()
    xx = F.when(both, xc)
    yy = F.when(both, yc)
    return F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))


def pair_count(x, y) -> Column:
    return F.count(F.when(col_(x).isNotNull() & col_(y).isNotNull(), F.lit(1)))


def cv(c) -> Column:
    return F.try_divide(F.stddev_samp(col_(c)), F.avg(col_(c)))


def strength_label(r) -> Column:
    """Correlation strength bands (0,.1], (.1,.3], (.3,.5], (.5,.7], (.7,1] on |r|."""
    a = F.abs(col_(r))
    # Strength labels of the correlation report.
    return (
        F.when(a.isNull() | (a <= 0), F.lit(None))
        .when(a <= 0.1, "Très faible")
        .when(a <= 0.3, "Faible")
        .when(a <= 0.5, "Modérée")
        .when(a <= 0.7, "Forte")
        .otherwise("Très forte")
    )


def significance_label(p) -> Column:
    pc = col_(p)
    # Significance labels of the rank tests.
    return (
        F.when(pc.isNull(), F.lit(None))
        .when(pc < 0.001, "Très significatif")
        .when(pc < 0.01, "Significatif")
        .when(pc < 0.05, "Modérément significatif")
        .otherwise("Non significatif")
    )
