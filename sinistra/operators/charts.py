"""Chart data (no rendering): histograms, box-plot statistics, heatmaps,
curves and a kernel density on a grid - all as small result tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casting import to_double
from . import ranks, summary
from .binning import cut_equal_width, winsorize
from .levels import split_join


def histogram_bins(df: DataFrame, col: str, bins: int | None = None, log: bool = False) -> DataFrame:
    """Equal-width histogram over min..max, left-closed bins, last bin closed.
    Default bin count min(50, max(10, int(sqrt(distinct)) * 5)); optional log
    when every value is positive."""
    x = to_double(col)
    mn, mx, nd = df.agg(F.min(x), F.max(x), F.count_distinct(x)).first()
    if mn is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count bigint")
    if log and mn > 0:
        x, mn, mx = F.log(x), math.log(mn), math.log(mx)
    k = bins or min(50, max(10, int(math.sqrt(nd)) * 5))
    w = (mx - mn) / k if mx > mn else 1.0
    b = F.least(F.floor((x - F.lit(mn)) / F.lit(w)), F.lit(k - 1)).cast("int")
    g = df.select(b.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return g.select("bin", (F.lit(mn) + F.col("bin") * w).alias("lower"), (F.lit(mn) + (F.col("bin") + 1) * w).alias("upper"), "count")


def boxplot_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """Per group: n, q1, median, q3 and the whiskers (extreme values within
    1.5 IQR of the box)."""
    d = df.select(F.col(group), to_double(value).alias("_x")).where(F.col(group).isNotNull() & F.col("_x").isNotNull())
    q = ranks.exact_quantiles(d, "_x", [0.25, 0.5, 0.75], [group], names=["q1", "median", "q3"])
    j = split_join(d, q, group, "inner")
    iqr = F.col("q3") - F.col("q1")
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.min(F.when(F.col("_x") >= F.col("q1") - 1.5 * iqr, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(F.col("_x") <= F.col("q3") + 1.5 * iqr, F.col("_x"))).alias("whisker_high"),
        F.count(F.when((F.col("_x") < F.col("q1") - 1.5 * iqr) | (F.col("_x") > F.col("q3") + 1.5 * iqr), 1)).cast("bigint").alias("outliers"),
    )


def climate_heatmap(df: DataFrame, target: str, x: str = "weather_temp_mean", y: str = "weather_precip_mean", k: int = 5) -> DataFrame:
    """k x k equal-width bins of two climate variables, mean target per cell
    (long form: one row per non-empty cell)."""
    d = cut_equal_width(cut_equal_width(df, x, k, "temp_bin"), y, k, "precip_bin")
    return d.where(F.col("temp_bin").isNotNull() & F.col("precip_bin").isNotNull()).groupBy("temp_bin", "precip_bin").agg(
        F.avg(to_double(target)).alias("mean"), F.count(F.lit(1)).cast("bigint").alias("n"))


def decade_means(df: DataFrame, target: str, year: str) -> DataFrame:
    dec = (F.floor(to_double(year) / 10) * 10).cast("int")
    return df.where(to_double(year) > 1800).groupBy(dec.alias("decade")).agg(
        F.avg(to_double(target)).alias("mean"), F.count(F.lit(1)).cast("bigint").alias("n")).where(F.col("decade").isNotNull())


def floors_median_curve(df: DataFrame, target: str, floors: str, min_n: int = 10) -> DataFrame:
    """Winsorised (1-99 %) count, median, mean per rounded floor count (0..20),
    floors with fewer than ``min_n`` rows dropped."""
    d = df.select(F.bround(to_double(floors), 0).cast("int").alias("floors"), to_double(target).alias("_y")).where(
        F.col("floors").between(0, 20) & (F.col("_y") > 0))
    d = winsorize(d, "_y")
    s = summary.summarize(d, "_y", ["floors"], ("count", "mean"), {"median": 0.5})
    return s.where(F.col("count") >= min_n).select("floors", F.col("count").cast("bigint").alias("n"), "median", "mean")


def score_bin_boxes(df: DataFrame, target: str, score: str, k: int = 5) -> DataFrame:
    """Score in k equal-width bins; amount quartiles per bin."""
    d = cut_equal_width(df, score, k, "score_bin").where(F.col("score_bin").isNotNull())
    d = d.select("score_bin", to_double(target).alias("_y"))
    return summary.summarize(d, "_y", ["score_bin"], ("count",), {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumn(
        "count", F.col("count").cast("bigint"))


#: mesh cells a bandwidth, and bandwidths after which a kernel counts as 0
MESH = 64
REACH = 8


def density_grid(df: DataFrame, col: str, points: int = 200) -> DataFrame:
    """Gaussian KDE on ``points`` grid values (Scott bandwidth n^(-1/5) std).

    Every value is shared out to the two ends of its cell of a mesh of
    bandwidth / MESH, in proportion to its distance; only cells that hold values
    exist, and they are counted before the shuffle. The kernel sum takes the
    mesh points within REACH bandwidths of a grid value. The error against the
    sum over all values is below 1e-4 of the largest density, whatever their number:
    1 / (8 MESH^2) of a kernel's height by the cells, exp(-REACH^2 / 2) by the
    cut."""
    x = to_double(col)
    n, sd, mn, mx = df.agg(F.count(x), F.stddev_samp(x), F.min(x), F.max(x)).first()
    if not n or sd is None or mx == mn:
        return df.sparkSession.createDataFrame([], "x double, density double")
    h = sd * n ** (-1 / 5)
    step, gap = h / MESH, (mx - mn) / (points - 1)
    at = (x - F.lit(mn)) / F.lit(step)
    cell = F.floor(at)
    # one row a cell first, then its two ends
    cells = df.where(x.isNotNull()).select(cell.alias("c"), (at - cell).alias("f")).groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("f"))
    ends = F.array(F.struct(F.col("c").alias("c"), (F.col("n") - F.col("f")).alias("w")), F.struct((F.col("c") + 1).alias("c"), F.col("f").alias("w")))
    mesh = cells.select(F.explode(ends).alias("e")).groupBy(F.col("e.c").alias("c")).agg(F.sum("e.w").alias("w"))
    place = F.col("c") * step  # from the smallest value
    first = F.greatest(F.lit(0), F.ceil((place - REACH * h) / gap))
    last = F.least(F.lit(points - 1), F.floor((place + REACH * h) / gap))
    near = mesh.where(first <= last).select("w", place.alias("p"), F.explode(F.sequence(first, last)).alias("i"))
    z = (F.col("i") * gap - F.col("p")) / h
    k = F.col("w") * F.exp(-0.5 * z * z) / (n * h * math.sqrt(2 * math.pi))
    sums = near.groupBy("i").agg(F.sum(k).alias("density"))
    grid = df.sparkSession.range(points).select(F.col("id").alias("i"))
    return grid.join(F.broadcast(sums), "i", "left").select((F.lit(mn) + F.col("i") * gap).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))
