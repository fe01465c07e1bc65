"""Time and place breakdowns: calendar groupings, monthly series on a
complete month spine, seasonality, fiscal order, departments and cities.

Every grouping is a plain ``groupBy`` (partial aggregation map-side); the
spines are generated from a one-row min/max aggregate, so a month with no
claim still appears without any scan of its own."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.casting import to_double
from ..functions.dates import SEASON_LABELS, WEEKDAYS, department, month_start
from . import selection, summary
from .binning import winsorize
from .lookup import month_spine


def clean_dates(df: DataFrame, target: str, date: str, positive: bool = False) -> DataFrame:
    d = df.select(to_double(target).alias("_y"), F.col(date).cast("timestamp_ntz").alias("_d")).where(
        F.col("_y").isNotNull() & F.col("_d").isNotNull())
    return d.where(F.col("_y") > 0) if positive else d


def _r(c, digits):
    return F.round(c, digits) if digits is not None else F.col(c)


def month_cells(d: DataFrame) -> list[Cell]:
    """Count, mean and sum of squared differences of ``_y`` by year and month of
    ``_d``: one aggregate, one row a calendar month."""
    one = d.groupBy(F.year("_d").alias("year"), F.month("_d").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), (F.var_pop("_y") * F.count(F.lit(1))).alias("m2"))
    return [Cell(r["year"], r["month"], r["n"], r["mean"], r["m2"]) for r in one.collect()]


@dataclass(frozen=True)
class Cell:
    year: int | None
    month: int | None
    n: int
    mean: float
    m2: float

    def merged(self, o: Cell) -> Cell:
        """Moments of both together; no row is read again."""
        n, d = self.n + o.n, o.mean - self.mean
        return Cell(None, None, n, self.mean + d * o.n / n, self.m2 + o.m2 + d * d * self.n * o.n / n)

    @property
    def std(self) -> float | None:
        return math.sqrt(self.m2 / (self.n - 1)) if self.n > 1 else None


def merge_cells(cells: Sequence[Cell], key) -> dict[str, Cell]:
    out: dict[str, Cell] = {}
    for c in sorted(cells, key=lambda c: (c.year, c.month)):
        k = key(c)
        out[k] = out[k].merged(c) if k in out else c
    return out


def season_of(month: int) -> str:
    return next(lab for lab, ms in SEASON_LABELS.items() if month in ms)


#: periods whose medians one selection looks for
_TOGETHER = 64


def temporal_breakdowns(df: DataFrame, target: str, date: str, digits: int | None = 2) -> DataFrame:
    """count, mean, median, std (and sum for years) of the target by year,
    season and month, in one long table (level kind, level, stats).

    Moments of the (year, month) cells are merged upwards; the medians of all
    periods come from one bracket selection, in which a period is a column that
    is null outside it. No row is copied."""
    d = clean_dates(df, target, date)
    cells = month_cells(d)
    kinds = {"year": lambda c: str(c.year), "season": lambda c: season_of(c.month), "month": lambda c: str(c.month)}
    found = [(kind, period, c) for kind, key in kinds.items() for period, c in merge_cells(cells, key).items()]
    month = F.month("_d")

    def inside(kind: str, period: str):
        if kind == "season":
            return month.isin(list(SEASON_LABELS[period]))
        return (F.year("_d") if kind == "year" else month) == int(period)

    medians = {}
    for lo in range(0, len(found), _TOGETHER):
        part = found[lo:lo + _TOGETHER]
        wide = d.select(*[F.when(inside(kind, period), F.col("_y")).alias(f"p{i}") for i, (kind, period, _) in enumerate(part)])
        for i, s in enumerate(selection.select(wide, wide.columns, (), [selection.Quantile("median", 0.5)], moments=False)):
            medians[part[i][:2]] = s.quantile("median")
    rows = [(kind, period, c.n, c.mean, medians[kind, period], c.std, c.mean * c.n if kind == "year" else None) for kind, period, c in found]
    out = df.sparkSession.createDataFrame(rows, "period_kind string, period string, count bigint, mean double, median double, std double, sum double")
    return out.select("period_kind", "period", "count", *[_r(c, digits).alias(c) for c in ("mean", "median", "std", "sum")])


def temporal_components(df: DataFrame, target: str, dates: Sequence[str]) -> DataFrame:
    """Mean and count of the target by year, month, quarter and weekday of
    each date column: one aggregate a date column by (year, month, weekday),
    merged upwards."""
    y = to_double(target)
    out = None
    for c in dates:
        ts = F.col(c).cast("timestamp_ntz")
        cells = df.select(y.alias("_y"), F.year(ts).alias("year"), F.month(ts).alias("month"), F.date_format(ts, "EEEE").alias("weekday"))
        cells = cells.where(F.col("year").isNotNull()).groupBy("year", "month", "weekday").agg(F.sum("_y").alias("s"), F.count("_y").alias("n"))
        quarter = F.floor((F.col("month") + 2) / 3)
        parts = F.array(*[F.struct(F.lit(k).alias("component"), v.cast("string").alias("value"))
                          for k, v in (("year", F.col("year")), ("month", F.col("month")), ("quarter", quarter), ("weekday", F.col("weekday")))])
        long = cells.select("s", "n", F.explode(parts).alias("p")).select(F.lit(c).alias("date_column"), "p.*", "s", "n")
        out = long if out is None else out.unionByName(long)
    return out.groupBy("date_column", "component", "value").agg(
        F.try_divide(F.sum("s"), F.sum("n")).alias("mean"), F.sum("n").cast("bigint").alias("count"))


def seasonality(df: DataFrame, target: str, date: str) -> DataFrame:
    """From the (at most 12) monthly means: top and bottom 3 months, amplitude
    (max - min) / mean of means, summer (6-8) over winter (12-2) ratio over
    the months present."""
    d = clean_dates(df, target, date)
    mm = d.groupBy(F.month("_d").alias("m")).agg(F.avg("_y").alias("mean"))
    top = F.sort_array(F.collect_list(F.struct((-F.col("mean")).alias("k"), F.col("m"))))
    bot = F.sort_array(F.collect_list(F.struct(F.col("mean").alias("k"), F.col("m"))))
    summer = F.avg(F.when(F.col("m").isin(6, 7, 8), F.col("mean")))
    winter = F.avg(F.when(F.col("m").isin(12, 1, 2), F.col("mean")))
    one = mm.agg(top.alias("_t"), bot.alias("_b"), F.max("mean").alias("_mx"), F.min("mean").alias("_mn"),
                 F.avg("mean").alias("_av"), summer.alias("_s"), winter.alias("_w"))
    ids = lambda a: F.array_join(F.transform(F.slice(F.col(a), 1, 3), lambda s: s["m"].cast("string")), ",")
    return one.select(ids("_t").alias("peak_months"), ids("_b").alias("low_months"),
                      F.try_divide(F.col("_mx") - F.col("_mn"), F.col("_av")).alias("seasonal_amplitude"),
                      F.when(F.col("_w") > 0, F.try_divide(F.col("_s"), F.col("_w"))).alias("summer_vs_winter"))


def monthly_series(df: DataFrame, target: str, date: str, agg: str = "sum", min_count: int = 0,
                   positive: bool = False, fill: float | None = 0.0) -> DataFrame:
    """Value per calendar month between the first and last month: months
    without claims get ``fill``; months with fewer than ``min_count`` claims
    get null (so, with min_count > 0, empty months are null)."""
    d = clean_dates(df, target, date, positive).withColumn("month", month_start("_d"))
    if agg == "median":
        g = summary.summarize(d, "_y", ["month"], ("count",), {"value": 0.5})
    else:
        fn = {"sum": F.sum, "mean": F.avg}[agg]
        g = d.groupBy("month").agg(F.count(F.lit(1)).alias("count"), fn("_y").alias("value"))
    sp = month_spine(d, "month")
    j = sp.join(g, "month", "left")
    n = F.coalesce(F.col("count"), F.lit(0))
    v = F.coalesce(F.col("value"), F.lit(fill)) if fill is not None else F.col("value")
    if min_count > 0:
        v = F.when(n >= min_count, v)
    return j.select("month", F.date_format("month", "yyyy-MM").alias("ym"), F.date_format("month", "MMyyyy").alias("mmaaaa"),
                    n.cast("bigint").alias("count"), v.alias(f"{target}_{agg}"))


def monthly_series_positive(df: DataFrame, target: str, date: str, agg: str = "sum", min_count: int = 1) -> DataFrame:
    """Positive amounts only; months below ``min_count`` are dropped."""
    d = clean_dates(df, target, date, positive=True).withColumn("month", month_start("_d"))
    if agg == "median":
        g = summary.summarize(d, "_y", ["month"], ("count",), {agg: 0.5})
    else:
        g = d.groupBy("month").agg(F.count(F.lit(1)).alias("count"), {"sum": F.sum, "mean": F.avg}[agg]("_y").alias(agg))
    return g.where(F.col("count") >= min_count).select(
        "month", F.date_format("month", "MMyyyy").alias("mmaaaa"), F.col("count").cast("bigint").alias("count"), agg)


def monthly_mean_count_sum(df: DataFrame, target: str, date: str) -> DataFrame:
    """mean, count, sum per year-month and mean, count per calendar month, in
    one long table (grain, period, ...)."""
    d = clean_dates(df, target, date)
    ym = d.groupBy(F.date_format("_d", "yyyy-MM").alias("period")).agg(
        F.avg("_y").alias("mean"), F.count(F.lit(1)).cast("bigint").alias("count"), F.sum("_y").alias("sum"))
    cm = d.groupBy(F.month("_d").cast("string").alias("period")).agg(
        F.avg("_y").alias("mean"), F.count(F.lit(1)).cast("bigint").alias("count"))
    return ym.withColumn("grain", F.lit("year_month")).unionByName(
        cm.withColumn("grain", F.lit("calendar_month")).withColumn("sum", F.lit(None).cast("double")))


def weekday_profile(df: DataFrame, target: str, date: str) -> DataFrame:
    """Mean by weekday, Monday..Sunday, absent days kept with null."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(d, i) for i, d in enumerate(WEEKDAYS)], "weekday string, ord int")
    d = clean_dates(df, target, date)
    g = d.groupBy(F.date_format("_d", "EEEE").alias("weekday")).agg(F.avg("_y").alias("mean"))
    return F.broadcast(dim).join(g, "weekday", "left").select("ord", "weekday", "mean")


def fiscal_month_profile(df: DataFrame, target: str, month_col, min_count: int = 12, fiscal_start: int = 1,
                         winsor=(0.01, 0.99)) -> DataFrame:
    """Winsorised count / median / mean / sum per month 1..12 in fiscal order
    (``pmod(m - start, 12)``), months below ``min_count`` dropped."""
    m = to_double(month_col) if isinstance(month_col, str) else month_col
    d = df.select(m.alias("_m"), to_double(target).alias("_y")).where(
        F.col("_m").between(1, 12) & (F.col("_y") > 0))
    d = winsorize(d, "_y", *winsor)
    s = summary.summarize(d, "_y", ["_m"], ("count", "mean", "sum"), {"median": 0.5})
    return s.where(F.col("count") >= min_count).select(
        F.col("_m").cast("int").alias("month"), F.pmod(F.col("_m").cast("int") - fiscal_start, F.lit(12)).alias("fiscal_order"),
        F.col("count").cast("bigint").alias("count"), "median", "mean", "sum")


def spatial_departments(df: DataFrame, target: str, postal: str = "cpostal", min_n: int = 10, pad: bool = False,
                        digits: int | None = 2) -> DataFrame:
    """Per department (first two characters of the postal code): count,
    mean, median, std, sum for departments with at least ``min_n`` claims,
    with ranks by mean and by volume and the share of the top-5 volume."""
    d = df.select(department(postal, pad).alias("departement"), to_double(target).alias("_y")).where(
        F.col("departement").isNotNull() & F.col("_y").isNotNull())
    s = summary.summarize(d, "_y", ["departement"], ("count", "mean", "std", "sum"), {"median": 0.5})
    s = s.where(F.col("count") >= min_n)
    from pyspark.sql import Window
    # one row per department: the windows below run over that small table
    w_mean = Window.orderBy(F.desc("mean"), "departement")
    w_vol = Window.orderBy(F.desc("count"), "departement")
    s = s.withColumn("rank_mean", F.row_number().over(w_mean)).withColumn("rank_volume", F.row_number().over(w_vol))
    tot = s.agg(F.sum("count").alias("_tot"), F.sum(F.when(F.col("rank_volume") <= 5, F.col("count"))).alias("_top5"))
    return s.crossJoin(F.broadcast(tot)).select(
        "departement", F.col("count").cast("bigint").alias("count"), *[_r(c, digits).alias(c) for c in ("mean", "median", "std", "sum")],
        "rank_mean", "rank_volume", (F.col("_top5") * 100.0 / F.col("_tot")).alias("top5_volume_pct"))


def spatial_cities(df: DataFrame, target: str, city: str = "ville", min_n: int = 5, digits: int | None = 2) -> DataFrame:
    d = df.select(F.col(city).alias("ville"), to_double(target).alias("_y")).where(F.col("ville").isNotNull())
    s = summary.summarize(d, "_y", ["ville"], ("count", "mean"), {"median": 0.5}).where(F.col("count") >= min_n)
    return s.select("ville", F.col("count").cast("bigint").alias("count"), _r("mean", digits).alias("mean"),
                    _r("median", digits).alias("median"))


def spatial_coordinates(df: DataFrame, target: str, lat: str, lon: str) -> DataFrame:
    from ..functions.stats import pair_corr

    d = df.select(to_double(lat).alias("lat"), to_double(lon).alias("lon"), to_double(target).alias("_y")).where(
        F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("_y").isNotNull())
    return d.agg(F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"), F.min("lat").alias("lat_min"),
                 F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
                 pair_corr(F.col("lat"), F.col("_y")).alias("lat_corr"), pair_corr(F.col("lon"), F.col("_y")).alias("lon_corr"))
