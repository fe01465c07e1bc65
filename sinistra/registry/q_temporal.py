"""Temporal and spatial keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal
from . import register
from .common import C, TARGET
from ..operators.groupdist import distribution_by_group
from .q_aggregates import rnd

_SEASON = """CASE WHEN month(date_sinistre) IN (12, 1, 2) THEN 'Hiver' WHEN month(date_sinistre) IN (3, 4, 5) THEN 'Printemps'
 WHEN month(date_sinistre) IN (6, 7, 8) THEN 'Été' ELSE 'Automne' END"""


@register("temporal_breakdowns", f"""
WITH d AS (SELECT montant_charge_brut AS y, CAST(year(date_sinistre) AS VARCHAR) AS year, {_SEASON} AS season,
                  CAST(month(date_sinistre) AS VARCHAR) AS month FROM claims WHERE montant_charge_brut IS NOT NULL AND date_sinistre IS NOT NULL),
l AS (SELECT 'year' AS period_kind, year AS period, y FROM d UNION ALL SELECT 'season', season, y FROM d UNION ALL SELECT 'month', month, y FROM d)
SELECT period_kind, period, CAST(count(*) AS BIGINT) AS count, round(avg(y), 4) AS mean, round(quantile_cont(y, 0.5), 4) AS median,
       round(stddev_samp(y), 4) AS std, round(CASE WHEN period_kind = 'year' THEN sum(y) END, 4) AS sum
FROM l GROUP BY period_kind, period""")
def q_temporal_breakdowns(spark, sf):
    return rnd(temporal.temporal_breakdowns(C(spark, sf), TARGET, "date_sinistre", digits=None))


def _comp_sql(c):
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS date_column, '{k}' AS component, {v} AS value, round(avg(montant_charge_brut), 4) AS mean, "
        f"CAST(count(montant_charge_brut) AS BIGINT) AS count FROM claims WHERE {c} IS NOT NULL GROUP BY 3"
        for k, v in (("year", f"CAST(year({c}) AS VARCHAR)"), ("month", f"CAST(month({c}) AS VARCHAR)"),
                     ("quarter", f"CAST(quarter({c}) AS VARCHAR)"), ("weekday", f"dayname({c})")))


@register("temporal_components", _comp_sql("date_sinistre") + "\nUNION ALL\n" + _comp_sql("date_cloture_sinistre"))
def q_temporal_components(spark, sf):
    return rnd(temporal.temporal_components(C(spark, sf), TARGET, ["date_sinistre", "date_cloture_sinistre"]))


@register("seasonality", """
WITH m AS (SELECT month(date_sinistre) AS m, avg(montant_charge_brut) AS mean FROM claims
           WHERE montant_charge_brut IS NOT NULL AND date_sinistre IS NOT NULL GROUP BY 1)
SELECT (SELECT string_agg(CAST(m AS VARCHAR), ',' ORDER BY mean DESC, m) FROM (SELECT * FROM m ORDER BY mean DESC, m LIMIT 3)) AS peak_months,
       (SELECT string_agg(CAST(m AS VARCHAR), ',' ORDER BY mean, m) FROM (SELECT * FROM m ORDER BY mean, m LIMIT 3)) AS low_months,
       round((max(mean) - min(mean)) / avg(mean), 6) AS seasonal_amplitude,
       round(avg(mean) FILTER (WHERE m IN (6, 7, 8)) / avg(mean) FILTER (WHERE m IN (12, 1, 2)), 6) AS summer_vs_winter FROM m""")
def q_seasonality(spark, sf):
    return rnd(temporal.seasonality(C(spark, sf), TARGET, "date_sinistre"), 6)


@register("monthly_series", f"""
WITH d AS (SELECT date_trunc('month', date_sinistre) AS month, montant_charge_brut AS y FROM claims WHERE date_sinistre IS NOT NULL),
g AS (SELECT month, count(*) AS n, sum(y) AS v FROM d GROUP BY month),
sp AS (SELECT unnest(generate_series((SELECT min(month) FROM d), (SELECT max(month) FROM d), INTERVAL 1 MONTH)) AS month)
SELECT sp.month, strftime(sp.month, '%Y-%m') AS ym, strftime(sp.month, '%m%Y') AS mmaaaa, CAST(coalesce(n, 0) AS BIGINT) AS count,
       round(CASE WHEN coalesce(n, 0) >= 3 THEN coalesce(v, 0) END, 4) AS montant_charge_brut_sum
FROM sp LEFT JOIN g USING (month)""")
def q_monthly_series(spark, sf):
    return rnd(temporal.monthly_series(C(spark, sf), TARGET, "date_sinistre", "sum", min_count=3))


@register("monthly_series_positive", f"""
SELECT date_trunc('month', date_sinistre) AS month, strftime(date_trunc('month', date_sinistre), '%m%Y') AS mmaaaa,
       CAST(count(*) AS BIGINT) AS count, round(quantile_cont(montant_charge_brut, 0.5), 4) AS median
FROM claims WHERE date_sinistre IS NOT NULL AND montant_charge_brut > 0 GROUP BY 1 HAVING count(*) >= 2""")
def q_monthly_positive(spark, sf):
    return rnd(temporal.monthly_series_positive(C(spark, sf), TARGET, "date_sinistre", "median", min_count=2))


@register("monthly_series_filled", f"""
WITH d AS (SELECT date_trunc('month', date_sinistre) AS month, montant_charge_brut AS y FROM claims WHERE date_sinistre IS NOT NULL),
g AS (SELECT month, count(*) AS n, sum(y) AS v FROM d GROUP BY month),
sp AS (SELECT unnest(generate_series((SELECT min(month) FROM d), (SELECT max(month) FROM d), INTERVAL 1 MONTH)) AS month)
SELECT sp.month, strftime(sp.month, '%Y-%m') AS ym, strftime(sp.month, '%m%Y') AS mmaaaa, CAST(coalesce(n, 0) AS BIGINT) AS count,
       round(coalesce(v, 0), 4) AS montant_charge_brut_sum FROM sp LEFT JOIN g USING (month)""")
def q_monthly_filled(spark, sf):
    return rnd(temporal.monthly_series(C(spark, sf), TARGET, "date_sinistre", "sum", min_count=0))


@register("monthly_mean_count_sum", """
SELECT strftime(date_sinistre, '%Y-%m') AS period, round(avg(montant_charge_brut), 4) AS mean, CAST(count(*) AS BIGINT) AS count,
       round(sum(montant_charge_brut), 4) AS sum, 'year_month' AS grain
FROM claims WHERE montant_charge_brut IS NOT NULL AND date_sinistre IS NOT NULL GROUP BY 1
UNION ALL
SELECT CAST(month(date_sinistre) AS VARCHAR), round(avg(montant_charge_brut), 4), CAST(count(*) AS BIGINT), NULL, 'calendar_month'
FROM claims WHERE montant_charge_brut IS NOT NULL AND date_sinistre IS NOT NULL GROUP BY 1""")
def q_monthly_mcs(spark, sf):
    return rnd(temporal.monthly_mean_count_sum(C(spark, sf), TARGET, "date_sinistre"))


@register("weekday_profile", """
WITH w(weekday, ord) AS (VALUES ('Monday', 0), ('Tuesday', 1), ('Wednesday', 2), ('Thursday', 3), ('Friday', 4), ('Saturday', 5), ('Sunday', 6)),
g AS (SELECT dayname(date_sinistre) AS weekday, avg(montant_charge_brut) AS mean FROM claims
      WHERE montant_charge_brut IS NOT NULL AND date_sinistre IS NOT NULL GROUP BY 1)
SELECT CAST(w.ord AS INTEGER) AS ord, w.weekday, round(g.mean, 4) AS mean FROM w LEFT JOIN g USING (weekday)""")
def q_weekday(spark, sf):
    return rnd(temporal.weekday_profile(C(spark, sf), TARGET, "date_sinistre"))


@register("monthly_distribution", """
WITH d0 AS (SELECT strftime(date_sinistre, '%m%Y') AS g, montant_charge_brut AS x FROM claims
            WHERE date_sinistre IS NOT NULL AND montant_charge_brut > 0),
f AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM d0),
d AS (SELECT g, least(greatest(x, lo), hi) AS x FROM d0, f)
SELECT g AS "group", CAST(count(*) AS BIGINT) AS n, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median,
       round(stddev_samp(x), 4) AS std, round(skewness(x), 4) AS skewness, round(kurtosis(x), 4) AS kurtosis,
       round(quantile_cont(x, 0.05), 4) AS p05, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.9), 4) AS p90,
       round(quantile_cont(x, 0.95), 4) AS p95, round(quantile_cont(x, 0.99), 4) AS p99,
       kurtosis(x) > 3 AS heavy_tails, skewness(x) > 1 AS right_skewed,
       round((quantile_cont(x, 0.9) - quantile_cont(x, 0.1)) / quantile_cont(x, 0.5), 4) AS concentration_ratio
FROM d GROUP BY g HAVING count(*) >= 10""")
def q_monthly_distribution(spark, sf):
    d = C(spark, sf).withColumn("mmaaaa", F.date_format("date_sinistre", "MMyyyy"))
    return rnd(distribution_by_group(d, TARGET, "mmaaaa", min_count=10))


@register("fiscal_month_profile", """
WITH d0 AS (SELECT month(date_sinistre) AS m, montant_charge_brut AS y FROM claims
            WHERE date_sinistre IS NOT NULL AND montant_charge_brut > 0),
f AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM d0),
d AS (SELECT m, least(greatest(y, lo), hi) AS y FROM d0, f)
SELECT CAST(m AS INTEGER) AS month, CAST((CAST(m AS INTEGER) - 4 + 12) % 12 AS INTEGER) AS fiscal_order, CAST(count(*) AS BIGINT) AS count,
       round(quantile_cont(y, 0.5), 4) AS median, round(avg(y), 4) AS mean, round(sum(y), 4) AS sum
FROM d GROUP BY m HAVING count(*) >= 12""")
def q_fiscal(spark, sf):
    # fiscal year from April
    return rnd(temporal.fiscal_month_profile(C(spark, sf), TARGET, F.month("date_sinistre"), 12, 4))


@register("spatial_departments", """
WITH d AS (SELECT substr(trim(cpostal), 1, 2) AS departement, montant_charge_brut AS y FROM claims
           WHERE cpostal IS NOT NULL AND montant_charge_brut IS NOT NULL),
s AS (SELECT departement, count(*) AS count, avg(y) AS mean, quantile_cont(y, 0.5) AS median, stddev_samp(y) AS std, sum(y) AS sum
      FROM d GROUP BY 1 HAVING count(*) >= 10),
r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, departement) AS rank_mean,
             row_number() OVER (ORDER BY count DESC, departement) AS rank_volume FROM s)
SELECT departement, CAST(count AS BIGINT) AS count, round(mean, 4) AS mean, round(median, 4) AS median,
       round(std, 4) AS std, round(sum, 4) AS sum, CAST(rank_mean AS INTEGER) AS rank_mean,
       CAST(rank_volume AS INTEGER) AS rank_volume,
       round((SELECT sum(count) FROM r WHERE rank_volume <= 5) * 100.0 / (SELECT sum(count) FROM r), 4) AS top5_volume_pct FROM r""")
def q_spatial_departments(spark, sf):
    return rnd(temporal.spatial_departments(C(spark, sf), TARGET, digits=None))


@register("spatial_cities", """
SELECT ville, CAST(count(montant_charge_brut) AS BIGINT) AS count, round(avg(montant_charge_brut), 4) AS mean,
       round(quantile_cont(montant_charge_brut, 0.5), 4) AS median
FROM claims WHERE ville IS NOT NULL GROUP BY ville HAVING count(montant_charge_brut) >= 5""")
def q_spatial_cities(spark, sf):
    return rnd(temporal.spatial_cities(C(spark, sf), TARGET, digits=None))


_LAT = "CAST(42 + CAST(substr(cpostal, 1, 2) AS INTEGER) * 0.3 AS DOUBLE)"
_LON = "CAST(-4 + CAST(substr(cpostal, 3, 3) AS INTEGER) / 100.0 AS DOUBLE)"


@register("spatial_coordinates", f"""
WITH d AS (SELECT {_LAT} AS lat, {_LON} AS lon, montant_charge_brut AS y FROM claims WHERE montant_charge_brut IS NOT NULL)
SELECT round(avg(lat), 6) AS centroid_lat, round(avg(lon), 6) AS centroid_lon, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max,
       round(min(lon), 6) AS lon_min, round(max(lon), 6) AS lon_max, round(corr(lat, y), 6) AS lat_corr, round(corr(lon, y), 6) AS lon_corr FROM d""")
def q_spatial_coords(spark, sf):
    d = C(spark, sf).withColumn("latitude", 42 + F.substring("cpostal", 1, 2).cast("int") * 0.3).withColumn(
        "longitude", -4 + F.substring("cpostal", 3, 3).cast("int") / 100.0)
    return rnd(temporal.spatial_coordinates(d, TARGET, "latitude", "longitude"), 6)
