"""Scalar function keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions.casting import to_double
from . import register
from .common import C, TARGET
from .q_aggregates import rnd

REF_YEAR = 2025


@register("fn_building_age", f"""
SELECT cod_sin, CASE WHEN annee_construction_batiment IS NULL THEN NULL
  ELSE CAST(greatest({REF_YEAR}.0 - annee_construction_batiment, 0.0) AS DOUBLE) END AS age_batiment FROM claims""")
def q_building_age(spark, sf):
    return C(spark, sf).select("cod_sin", dates.building_age("annee_construction_batiment", REF_YEAR).alias("age_batiment"))


@register("fn_closing_delay", """
SELECT cod_sin, CAST(floor((epoch_us(date_cloture_sinistre) - epoch_us(date_sinistre)) / 86400e6) AS INTEGER) AS delai_cloture_jours
FROM claims""")
def q_closing_delay(spark, sf):
    return C(spark, sf).select("cod_sin", dates.closing_delay_days("date_sinistre", "date_cloture_sinistre").alias("delai_cloture_jours"))


@register("fn_year_season", """
SELECT cod_sin, CAST(year(date_sinistre) AS INTEGER) AS annee_sinistre,
  CASE WHEN month(date_sinistre) IN (3, 4, 5) THEN 'PRINTEMPS' WHEN month(date_sinistre) IN (6, 7, 8) THEN 'ETE'
       WHEN month(date_sinistre) IN (9, 10, 11) THEN 'AUTOMNE' WHEN month(date_sinistre) IN (12, 1, 2) THEN 'HIVER' END AS saison_sinistre,
  CASE WHEN month(date_sinistre) IN (3, 4, 5) THEN 'Printemps' WHEN month(date_sinistre) IN (6, 7, 8) THEN 'Été'
       WHEN month(date_sinistre) IN (9, 10, 11) THEN 'Automne' WHEN month(date_sinistre) IN (12, 1, 2) THEN 'Hiver' END AS season
FROM claims""")
def q_year_season(spark, sf):
    d = C(spark, sf)
    return d.select("cod_sin", F.year("date_sinistre").alias("annee_sinistre"),
                    dates.season("date_sinistre").alias("saison_sinistre"),
                    dates.season("date_sinistre", dates.SEASON_LABELS).alias("season"))


@register("fn_calendar_parts", """
SELECT cod_sin, CAST(month(date_sinistre) AS INTEGER) AS month, CAST(quarter(date_sinistre) AS INTEGER) AS quarter,
  CAST(dayofyear(date_sinistre) AS INTEGER) AS day_of_year, dayname(date_sinistre) AS weekday,
  CAST(floor(annee_construction_batiment / 10) * 10 AS INTEGER) AS decade FROM claims""")
def q_calendar_parts(spark, sf):
    d = C(spark, sf)
    return d.select("cod_sin", F.month("date_sinistre").alias("month"), F.quarter("date_sinistre").alias("quarter"),
                    F.dayofyear("date_sinistre").alias("day_of_year"), F.date_format("date_sinistre", "EEEE").alias("weekday"),
                    dates.decade("annee_construction_batiment").alias("decade"))


@register("fn_department", """
SELECT cod_sin, substr(CASE WHEN length(trim(cpostal)) < 5 THEN lpad(trim(cpostal), 5, '0') ELSE trim(cpostal) END, 1, 2) AS region_code,
  substr(trim(CAST(CAST(annee_construction_batiment AS BIGINT) AS VARCHAR)), 1, 2) AS raw_prefix FROM claims""")
def q_department(spark, sf):
    d = C(spark, sf)
    return d.select("cod_sin", dates.department("cpostal").alias("region_code"),
                    dates.department(F.col("annee_construction_batiment").cast("string"), pad=False).alias("raw_prefix"))


@register("fn_month_label", """
SELECT cod_sin, strftime(date_sinistre, '%m%Y') AS mois_mmaaaa, strftime(date_sinistre, '%Y-%m') AS year_month FROM claims""")
def q_month_label(spark, sf):
    d = C(spark, sf)
    return d.select("cod_sin", dates.month_label("date_sinistre").alias("mois_mmaaaa"),
                    dates.month_label("date_sinistre", "yyyy-MM").alias("year_month"))


@register("fn_month_from_parts", """
SELECT cod_sin, CASE WHEN nb_pieces_police BETWEEN 1 AND 12 THEN CAST(make_date(CAST(year(date_sinistre) AS INTEGER), CAST(nb_pieces_police AS INTEGER), 1) AS TIMESTAMP) END AS month_start
FROM claims""")
def q_month_from_parts(spark, sf):
    d = C(spark, sf)
    return d.select("cod_sin", dates.month_from_parts(F.year("date_sinistre"), "nb_pieces_police").cast("timestamp_ntz").alias("month_start"))


@register("fn_log_transforms", """
SELECT cod_sin, round(ln(montant_charge_brut), 6) AS log_amount, round(ln(1 + montant_charge_brut), 6) AS log1p_amount,
  round(sqrt(montant_charge_brut), 6) AS sqrt_amount,
  round(ln(1 + prime - (SELECT least(min(prime), 0) FROM claims)), 6) AS log1p_prime_shifted FROM claims""")
def q_log_transforms(spark, sf):
    d = C(spark, sf)
    mn = d.agg(F.least(F.min("prime"), F.lit(0.0)).alias("_mn"))
    j = d.crossJoin(F.broadcast(mn))
    return rnd(j.select("cod_sin", F.ln(TARGET).alias("log_amount"), F.log1p(TARGET).alias("log1p_amount"),
                        F.sqrt(TARGET).alias("sqrt_amount"), F.log1p(F.col("prime") - F.col("_mn")).alias("log1p_prime_shifted")), 6)


@register("fn_loss_ratio", """
WITH d AS (SELECT CASE WHEN prime <> 0 THEN montant_charge_brut / prime END AS lr FROM claims)
SELECT CAST(count(lr) AS BIGINT) AS count, round(avg(lr), 4) AS mean, round(stddev_samp(lr), 4) AS std,
       round(min(lr), 4) AS min, round(max(lr), 4) AS max FROM d""")
def q_loss_ratio(spark, sf):
    d = C(spark, sf).select(F.try_divide(to_double(TARGET), F.when(F.col("prime") != 0, F.col("prime"))).alias("lr"))
    return rnd(d.agg(F.count("lr").cast("bigint").alias("count"), F.avg("lr").alias("mean"), F.stddev_samp("lr").alias("std"),
                     F.min("lr").alias("min"), F.max("lr").alias("max")))


@register("fn_format_number", """
SELECT cod_sin, CASE WHEN engagements IS NULL THEN 'N/A' ELSE format('{:,.0f}', round(engagements, 0)) || ' €' END AS engagements_txt
FROM claims""")
def q_format_number(spark, sf):
    d = C(spark, sf)
    return d.select("cod_sin", dates.format_number(F.round("engagements", 0), "currency").alias("engagements_txt"))


@register("fn_round", """
SELECT cod_sin, round(surface_batiment, 1) AS surface_1, round(weather_precip_mean, 2) AS precip_2 FROM claims""")
def q_round(spark, sf):
    d = C(spark, sf)
    return d.select("cod_sin", F.round("surface_batiment", 1).alias("surface_1"), F.round("weather_precip_mean", 2).alias("precip_2"))
