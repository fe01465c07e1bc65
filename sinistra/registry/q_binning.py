"""Binning and outlier keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import binning
from . import register
from .common import C, TARGET
from .q_aggregates import NUM, rnd

AGE_EDGES = [0, 20, 40, 60, float("inf")]
# Age and surface class labels.
AGE_LABELS = ["RÉCENT", "MODERNE", "ANCIEN", "TRÈS ANCIEN"]
SURFACE_LABELS = ["PETITE", "MOYENNE", "GRANDE", "TRÈS GRANDE"]
REF_YEAR = 2025


def _age(df):
    return df.withColumn("age_batiment", F.lit(float(REF_YEAR)) - F.col("annee_construction_batiment").cast("double"))


@register("cut_fixed_edges", f"""
WITH d AS (SELECT cod_sin, {REF_YEAR}.0 - annee_construction_batiment AS a, surface_police AS s FROM claims)
SELECT cod_sin,
  CASE WHEN a IS NULL THEN NULL WHEN a >= 0 AND a <= 20 THEN 'RÉCENT' WHEN a > 20 AND a <= 40 THEN 'MODERNE'
       WHEN a > 40 AND a <= 60 THEN 'ANCIEN' WHEN a > 60 THEN 'TRÈS ANCIEN' END AS classe_age,
  CASE WHEN a IS NULL THEN NULL WHEN a > 0 AND a <= 20 THEN '0-20' WHEN a > 20 AND a <= 40 THEN '20-40'
       WHEN a > 40 AND a <= 60 THEN '40-60' WHEN a > 60 AND a <= 100 THEN '60-100' WHEN a > 100 THEN '100+' END AS age_bin,
  CASE WHEN s IS NULL THEN NULL WHEN s >= 0 AND s <= 80 THEN 'PETITE' WHEN s > 80 AND s <= 120 THEN 'MOYENNE'
       WHEN s > 120 AND s <= 180 THEN 'GRANDE' WHEN s > 180 THEN 'TRÈS GRANDE' END AS classe_surface
FROM d""")
def q_cut_fixed(spark, sf):
    d = _age(C(spark, sf))
    a = F.col("age_batiment")
    return d.select(
        "cod_sin",
        binning.cut_expr(a, AGE_EDGES, AGE_LABELS, include_lowest=True).alias("classe_age"),
        binning.cut_expr(a, [0, 20, 40, 60, 100, float("inf")], ["0-20", "20-40", "40-60", "60-100", "100+"]).alias("age_bin"),
        binning.cut_expr(F.col("surface_police"), [0, 80, 120, 180, float("inf")], SURFACE_LABELS,
                         include_lowest=True).alias("classe_surface"),
    )


@register("cut_equal_width", """
WITH m AS (SELECT min(weather_temp_mean) AS mn, max(weather_temp_mean) AS mx FROM claims)
SELECT cod_sin, CASE WHEN weather_temp_mean IS NULL THEN NULL
  ELSE CAST(least(5, greatest(1, ceil((weather_temp_mean - mn) / ((mx - mn) / 5)))) AS INTEGER) END AS temp_bin
FROM claims, m""")
def q_cut_equal_width(spark, sf):
    return binning.cut_equal_width(C(spark, sf), "weather_temp_mean", 5, "temp_bin").select("cod_sin", "temp_bin")


@register("qcut_quartiles", """
WITH q AS (SELECT quantile_cont(prime, 0) AS e0, quantile_cont(prime, 0.25) AS e1, quantile_cont(prime, 0.5) AS e2,
                  quantile_cont(prime, 0.75) AS e3, quantile_cont(prime, 1) AS e4 FROM claims)
SELECT cod_sin, CASE WHEN prime IS NULL THEN NULL WHEN prime >= e0 AND prime <= e1 THEN 'Q1' WHEN prime > e1 AND prime <= e2 THEN 'Q2'
  WHEN prime > e2 AND prime <= e3 THEN 'Q3' WHEN prime > e3 AND prime <= e4 THEN 'Q4' END AS prime_q
FROM claims, q""")
def q_qcut(spark, sf):
    return binning.qcut_quartiles(C(spark, sf), "prime", 4, out="prime_q").select("cod_sin", "prime_q")


@register("winsorize", """
WITH q AS (SELECT quantile_cont(montant_charge_brut, 0.01) AS lo, quantile_cont(montant_charge_brut, 0.99) AS hi FROM claims)
SELECT cod_sin, round(CASE WHEN montant_charge_brut IS NULL THEN NULL ELSE least(greatest(montant_charge_brut, lo), hi) END, 4)
  AS montant_charge_brut FROM claims, q""")
def q_winsorize(spark, sf):
    return rnd(binning.winsorize(C(spark, sf).select("cod_sin", TARGET), TARGET))


_CLIP = NUM


def _clip_sql():
    qs = ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in _CLIP)
    cols = ", ".join(f"round(CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, {c}_lo), {c}_hi) END, 4) AS {c}" for c in _CLIP)
    return f"WITH q AS (SELECT {qs} FROM claims) SELECT cod_sin, {cols} FROM claims, q"


@register("clip_outliers", _clip_sql())
def q_clip(spark, sf):
    return rnd(binning.clip_outliers(C(spark, sf).select("cod_sin", *_CLIP), _CLIP))


_IMP = ["engagements", "surface_police", "weather_precip_mean", "weather_temp_mean", "date_cloture_sinistre"]


@register("impute_numeric", """
WITH q AS (SELECT quantile_cont(engagements, 0.5) AS e, quantile_cont(surface_police, 0.5) AS s,
                  quantile_cont(weather_precip_mean, 0.5) AS p, avg(weather_temp_mean) AS t FROM claims)
SELECT cod_sin, round(coalesce(engagements, e), 4) AS engagements, round(coalesce(surface_police, s), 4) AS surface_police,
       round(coalesce(weather_precip_mean, p), 4) AS weather_precip_mean, round(coalesce(weather_temp_mean, t), 4) AS weather_temp_mean
FROM claims, q""")
def q_impute(spark, sf):
    d = C(spark, sf).select("cod_sin", "engagements", "surface_police", "weather_precip_mean", "weather_temp_mean")
    d = binning.impute_numeric(d, ["engagements", "surface_police", "weather_precip_mean"], "median")
    return rnd(binning.impute_numeric(d, ["weather_temp_mean"], "mean"))


@register("cleaning_audit", "\nUNION ALL\n".join(f"""SELECT '{c}' AS variable,
 CAST(count(*) FILTER (WHERE {c} < lo) AS BIGINT) AS below, CAST(count(*) FILTER (WHERE {c} > hi) AS BIGINT) AS above,
 CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS nulls, round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound
 FROM claims, (SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi FROM claims)""" for c in _CLIP))
def q_cleaning_audit(spark, sf):
    return rnd(binning.cleaning_audit(C(spark, sf), _CLIP))


@register("outliers_iqr", """
WITH q AS (SELECT quantile_cont(montant_charge_brut, 0.25) AS q1, quantile_cont(montant_charge_brut, 0.5) AS med,
                  quantile_cont(montant_charge_brut, 0.75) AS q3 FROM claims),
d AS (SELECT montant_charge_brut AS x, q1, q3, med, q3 - q1 AS iqr FROM claims, q WHERE montant_charge_brut IS NOT NULL)
SELECT round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, round(any_value(iqr), 4) AS iqr,
       round(any_value(q1 - 1.5 * iqr), 4) AS lower, round(any_value(q3 + 1.5 * iqr), 4) AS upper,
       CAST(count(*) FILTER (WHERE x < q1 - 1.5 * iqr OR x > q3 + 1.5 * iqr) AS BIGINT) AS outlier_count,
       round(count(*) FILTER (WHERE x < q1 - 1.5 * iqr OR x > q3 + 1.5 * iqr) / count(*), 4) AS outlier_rate,
       CAST(count(*) AS BIGINT) AS n, round(avg(x), 4) AS mean, round(any_value(med), 4) AS median,
       round(stddev_samp(x), 4) AS std, CAST(NULL AS VARCHAR) AS warning FROM d""")
def q_outliers_iqr(spark, sf):
    return rnd(binning.outliers_iqr(C(spark, sf), TARGET))


@register("outliers_multi", """
WITH d AS (SELECT montant_charge_brut AS x FROM claims WHERE montant_charge_brut IS NOT NULL),
q AS (SELECT quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3,
             quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.99) AS p99, avg(x) AS mean, stddev_pop(x) AS sd0, count(*) AS n FROM d),
m AS (SELECT quantile_cont(abs(x - med), 0.5) AS mad FROM d, q),
a AS (SELECT any_value(n) AS n, any_value(q1) AS q1, any_value(q3) AS q3, any_value(mad) AS mad, any_value(med) AS med,
             count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS iqr_count,
             count(*) FILTER (WHERE x > p95) AS above_p95, count(*) FILTER (WHERE x < p5) AS below_p5,
             count(*) FILTER (WHERE abs(0.6745 * (x - med) / mad) > 3.5) AS mad_count,
             count(*) FILTER (WHERE abs((x - mean) / sd0) > 3) AS z_count,
             avg(x) FILTER (WHERE x > p99) AS exceptional_mean, count(*) FILTER (WHERE x > p99) AS exceptional_count
      FROM d, q, m)
SELECT CAST(n AS BIGINT) AS n, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, CAST(iqr_count AS BIGINT) AS iqr_count,
       round(iqr_count * 100.0 / n, 4) AS iqr_rate_pct, CAST(above_p95 AS BIGINT) AS above_p95, CAST(below_p5 AS BIGINT) AS below_p5,
       round(mad, 4) AS mad, CAST(mad_count AS BIGINT) AS mad_count, CAST(z_count AS BIGINT) AS z_count,
       CAST(exceptional_count AS BIGINT) AS exceptional_count, round(exceptional_mean, 4) AS exceptional_mean,
       round(exceptional_mean / med, 4) AS exceptional_ratio,
       CASE WHEN iqr_count * 100.0 / n < 2 THEN 'low' WHEN iqr_count * 100.0 / n < 10 THEN 'medium' ELSE 'high' END AS severity,
       iqr_count * 100.0 / n > 5 AS action_needed FROM a""")
def q_outliers_multi(spark, sf):
    return rnd(binning.outliers_multi(C(spark, sf), TARGET))
