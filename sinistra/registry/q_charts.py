"""Chart data keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts
from ..plans import drought as D
from . import register
from .common import C, TARGET
from .q_aggregates import rnd
from .q_domain import _BUILD_CTE


@register("histogram_bins", """
WITH m AS (SELECT min(montant_charge_brut) AS mn, max(montant_charge_brut) AS mx,
                  least(50, greatest(10, CAST(floor(sqrt(count(DISTINCT montant_charge_brut))) AS INTEGER) * 5)) AS k FROM claims),
b AS (SELECT CAST(least(floor((montant_charge_brut - mn) / ((mx - mn) / k)), k - 1) AS INTEGER) AS bin, mn, mx, k FROM claims, m
      WHERE montant_charge_brut IS NOT NULL)
SELECT bin, round(any_value(mn) + bin * (any_value(mx) - any_value(mn)) / any_value(k), 4) AS lower,
       round(any_value(mn) + (bin + 1) * (any_value(mx) - any_value(mn)) / any_value(k), 4) AS upper, CAST(count(*) AS BIGINT) AS count
FROM b GROUP BY bin""")
def q_histogram(spark, sf):
    return rnd(charts.histogram_bins(C(spark, sf), TARGET))


@register("boxplot_stats", """
WITH d AS (SELECT risque_rga_gcl AS g, montant_charge_brut AS x FROM claims WHERE risque_rga_gcl IS NOT NULL AND montant_charge_brut IS NOT NULL),
q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM d GROUP BY g)
SELECT d.g AS risque_rga_gcl, round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median, round(any_value(q3), 4) AS q3,
       CAST(count(*) AS BIGINT) AS n, round(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low,
       round(max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
       CAST(count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers
FROM d JOIN q ON d.g = q.g GROUP BY d.g""")
def q_boxplot(spark, sf):
    return rnd(charts.boxplot_stats(C(spark, sf), TARGET, "risque_rga_gcl"))


def _ew(col, k=5):
    return (f"CASE WHEN {col} IS NULL THEN NULL ELSE CAST(least({k}, greatest(1, ceil(({col} - (SELECT min({col}) FROM claims)) / "
            f"(((SELECT max({col}) FROM claims) - (SELECT min({col}) FROM claims)) / {k})))) AS INTEGER) END")


@register("climate_heatmap", f"""
SELECT {_ew('weather_temp_mean')} AS temp_bin, {_ew('weather_precip_mean')} AS precip_bin, round(avg(montant_charge_brut), 4) AS mean,
       CAST(count(*) AS BIGINT) AS n FROM claims WHERE weather_temp_mean IS NOT NULL AND weather_precip_mean IS NOT NULL GROUP BY 1, 2""")
def q_heatmap(spark, sf):
    return rnd(charts.climate_heatmap(C(spark, sf), TARGET))


@register("decade_means", """
SELECT CAST(floor(annee_construction_batiment / 10) * 10 AS INTEGER) AS decade, round(avg(montant_charge_brut), 4) AS mean,
       CAST(count(*) AS BIGINT) AS n FROM claims WHERE annee_construction_batiment > 1800 GROUP BY 1""")
def q_decades(spark, sf):
    return rnd(charts.decade_means(C(spark, sf), TARGET, "annee_construction_batiment"))


@register("floors_median_curve", """
WITH d0 AS (SELECT CAST(round_even(CAST(nb_etages_batiment AS DOUBLE), 0) AS INTEGER) AS floors, montant_charge_brut AS y FROM claims
            WHERE nb_etages_batiment BETWEEN 0 AND 20 AND montant_charge_brut > 0),
f AS (SELECT quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM d0),
d AS (SELECT floors, least(greatest(y, lo), hi) AS y FROM d0, f)
SELECT floors, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(y, 0.5), 4) AS median, round(avg(y), 4) AS mean
FROM d GROUP BY floors HAVING count(*) >= 10""")
def q_floors_curve(spark, sf):
    return rnd(charts.floors_median_curve(C(spark, sf), TARGET, "nb_etages_batiment"))


@register("score_bin_boxes", f"""WITH {_BUILD_CTE},
_s AS (SELECT building_vulnerability_score AS s, montant_charge_brut AS y FROM bs),
_r AS (SELECT min(s) AS a, max(s) AS z FROM _s),
_c AS (SELECT CAST(least(5, greatest(1, ceil((s - lo) / ((hi - lo) / 5)))) AS INTEGER) AS score_bin, y FROM _s,
       (SELECT CASE WHEN a = z THEN a - abs(a) * 0.001 ELSE a END AS lo, CASE WHEN a = z THEN z + abs(z) * 0.001 ELSE z END AS hi FROM _r) WHERE s IS NOT NULL)
SELECT score_bin, CAST(count(y) AS BIGINT) AS count, round(quantile_cont(y, 0.25), 4) AS q1, round(quantile_cont(y, 0.5), 4) AS median,
       round(quantile_cont(y, 0.75), 4) AS q3 FROM _c WHERE y IS NOT NULL GROUP BY score_bin""")
def q_score_boxes(spark, sf):
    d = D.score_building(C(spark, sf), 2025)
    return rnd(charts.score_bin_boxes(d, TARGET, "building_vulnerability_score"))


@register("density_grid", f"""
WITH d AS (SELECT montant_charge_brut AS x FROM claims WHERE montant_charge_brut IS NOT NULL),
p AS (SELECT CAST(count(*) AS DOUBLE) AS n, min(x) AS mn, (max(x) - min(x)) / 199 AS gap, stddev_samp(x) * power(count(*), -0.2) AS h FROM d),
a AS (SELECT (x - mn) / (h / {charts.MESH}) AS cell FROM d, p),
m AS (SELECT c, sum(w) AS w FROM (SELECT floor(cell) AS c, 1 - (cell - floor(cell)) AS w FROM a UNION ALL SELECT floor(cell) + 1, cell - floor(cell) FROM a) GROUP BY c)
SELECT round(mn + i * gap, 4) AS x, round(1e6 * coalesce(sum(w * exp(-0.5 * power((i * gap - c * h / {charts.MESH}) / h, 2)) / (n * h * sqrt(2 * pi()))), 0), 6) AS density
FROM p, range(0, 200) g(i), m WHERE abs(i * gap - c * h / {charts.MESH}) <= {charts.REACH} * h GROUP BY i, mn, gap""")
def q_density(spark, sf):
    """Densities of amounts are small: shown times a million."""
    d = charts.density_grid(C(spark, sf), TARGET)
    return d.select(F.round("x", 4).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density"))
