"""Join-like keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup, summary
from . import register
from .common import C, TARGET
from .q_aggregates import rnd


@register("topn_levels_semi", """
WITH t AS (SELECT ville FROM claims GROUP BY ville ORDER BY count(*) DESC, ville LIMIT 5)
SELECT claims.* FROM claims WHERE ville IN (SELECT ville FROM t)""")
def q_topn_semi(spark, sf):
    return lookup.topn_levels_semi(C(spark, sf), "ville", 5)


@register("lookup_map", """
SELECT cod_sin,
  CASE lower(risque_rga_gcl) WHEN 'faible' THEN 'faible' WHEN 'bas' THEN 'faible' WHEN 'moyen' THEN 'moyen' WHEN 'modere' THEN 'moyen'
    WHEN 'modéré' THEN 'moyen' WHEN 'fort' THEN 'fort' WHEN 'eleve' THEN 'fort' WHEN 'élevé' THEN 'fort' WHEN 'tres eleve' THEN 'maximal'
    WHEN 'très élevé' THEN 'maximal' WHEN 'maximal' THEN 'maximal' END AS rga,
  CAST(coalesce(CASE lower(risque_rga_gcl) WHEN 'faible' THEN 0.2 WHEN 'moyen' THEN 0.5 WHEN 'fort' THEN 0.8 WHEN 'maximal' THEN 1.0 END, 0.5) AS DOUBLE) AS rga_score,
  CAST(coalesce(CASE lower(type_mur_batiment) WHEN 'parpaing' THEN 0.5 WHEN 'brique' THEN 0.6 WHEN 'pierre' THEN 0.7 WHEN 'bois' THEN 0.55
    WHEN 'béton' THEN 0.45 END, 0.5) AS DOUBLE) AS wall_weight,
  CASE WHEN month(date_sinistre) IN (12, 1, 2) THEN 'Hiver' WHEN month(date_sinistre) IN (3, 4, 5) THEN 'Printemps'
    WHEN month(date_sinistre) IN (6, 7, 8) THEN 'Été' ELSE 'Automne' END AS season
FROM claims""")
def q_lookup(spark, sf):
    from ..functions.dates import SEASON_LABELS

    d = C(spark, sf)
    month_season = {m: lab for lab, ms in SEASON_LABELS.items() for m in ms}
    return d.select(
        "cod_sin",
        lookup.map_expr(lookup.RGA_SYNONYMS, F.lower("risque_rga_gcl")).alias("rga"),
        lookup.map_expr(lookup.RGA_SCORE, F.lower("risque_rga_gcl"), 0.5).alias("rga_score"),
        lookup.map_expr(lookup.WALL_WEIGHTS, F.lower("type_mur_batiment"), 0.5).alias("wall_weight"),
        lookup.map_expr(month_season, F.month("date_sinistre")).alias("season"),
    )


@register("category_spine", """
WITH lv(level, ord) AS (VALUES ('faible', 0), ('moyen', 1), ('fort', 2), ('maximal', 3)),
d AS (SELECT * FROM claims)
SELECT lv.ord, lv.level AS rga, CAST(count(d.montant_charge_brut) AS BIGINT) AS count,
       round(avg(d.montant_charge_brut), 4) AS mean, round(quantile_cont(d.montant_charge_brut, 0.5), 4) AS median
FROM lv LEFT JOIN d ON d.risque_rga_gcl = lv.level GROUP BY lv.ord, lv.level""")
def q_category_spine(spark, sf):
    d = C(spark, sf)
    s = summary.summarize(d.where(F.col("risque_rga_gcl").isNotNull()), TARGET, ["risque_rga_gcl"], ("count", "mean"),
                          {"median": 0.5})
    dim = lookup.dimension(spark, lookup.RGA_ORDER, "level", "ord")
    out = lookup.category_spine(s, dim, "risque_rga_gcl", "level").withColumnRenamed("risque_rga_gcl", "rga")
    return rnd(out.select("ord", "rga", "count", "mean", "median"))


@register("month_spine", """
WITH d AS (SELECT date_trunc('month', date_sinistre) AS m FROM claims),
sp AS (SELECT unnest(generate_series((SELECT min(m) FROM d), (SELECT max(m) FROM d), INTERVAL 1 MONTH)) AS month)
SELECT sp.month, CAST(count(d.m) AS BIGINT) AS n FROM sp LEFT JOIN d ON d.m = sp.month GROUP BY sp.month""")
def q_month_spine(spark, sf):
    from ..functions.dates import month_start
    d = C(spark, sf).select(month_start("date_sinistre").alias("month"))
    counts = d.groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    spine = lookup.month_spine(d, "month")
    out = spine.join(counts, "month", "left")
    return out.select("month", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@register("broadcast_fence", """
WITH f AS (SELECT avg(montant_charge_brut) AS m, quantile_cont(montant_charge_brut, 0.9) AS p90 FROM claims)
SELECT cod_sin, montant_charge_brut > m AS above_mean, montant_charge_brut > p90 AS above_p90 FROM claims, f""")
def q_fence(spark, sf):
    from ..operators import ranks

    d = C(spark, sf)
    f = d.agg(F.avg(TARGET).alias("_m")).crossJoin(ranks.exact_quantiles(d, TARGET, [0.9], names=["_p90"]))
    j = lookup.broadcast_fence(d, f)
    return j.select("cod_sin", (F.col(TARGET) > F.col("_m")).alias("above_mean"), (F.col(TARGET) > F.col("_p90")).alias("above_p90"))
