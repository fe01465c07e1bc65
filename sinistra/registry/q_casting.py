"""Projection, casting and schema keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import casting
from ..operators import casting_ops
from . import register
from .common import C, TARGET
from .q_aggregates import rnd


@register("project_columns", "SELECT police, cod_sin, montant_charge_brut, risque_rga_gcl FROM claims")
def q_project(spark, sf):
    return C(spark, sf).select("police", "cod_sin", TARGET, "risque_rga_gcl")


@register("to_numeric_coerce", """
SELECT cod_sin, TRY_CAST(cpostal AS DOUBLE) AS cpostal_num, TRY_CAST(ville AS DOUBLE) AS ville_num,
       TRY_CAST(risque_rga_gcl AS DOUBLE) AS rga_num FROM claims""")
def q_to_numeric(spark, sf):
    d = C(spark, sf)
    return d.select("cod_sin", casting.to_double("cpostal").alias("cpostal_num"), casting.to_double("ville").alias("ville_num"),
                    casting.to_double("risque_rga_gcl").alias("rga_num"))


def _mixed_dates(d):
    """Text dates in two formats (even order keys day-first), plus junk."""
    k = F.col("cod_sin").cast("bigint")
    return F.when(k % 7 == 0, F.lit("bad")).when(k % 2 == 0, F.date_format("date_sinistre", "dd/MM/yyyy")).otherwise(
        F.date_format("date_sinistre", "yyyy-MM-dd"))


@register("to_datetime_coerce", """
WITH t AS (SELECT cod_sin, CASE WHEN CAST(cod_sin AS BIGINT) % 7 = 0 THEN 'bad' WHEN CAST(cod_sin AS BIGINT) % 2 = 0
  THEN strftime(date_sinistre, '%d/%m/%Y') ELSE strftime(date_sinistre, '%Y-%m-%d') END AS s FROM claims)
SELECT cod_sin, coalesce(try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%d/%m/%Y')) AS date_parsed FROM t""")
def q_to_datetime(spark, sf):
    d = C(spark, sf)
    t = d.select("cod_sin", _mixed_dates(d).alias("s"))
    return t.select("cod_sin", casting.to_timestamp_any("s").alias("date_parsed"))


@register("promote_numeric_strict", """
SELECT police, cod_sin, TRY_CAST(trim(cpostal) AS DOUBLE) AS cpostal, ville, statut_sinistre FROM claims""")
def q_promote_strict(spark, sf):
    d = C(spark, sf).select("police", "cod_sin", "cpostal", "ville", "statut_sinistre")
    return casting_ops.promote_numeric(d, protect=["police", "cod_sin"])


@register("promote_numeric_80pct", """
SELECT cod_sin, CASE WHEN risque_rga_gcl IS NULL THEN 'n/a' ELSE CAST(nb_pieces_police AS VARCHAR) END AS rooms_txt,
       TRY_CAST(trim(CAST(surface_police AS VARCHAR)) AS DOUBLE) AS surface_txt FROM claims""")
def q_promote_80(spark, sf):
    d = C(spark, sf).select(
        "cod_sin",
        F.when(F.col("risque_rga_gcl").isNull(), F.lit("n/a")).otherwise(F.col("nb_pieces_police").cast("string")).alias("rooms_txt"),
        F.col("surface_police").cast("string").alias("surface_txt"))
    return casting_ops.promote_numeric(d, ["rooms_txt", "surface_txt"], min_share=0.8)


@register("promote_dates_by_name", """
SELECT cod_sin, CAST(date_sinistre AS TIMESTAMP) AS date_txt, ville FROM claims""")
def q_promote_dates(spark, sf):
    d = C(spark, sf).select("cod_sin", F.date_format("date_sinistre", "yyyy-MM-dd").alias("date_txt"), "ville")
    return casting_ops.promote_dates_by_name(d)


@register("clean_european_number", """
WITH t AS (SELECT cod_sin, replace(printf('%.2f', montant_charge_brut), '.', ',') || ' €' AS s FROM claims)
SELECT cod_sin, s AS montant_txt, TRY_CAST(replace(regexp_replace(s, '[^0-9.,+-]', '', 'g'), ',', '.') AS DOUBLE) AS montant FROM t""")
def q_european(spark, sf):
    d = C(spark, sf).select("cod_sin", F.concat(F.replace(F.format_string("%.2f", F.col(TARGET)), F.lit("."), F.lit(",")),
                                                 F.lit(" €")).alias("montant_txt"))
    return d.withColumn("montant", casting.clean_european_number("montant_txt"))


_T = "('1','true','t','yes','y','vrai','oui')"
_F = "('0','false','f','no','n','faux','non')"


@register("boolify", f"""
SELECT cod_sin,
  CASE WHEN est_dans_sin_cluster IS NULL THEN false WHEN lower(trim(est_dans_sin_cluster)) IN {_T} THEN true
       WHEN lower(trim(est_dans_sin_cluster)) IN {_F} THEN false ELSE length(est_dans_sin_cluster) > 0 END AS cluster_flag,
  CASE WHEN type_mur_batiment IS NULL THEN false WHEN lower(trim(type_mur_batiment)) IN {_T} THEN true
       WHEN lower(trim(type_mur_batiment)) IN {_F} THEN false ELSE length(type_mur_batiment) > 0 END AS wall_flag,
  CASE WHEN risque_rga_gcl IS NULL THEN false WHEN lower(trim(risque_rga_gcl)) IN {_T} THEN true
       WHEN lower(trim(risque_rga_gcl)) IN {_F} THEN false ELSE length(risque_rga_gcl) > 0 END AS rga_flag,
  coalesce(abs(CAST(nb_pieces_police AS DOUBLE) - 1) >= 1, false) AS rooms_flag
FROM claims""")
def q_boolify(spark, sf):
    d = C(spark, sf)
    return d.select("cod_sin", casting.boolify("est_dans_sin_cluster").alias("cluster_flag"),
                    casting.boolify("type_mur_batiment").alias("wall_flag"),
                    casting.boolify("risque_rga_gcl").alias("rga_flag"),
                    casting.boolify(F.col("nb_pieces_police") - 1, "double").alias("rooms_flag"))


_TN = "('1','true','vrai','oui','yes','y')"
_FN = "('0','false','faux','non','no','n')"


@register("boolify_nullable", f"""
SELECT cod_sin,
  CASE WHEN lower(trim(est_dans_sin_cluster)) IN {_TN} THEN true WHEN lower(trim(est_dans_sin_cluster)) IN {_FN} THEN false
       ELSE TRY_CAST(lower(trim(est_dans_sin_cluster)) AS INTEGER) <> 0 END AS cluster_flag,
  CASE WHEN lower(trim(cpostal)) IN {_TN} THEN true WHEN lower(trim(cpostal)) IN {_FN} THEN false
       ELSE TRY_CAST(lower(trim(cpostal)) AS INTEGER) <> 0 END AS postal_flag,
  CASE WHEN lower(trim(ville)) IN {_TN} THEN true WHEN lower(trim(ville)) IN {_FN} THEN false
       ELSE TRY_CAST(lower(trim(ville)) AS INTEGER) <> 0 END AS ville_flag
FROM claims""")
def q_boolify_nullable(spark, sf):
    d = C(spark, sf)
    return d.select("cod_sin", casting.boolify_nullable("est_dans_sin_cluster").alias("cluster_flag"),
                    casting.boolify_nullable("cpostal").alias("postal_flag"), casting.boolify_nullable("ville").alias("ville_flag"))


@register("clean_text", """
SELECT cod_sin, upper(trim(coalesce(risque_rga_gcl, 'Inconnu'))) AS risque_rga_gcl, upper(trim(coalesce(statut_sinistre, 'Inconnu'))) AS statut_sinistre
FROM claims""")
def q_clean_text(spark, sf):
    d = C(spark, sf)
    return d.select("cod_sin", casting.clean_text("risque_rga_gcl").alias("risque_rga_gcl"),
                    casting.clean_text("statut_sinistre").alias("statut_sinistre"))


@register("drop_sparse_columns", "SELECT * EXCLUDE (risque_rga_gcl) FROM claims")
def q_drop_sparse(spark, sf):
    return casting_ops.drop_sparse_columns(C(spark, sf), threshold=0.1)


_RENAMES = {"MONTANT": "montant_charge_brut", "Police": "police", "Sinistre": "cod_sin"}
_DEFAULTS = {"geocoding_validity": "oui", "statut_sinistre": "Clos"}
_TYPES = {"montant_charge_brut": "double", "police": "string", "cod_sin": "string", "cpostal": "int"}


@register("conform_schema", """
SELECT police, cod_sin, montant_charge_brut, TRY_CAST(cpostal AS INTEGER) AS cpostal, 'oui' AS geocoding_validity, 'Clos' AS statut_sinistre
FROM claims""")
def q_conform(spark, sf):
    d = C(spark, sf).select(F.col("police").alias("Police"), F.col("cod_sin").alias("Sinistre"),
                            F.col(TARGET).alias("MONTANT"), "cpostal")
    t, _ = casting_ops.conform_schema(d, _RENAMES, _DEFAULTS, _TYPES)
    return t


@register("conform_schema_report", """
SELECT 'montant_charge_brut' AS variable, 'double' AS type, CAST(count(montant_charge_brut) AS BIGINT) AS non_null_before,
       CAST(count(montant_charge_brut) AS BIGINT) AS non_null_after, 0.0 AS lost_share FROM claims
UNION ALL SELECT 'police', 'string', CAST(count(police) AS BIGINT), CAST(count(police) AS BIGINT), 0.0 FROM claims
UNION ALL SELECT 'cod_sin', 'string', CAST(count(cod_sin) AS BIGINT), CAST(count(cod_sin) AS BIGINT), 0.0 FROM claims
UNION ALL SELECT 'cpostal', 'int', CAST(count(cpostal) AS BIGINT), CAST(count(TRY_CAST(cpostal AS INTEGER)) AS BIGINT),
  round((count(cpostal) - count(TRY_CAST(cpostal AS INTEGER))) * 1.0 / count(cpostal), 4) FROM claims""")
def q_conform_report(spark, sf):
    d = C(spark, sf).select(F.col("police").alias("Police"), F.col("cod_sin").alias("Sinistre"),
                            F.col(TARGET).alias("MONTANT"), "cpostal")
    _, rep = casting_ops.conform_schema(d, _RENAMES, _DEFAULTS, _TYPES)
    return rnd(rep)
