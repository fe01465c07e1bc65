"""Domain analysis keys: tidy (part, level, metric, value)
tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import drought as D
from . import register
from . import sqlgen as S
from .common import C
from .sqlsnips import mann_whitney_sql

REF = 2025


def R(df, digits=4):
    return df.withColumn("value", F.round("value", digits))


def _src(*cols, extra=""):
    nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    sel = ", ".join(cols)
    return f"SELECT {sel}, montant_charge_brut AS y FROM claims WHERE {nn} AND montant_charge_brut IS NOT NULL AND montant_charge_brut > 0 {extra}"


_PSRC = _src("weather_precip_mean")
_PCUT = S.cut("weather_precip_mean", [float("-inf"), 20, 40, float("inf")], D.PRECIP_LABELS)


@register("climate_precip", S.union(
    S.level_stats("by_category", _PSRC, _PCUT, D.PRECIP_LABELS, ["count", "mean", "median", "std", "p90", "p95"]),
    S.kruskal_gated("kruskal", _PSRC, _PCUT, 3),
    S.pearson("pearson", _PSRC, "weather_precip_mean")))
def q_climate_precip(spark, sf):
    return R(D.climate_precip(C(spark, sf)))


_TSRC = _src("weather_temp_mean")
_TCUT = S.cut("weather_temp_mean", [float("-inf"), 20, 25, float("inf")], D.TEMP_LABELS)


@register("climate_temp", S.union(
    S.level_stats("by_category", _TSRC, _TCUT, D.TEMP_LABELS, ["count", "mean", "median", "std", "p90", "p95"]),
    S.kruskal_gated("kruskal", _TSRC, _TCUT, 3),
    S.pearson("pearson", _TSRC, "weather_temp_mean")))
def q_climate_temp(spark, sf):
    return R(D.climate_temp(C(spark, sf)))


_DSRC = ("SELECT *, weather_precip_mean < 20 AND weather_temp_mean > 25 AS is_drought, "
         "greatest(0.0, (20 - weather_precip_mean) / 20.0 + (weather_temp_mean - 25) / 25.0) AS inten FROM ("
         + _src("weather_precip_mean", "weather_temp_mean") + ")")
_DCUT = S.cut("inten", [float("-inf"), 0, 0.5, 1, float("inf")], D.DROUGHT_LABELS)
_MW = f"WITH _dd AS ({_DSRC}),{mann_whitney_sql('_dd', 'is_drought', 'y')} SELECT CASE WHEN n1 >= 3 AND n2 >= 3 THEN U END AS U, CASE WHEN n1 >= 3 AND n2 >= 3 THEN p_value END AS p_value FROM _mw"


@register("drought_conditions", S.union(
    S.level_stats("by_category", _DSRC, _DCUT, D.DROUGHT_LABELS, ["count", "mean", "median", "std", "p90", "p95"]),
    S.level_stats("by_flag", _DSRC, "is_drought", None, ["count", "mean", "median", "std"]),
    S.tidy("mann_whitney", _MW, ["U", "p_value"], None),
    S.tidy("share", f"SELECT sum(CAST(is_drought AS INTEGER)) * 100.0 / count(*) AS drought_percentage FROM ({_DSRC})",
           ["drought_percentage"], None)))
def q_drought(spark, sf):
    return R(D.drought_conditions(C(spark, sf)))


_MSRC = ("SELECT month(date_sinistre) AS level, avg(montant_charge_brut) AS montant_mean, avg(weather_precip_mean) AS precip_mean, "
         "avg(weather_temp_mean) AS temp_mean, count(*) AS n FROM claims WHERE date_sinistre IS NOT NULL AND montant_charge_brut IS NOT NULL GROUP BY 1")


@register("climate_by_month", S.union(
    S.tidy("by_month", _MSRC, ["montant_mean", "precip_mean", "temp_mean", "n"]),
    S.tidy("correlation", f"SELECT corr(montant_mean, precip_mean) AS corr_montant_precip, corr(montant_mean, temp_mean) AS corr_montant_temp FROM ({_MSRC})",
           ["corr_montant_precip", "corr_montant_temp"], None)))
def q_climate_month(spark, sf):
    return R(D.climate_by_month(C(spark, sf)))


_ASRC = f"SELECT * FROM (SELECT {REF}.0 - annee_construction_batiment AS age_batiment, montant_charge_brut AS y FROM claims) WHERE age_batiment IS NOT NULL AND y IS NOT NULL AND y > 0 AND age_batiment BETWEEN 0 AND 200"
_ACUT = S.cut("age_batiment", [0, 20, 40, 60, 100, float("inf")], D.AGE_LABELS)


@register("vuln_age", S.union(
    S.level_stats("by_category", _ASRC, _ACUT, D.AGE_LABELS, ["count", "mean", "median", "std", "p90"]),
    S.pearson("pearson", _ASRC, "age_batiment"), S.spearman_rho("spearman", _ASRC, "age_batiment")))
def q_vuln_age(spark, sf):
    return R(D.vuln_age(C(spark, sf), REF))


_SSRC = _src("surface_batiment", extra="AND surface_batiment > 0")


@register("vuln_surface", S.union(
    S.level_stats("by_quartile", _SSRC, S.qcut("surface_batiment", _SSRC, D.QUARTILE_LABELS), D.QUARTILE_LABELS,
                  ["count", "mean", "median", "std"]),
    S.spearman_rho("spearman", _SSRC, "surface_batiment")))
def q_vuln_surface(spark, sf):
    return R(D.vuln_surface(C(spark, sf)))


_WSRC = _src("type_mur_batiment")


@register("vuln_wall_type", S.union(
    S.level_stats("by_wall_type", _WSRC, "type_mur_batiment", None, ["count", "mean", "median", "std"]),
    S.kruskal_gated("kruskal", _WSRC, "type_mur_batiment", None)))
def q_vuln_wall(spark, sf):
    return R(D.vuln_wall_type(C(spark, sf)))


_RSRC = _src("nb_pieces_police", extra="AND nb_pieces_police BETWEEN 0 AND 20")


@register("vuln_rooms", S.union(
    S.level_stats("by_rooms", _RSRC, "CAST(nb_pieces_police AS INTEGER)", None, ["count", "mean", "median", "std"]),
    S.spearman_rho("spearman", _RSRC, "nb_pieces_police")))
def q_vuln_rooms(spark, sf):
    return R(D.vuln_rooms(C(spark, sf)))


_BUILD_CTE = f"""_b AS (SELECT *, {REF}.0 - annee_construction_batiment AS _age FROM claims),
_bq AS (SELECT quantile_cont(surface_batiment, 0.99) AS s99 FROM claims),
_bc AS (SELECT _b.*, CASE WHEN surface_batiment IS NULL THEN NULL ELSE least(greatest(surface_batiment, 0.0), s99) END AS _sc FROM _b, _bq),
_bm AS (SELECT min(_sc) AS _sa, max(_sc) AS _sz FROM _bc),
bs AS (SELECT _bc.*, least(greatest((coalesce(least(greatest(_age, 0.0), 150.0) / 150.0, 0.5)
        + coalesce((_sc - _sa) / greatest(_sz - _sa, 1e-9), 0.5)) / 2, 0.0), 1.0) AS building_vulnerability_score FROM _bc, _bm)"""

_EXPO_CTE = """_e AS (SELECT quantile_cont(prime, 0.01) AS p1, quantile_cont(prime, 0.99) AS p99,
                   quantile_cont(engagements, 0.01) AS e1, quantile_cont(engagements, 0.99) AS e99 FROM claims),
_ec AS (SELECT claims.*, CASE WHEN prime IS NULL THEN NULL ELSE least(greatest(prime, p1), p99) END AS _pc,
               CASE WHEN engagements IS NULL THEN NULL ELSE least(greatest(engagements, e1), e99) END AS _ecc FROM claims, _e),
_em AS (SELECT min(_pc) AS pa, max(_pc) AS pb, min(_ecc) AS ea, max(_ecc) AS eb FROM _ec),
_ep AS (SELECT _ec.*, CASE WHEN pb <> pa THEN (_pc - pa) / (pb - pa) END AS _pp, CASE WHEN eb <> ea THEN (_ecc - ea) / (eb - ea) END AS _pe,
               coalesce(CASE lower(risque_rga_gcl) WHEN 'faible' THEN 0.2 WHEN 'moyen' THEN 0.5 WHEN 'fort' THEN 0.8 WHEN 'maximal' THEN 1.0 END, 0.5) AS _pr
        FROM _ec, _em),
es AS (SELECT _ep.*, least(greatest((coalesce(_pp, 0) + coalesce(_pe, 0) + _pr)
        / ((CASE WHEN _pp IS NULL THEN 0 ELSE 1 END) + (CASE WHEN _pe IS NULL THEN 0 ELSE 1 END) + 1), 0.0), 1.0) AS exposure_score FROM _ep)"""


def _score_sql(src: str, col: str) -> str:
    return f"SELECT cod_sin, round({col}, 9) AS {col} FROM {src}"


def _score(df, col):
    return df.select("cod_sin", F.round(col, 9).alias(col))


@register("score_building", f"WITH {_BUILD_CTE} " + _score_sql("bs", "building_vulnerability_score"))
def q_score_building(spark, sf):
    return _score(D.score_building(C(spark, sf), REF), "building_vulnerability_score")


_WALL = "coalesce(CASE lower(type_mur_batiment) WHEN 'parpaing' THEN 0.5 WHEN 'brique' THEN 0.6 WHEN 'pierre' THEN 0.7 WHEN 'bois' THEN 0.55 WHEN 'béton' THEN 0.45 END, 0.5)"
_VULN_SQL = f"WITH {_BUILD_CTE}, v AS (SELECT cod_sin, least(greatest((building_vulnerability_score + {_WALL}) / 2, 0.0), 1.0) AS vulnerability_score FROM bs) "


@register("score_vulnerability", _VULN_SQL + _score_sql("v", "vulnerability_score"))
def q_score_vuln(spark, sf):
    return _score(D.score_vulnerability(C(spark, sf), REF), "vulnerability_score")


@register("score_exposure", f"WITH {_EXPO_CTE} " + _score_sql("es", "exposure_score"))
def q_score_exposure(spark, sf):
    return _score(D.score_exposure(C(spark, sf)), "exposure_score")


@register("score_climate", """
WITH m AS (SELECT min(weather_precip_mean) AS pa, max(weather_precip_mean) AS pb, min(weather_temp_mean) AS ta, max(weather_temp_mean) AS tb FROM claims),
sc AS (SELECT cod_sin, least(greatest(coalesce((1 - (weather_precip_mean - pa) / greatest(pb - pa, 1e-9)) * 0.5
                                     + (weather_temp_mean - ta) / greatest(tb - ta, 1e-9) * 0.5, 0.5), 0.0), 1.0) AS climate_risk_score
       FROM claims, m)
""" + _score_sql("sc", "climate_risk_score"))
def q_score_climate(spark, sf):
    return _score(D.score_climate(C(spark, sf)), "climate_risk_score")


SCORE_METRICS = ["count", "mean", "std", "min", "q25", "median", "q75", "max"]


def score_summary_sql(col: str, src: str) -> str:
    return (f"SELECT CAST(count({col}) AS BIGINT) AS count, round(avg({col}), 6) AS mean, round(stddev_samp({col}), 6) AS std, "
            f"round(min({col}), 6) AS min, round(quantile_cont({col}, 0.25), 6) AS q25, round(quantile_cont({col}, 0.5), 6) AS median, "
            f"round(quantile_cont({col}, 0.75), 6) AS q75, round(max({col}), 6) AS max FROM {src}")


def score_summary(df, col):
    from ..operators import summary
    s = summary.summarize(df, col, (), ("count", "mean", "std", "min", "max"), {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return s.select(F.col("count").cast("bigint").alias("count"), *[F.round(c, 6).alias(c) for c in SCORE_METRICS[1:]])


_PRSRC = _src("prime", extra="AND prime > 0")


@register("exposure_premium", S.union(
    S.level_stats("by_quartile", _PRSRC, S.qcut("prime", _PRSRC, D.PREMIUM_LABELS), D.PREMIUM_LABELS, ["count", "mean", "median", "std", "p90"]),
    S.pearson("pearson", _PRSRC, "prime"),
    S.tidy("loss_ratio", f"SELECT count(y / prime) AS count, avg(y / prime) AS mean, stddev_samp(y / prime) AS std, min(y / prime) AS min, "
           f"quantile_cont(y / prime, 0.25) AS q25, quantile_cont(y / prime, 0.5) AS median, quantile_cont(y / prime, 0.75) AS q75, "
           f"max(y / prime) AS max FROM ({_PRSRC})", ["count", "mean", "std", "min", "q25", "median", "q75", "max"], None)))
def q_expo_premium(spark, sf):
    return R(D.exposure_premium(C(spark, sf)))


_ESRC = _src("engagements", extra="AND engagements > 0")


@register("exposure_commitment", S.union(
    S.level_stats("by_quartile", _ESRC, S.qcut("engagements", _ESRC, D.QUARTILE_LABELS), D.QUARTILE_LABELS, ["count", "mean", "median", "std"]),
    S.pearson("pearson", _ESRC, "engagements")))
def q_expo_commit(spark, sf):
    return R(D.exposure_commitment(C(spark, sf)))


_RGA_MAP = ("CASE lower(risque_rga_gcl) WHEN 'faible' THEN 'faible' WHEN 'bas' THEN 'faible' WHEN 'moyen' THEN 'moyen' WHEN 'modere' THEN 'moyen' "
            "WHEN 'modéré' THEN 'moyen' WHEN 'fort' THEN 'fort' WHEN 'eleve' THEN 'fort' WHEN 'élevé' THEN 'fort' WHEN 'tres eleve' THEN 'maximal' "
            "WHEN 'très élevé' THEN 'maximal' WHEN 'maximal' THEN 'maximal' END")
_RGSRC = (f"SELECT rga, CAST(CASE rga WHEN 'faible' THEN 0 WHEN 'moyen' THEN 1 WHEN 'fort' THEN 2 WHEN 'maximal' THEN 3 END AS DOUBLE) AS code, y "
          f"FROM (SELECT {_RGA_MAP} AS rga, montant_charge_brut AS y FROM claims) WHERE rga IS NOT NULL AND y > 0")


@register("exposure_rga", S.union(
    S.level_stats("by_rga", _RGSRC, "rga", ["faible", "moyen", "fort", "maximal"], ["count", "mean", "median", "std"]),
    S.kruskal_gated("kruskal", _RGSRC, "rga", 4), S.spearman_rho("spearman", _RGSRC, "code")))
def q_expo_rga(spark, sf):
    return R(D.exposure_rga(C(spark, sf)))


_XSRC = f"WITH {_EXPO_CTE} SELECT exposure_score, montant_charge_brut AS y FROM es WHERE exposure_score IS NOT NULL AND montant_charge_brut IS NOT NULL"


@register("exposure_combined", S.union(
    S.level_stats("by_quartile", _XSRC, S.qcut("exposure_score", _XSRC, D.QUARTILE_LABELS), D.QUARTILE_LABELS, ["count", "mean", "median", "std"]),
    S.spearman_rho("spearman", _XSRC, "exposure_score")))
def q_expo_combined(spark, sf):
    return R(D.exposure_combined(C(spark, sf)))


_PROFILE = """CASE WHEN e < 0.4 AND v < 0.4 THEN 'Faible risque' WHEN e > 0.7 AND v > 0.7 THEN 'Très haut risque'
 WHEN e > 0.6 OR v > 0.6 THEN 'Haut risque' ELSE 'Risque modéré' END"""
_BOTH = f"""WITH {_EXPO_CTE}, {_BUILD_CTE.replace('FROM claims)', 'FROM es)', 1)}"""


@register("risk_profile", f"""{_BOTH},
p AS (SELECT {_PROFILE} AS risk_profile, y FROM (SELECT coalesce(exposure_score, 0.5) AS e,
             coalesce(building_vulnerability_score, 0.5) AS v, montant_charge_brut AS y FROM bs WHERE montant_charge_brut IS NOT NULL))
SELECT risk_profile, CAST(count(y) AS BIGINT) AS count, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std,
       round(quantile_cont(y, 0.5), 4) AS median, round(count(y) * 100.0 / sum(count(y)) OVER (), 4) AS percentage FROM p GROUP BY 1""")
def q_risk_profile(spark, sf):
    from .q_aggregates import rnd
    return rnd(D.risk_profile(C(spark, sf), REF), 4)


@register("risk_matrix", f"""{_BOTH}
SELECT exposure_score > 0.5 AS high_exposure, building_vulnerability_score > 0.5 AS high_vulnerability, CAST(count(*) AS BIGINT) AS count,
       round(avg(montant_charge_brut), 4) AS mean FROM bs GROUP BY 1, 2""")
def q_risk_matrix(spark, sf):
    from .q_aggregates import rnd
    return rnd(D.risk_matrix(C(spark, sf), REF), 4)
