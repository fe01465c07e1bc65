"""Composite keys (SURVEY §2.10 compositions, §2.5 data dictionary, §2.9
quantile regression). Oracle forms reuse the registered parts' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, summary
from ..operators.lookup import RGA_ORDER, RGA_SYNONYMS
from ..plans import drought as D
from ..plans import suites as X
from . import REGISTRY, register
from . import sqlgen as S
from .common import C, TARGET
from ..sources.claims import with_claims
from .q_aggregates import NUM, rnd
from .q_domain import _VULN_SQL, REF, SCORE_METRICS, score_summary, score_summary_sql
from .sqlsnips import avg_rank, chi2_p, corr_p, f_p, kruskal_sql


def _round4(df):
    return df.withColumn("value", F.round("value", 4))


def _union_parts(keys):
    return S.union(*[S.tagged(k, REGISTRY[k].sql) for k in keys])


def _build_union(spark, sf, keys):
    return X.union_all([REGISTRY[k].build(spark, sf).withColumn("analysis", F.lit(k)).select(
        "analysis", "part", "level", "metric", "value") for k in keys])


_CLIMATE = ["climate_precip", "climate_temp", "drought_conditions", "climate_by_month"]


@register("climate_impact", _union_parts(_CLIMATE), claims=False)
def q_climate_impact(spark, sf):
    return _build_union(spark, sf, _CLIMATE)


_VULN = ["vuln_age", "vuln_surface", "vuln_wall_type", "vuln_rooms"]


@register("building_vulnerability", S.union(
    _union_parts(_VULN),
    S.tagged("score_vulnerability", S.tidy("score", with_claims(_VULN_SQL + score_summary_sql("vulnerability_score", "v")), SCORE_METRICS, level=None, digits=None))),
    claims=False)
def q_building_vuln(spark, sf):
    sc = score_summary(D.score_vulnerability(C(spark, sf), REF), "vulnerability_score")
    score = D.tidy(sc, "score", None, SCORE_METRICS).withColumn("analysis", F.lit("score_vulnerability"))
    return _build_union(spark, sf, _VULN).unionByName(score.select("analysis", "part", "level", "metric", "value"))


_EXPO = ["exposure_premium", "exposure_commitment", "exposure_rga", "exposure_combined"]


@register("risk_exposure", _union_parts(_EXPO), claims=False)
def q_risk_exposure(spark, sf):
    return _build_union(spark, sf, _EXPO)


_DESC_M = ["count", "mean", "std", "min", "q25", "median", "q75", "max", "missing_count", "missing_percent", "skewness",
           "kurtosis", "cv", "q05", "q95", "iqr"]
_CORR_M = ["correlation_abs", "correlation", "data_count", "missing_pct"]
_OUT_M = ["q1", "q3", "iqr", "lower", "upper", "outlier_count", "outlier_rate", "n", "mean", "median", "std"]
_CLASS = ["statut_sinistre", "type_mur_batiment", "risque_rga_gcl"]
_GS_M = ["count", "mean", "median", "std", "min", "max", "percentage"]


def _gs_sql(c):
    return with_claims(f"""SELECT {c}, CAST(count(montant_charge_brut) AS BIGINT) AS count, round(avg(montant_charge_brut), 4) AS mean,
       round(quantile_cont(montant_charge_brut, 0.5), 4) AS median, round(stddev_samp(montant_charge_brut), 4) AS std,
       round(min(montant_charge_brut), 4) AS min, round(max(montant_charge_brut), 4) AS max,
       round(count(montant_charge_brut) * 100.0 / sum(count(montant_charge_brut)) OVER (), 1) AS percentage
FROM claims WHERE {c} IS NOT NULL AND montant_charge_brut IS NOT NULL GROUP BY {c}""")


def _kw_sql(c):
    return with_claims("WITH " + kruskal_sql("claims", c, "montant_charge_brut", chi2_p("H", "(k - 1.0)")) + """
SELECT round(H, 6) AS statistic, CAST(k AS BIGINT) AS groups_count, CAST(N AS BIGINT) AS n, round((H - k + 1) / (N - 1), 6) AS epsilon_sq,
       round(p, 6) AS p_value FROM _kp""")


_KW_M = ["statistic", "groups_count", "n", "epsilon_sq", "p_value"]


@register("statistics_suite", S.union(
    S.tidy_keys("describe_numeric", REGISTRY["describe_numeric"].sql, ["variable"], _DESC_M),
    S.tidy_keys("corr_with_target", REGISTRY["corr_with_target"].sql, ["variable"], _CORR_M),
    *[S.tidy_keys(f"group_stats_{c}", _gs_sql(c), [c], _GS_M) for c in _CLASS],
    *[S.tidy_keys(f"kruskal_{c}", _kw_sql(c), [], _KW_M) for c in _CLASS],
    S.tidy_keys("outliers_iqr", REGISTRY["outliers_iqr"].sql, [], _OUT_M)), claims=False)
def q_statistics_suite(spark, sf):
    from ..operators import tests
    d = C(spark, sf)
    parts = [X.to_tidy(REGISTRY["describe_numeric"].build(spark, sf), "describe_numeric", ["variable"], _DESC_M),
             X.to_tidy(REGISTRY["corr_with_target"].build(spark, sf), "corr_with_target", ["variable"], _CORR_M)]
    for c in _CLASS:
        g = rnd(summary.group_stats(d, c, TARGET, digits=None), 4, skip=("percentage",))
        parts.append(X.to_tidy(g, f"group_stats_{c}", [c], _GS_M))
        k = tests.kruskal_wallis(d, c, TARGET).select(F.round("statistic", 6).alias("statistic"), "groups_count", "n",
                                                      F.round("epsilon_sq", 6).alias("epsilon_sq"), F.round("p_value", 6).alias("p_value"))
        parts.append(X.to_tidy(k, f"kruskal_{c}", [], _KW_M))
    parts.append(X.to_tidy(REGISTRY["outliers_iqr"].build(spark, sf), "outliers_iqr", [], _OUT_M))
    return X.union_all(parts)


_OV_M = ["rows", "columns", "numeric_columns", "text_columns", "missing_cells", "target_mean", "target_sum", "duration_days"]
_AU_M = ["removed", "remaining", "retention", "overall_retention"]
_CA_M = ["below", "above", "nulls", "lower_bound", "upper_bound"]


@register("quality_report", S.union(
    S.tidy_keys("dataset_overview", REGISTRY["dataset_overview"].sql, [], _OV_M),
    S.tidy_keys("filter_audit", REGISTRY["filter_audit"].sql, ["step", "filter"], _AU_M),
    S.tidy_keys("cleaning_audit", REGISTRY["cleaning_audit"].sql, ["variable"], _CA_M)), claims=False)
def q_quality_report(spark, sf):
    return X.union_all([
        X.to_tidy(REGISTRY["dataset_overview"].build(spark, sf), "dataset_overview", [], _OV_M),
        X.to_tidy(REGISTRY["filter_audit"].build(spark, sf), "filter_audit", ["step", "filter"], _AU_M),
        X.to_tidy(REGISTRY["cleaning_audit"].build(spark, sf), "cleaning_audit", ["variable"], _CA_M)])


_LV = {v: i for i, v in enumerate(RGA_ORDER)}
_RGA_SRC = S.winsorized(f"SELECT rga AS level, CASE rga {' '.join(f"WHEN '{v}' THEN {i}.0" for v, i in _LV.items())} END AS code, y FROM "
                        f"(SELECT CASE lower(risque_rga_gcl) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in RGA_SYNONYMS.items())} END AS rga, "
                        "montant_charge_brut AS y FROM claims) WHERE rga IS NOT NULL AND y > 0")
_RGA_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b" for i, a in enumerate(RGA_ORDER) for b in RGA_ORDER[i + 1:])
_RGA_SQL = S.union(S.robust("robust_summary", _RGA_SRC), S.kruskal("kruskal", _RGA_SRC), S.spearman("spearman", _RGA_SRC, "code", monotone=True),
                   S.dunn("dunn", _RGA_SRC), S.cliffs("cliffs_delta", _RGA_SRC, _RGA_PAIRS))


@register("rga_vs_amount", _RGA_SQL)
def q_rga(spark, sf):
    return _round4(D.rga_vs_amount(C(spark, sf), with_quantreg=False))


@register("rga_quantile_slopes", None)
def q_rga_slopes(spark, sf):
    """The quantile regression slopes of ``rga_vs_amount``, which SQL cannot
    express."""
    return D.rga_vs_amount(C(spark, sf)).where(F.col("part").startswith("quantreg"))


_FLOOR_SRC = S.winsorized("SELECT CAST(CAST(fl AS INTEGER) AS VARCHAR) AS level, fl, y FROM (SELECT round_even(CAST(nb_etages_batiment AS DOUBLE), 0) AS fl, "
                          "montant_charge_brut AS y FROM claims) WHERE fl BETWEEN 0 AND 30 AND y > 0")
_FLOOR_PAIRS = (f"SELECT a, b FROM (SELECT level AS a, lead(level) OVER (ORDER BY fl) AS b FROM (SELECT DISTINCT level, fl FROM ({_FLOOR_SRC}))) WHERE b IS NOT NULL")
_FLOOR_SQL = S.union(S.robust("robust_summary", _FLOOR_SRC), S.kruskal("kruskal", _FLOOR_SRC), S.spearman("spearman", _FLOOR_SRC, "fl"),
                     S.cliffs("cliffs_delta", _FLOOR_SRC, _FLOOR_PAIRS))


@register("floors_vs_amount", _FLOOR_SQL)
def q_floors(spark, sf):
    return _round4(D.floors_vs_amount(C(spark, sf)))


_FLAG_SRC = S.winsorized("SELECT risk_flag AS f, montant_charge_brut AS y FROM claims WHERE risk_flag IS NOT NULL AND montant_charge_brut > 0")
_FLAG_SQL = S.union(S.two_sides("summary", _FLAG_SRC), S.mann_whitney("mann_whitney", _FLAG_SRC), S.welch_log("log_ttest", _FLAG_SRC))


@register("flag_vs_amount", _FLAG_SQL)
def q_flag(spark, sf):
    return _round4(D.flag_vs_amount(C(spark, sf), "risk_flag"))


_MONTH_M = ["count", "montant_charge_brut_sum"]


def _prefixed(prefix, sql):
    return f"SELECT '{prefix}:' || part AS part, level, metric, value FROM ({sql})"


@register("comprehensive_suite", S.union(
    f"SELECT analysis AS part, level, metric, value FROM ({REGISTRY['quality_report'].sql})",
    *[_prefixed(p, REGISTRY[k].sql) for p, k in (("rga", "rga_vs_amount"), ("flag", "flag_vs_amount"), ("floors", "floors_vs_amount"))],
    f"SELECT analysis AS part, level, metric, value FROM ({S.tidy_keys('monthly', REGISTRY['monthly_series'].sql, ['ym'], _MONTH_M)})"), claims=False)
def q_comprehensive(spark, sf):
    """Quality + RGA + flag + floors + months + tests (first RGA column found
    among the candidates)."""
    d = C(spark, sf)
    rga = next(c for c in ("risque_rga_gcl", "risque_rga_gcl_detail", "risk_retraitGonflementArgile", "rga") if c in d.columns)
    named = lambda df, p: df.withColumn("part", F.concat(F.lit(f"{p}:"), F.col("part")))
    parts = [
        REGISTRY["quality_report"].build(spark, sf).withColumnRenamed("analysis", "part"),
        named(_round4(D.rga_vs_amount(d, rga, with_quantreg=False)), "rga"),
        named(_round4(D.flag_vs_amount(d, "risk_flag")), "flag"),
        named(_round4(D.floors_vs_amount(d)), "floors"),
        X.to_tidy(REGISTRY["monthly_series"].build(spark, sf), "monthly", ["ym"], _MONTH_M).withColumnRenamed("analysis", "part"),
    ]
    return X.union_all([p.select("part", "level", "metric", "value") for p in parts])


@register("quantile_regression", None)
def q_quantreg(spark, sf):
    d = C(spark, sf).withColumn("_code", F.col("nb_pieces_police").cast("double"))
    return X.quantile_regression(d, "_code", TARGET, 0.5).unionByName(X.quantile_regression(d, "_code", TARGET, 0.9))


@register("risk_segmentation", None)
def q_segmentation(spark, sf):
    return X.risk_segmentation(C(spark, sf))


def _kw_p(c):
    return f"SELECT p FROM (WITH {kruskal_sql('claims', c, 'montant_charge_brut', chi2_p('H', '(k - 1.0)'))} SELECT p FROM _kp)"


@register("stats_rollup", f"""
WITH t AS (SELECT * FROM ({REGISTRY['linear_trend'].sql})),
dm AS (SELECT month(date_sinistre) AS m, montant_charge_brut AS y FROM claims WHERE date_sinistre IS NOT NULL AND montant_charge_brut IS NOT NULL),
sm AS (SELECT CASE WHEN m IN (12, 1, 2) THEN 'Hiver' WHEN m IN (3, 4, 5) THEN 'Printemps' WHEN m IN (6, 7, 8) THEN 'Été' ELSE 'Automne' END AS s, avg(y) AS v
       FROM dm GROUP BY 1 ORDER BY v DESC, s LIMIT 1),
dep AS (SELECT substr(cpostal, 1, 2) AS d, count(*) AS n, avg(montant_charge_brut) AS m FROM claims WHERE cpostal IS NOT NULL AND montant_charge_brut IS NOT NULL
        GROUP BY 1 HAVING count(*) >= 10),
dr AS (SELECT *, row_number() OVER (ORDER BY m DESC, d) AS rm, row_number() OVER (ORDER BY n DESC, d) AS rv, sum(n) OVER () AS tot FROM dep),
cr AS ({" UNION ALL ".join(f"SELECT '{c}' AS variable, corr({c}, montant_charge_brut) FILTER (WHERE {c} IS NOT NULL AND montant_charge_brut IS NOT NULL) AS r FROM claims" for c in NUM if c != TARGET)}),
om AS (SELECT * FROM ({REGISTRY['outliers_multi'].sql})),
kw AS ({" UNION ALL ".join(_kw_p(c) for c in ("statut_sinistre", "type_mur_batiment", "risque_rga_gcl"))})
SELECT 'significant_trend' AS finding, CASE WHEN p_value < 0.05 THEN 'true' ELSE 'false' END AS label, round(slope_per_year, 4) AS value FROM t
UNION ALL SELECT 'peak_season', s, round(v, 4) FROM sm
UNION ALL SELECT 'top_department', d, round(m, 4) FROM dr WHERE rm = 1
UNION ALL SELECT 'top5_volume_pct', NULL, round(sum(n) * 100.0 / max(tot), 4) FROM dr WHERE rv <= 5
UNION ALL SELECT 'strongest_correlation', variable, round(r, 4) FROM (SELECT * FROM cr ORDER BY abs(r) DESC, variable LIMIT 1)
UNION ALL SELECT 'outlier_severity', severity, round(iqr_rate_pct, 4) FROM om
UNION ALL SELECT 'significant_tests', NULL, CAST(count(*) FILTER (WHERE p < 0.05) AS DOUBLE) FROM kw""")
def q_rollup(spark, sf):
    return _round4(X.stats_rollup(C(spark, sf)))


_CATALOGUE = {
    "contrat": ["prime", "engagements", "statut_sinistre"],
    "batiment": ["surface_police", "surface_batiment", "nb_etages_batiment", "nb_pieces_police", "annee_construction_batiment",
                 "type_mur_batiment"],
    "climat": ["weather_precip_mean", "weather_temp_mean"],
    "risque": ["risque_rga_gcl", "risk_flag", "risk_seisme"],
    "sol": ["compo_sol_has_argile", "dem_altitude"],
}
# Importance class of each catalogue group: a choice of this example.
_IMPORTANCE = {"contrat": "haute", "batiment": "haute", "climat": "critique", "risque": "critique", "sol": "moyenne"}


def _avail_sql():
    rows = ", ".join(f"('{g}', '{v}')" for g, vs in _CATALOGUE.items() for v in vs)
    present = [v for vs in _CATALOGUE.values() for v in vs if v in NUM + ["statut_sinistre", "type_mur_batiment", "risque_rga_gcl", "risk_flag"]]
    comp = " UNION ALL ".join(f"SELECT '{v}' AS variable, count({v}) * 100.0 / count(*) AS c FROM claims" for v in present)
    imp = ", ".join(f"('{g}', '{v}')" for g, v in _IMPORTANCE.items())
    return f"""WITH cat(grp, variable) AS (VALUES {rows}), comp AS ({comp}), imp(grp, importance) AS (VALUES {imp}),
j AS (SELECT cat.grp, comp.c FROM cat LEFT JOIN comp USING (variable)),
g AS (SELECT grp, count(*) AS expected, sum(CASE WHEN coalesce(c > 0, false) THEN 1 ELSE 0 END) AS available, avg(c) AS mc FROM j GROUP BY grp)
SELECT g.grp, CAST(expected AS BIGINT) AS expected, CAST(available AS BIGINT) AS available, round(mc, 4) AS mean_completeness,
       CAST(expected - available AS BIGINT) AS missing, round(available * 1.0 / expected, 4) AS rate, imp.importance,
       available * 1.0 / expected > 0.5 AS ready FROM g LEFT JOIN imp USING (grp)"""


@register("variable_availability", _avail_sql())
def q_availability(spark, sf):
    return rnd(X.variable_availability(C(spark, sf), _CATALOGUE, _IMPORTANCE), 4)


def _importance_sql():
    """Every score by its definition over the rows."""
    y, parts = "montant_charge_brut", []
    numeric = set(NUM)
    flags = {"risk_flag"}
    for g, vs in _CATALOGUE.items():
        for v in vs:
            if v not in numeric | flags | {"statut_sinistre", "type_mur_batiment", "risque_rga_gcl"}:
                continue
            if v in numeric:
                kind, score = "abs_pearson", f"(SELECT coalesce(abs(corr({v}, {y})), 0) FROM claims WHERE {v} IS NOT NULL AND {y} IS NOT NULL)"
            else:
                kind = "abs_t" if v in flags else "anova_f"
                root = "sqrt(f)" if v in flags else "f"
                limit = "true" if v in flags else f"(SELECT count(DISTINCT {v}) FROM claims) <= 10"
                score = f"""(SELECT CASE WHEN k >= 2 AND {limit} AND {f_p('f', '(k - 1.0)', '(n - k + 0.0)')} < 0.05 THEN {root} ELSE 0 END FROM
 (SELECT k, n, (b / (k - 1)) / (w / (n - k)) AS f FROM (SELECT count(*) AS k, sum(c) AS n, sum(c * (m - gm) * (m - gm)) AS b, sum(s2) AS w FROM
  (SELECT *, sum(c * m) OVER () / sum(c) OVER () AS gm FROM (SELECT count(*) AS c, avg({y}) AS m, var_pop({y}) * count(*) AS s2 FROM claims
   WHERE {v} IS NOT NULL AND {y} IS NOT NULL GROUP BY {v} HAVING count(*) >= 3)))))"""
            parts.append(f"SELECT '{g}' AS grp, '{v}' AS variable, '{kind}' AS kind, CAST({score} AS DOUBLE) AS score, "
                         f"(SELECT count({v}) * 100.0 / count(*) FROM claims) AS completeness_pct, (SELECT count(DISTINCT {v}) FROM claims) AS distinct_n")
    return "WITH _v AS (" + " UNION ALL ".join(parts) + """),
_g AS (SELECT grp, avg(score) AS m, max(score) AS x, row_number() OVER (ORDER BY avg(score) DESC, grp) AS r FROM _v GROUP BY grp)
SELECT grp, variable, kind, round(score, 6) AS score, round(completeness_pct, 6) AS completeness_pct, CAST(distinct_n AS BIGINT) AS "distinct",
       CAST(row_number() OVER (ORDER BY score DESC, variable) AS INTEGER) AS rank, round(m, 6) AS group_mean_score, round(x, 6) AS group_max_score,
       CAST(r AS INTEGER) AS group_rank FROM _v JOIN _g USING (grp)"""


@register("variable_importance", _importance_sql())
def q_importance_vars(spark, sf):
    return rnd(X.variable_importance(C(spark, sf), _CATALOGUE), 6)


_AGE = "SELECT 2025.0 - annee_construction_batiment AS a, montant_charge_brut AS y FROM claims WHERE annee_construction_batiment IS NOT NULL AND montant_charge_brut IS NOT NULL AND 2025 - annee_construction_batiment BETWEEN 0 AND 200"


@register("insight_rules", """
WITH q AS (SELECT quantile_cont(montant_charge_brut, 0.25) AS q1, quantile_cont(montant_charge_brut, 0.5) AS med,
                  quantile_cont(montant_charge_brut, 0.75) AS q3, avg(montant_charge_brut) AS mean,
                  corr(weather_precip_mean, montant_charge_brut) FILTER (WHERE weather_precip_mean IS NOT NULL AND montant_charge_brut IS NOT NULL) AS rp,
                  corr(weather_temp_mean, montant_charge_brut) FILTER (WHERE weather_temp_mean IS NOT NULL AND montant_charge_brut IS NOT NULL) AS rt FROM claims),
o AS (SELECT count(*) FILTER (WHERE montant_charge_brut < q1 - 1.5 * (q3 - q1) OR montant_charge_brut > q3 + 1.5 * (q3 - q1)) * 1.0 / count(*) AS orate
      FROM claims, q WHERE montant_charge_brut IS NOT NULL),
c AS (SELECT count(*) FILTER (WHERE abs(r) >= 0.3) AS n_strong FROM (""" + " UNION ALL ".join(
    f"SELECT corr({c}, montant_charge_brut) FILTER (WHERE {c} IS NOT NULL AND montant_charge_brut IS NOT NULL) AS r FROM claims"
    for c in NUM if c != TARGET) + f""")),
k AS (SELECT value AS p FROM ({REGISTRY['climate_precip'].sql}) WHERE part = 'kruskal' AND metric = 'p_value'),
ar AS (SELECT corr(rx, ry) AS rho, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {avg_rank('a')} AS rx, {avg_rank('y')} AS ry FROM ({_AGE}))),
ap AS (SELECT rho, {corr_p('rho', 'n')} AS p FROM ar),
dm AS (SELECT month(date_sinistre) AS m, montant_charge_brut AS y FROM claims WHERE date_sinistre IS NOT NULL AND montant_charge_brut IS NOT NULL),
mm AS (SELECT m, avg(y) AS v FROM dm GROUP BY m ORDER BY v DESC, m LIMIT 3),
sm AS (SELECT CASE WHEN m IN (12, 1, 2) THEN 'Hiver' WHEN m IN (3, 4, 5) THEN 'Printemps' WHEN m IN (6, 7, 8) THEN 'Été' ELSE 'Automne' END AS s, avg(y) AS v
       FROM dm GROUP BY 1 ORDER BY v DESC, s LIMIT 1)
SELECT 'precip_negative_correlation' AS rule, coalesce(rp < -0.2, false) AS fired, round(rp, 6) AS value, CAST(NULL AS VARCHAR) AS label FROM q
UNION ALL SELECT 'temp_positive_correlation', coalesce(rt > 0.2, false), round(rt, 6), NULL FROM q
UNION ALL SELECT 'precip_classes_differ', coalesce(p < 0.05, false), round(p, 4), NULL FROM k
UNION ALL SELECT 'age_rank_correlation', coalesce(abs(rho) > 0.2 AND p < 0.05, false), round(rho, 6), NULL FROM ap
UNION ALL SELECT 'strong_correlations', n_strong > 0, CAST(n_strong AS DOUBLE), NULL FROM c
UNION ALL SELECT 'mean_above_median', mean > 1.1 * med, round(mean / med, 6), NULL FROM q
UNION ALL SELECT 'outliers_above_5pct', orate > 0.05, round(orate, 6), NULL FROM o
UNION ALL SELECT 'peak_season', true, round(v, 6), s FROM sm
UNION ALL SELECT 'peak_months', true, round(max(v), 6), string_agg(CAST(m AS VARCHAR), ',' ORDER BY v DESC, m) FROM mm""")
def q_insights(spark, sf):
    places = F.when(F.col("rule") == "precip_classes_differ", F.round("value", 4)).otherwise(F.round("value", 6))
    return X.insight_rules(C(spark, sf)).withColumn("value", places)


# the claims view's columns and types
_TYPES = ({c: "string" for c in ("police", "cod_sin", "statut_sinistre", "risque_rga_gcl", "type_mur_batiment", "cpostal", "ville", "est_dans_sin_cluster")}
          | {c: "double" for c in NUM})
_AMOUNTS = {"nb_etages_batiment": "bigint", "nb_pieces_police": "int", "annee_construction_batiment": "bigint"}


def _dictionary_sql():
    text = lambda c: f"CAST({c} AS VARCHAR)"
    types = _TYPES | _AMOUNTS | _OTHERS
    long = " UNION ALL ".join(f"SELECT '{c}' AS variable, {text(c)} AS v FROM claims" for c in _DICTIONARY)
    number = lambda c: c in NUM
    stats = " UNION ALL ".join(
        f"SELECT '{c}' AS variable, '{types[c]}' AS dtype, count({c}) AS nn, count(*) AS rows, "
        + ", ".join(f"{f'CAST({fn}({c}) AS DOUBLE)' if number(c) else 'CAST(NULL AS DOUBLE)'} AS {name}"
                    for fn, name in (("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_samp", "std"))) + " FROM claims" for c in _DICTIONARY)
    return f"""WITH l AS ({long}),
vc AS (SELECT variable, v, count(*) AS c FROM l WHERE v IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY c DESC, v) AS rn FROM vc),
t AS (SELECT variable, string_agg(v || ' (' || CAST(c AS VARCHAR) || ')', ', ' ORDER BY rn) AS top_values FROM r WHERE rn <= 3 GROUP BY 1),
d AS (SELECT variable, count(*) AS distinct FROM vc GROUP BY 1),
s AS ({stats})
SELECT s.variable, dtype, CAST(nn AS BIGINT) AS non_null, CAST(rows - nn AS BIGINT) AS null, round((rows - nn) * 100.0 / rows, 4) AS null_pct,
       CAST(d.distinct AS BIGINT) AS distinct, round(min, 4) AS min, round(max, 4) AS max, round(mean, 4) AS mean, round(std, 4) AS std, top_values
FROM s LEFT JOIN d USING (variable) LEFT JOIN t USING (variable)"""


_OTHERS = {"date_sinistre": "timestamp_ntz", "date_cloture_sinistre": "timestamp_ntz", "risk_flag": "boolean"}
_DICTIONARY = [*_TYPES, *_OTHERS]


@register("data_dictionary", _dictionary_sql())
def q_dictionary(spark, sf):
    return rnd(profile.data_dictionary(C(spark, sf)), 4)


_CLEAN_NUM = ["montant_charge_brut", "prime", "engagements", "surface_police", "surface_batiment", "nb_etages_batiment",
              "nb_pieces_police", "annee_construction_batiment", "weather_precip_mean", "weather_temp_mean"]


def _clean_sql():
    qs = ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in _CLEAN_NUM)
    clipped = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(CAST({c} AS DOUBLE), {c}_lo), {c}_hi) END AS {c}" for c in _CLEAN_NUM)
    meds = ", ".join(f"quantile_cont({c}, 0.5) AS {c}_m" for c in _CLEAN_NUM)
    filled = ", ".join(f"round(coalesce({c}, {c}_m), 4) AS {c}" for c in _CLEAN_NUM)
    return f"""WITH q AS (SELECT {qs} FROM claims),
c AS (SELECT cod_sin, police, cpostal, date_sinistre, date_cloture_sinistre, statut_sinistre, risque_rga_gcl, type_mur_batiment, ville,
             est_dans_sin_cluster, {clipped} FROM claims, q),
m AS (SELECT {meds} FROM c),
f AS (SELECT cod_sin, police, cpostal, date_sinistre, date_cloture_sinistre,
             upper(trim(coalesce(statut_sinistre, 'Inconnu'))) AS statut_sinistre, upper(trim(coalesce(risque_rga_gcl, 'Inconnu'))) AS risque_rga_gcl,
             upper(trim(coalesce(type_mur_batiment, 'Inconnu'))) AS type_mur_batiment, upper(trim(coalesce(ville, 'Inconnu'))) AS ville,
             upper(trim(coalesce(est_dans_sin_cluster, 'Inconnu'))) AS est_dans_sin_cluster, {filled} FROM c, m)
SELECT *, CASE WHEN annee_construction_batiment IS NULL THEN NULL ELSE greatest(2025.0 - annee_construction_batiment, 0.0) END AS age_batiment,
  CAST(floor((epoch_us(date_cloture_sinistre) - epoch_us(date_sinistre)) / 86400e6) AS INTEGER) AS delai_cloture_jours,
  CAST(year(date_sinistre) AS INTEGER) AS annee_sinistre,
  CASE WHEN month(date_sinistre) IN (3, 4, 5) THEN 'PRINTEMPS' WHEN month(date_sinistre) IN (6, 7, 8) THEN 'ETE'
       WHEN month(date_sinistre) IN (9, 10, 11) THEN 'AUTOMNE' WHEN month(date_sinistre) IN (12, 1, 2) THEN 'HIVER' END AS saison_sinistre,
  CASE WHEN greatest(2025.0 - annee_construction_batiment, 0.0) BETWEEN 0 AND 20 THEN 'RÉCENT' WHEN greatest(2025.0 - annee_construction_batiment, 0.0) <= 40 THEN 'MODERNE'
       WHEN greatest(2025.0 - annee_construction_batiment, 0.0) <= 60 THEN 'ANCIEN' WHEN greatest(2025.0 - annee_construction_batiment, 0.0) > 60 THEN 'TRÈS ANCIEN' END AS classe_age,
  CASE WHEN surface_police >= 0 AND surface_police <= 80 THEN 'PETITE' WHEN surface_police > 80 AND surface_police <= 120 THEN 'MOYENNE'
       WHEN surface_police > 120 AND surface_police <= 180 THEN 'GRANDE' WHEN surface_police > 180 THEN 'TRÈS GRANDE' END AS classe_surface,
  substr(CASE WHEN length(trim(cpostal)) < 5 THEN lpad(trim(cpostal), 5, '0') ELSE trim(cpostal) END, 1, 2) AS region_code
FROM f"""


@register("clean_claims", _clean_sql())
def q_clean(spark, sf):
    d = C(spark, sf).select("cod_sin", "police", "cpostal", "date_sinistre", "date_cloture_sinistre", "statut_sinistre", "risque_rga_gcl",
                            "type_mur_batiment", "ville", "est_dans_sin_cluster", *_CLEAN_NUM)
    out = X.clean_claims(d)
    return out.select(*[F.round(c, 4).alias(c) if c in _CLEAN_NUM else F.col(c) for c in out.columns])
