"""Aggregation keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, ranks, summary
from ..operators.groupdist import binary_summary, distribution_by_group, group_robust_summary
from ..operators.lookup import RGA_ORDER
from . import register
from .common import C, TARGET

NUM = ["montant_charge_brut", "prime", "engagements", "surface_police", "surface_batiment", "nb_etages_batiment",
       "nb_pieces_police", "annee_construction_batiment", "weather_precip_mean", "weather_temp_mean"]
TXT = ["police", "cod_sin", "statut_sinistre", "risque_rga_gcl", "type_mur_batiment", "cpostal", "ville",
       "est_dans_sin_cluster"]


def rnd(df, digits=4, skip=()):
    """Round every double column (the same rounding is applied in the SQL)."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" and c not in skip else F.col(c)
                       for c, t in df.dtypes])


def _union(cols, body):
    return "\nUNION ALL\n".join(body.format(c=c) for c in cols)


@register("group_stats", """
SELECT risque_rga_gcl, CAST(count(montant_charge_brut) AS BIGINT) AS count,
       round(avg(montant_charge_brut), 4) AS mean,
       round(quantile_cont(montant_charge_brut, 0.5), 4) AS median,
       round(stddev_samp(montant_charge_brut), 4) AS std,
       round(min(montant_charge_brut), 4) AS min, round(max(montant_charge_brut), 4) AS max,
       round(count(montant_charge_brut) * 100.0 / sum(count(montant_charge_brut)) OVER (), 1) AS percentage
FROM claims WHERE risque_rga_gcl IS NOT NULL AND montant_charge_brut IS NOT NULL
GROUP BY risque_rga_gcl""")
def q_group_stats(spark, sf):
    return rnd(summary.group_stats(C(spark, sf), "risque_rga_gcl", TARGET, digits=None), 4, skip=("percentage",))


_DESC = """SELECT '{c}' AS variable, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 4) AS mean,
 round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
 round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max,
 CAST(count(*) - count({c}) AS BIGINT) AS missing_count, round((count(*) - count({c})) * 100.0 / count(*), 4) AS missing_percent,
 round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis,
 round(CASE WHEN avg({c}) <> 0 THEN stddev_samp({c}) / avg({c}) END, 4) AS cv,
 round(quantile_cont({c}, 0.05), 4) AS q05, round(quantile_cont({c}, 0.95), 4) AS q95,
 round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr FROM claims"""


@register("describe_numeric", _union(NUM, _DESC))
def q_describe_numeric(spark, sf):
    return rnd(profile.describe_numeric(C(spark, sf), NUM))


_BASIC = """SELECT '{c}' AS variable, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 4) AS mean,
 round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
 round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max
 FROM claims"""


@register("describe_basic", _union(NUM, _BASIC))
def q_describe_basic(spark, sf):
    return rnd(profile.describe_numeric(C(spark, sf), NUM, full=False))


_PCTS = [1, 5, 10, 25, 50, 75, 90, 95, 99]


@register("target_distribution", f"""
WITH d AS (SELECT montant_charge_brut AS x FROM claims WHERE montant_charge_brut IS NOT NULL),
m AS (SELECT x AS mode FROM d GROUP BY x ORDER BY count(*) DESC, x LIMIT 1),
s AS (SELECT count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, var_samp(x) AS var, skewness(x) AS sk, kurtosis(x) AS ku,
      {", ".join(f"quantile_cont(x, {p / 100}) AS p{p}" for p in _PCTS)} FROM d),
c AS (SELECT avg(power(x - mean, 2)) AS c2, avg(power(x - mean, 3)) AS c3, avg(power(x - mean, 4)) AS c4 FROM d, s),
j AS (SELECT n / 6.0 * (power(c3 / power(c2, 1.5), 2) + power(c4 / (c2 * c2) - 3, 2) / 4) AS jb FROM c, s)
SELECT CAST(n AS BIGINT) AS count, round(mean, 4) AS mean, round(p50, 4) AS median, round(mode, 4) AS mode, round(std, 4) AS std,
       round(var, 4) AS var, round(sk, 4) AS skewness, round(ku, 4) AS kurtosis,
       {", ".join(f"round(p{p}, 4) AS p{p}" for p in _PCTS)},
       ku > 3 AS heavy_tails, sk > 1 AS right_skewed, round((p90 - p10) / p50, 4) AS concentration_ratio,
       round(jb, 4) AS jarque_bera, round(exp(-jb / 2), 4) AS jarque_bera_p
FROM s, m, j""")
def q_target_distribution(spark, sf):
    return rnd(profile.target_distribution(C(spark, sf), TARGET))


@register("target_quality_stats", """
SELECT CAST(count(montant_charge_brut) AS BIGINT) AS count, round(avg(montant_charge_brut), 4) AS mean,
       round(quantile_cont(montant_charge_brut, 0.5), 4) AS median, round(stddev_samp(montant_charge_brut), 4) AS std,
       round(min(montant_charge_brut), 4) AS min, round(max(montant_charge_brut), 4) AS max,
       round(quantile_cont(montant_charge_brut, 0.25), 4) AS q25, round(quantile_cont(montant_charge_brut, 0.75), 4) AS q75
FROM claims""")
def q_target_quality(spark, sf):
    s = summary.summarize(C(spark, sf), TARGET, (), ("count", "mean", "std", "min", "max"),
                          {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return rnd(s.withColumn("count", F.col("count").cast("bigint")))


# amount-like columns found by name keywords at plan time
_AMOUNT_KEYS = ("montant", "charge", "prime", "engagement")
_CAND = [c for c in NUM if any(k in c for k in _AMOUNT_KEYS)]


@register("target_candidate_stats", _union(_CAND, """SELECT '{c}' AS variable, CAST(count({c}) AS BIGINT) AS non_null,
 round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(min({c}), 4) AS min, round(max({c}), 4) AS max
 FROM claims"""))
def q_target_candidates(spark, sf):
    df = C(spark, sf)
    cols = [c for c in profile.numeric_columns(df) if any(k in c for k in _AMOUNT_KEYS)]
    d = profile.describe_numeric(df, cols, full=False)
    return rnd(d.select("variable", F.col("count").alias("non_null"), "mean", "median", "min", "max"))


@register("group_stats_tail", """
SELECT type_mur_batiment, CAST(count(montant_charge_brut) AS BIGINT) AS count, round(avg(montant_charge_brut), 4) AS mean,
       round(quantile_cont(montant_charge_brut, 0.5), 4) AS median, round(stddev_samp(montant_charge_brut), 4) AS std,
       round(quantile_cont(montant_charge_brut, 0.9), 4) AS p90, round(quantile_cont(montant_charge_brut, 0.95), 4) AS p95
FROM claims WHERE type_mur_batiment IS NOT NULL AND montant_charge_brut IS NOT NULL GROUP BY type_mur_batiment""")
def q_group_stats_tail(spark, sf):
    d = C(spark, sf).where(F.col("type_mur_batiment").isNotNull() & F.col(TARGET).isNotNull())
    s = summary.summarize(d, TARGET, ["type_mur_batiment"], ("count", "mean", "std"),
                          {"median": 0.5, "p90": 0.9, "p95": 0.95})
    return rnd(s.withColumn("count", F.col("count").cast("bigint")))


_DIST_SQL = """
WITH d0 AS (SELECT lower(risque_rga_gcl) AS g, montant_charge_brut AS x FROM claims
            WHERE risque_rga_gcl IS NOT NULL AND montant_charge_brut IS NOT NULL AND montant_charge_brut > 0
              AND lower(risque_rga_gcl) IN ('faible', 'moyen', 'fort', 'maximal')),
f AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM d0),
d AS (SELECT g, least(greatest(x, lo), hi) AS x FROM d0, f)
SELECT g AS "group", CAST(count(*) AS BIGINT) AS n, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median,
       round(stddev_samp(x), 4) AS std, round(skewness(x), 4) AS skewness, round(kurtosis(x), 4) AS kurtosis,
       round(quantile_cont(x, 0.05), 4) AS p05, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.9), 4) AS p90,
       round(quantile_cont(x, 0.95), 4) AS p95, round(quantile_cont(x, 0.99), 4) AS p99,
       kurtosis(x) > 3 AS heavy_tails, skewness(x) > 1 AS right_skewed,
       round((quantile_cont(x, 0.9) - quantile_cont(x, 0.1)) / quantile_cont(x, 0.5), 4) AS concentration_ratio,
       CASE g WHEN 'faible' THEN 0 WHEN 'moyen' THEN 1 WHEN 'fort' THEN 2 WHEN 'maximal' THEN 3 END AS ord
FROM d GROUP BY g HAVING count(*) >= 20"""


@register("distribution_by_group", _DIST_SQL)
def q_distribution_by_group(spark, sf):
    return rnd(distribution_by_group(C(spark, sf), TARGET, "risque_rga_gcl", order=RGA_ORDER))


@register("trimmed_mean", """
WITH d AS (SELECT type_mur_batiment AS g, montant_charge_brut AS x,
                  row_number() OVER (PARTITION BY type_mur_batiment ORDER BY montant_charge_brut) - 1 AS pos,
                  count(*) OVER (PARTITION BY type_mur_batiment) AS n
           FROM claims WHERE type_mur_batiment IS NOT NULL AND montant_charge_brut IS NOT NULL)
SELECT g AS type_mur_batiment, round(avg(x), 4) AS trimmed_mean FROM d
WHERE n < 20 OR (pos >= floor(n * 0.05) AND pos < greatest(floor(n * 0.95), 1))
GROUP BY g""")
def q_trimmed_mean(spark, sf):
    d = C(spark, sf).where(F.col("type_mur_batiment").isNotNull())
    return rnd(ranks.trimmed_means(d, TARGET, ["type_mur_batiment"]))


@register("group_robust_summary", """
WITH d AS (SELECT risque_rga_gcl AS g, montant_charge_brut AS x,
                  row_number() OVER (PARTITION BY risque_rga_gcl ORDER BY montant_charge_brut) - 1 AS pos,
                  count(*) OVER (PARTITION BY risque_rga_gcl) AS n
           FROM claims WHERE risque_rga_gcl IS NOT NULL AND montant_charge_brut IS NOT NULL),
t AS (SELECT g, avg(x) AS tm FROM d WHERE n < 20 OR (pos >= floor(n * 0.05) AND pos < greatest(floor(n * 0.95), 1)) GROUP BY g)
SELECT d.g AS risque_rga_gcl, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(x, 0.5), 4) AS median,
       round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr, round(any_value(t.tm), 4) AS trimmed_mean,
       round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std
FROM d JOIN t ON d.g = t.g GROUP BY d.g""")
def q_group_robust(spark, sf):
    return rnd(group_robust_summary(C(spark, sf), "risque_rga_gcl", TARGET))


@register("value_counts", """
SELECT ville, CAST(count(*) AS BIGINT) AS count FROM claims GROUP BY ville""")
def q_value_counts(spark, sf):
    return profile.value_counts(C(spark, sf), "ville")


def _by_level(rows: str, cols, max_levels: int, max_cols: int) -> str:
    """``rows`` for the text columns that the selection rule takes, the rule
    being worked out in SQL: the first ``max_cols`` with few enough levels."""
    rule = " UNION ALL ".join(f"SELECT {i} AS place, '{c}' AS variable, count(DISTINCT {c}) AS k FROM claims" for i, c in enumerate(cols))
    return f"""WITH _k AS ({rule}), _s AS (SELECT variable FROM _k WHERE k BETWEEN 1 AND {max_levels} ORDER BY place LIMIT {max_cols}),
_a AS ({" UNION ALL ".join(rows.format(c=c) for c in cols)})
SELECT _a.* FROM _a JOIN _s USING (variable)"""


_TEXT = ["police", "cod_sin", "statut_sinistre", "risque_rga_gcl", "type_mur_batiment", "cpostal", "ville", "est_dans_sin_cluster"]


@register("categorical_profile", _by_level("""SELECT '{c}' AS variable, {c} AS level, CAST(count(*) AS BIGINT) AS count,
 round(avg(montant_charge_brut), 4) AS target_mean, CAST(count(montant_charge_brut) AS BIGINT) AS target_count FROM claims GROUP BY {c}""", _TEXT, 49, 10))
def q_categorical_profile(spark, sf):
    return rnd(profile.categorical_profile(C(spark, sf), TARGET, max_cols=10, max_levels=50))


@register("category_means", _by_level("""SELECT '{c}' AS variable, {c} AS level, round(avg(montant_charge_brut), 4) AS mean,
 CAST(count(montant_charge_brut) AS BIGINT) AS count FROM claims WHERE {c} IS NOT NULL GROUP BY {c}""", _TEXT, 10, 4))
def q_category_means(spark, sf):
    return rnd(profile.category_means(C(spark, sf), TARGET, max_levels=10, max_cols=4))


@register("distinct_counts", _union(NUM + TXT, "SELECT '{c}' AS variable, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct FROM claims"))
def q_distinct_counts(spark, sf):
    return profile.distinct_counts(C(spark, sf), NUM + TXT)


_ALL = NUM + TXT + ["date_sinistre", "date_cloture_sinistre", "risk_flag"]


@register("missing_profile", _union(_ALL, """SELECT '{c}' AS variable, CAST(count({c}) AS BIGINT) AS non_null,
 CAST(count(*) - count({c}) AS BIGINT) AS missing, round(count({c}) * 100.0 / count(*), 4) AS completeness_pct FROM claims"""))
def q_missing_profile(spark, sf):
    return rnd(profile.missing_profile(C(spark, sf).select(*_ALL)))


@register("dataset_overview", f"""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(21 AS BIGINT) AS columns, CAST(10 AS BIGINT) AS numeric_columns,
       CAST(8 AS BIGINT) AS text_columns,
       CAST({" + ".join(f"(count(*) - count({c}))" for c in _ALL)} AS BIGINT) AS missing_cells,
       round(avg(montant_charge_brut), 4) AS target_mean, round(sum(montant_charge_brut), 4) AS target_sum,
       min(date_sinistre) AS period_start, max(date_sinistre) AS period_end,
       CAST(date_diff('day', min(date_sinistre), max(date_sinistre)) AS BIGINT) AS duration_days
FROM claims""")
def q_dataset_overview(spark, sf):
    return rnd(profile.dataset_overview(C(spark, sf), TARGET, "date_sinistre"), 4)


@register("binary_summary", """
WITH d AS (SELECT risk_flag AS f, montant_charge_brut AS x,
                  row_number() OVER (PARTITION BY risk_flag ORDER BY montant_charge_brut) - 1 AS pos,
                  count(*) OVER (PARTITION BY risk_flag) AS n
           FROM claims WHERE risk_flag IS NOT NULL AND montant_charge_brut IS NOT NULL),
t AS (SELECT f, avg(x) AS tm FROM d WHERE n < 20 OR (pos >= floor(n * 0.05) AND pos < greatest(floor(n * 0.95), 1)) GROUP BY f),
s AS (SELECT f, count(*) AS n, avg(x) AS m, quantile_cont(x, 0.5) AS med,
             quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM d GROUP BY f)
SELECT CAST(max(n) FILTER (WHERE NOT s.f) AS BIGINT) AS n_false, CAST(max(n) FILTER (WHERE s.f) AS BIGINT) AS n_true,
       round(max(med) FILTER (WHERE NOT s.f), 4) AS median_false, round(max(med) FILTER (WHERE s.f), 4) AS median_true,
       round(max(iqr) FILTER (WHERE NOT s.f), 4) AS iqr_false, round(max(iqr) FILTER (WHERE s.f), 4) AS iqr_true,
       round(max(tm) FILTER (WHERE NOT s.f), 4) AS mean_trimmed_false, round(max(tm) FILTER (WHERE s.f), 4) AS mean_trimmed_true,
       round(max(med) FILTER (WHERE s.f) - max(med) FILTER (WHERE NOT s.f), 4) AS median_diff,
       round(max(m) FILTER (WHERE s.f) / max(m) FILTER (WHERE NOT s.f), 4) AS ratio_means
FROM s JOIN t ON s.f = t.f""")
def q_binary_summary(spark, sf):
    return rnd(binary_summary(C(spark, sf), "risk_flag", TARGET))
