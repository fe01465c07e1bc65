"""Windows, sorts, top-k keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import department
from ..operators import correlation, profile, summary, topk
from ..operators.lookup import RGA_ORDER, dimension
from . import register
from .common import C, TARGET
from .q_aggregates import NUM, rnd

NUM_X = [c for c in NUM if c != TARGET]


@register("topk_groups", """
WITH g AS (SELECT substr(CASE WHEN length(trim(cpostal)) < 5 THEN lpad(trim(cpostal), 5, '0') ELSE trim(cpostal) END, 1, 2) AS dept,
                  count(*) AS n, avg(montant_charge_brut) AS mean FROM claims GROUP BY 1 HAVING count(*) >= 10)
SELECT dept, CAST(n AS BIGINT) AS n, round(mean, 4) AS mean FROM g ORDER BY mean DESC, dept LIMIT 3""")
def q_topk_groups(spark, sf):
    d = C(spark, sf).withColumn("dept", department("cpostal"))
    g = d.groupBy("dept").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.avg(TARGET).alias("mean")).where(F.col("n") >= 10)
    return rnd(topk.topk(g, 3, [F.desc("mean"), F.asc("dept")]))


@register("topk_values", """
SELECT cod_sin, montant_charge_brut FROM claims ORDER BY montant_charge_brut DESC, cod_sin LIMIT 10""")
def q_topk_values(spark, sf):
    return topk.topk(C(spark, sf).select("cod_sin", TARGET), 10, [F.desc(TARGET), F.asc("cod_sin")])


def _corr_sql(cols, threshold=None, limit=None):
    parts = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS variable, corr({c}, montant_charge_brut) FILTER (WHERE {c} IS NOT NULL AND montant_charge_brut IS NOT NULL) AS r, "
        f"count({c}) AS n, count(*) AS rows FROM claims" for c in cols)
    where = f"WHERE abs(r) >= {threshold}" if threshold is not None else ""
    lim = f"ORDER BY abs(r) DESC, variable LIMIT {limit}" if limit else ""
    return f"""WITH s AS ({parts})
SELECT variable, round(abs(r), 6) AS correlation_abs, round(r, 6) AS correlation, CAST(n AS BIGINT) AS data_count,
  round((rows - n) * 100.0 / rows, 2) AS missing_pct,
  CASE WHEN abs(r) <= 0 THEN NULL WHEN abs(r) <= 0.1 THEN 'Très faible' WHEN abs(r) <= 0.3 THEN 'Faible' WHEN abs(r) <= 0.5 THEN 'Modérée'
       WHEN abs(r) <= 0.7 THEN 'Forte' ELSE 'Très forte' END AS correlation_strength FROM s {where} {lim}"""


@register("top_correlations", _corr_sql(NUM_X, None, 5))
def q_top_corr(spark, sf):
    c = correlation.corr_with_target(C(spark, sf), TARGET, NUM_X, threshold=0.0)
    return rnd(topk.topk(c, 5, [F.desc("correlation_abs"), F.asc("variable")]), 6, skip=("missing_pct",))


@register("sort_by_order", """
WITH lv(level, ord) AS (VALUES ('faible', 0), ('moyen', 1), ('fort', 2), ('maximal', 3))
SELECT lv.ord, risque_rga_gcl, CAST(count(*) AS BIGINT) AS n, round(avg(montant_charge_brut), 4) AS mean
FROM claims JOIN lv ON lv.level = claims.risque_rga_gcl GROUP BY lv.ord, risque_rga_gcl ORDER BY lv.ord""")
def q_sort_by_order(spark, sf):
    d = C(spark, sf)
    g = d.groupBy("risque_rga_gcl").agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.avg(TARGET).alias("mean"))
    dim = dimension(spark, RGA_ORDER, "risque_rga_gcl", "ord")
    return rnd(g.join(F.broadcast(dim), "risque_rga_gcl").select("ord", "risque_rga_gcl", "n", "mean").orderBy("ord"))


# variable catalogue: group of each numeric variable (a small dimension)
CATALOGUE = {
    "prime": "contrat", "engagements": "contrat",
    "surface_police": "batiment", "surface_batiment": "batiment", "nb_etages_batiment": "batiment",
    "nb_pieces_police": "batiment", "annee_construction_batiment": "batiment",
    "weather_precip_mean": "climat", "weather_temp_mean": "climat",
}


def _topn_sql():
    parts = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS variable, round(abs(corr({c}, montant_charge_brut) FILTER (WHERE {c} IS NOT NULL AND montant_charge_brut IS NOT NULL)), 6) AS correlation_abs FROM claims"
        for c in CATALOGUE)
    cat = ", ".join(f"('{k}', '{v}')" for k, v in CATALOGUE.items())
    return f"""WITH cat(variable, grp) AS (VALUES {cat}), c AS ({parts}),
r AS (SELECT cat.grp, c.variable, c.correlation_abs,
             row_number() OVER (PARTITION BY cat.grp ORDER BY c.correlation_abs DESC, c.variable) AS rank FROM c JOIN cat USING (variable))
SELECT grp, variable, correlation_abs, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""


@register("topn_per_group", _topn_sql())
def q_topn_per_group(spark, sf):
    c = correlation.corr_with_target(C(spark, sf), TARGET, list(CATALOGUE), threshold=0.0)
    cat = spark.createDataFrame(list(CATALOGUE.items()), "variable string, grp string")
    j = rnd(c, 6, skip=("missing_pct",)).join(F.broadcast(cat), "variable")
    return topk.topn_per_group(j, "grp", 3, [F.desc("correlation_abs"), F.asc("variable")]).select(
        "grp", "variable", "correlation_abs", "rank")


@register("stack_metrics", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, 'mean' AS metric, round(avg({c}), 4) AS value FROM claims UNION ALL "
    f"SELECT '{c}', 'q05', round(quantile_cont({c}, 0.05), 4) FROM claims UNION ALL "
    f"SELECT '{c}', 'missing_count', CAST(count(*) - count({c}) AS DOUBLE) FROM claims" for c in ["montant_charge_brut", "prime"]))
def q_stack(spark, sf):
    d = profile.describe_numeric(C(spark, sf), ["montant_charge_brut", "prime"])
    base = d.select("variable", F.lit("mean").alias("metric"), F.col("mean").alias("value"))
    extra = d.select("variable", F.lit("q05").alias("metric"), F.col("q05").alias("value")).unionByName(
        d.select("variable", F.lit("missing_count").alias("metric"), F.col("missing_count").cast("double").alias("value")))
    return rnd(base.unionByName(extra))
