"""Feature engineering and model keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, models, profile
from . import register
from .common import C, TARGET
from .q_aggregates import rnd

NUMF = ["prime", "engagements", "surface_police", "nb_pieces_police", "weather_precip_mean", "weather_temp_mean"]
CATF = ["type_mur_batiment", "statut_sinistre", "risque_rga_gcl", "ville"]
BOOLF = ["risk_flag"]


@register("encode_label", """
WITH c AS (SELECT cod_sin, type_mur_batiment, statut_sinistre FROM claims)
SELECT cod_sin, type_mur_batiment, statut_sinistre,
  CAST(dense_rank() OVER (ORDER BY type_mur_batiment) - 1 AS INTEGER) AS type_mur_batiment_encoded,
  CAST(dense_rank() OVER (ORDER BY statut_sinistre) - 1 AS INTEGER) AS statut_sinistre_encoded FROM c""")
def q_encode_label(spark, sf):
    d = C(spark, sf).select("cod_sin", "type_mur_batiment", "statut_sinistre")
    return features.encode_label(d, ["type_mur_batiment", "statut_sinistre"])


@register("encode_onehot", """
SELECT cod_sin, CASE WHEN statut_sinistre = 'Clos' THEN 1 ELSE 0 END AS statut_sinistre_Clos,
  CASE WHEN statut_sinistre = 'Fermé' THEN 1 ELSE 0 END AS "statut_sinistre_Fermé",
  CASE WHEN statut_sinistre = 'Ouvert' THEN 1 ELSE 0 END AS statut_sinistre_Ouvert FROM claims""")
def q_encode_onehot(spark, sf):
    d = C(spark, sf).select("cod_sin", "statut_sinistre")
    return features.encode_onehot(d, "statut_sinistre", drop_original=True)


@register("scale_standard", """
SELECT cod_sin, round((montant_charge_brut - (SELECT avg(montant_charge_brut) FROM claims)) / (SELECT stddev_pop(montant_charge_brut) FROM claims), 6) AS montant_charge_brut,
       round((prime - (SELECT avg(prime) FROM claims)) / (SELECT stddev_pop(prime) FROM claims), 6) AS prime FROM claims""")
def q_scale_standard(spark, sf):
    d = C(spark, sf).select("cod_sin", TARGET, "prime")
    return rnd(features.scale_standard(d, [TARGET, "prime"]), 6)


@register("scale_minmax", """
SELECT cod_sin, round((engagements - (SELECT min(engagements) FROM claims)) / ((SELECT max(engagements) FROM claims) - (SELECT min(engagements) FROM claims)), 6) AS engagements
FROM claims""")
def q_scale_minmax(spark, sf):
    return rnd(features.scale_minmax(C(spark, sf).select("cod_sin", "engagements"), ["engagements"]), 6)


@register("target_transform", """
SELECT cod_sin, round(ln(prime + CASE WHEN (SELECT min(prime) FROM claims) <= 0 THEN abs((SELECT min(prime) FROM claims)) + 1 ELSE 0 END), 6) AS y_t,
       round(CASE WHEN (SELECT min(prime) FROM claims) <= 0 THEN abs((SELECT min(prime) FROM claims)) + 1 ELSE 0 END, 6) AS shift
FROM claims WHERE prime IS NOT NULL""")
def q_target_transform(spark, sf):
    d = C(spark, sf).select("cod_sin", "prime").where(F.col("prime").isNotNull())
    return rnd(features.target_transform(d, "prime", "log").select("cod_sin", "y_t", "shift"), 6)


@register("model_input_profile", f"""
SELECT CAST(count(*) AS BIGINT) AS rows,
  CAST({" + ".join(f"(count(*) - count({c}))" for c in NUMF + CATF)} AS BIGINT) AS missing_cells,
  CAST({len(NUMF)} AS BIGINT) AS numeric_features, CAST({len(CATF)} AS BIGINT) AS categorical_features,
  round(avg(montant_charge_brut), 4) AS target_mean, round(quantile_cont(montant_charge_brut, 0.5), 4) AS target_median,
  round(stddev_samp(montant_charge_brut), 4) AS target_std, round(skewness(montant_charge_brut), 4) AS target_skew,
  round(kurtosis(montant_charge_brut), 4) AS target_kurt FROM claims""")
def q_model_input(spark, sf):
    d = C(spark, sf)
    miss = sum((F.count(F.lit(1)) - F.count(c) for c in NUMF + CATF), F.lit(0))
    base = d.agg(F.count(F.lit(1)).cast("bigint").alias("rows"), miss.cast("bigint").alias("missing_cells"),
                 F.lit(len(NUMF)).cast("bigint").alias("numeric_features"), F.lit(len(CATF)).cast("bigint").alias("categorical_features"))
    t = profile.target_distribution(d, TARGET).select(
        F.col("mean").alias("target_mean"), F.col("median").alias("target_median"), F.col("std").alias("target_std"),
        F.col("skewness").alias("target_skew"), F.col("kurtosis").alias("target_kurt"))
    return rnd(base.crossJoin(t))


def _model_table(spark, sf):
    return models.model_table(C(spark, sf), TARGET, NUMF, CATF, "cod_sin", BOOLF)


# levels of the text features in the claims view; ville has more than 20 and goes
_LEVELS = {"type_mur_batiment": ["automobile", "building", "furniture", "household", "machinery"],
           "statut_sinistre": ["Clos", "Fermé", "Ouvert"], "risque_rga_gcl": ["faible", "fort", "maximal", "moyen"]}


def _features_sql():
    fills = ", ".join([f"quantile_cont({c}, 0.5) AS {c}_m" for c in NUMF])
    modes = ", ".join(f"(SELECT {c} FROM y WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}_m" for c in [*_LEVELS, *BOOLF])
    numbers = ", ".join(f"round((coalesce({c}, {c}_m) - avg(coalesce({c}, {c}_m)) OVER ()) / stddev_pop(coalesce({c}, {c}_m)) OVER (), 6) AS {c}" for c in NUMF)
    hot = ", ".join(f"CASE WHEN coalesce({c}, {c}_m) = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{c}_{v}\"" for c, vs in _LEVELS.items() for v in vs)
    flags = ", ".join(f"CAST(CAST(coalesce({c}, {c}_m) AS INTEGER) AS DOUBLE) AS {c}" for c in BOOLF)
    return f"""WITH y AS (SELECT * FROM claims WHERE montant_charge_brut IS NOT NULL),
s AS (SELECT CASE WHEN min(montant_charge_brut) <= 0 THEN abs(min(montant_charge_brut)) + 1 ELSE 0 END AS shift, {fills} FROM y),
m AS (SELECT {modes})
SELECT cod_sin, round(ln(montant_charge_brut + shift), 6) AS label, {numbers}, {hot}, {flags} FROM y, s, m"""


@register("model_features", _features_sql())
def q_model_features(spark, sf):
    df, design = _model_table(spark, sf)
    return df.select("cod_sin", F.round("label", 6).alias("label"), *[F.round(F.col(f"`{n}`"), 6).alias(n) for n in design.names])


@register("train_test_split", """
SELECT cod_sin, ('0x' || substr(md5('42:' || cod_sin), 1, 8))::BIGINT % 100 < 80 AS train,
       CAST(('0x' || substr(md5('43:' || cod_sin), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM claims""")
def q_split(spark, sf):
    tr, te = models.hash_split(models.fold_column(C(spark, sf).select("cod_sin"), "cod_sin"), "cod_sin")
    return tr.withColumn("train", F.lit(True)).unionByName(te.withColumn("train", F.lit(False))).withColumnRenamed("_fold", "fold")


@register("fit_linear_family", None)
def q_linear_family(spark, sf):
    df, design = _model_table(spark, sf)
    return models.fit_models(df, design.names, "cod_sin", models.LINEAR)[1]


@register("fit_trees", None)
def q_trees(spark, sf):
    df, design = _model_table(spark, sf)
    return models.fit_models(df, design.names, "cod_sin", models.TREES)[1]


#: the forests of the other queries are shallower, by argument
FOREST = {"random_forest": 12}


@register("cross_validate", None)
def q_cv(spark, sf):
    df, design = _model_table(spark, sf)
    return models.cross_validate(df, design.names, "cod_sin", models.LINEAR + ("decision_tree",), 5)


@register("cross_validate_trees", None)
def q_cv_trees(spark, sf):
    df, design = _model_table(spark, sf)
    return models.cross_validate(df, design.names, "cod_sin", ("random_forest", "gradient_boosting"), 5, FOREST)


@register("regression_metrics", """
WITH d AS (SELECT engagements AS x, montant_charge_brut AS y FROM claims WHERE engagements IS NOT NULL AND montant_charge_brut IS NOT NULL),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d),
p AS (SELECT y, a + b * x AS yhat FROM d, f)
SELECT CAST(count(*) AS BIGINT) AS n, round(1 - avg((y - yhat) * (y - yhat)) / var_pop(y), 6) AS r2,
       round(sqrt(avg((y - yhat) * (y - yhat))), 2) AS rmse, round(avg(abs(y - yhat)), 2) AS mae FROM p""")
def q_reg_metrics(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    d = C(spark, sf).where(F.col("engagements").isNotNull() & F.col(TARGET).isNotNull()).select(
        "engagements", F.col(TARGET).alias("label"))
    d = VectorAssembler(inputCols=["engagements"], outputCol="features").transform(d)
    m = LinearRegression(solver="normal", regParam=0.0, standardization=False).fit(d)
    r = models.regression_metrics(m.transform(d))
    return r.select("n", F.round("r2", 6).alias("r2"), F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"))


@register("ols_inference", None)
def q_ols(spark, sf):
    d = models.prepare(C(spark, sf), TARGET, NUMF, [], "cod_sin")
    return models.ols_inference(d, NUMF)


@register("feature_importance", None)
def q_importance(spark, sf):
    df, design = _model_table(spark, sf)
    fitted, _ = models.fit_models(df, design.names, "cod_sin", models.LINEAR + ("random_forest", "decision_tree"), FOREST)
    return models.feature_importance(fitted, 15)


@register("residual_diagnostics", None)
def q_residuals(spark, sf):
    d = models.prepare(C(spark, sf), TARGET, NUMF, [], "cod_sin").na.drop(subset=NUMF)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    d = VectorAssembler(inputCols=NUMF, outputCol="features").transform(d)
    m = LinearRegression(regParam=0.0).fit(d)
    return models.residual_diagnostics(m.transform(d).drop("features"), NUMF)


@register("scatter_pairs", """
SELECT 'surface_police' AS variable, CAST(surface_police AS DOUBLE) AS x, montant_charge_brut AS y FROM claims
  WHERE surface_police IS NOT NULL AND montant_charge_brut IS NOT NULL
UNION ALL SELECT 'prime', prime, montant_charge_brut FROM claims WHERE prime IS NOT NULL AND montant_charge_brut IS NOT NULL
UNION ALL SELECT 'weather_temp_mean', weather_temp_mean, montant_charge_brut FROM claims WHERE weather_temp_mean IS NOT NULL AND montant_charge_brut IS NOT NULL""")
def q_scatter(spark, sf):
    keys = ["surface_police", "prime", "weather_temp_mean"]
    d = C(spark, sf).select(F.col(TARGET).alias("y"), *[F.col(c).cast("double") for c in keys])
    long = d.unpivot(["y"], keys, "variable", "x")
    return long.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("variable", "x", "y")


@register("predict_interval", None)
def q_predict(spark, sf):
    df, design = _model_table(spark, sf)
    fitted, rows = models.fit_models(df, design.names, "cod_sin", models.LINEAR + models.TREES, FOREST)
    _, test = models.hash_split(df, "cod_sin")
    return models.predict_interval(fitted, rows, test).select("cod_sin", "model_used", "pred", "pred_lower", "pred_upper")
