"""Drought claim analyses: climate, building vulnerability, exposure, scores
and risk profiles, as tidy result tables ``(part, level, metric, value)``.

Each analysis is a composition of the distributed operators (grouped
summaries with exact quantiles, rank tests, correlations); parts whose
columns are missing are skipped at plan time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casting import to_double
from ..functions.stats import pair_corr
from ..operators import ranks, summary, tests
from ..operators.binning import cut_expr
from ..operators.lookup import RGA_ORDER, RGA_SCORE, RGA_SYNONYMS, WALL_WEIGHTS, map_expr

TARGET = "montant_charge_brut"

# Category labels of the climate, age and quartile breakdowns.
PRECIP_LABELS = ["Très sec", "Sec", "Normal+"]
TEMP_LABELS = ["Fraîche", "Modérée", "Chaude"]
DROUGHT_LABELS = ["Pas de sécheresse", "Sécheresse légère", "Sécheresse modérée", "Sécheresse sévère"]
AGE_LABELS = ["Très récent (0-20)", "Récent (20-40)", "Moyen (40-60)", "Ancien (60-100)", "Très ancien (100+)"]
PREMIUM_LABELS = ["Q1 (Faible)", "Q2 (Moyen-)", "Q3 (Moyen+)", "Q4 (Élevé)"]
QUARTILE_LABELS = ["Q1", "Q2", "Q3", "Q4"]
# Risk profile labels in order.
PROFILE_LABELS = ["Faible risque", "Risque modéré", "Haut risque", "Très haut risque"]

TAIL = {"median": 0.5, "p90": 0.9, "p95": 0.95}


def tidy(df: DataFrame, part: str, level: Column | str | None, metrics: Sequence[str]) -> DataFrame:
    """Wide result -> (part, level, metric, value)."""
    lv = F.lit(None).cast("string") if level is None else (F.col(level) if isinstance(level, str) else level).cast("string")
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(part).alias("part"), lv.alias("level"), F.explode(arr).alias("_m")).select(
        "part", "level", "_m.metric", "_m.value")


def level_stats(d: DataFrame, y: str, level: str, levels: Sequence[str] | None,
                measures=("count", "mean", "std"), quantiles=TAIL) -> DataFrame:
    """Per level: the measures and quantiles; with ``levels`` every level of
    the ordered list is reported (count 0, null statistics when empty)."""
    s = summary.summarize(d.where(F.col(level).isNotNull()), y, [level], measures, quantiles)
    if levels is None:
        return s
    dim = d.sparkSession.createDataFrame([(str(v), i) for i, v in enumerate(levels)], f"_lv string, ord int")
    j = F.broadcast(dim).join(s, F.col("_lv") == F.col(level).cast("string"), "left").drop(level)
    return j.withColumnRenamed("_lv", level).withColumn("count", F.coalesce(F.col("count"), F.lit(0)))


def kruskal_gated(d: DataFrame, group: str, y: str, levels: Sequence[str] | None = None) -> DataFrame:
    """Kruskal H only when there are >= 2 groups and every group (every level
    of ``levels``, empty ones included) has >= 3 rows; else null."""
    k = tests.kruskal_wallis(d, group, y, min_n=1)
    sizes = d.where(F.col(group).isNotNull() & F.col(y).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    gate = sizes.agg(F.min("_n").alias("_mn"), F.count(F.lit(1)).alias("_k"))
    ok = (F.col("_mn") >= 3) & (F.col("_k") >= 2)
    if levels is not None:
        ok = ok & (F.col("_k") == len(levels))
    return k.crossJoin(gate).select(F.when(ok, F.col("statistic")).alias("statistic"), F.when(ok, F.col("p_value")).alias("p_value"))


def _pos(df: DataFrame, *cols: str) -> DataFrame:
    """Rows with every column present (numeric) and a positive target."""
    d = df.select(*[to_double(c).alias(c) for c in cols])
    for c in cols:
        d = d.where(F.col(c).isNotNull())
    return d.where(F.col(TARGET) > 0)


def _corr_row(d: DataFrame, x: str, y: str = TARGET, name: str = "correlation") -> DataFrame:
    return d.agg(pair_corr(F.col(x), F.col(y)).alias(name))


def _spearman(d: DataFrame, x: str, y: str = TARGET) -> DataFrame:
    return tests.spearman(d, x, y).select("rho", "p_value")


def _cat_analysis(d: DataFrame, cat: Column, labels, y: str = TARGET, quantiles=TAIL) -> tuple[DataFrame, DataFrame]:
    d = d.withColumn("_cat", cat)
    return d, level_stats(d, y, "_cat", labels, quantiles=quantiles)


# ---- climate ----------------------------------------------------------------

def climate_precip(df: DataFrame, threshold: float = 20.0) -> DataFrame:
    d = _pos(df, "weather_precip_mean", TARGET)
    x = F.col("weather_precip_mean")
    d, st = _cat_analysis(d, cut_expr(x, [float("-inf"), threshold, 2 * threshold, float("inf")], PRECIP_LABELS), PRECIP_LABELS)
    k = kruskal_gated(d, "_cat", TARGET, PRECIP_LABELS)
    return (tidy(st, "by_category", "_cat", ["count", "mean", "median", "std", "p90", "p95"])
            .unionByName(tidy(k, "kruskal", None, k.columns))
            .unionByName(tidy(_corr_row(d, "weather_precip_mean"), "pearson", None, ["correlation"])))


def climate_temp(df: DataFrame, threshold: float = 25.0) -> DataFrame:
    d = _pos(df, "weather_temp_mean", TARGET)
    x = F.col("weather_temp_mean")
    d, st = _cat_analysis(d, cut_expr(x, [float("-inf"), threshold - 5, threshold, float("inf")], TEMP_LABELS), TEMP_LABELS)
    k = kruskal_gated(d, "_cat", TARGET, TEMP_LABELS)
    return (tidy(st, "by_category", "_cat", ["count", "mean", "median", "std", "p90", "p95"])
            .unionByName(tidy(k, "kruskal", None, k.columns))
            .unionByName(tidy(_corr_row(d, "weather_temp_mean"), "pearson", None, ["correlation"])))


def drought_flags(df: DataFrame, p_t: float = 20.0, t_t: float = 25.0) -> DataFrame:
    p, t = to_double("weather_precip_mean"), to_double("weather_temp_mean")
    inten = F.greatest(F.lit(0.0), (F.lit(p_t) - p) / max(p_t, 1e-6) + (t - F.lit(t_t)) / max(t_t, 1e-6))
    return df.withColumn("is_drought", (p < p_t) & (t > t_t)).withColumn(
        "drought_intensity", F.when(p.isNotNull() & t.isNotNull(), inten))


def drought_conditions(df: DataFrame, p_t: float = 20.0, t_t: float = 25.0) -> DataFrame:
    d = drought_flags(_pos(df, "weather_precip_mean", "weather_temp_mean", TARGET), p_t, t_t)
    d, st = _cat_analysis(d, cut_expr(F.col("drought_intensity"), [float("-inf"), 0, 0.5, 1, float("inf")], DROUGHT_LABELS),
                          DROUGHT_LABELS)
    by_flag = summary.summarize(d, TARGET, ["is_drought"], ("count", "mean", "std"), {"median": 0.5})
    mw = tests.mann_whitney(d, "is_drought", TARGET, first=True).select("U", "p_value")
    pct = d.agg((F.sum(F.col("is_drought").cast("int")) * 100.0 / F.count(F.lit(1))).alias("drought_percentage"))
    return (tidy(st, "by_category", "_cat", ["count", "mean", "median", "std", "p90", "p95"])
            .unionByName(tidy(by_flag, "by_flag", "is_drought", ["count", "mean", "median", "std"]))
            .unionByName(tidy(mw, "mann_whitney", None, mw.columns))
            .unionByName(tidy(pct, "share", None, ["drought_percentage"])))


def climate_by_month(df: DataFrame, date: str = "date_sinistre") -> DataFrame:
    d = df.select(F.month(F.col(date)).alias("month"), to_double(TARGET).alias("_y"),
                  to_double("weather_precip_mean").alias("_p"), to_double("weather_temp_mean").alias("_t")).where(
        F.col("month").isNotNull() & F.col("_y").isNotNull())
    m = d.groupBy("month").agg(F.avg("_y").alias("montant_mean"), F.avg("_p").alias("precip_mean"),
                               F.avg("_t").alias("temp_mean"), F.count(F.lit(1)).alias("n"))
    c = m.agg(pair_corr(F.col("montant_mean"), F.col("precip_mean")).alias("corr_montant_precip"),
              pair_corr(F.col("montant_mean"), F.col("temp_mean")).alias("corr_montant_temp"))
    return tidy(m, "by_month", "month", ["montant_mean", "precip_mean", "temp_mean", "n"]).unionByName(
        tidy(c, "correlation", None, ["corr_montant_precip", "corr_montant_temp"]))


# ---- building vulnerability ------------------------------------------------

def with_age(df: DataFrame, ref_year: int) -> DataFrame:
    if "age_batiment" in df.columns:
        return df
    return df.withColumn("age_batiment", F.lit(float(ref_year)) - to_double("annee_construction_batiment"))


def vuln_age(df: DataFrame, ref_year: int = 2025) -> DataFrame:
    d = _pos(with_age(df, ref_year), "age_batiment", TARGET).where(F.col("age_batiment").between(0, 200))
    d, st = _cat_analysis(d, cut_expr(F.col("age_batiment"), [0, 20, 40, 60, 100, float("inf")], AGE_LABELS), AGE_LABELS,
                          quantiles={"median": 0.5, "p90": 0.9})
    sp = _spearman(d, "age_batiment")
    return (tidy(st, "by_category", "_cat", ["count", "mean", "median", "std", "p90"])
            .unionByName(tidy(_corr_row(d, "age_batiment"), "pearson", None, ["correlation"]))
            .unionByName(tidy(sp, "spearman", None, sp.columns)))


def _quartile_part(d: DataFrame, x: str, labels, quantiles=None) -> DataFrame:
    from ..operators.binning import qcut_quartiles

    q = qcut_quartiles(d, x, 4, labels, out="_cat")
    return level_stats(q, TARGET, "_cat", labels, quantiles=quantiles or {"median": 0.5})


def vuln_surface(df: DataFrame) -> DataFrame:
    d = _pos(df, "surface_batiment", TARGET).where(F.col("surface_batiment") > 0)
    st = _quartile_part(d, "surface_batiment", QUARTILE_LABELS)
    sp = _spearman(d, "surface_batiment")
    return tidy(st, "by_quartile", "_cat", ["count", "mean", "median", "std"]).unionByName(tidy(sp, "spearman", None, sp.columns))


def vuln_wall_type(df: DataFrame) -> DataFrame:
    d = df.select(F.col("type_mur_batiment"), to_double(TARGET).alias(TARGET)).where(
        F.col("type_mur_batiment").isNotNull() & (F.col(TARGET) > 0))
    st = level_stats(d, TARGET, "type_mur_batiment", None, quantiles={"median": 0.5})
    k = kruskal_gated(d, "type_mur_batiment", TARGET, None)
    return tidy(st, "by_wall_type", "type_mur_batiment", ["count", "mean", "median", "std"]).unionByName(
        tidy(k, "kruskal", None, k.columns))


def vuln_rooms(df: DataFrame) -> DataFrame:
    d = _pos(df, "nb_pieces_police", TARGET).where(F.col("nb_pieces_police").between(0, 20))
    st = level_stats(d, TARGET, "nb_pieces_police", None, quantiles={"median": 0.5})
    sp = _spearman(d, "nb_pieces_police")
    return tidy(st, "by_rooms", F.col("nb_pieces_police").cast("int"), ["count", "mean", "median", "std"]).unionByName(
        tidy(sp, "spearman", None, sp.columns))


# ---- scores ---------------------------------------------------------------

def _minmax(x: Column, lo: Column, hi: Column, eps: float | None = 1e-9) -> Column:
    rng = hi - lo
    return (x - lo) / (F.greatest(rng, F.lit(eps)) if eps is not None else rng)


def score_building(df: DataFrame, ref_year: int = 2025, out: str = "building_vulnerability_score") -> DataFrame:
    """Mean of (clip(age, 0, 150) / 150) and min-max of the surface clipped
    at (0, q99); a missing part counts 0.5; no part -> 0.5; clipped to 0..1.
    The fences (q99, then min / max of the clipped surface) are a few
    scalars computed once and inlined."""
    d = with_age(df, ref_year)
    parts = []
    age = to_double("age_batiment")
    parts.append(F.coalesce(F.least(F.greatest(age, F.lit(0.0)), F.lit(150.0)) / 150.0, F.lit(0.5)))
    if "surface_batiment" in d.columns:
        (s99,) = ranks.quantile_values(d, "surface_batiment", [0.99])
        s = to_double("surface_batiment")
        sc = F.when(s.isNotNull(), F.least(F.greatest(s, F.lit(0.0)), ranks.lit_or_null(s99)))
        smin, smax = d.agg(F.min(sc), F.max(sc)).first()
        if smin is not None:
            parts.append(F.coalesce((sc - F.lit(smin)) / F.lit(max(smax - smin, 1e-9)), F.lit(0.5)))
        else:
            parts.append(F.lit(0.5))
    v = sum(parts[1:], parts[0]) / len(parts)
    return d.withColumn(out, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def score_vulnerability(df: DataFrame, ref_year: int = 2025, out: str = "vulnerability_score") -> DataFrame:
    """Mean of the building score and the wall-type weight (0.5 unknown)."""
    d = score_building(df, ref_year)
    wall = map_expr(WALL_WEIGHTS, F.lower(F.col("type_mur_batiment").cast("string")), 0.5)
    v = (F.col("building_vulnerability_score") + wall) / 2
    return d.withColumn(out, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def _clipped_minmax(df: DataFrame, col: str) -> Column | None:
    """min-max of ``col`` clipped to its q01..q99 (fences inlined); null when
    the clipped column is constant or empty."""
    lo, hi = ranks.quantile_values(df, col, [0.01, 0.99])
    if lo is None:
        return None
    x = to_double(col)
    c = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    a, b = df.agg(F.min(c), F.max(c)).first()
    if a is None or b == a:
        return F.lit(None).cast("double")
    return (c - F.lit(a)) / F.lit(b - a)


def score_exposure(df: DataFrame, out: str = "exposure_score") -> DataFrame:
    """Mean of the available parts: min-max of premium and of commitments
    (each clipped to its q01..q99 first), RGA score (0.5 when unknown)."""
    parts = [p for p in (_clipped_minmax(df, "prime"), _clipped_minmax(df, "engagements")) if p is not None]
    parts.append(map_expr(RGA_SCORE, F.lower(F.col("risque_rga_gcl").cast("string")), 0.5))
    num = sum((F.coalesce(x, F.lit(0.0)) for x in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    cnt = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in parts[1:]), F.when(parts[0].isNotNull(), 1).otherwise(0))
    v = F.try_divide(num, cnt)
    return df.withColumn(out, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def score_climate(df: DataFrame, out: str = "climate_risk_score") -> DataFrame:
    """0.5 (1 - minmax precip) + 0.5 minmax temp; null -> 0.5; 0..1."""
    pa, pb, ta, tb = df.agg(F.min(to_double("weather_precip_mean")), F.max(to_double("weather_precip_mean")),
                            F.min(to_double("weather_temp_mean")), F.max(to_double("weather_temp_mean"))).first()
    if pa is None or ta is None:
        return df.withColumn(out, F.lit(0.5))
    pr = 1 - (to_double("weather_precip_mean") - F.lit(pa)) / F.lit(max(pb - pa, 1e-9))
    tn = (to_double("weather_temp_mean") - F.lit(ta)) / F.lit(max(tb - ta, 1e-9))
    v = F.coalesce(pr * 0.5 + tn * 0.5, F.lit(0.5))
    return df.withColumn(out, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


# ---- exposure ----------------------------------------------------------------

def exposure_premium(df: DataFrame) -> DataFrame:
    d = _pos(df, "prime", TARGET).where(F.col("prime") > 0)
    st = _quartile_part(d, "prime", PREMIUM_LABELS, {"median": 0.5, "p90": 0.9})
    lr = d.withColumn("_lr", F.col(TARGET) / F.col("prime"))
    lrs = summary.summarize(lr, "_lr", (), ("count", "mean", "std", "min", "max"), {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return (tidy(st, "by_quartile", "_cat", ["count", "mean", "median", "std", "p90"])
            .unionByName(tidy(_corr_row(d, "prime"), "pearson", None, ["correlation"]))
            .unionByName(tidy(lrs, "loss_ratio", None, ["count", "mean", "std", "min", "q25", "median", "q75", "max"])))


def exposure_commitment(df: DataFrame) -> DataFrame:
    d = _pos(df, "engagements", TARGET).where(F.col("engagements") > 0)
    st = _quartile_part(d, "engagements", QUARTILE_LABELS)
    return tidy(st, "by_quartile", "_cat", ["count", "mean", "median", "std"]).unionByName(
        tidy(_corr_row(d, "engagements"), "pearson", None, ["correlation"]))


def exposure_rga(df: DataFrame) -> DataFrame:
    d = df.select(map_expr(RGA_SYNONYMS, F.lower(F.col("risque_rga_gcl").cast("string"))).alias("rga"),
                  to_double(TARGET).alias(TARGET)).where(F.col("rga").isNotNull() & (F.col(TARGET) > 0))
    st = level_stats(d, TARGET, "rga", RGA_ORDER, quantiles={"median": 0.5})
    k = kruskal_gated(d, "rga", TARGET, RGA_ORDER)
    codes = d.withColumn("_code", map_expr({v: i for i, v in enumerate(RGA_ORDER)}, F.col("rga")).cast("double"))
    sp = _spearman(codes, "_code")
    return (tidy(st, "by_rga", "rga", ["count", "mean", "median", "std"])
            .unionByName(tidy(k, "kruskal", None, k.columns)).unionByName(tidy(sp, "spearman", None, sp.columns)))


def exposure_combined(df: DataFrame) -> DataFrame:
    d = score_exposure(df).select("exposure_score", to_double(TARGET).alias(TARGET)).where(
        F.col("exposure_score").isNotNull() & F.col(TARGET).isNotNull())
    st = _quartile_part(d, "exposure_score", QUARTILE_LABELS)
    sp = _spearman(d, "exposure_score")
    return tidy(st, "by_quartile", "_cat", ["count", "mean", "median", "std"]).unionByName(tidy(sp, "spearman", None, sp.columns))


# ---- risk profiles -------------------------------------------------------------

def risk_profile(df: DataFrame, ref_year: int = 2025) -> DataFrame:
    """Profile from exposure e and building score v (null -> 0.5): both < .4
    low; both > .7 very high; either > .6 high; else moderate. Count, mean,
    median, std (0 decimals) and share per profile."""
    d = score_building(score_exposure(df), ref_year)
    e = F.coalesce(F.col("exposure_score"), F.lit(0.5))
    v = F.coalesce(F.col("building_vulnerability_score"), F.lit(0.5))
    prof = (F.when((e < 0.4) & (v < 0.4), PROFILE_LABELS[0]).when((e > 0.7) & (v > 0.7), PROFILE_LABELS[3])
            .when((e > 0.6) | (v > 0.6), PROFILE_LABELS[2]).otherwise(PROFILE_LABELS[1]))
    p = d.select(prof.alias("risk_profile"), to_double(TARGET).alias(TARGET)).where(F.col(TARGET).isNotNull())
    s = summary.summarize(p, TARGET, ["risk_profile"], ("count", "mean", "std"), {"median": 0.5})
    return summary.with_share(s.withColumn("count", F.col("count").cast("bigint")), digits=None)


def risk_matrix(df: DataFrame, ref_year: int = 2025) -> DataFrame:
    """Exposure x vulnerability quadrants at 0.5: count and mean amount."""
    d = score_building(score_exposure(df), ref_year)
    return d.groupBy((F.col("exposure_score") > 0.5).alias("high_exposure"),
                     (F.col("building_vulnerability_score") > 0.5).alias("high_vulnerability")).agg(
        F.count(F.lit(1)).cast("bigint").alias("count"), F.avg(to_double(TARGET)).alias("mean"))


# ---- ordered-risk, floors and binary-flag analyses ---------------------------

def _robust(d: DataFrame, level: str, y: str = "_y") -> DataFrame:
    s = summary.summarize(d, y, [level], ("count", "mean", "std"), {"median": 0.5, "_q1": 0.25, "_q3": 0.75},
                          trimmed="trimmed_mean")
    return s.select(level, F.col("count").alias("n"), "median", (F.col("_q3") - F.col("_q1")).alias("iqr"), "trimmed_mean", "mean", "std")


def _winsor(d: DataFrame, y: str = "_y") -> DataFrame:
    from ..operators.binning import winsorize
    return winsorize(d, y, 0.01, 0.99)


def rga_vs_amount(df: DataFrame, rga: str = "risque_rga_gcl", with_quantreg: bool = True) -> DataFrame:
    """Ordered RGA level vs amount: winsorised robust summary per level,
    Kruskal + epsilon squared, Spearman trend on the level code (monotone if
    rho > 0 and p < .05), Dunn (Holm), Cliff's delta for every pair, quantile
    regression slopes and their p at .5 and .9."""
    code = {v: i for i, v in enumerate(RGA_ORDER)}
    d = df.select(map_expr(RGA_SYNONYMS, F.lower(F.col(rga).cast("string"))).alias("rga"), to_double(TARGET).alias("_y")).where(
        F.col("rga").isNotNull() & (F.col("_y") > 0))
    d = _winsor(d).withColumn("_code", map_expr(code, F.col("rga")).cast("double"))
    parts = [tidy(_robust(d, "rga"), "robust_summary", "rga", ["n", "median", "iqr", "trimmed_mean", "mean", "std"])]
    k = tests.kruskal_wallis(d, "rga", "_y")
    parts.append(tidy(k, "kruskal", None, ["statistic", "p_value", "epsilon_sq", "groups_count"]))
    sp = tests.spearman(d, "_code", "_y").withColumn("monotone", ((F.col("rho") > 0) & (F.col("p_value") < 0.05)).cast("double"))
    parts.append(tidy(sp, "spearman", None, ["rho", "p_value", "monotone"]))
    dn = tests.dunn_posthoc(d, "rga", "_y")
    parts.append(tidy(dn.withColumn("_pair", F.concat_ws("|", "level_a", "level_b")), "dunn", "_pair", ["z", "p_value", "p_holm"]))
    pairs = [(a, b) for i, a in enumerate(RGA_ORDER) for b in RGA_ORDER[i + 1:]]
    cd = tests.cliffs_delta_pairs(d, "rga", "_y", pairs).withColumn("_pair", F.concat_ws("|", "level_a", "level_b"))
    parts.append(tidy(cd, "cliffs_delta", "_pair", ["delta"]))
    if with_quantreg:
        from .suites import quantile_regression
        for q in (0.5, 0.9):
            parts.append(tidy(quantile_regression(d, "_code", "_y", q), f"quantreg_q{int(q * 100)}", None, ["slope", "slope_p"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def floors_vs_amount(df: DataFrame, floors: str = "nb_etages_batiment") -> DataFrame:
    """Rounded (half-even) floor count 0..30 vs amount: robust summary,
    Kruskal, Spearman, Cliff's delta of adjacent floor counts."""
    d = df.select(F.bround(to_double(floors), 0).alias("_f"), to_double(TARGET).alias("_y")).where(
        F.col("_f").between(0, 30) & (F.col("_y") > 0))
    d = _winsor(d).withColumn("floors", F.col("_f").cast("int").cast("string"))
    parts = [tidy(_robust(d, "floors"), "robust_summary", "floors", ["n", "median", "iqr", "trimmed_mean", "mean", "std"])]
    k = tests.kruskal_wallis(d, "floors", "_y")
    parts.append(tidy(k, "kruskal", None, ["statistic", "p_value", "epsilon_sq", "groups_count"]))
    sp = tests.spearman(d, "_f", "_y")
    parts.append(tidy(sp, "spearman", None, ["rho", "p_value"]))
    levels = sorted(int(r[0]) for r in d.select("_f").distinct().collect())
    pairs = [(str(a), str(b)) for a, b in zip(levels, levels[1:])]
    if pairs:
        cd = tests.cliffs_delta_pairs(d, "floors", "_y", pairs).withColumn("_pair", F.concat_ws("|", "level_a", "level_b"))
        parts.append(tidy(cd, "cliffs_delta", "_pair", ["delta"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flag_vs_amount(df: DataFrame, flag: str) -> DataFrame:
    """Binary flag vs amount (winsorised): per-side summary, Mann-Whitney U
    and p, Cliff's delta, Welch t on log1p, median difference, ratio of means."""
    from ..functions.casting import boolify_nullable
    from ..operators.groupdist import binary_summary

    t = dict(df.dtypes)[flag]
    d = df.select(boolify_nullable(flag, t).alias("_f"), to_double(TARGET).alias("_y")).where(
        F.col("_f").isNotNull() & (F.col("_y") > 0))
    d = _winsor(d)
    bs = binary_summary(d, "_f", "_y")
    mw = tests.mann_whitney(d, "_f", "_y", first=True)
    wt = tests.t_test(d, "_f", "_y", equal_var=False, log1p=True).select(F.col("t").alias("log_t"), F.col("p_value").alias("log_t_p"))
    return (tidy(bs, "summary", None, bs.columns)
            .unionByName(tidy(mw, "mann_whitney", None, ["U", "p_value", "cliffs_delta"]))
            .unionByName(tidy(wt, "log_ttest", None, ["log_t", "log_t_p"])))
