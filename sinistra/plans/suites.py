"""Composite analyses: tidy unions of operator results, the cleaning
sequence, rule flags, key findings, segmentation and variable ranking."""

from __future__ import annotations

import math
import statistics
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.casting import as_double, clean_text, to_double, to_timestamp_any
from ..functions.special import f_sf, t_sf2
from ..operators import binning, correlation, profile, ranks, summary, temporal, tests
from ..operators.binning import cut_expr
from ..session import scratch_table

TARGET = "montant_charge_brut"
_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")


def to_tidy(df: DataFrame, analysis: str, keys: Sequence[str] = (), metrics: Sequence[str] | None = None) -> DataFrame:
    """Any result table -> (analysis, level, metric, value): level joins the
    key columns with '|', every numeric/boolean column becomes a metric."""
    keys = list(keys)
    metrics = list(metrics) if metrics else [c for c, t in df.dtypes if c not in keys and t.split("(")[0] in _NUMERIC]
    level = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit(None).cast("string")
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(F.lit(analysis).alias("analysis"), level.alias("level"), F.explode(arr).alias("_m")).select(
        "analysis", "level", "_m.metric", "_m.value")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- cleaning ----------------------------------------------------------------

def clean_claims(df: DataFrame, date_cols: Sequence[str] = ("date_sinistre", "date_cloture_sinistre"),
                 protect: Sequence[str] = ("police", "cod_sin", "cpostal"), ref_year: int = 2025,
                 q: tuple[float, float] = (0.01, 0.99), impute: str = "median") -> DataFrame:
    """dates -> numeric clip (q01..q99) and impute (median of the clipped
    column) -> text (trim, upper, 'INCONNU') -> derived columns (age,
    closing delay, year, season, age and surface classes, department)."""
    d = df
    for c in date_cols:
        if c in d.columns and dict(d.dtypes)[c] == "string":
            d = d.withColumn(c, to_timestamp_any(c))
    num = [c for c, t in d.dtypes if t.split("(")[0] in _NUMERIC[:-1] and c not in protect]
    d = binning.clip_and_impute(d, num, q[0], q[1], impute=impute)
    txt = [c for c, t in d.dtypes if t == "string" and c not in protect]
    d = d.select(*[clean_text(c).alias(c) if c in txt else F.col(c) for c in d.columns])
    d = d.withColumn("age_batiment", dates.building_age(as_double(d, "annee_construction_batiment"), ref_year))
    d = d.withColumn("delai_cloture_jours", dates.closing_delay_days("date_sinistre", "date_cloture_sinistre"))
    d = d.withColumn("annee_sinistre", F.year("date_sinistre")).withColumn("saison_sinistre", dates.season("date_sinistre"))
    # Class labels of age and surface.
    d = d.withColumn("classe_age", cut_expr(F.col("age_batiment"), [0, 20, 40, 60, float("inf")],
                                            ["RÉCENT", "MODERNE", "ANCIEN", "TRÈS ANCIEN"], include_lowest=True))
    d = d.withColumn("classe_surface", cut_expr(as_double(d, "surface_police"), [0, 80, 120, 180, float("inf")],
                                                ["PETITE", "MOYENNE", "GRANDE", "TRÈS GRANDE"], include_lowest=True))
    return d.withColumn("region_code", dates.department("cpostal"))


# ---- rules and findings ------------------------------------------------------

def insight_rules(df: DataFrame, date: str = "date_sinistre", ref_year: int = 2025) -> DataFrame:
    """Threshold flags computed end to end from the claims table: (rule, fired,
    value, label). The age rule wants |rho| > 0.2 and p < 0.05; the peak season
    (by mean amount) and the three peak months carry their names as label."""
    from ..functions.stats import pair_corr
    from . import drought

    y = to_double(TARGET)
    r = df.agg(pair_corr(to_double("weather_precip_mean"), y).alias("r_precip"), pair_corr(to_double("weather_temp_mean"), y).alias("r_temp")).first()
    box = binning.outliers_iqr(df, TARGET).first()
    others = [c for c in profile.numeric_columns(df) if c != TARGET]
    strong = correlation.corr_with_target(df, TARGET, others, 0.3).count()
    aged = drought.with_age(df, ref_year)
    age = tests.spearman(aged.where(F.col("age_batiment").between(0, 200)), "age_batiment", TARGET).first()
    kruskal = drought.climate_precip(df).where("part = 'kruskal' AND metric = 'p_value'").first()["value"]
    mean, median = (box["mean"], box["median"]) if box else (None, None)
    above = lambda v, limit: v is not None and v > limit
    rows = [
        ("precip_negative_correlation", above(-r["r_precip"] if r["r_precip"] is not None else None, 0.2), r["r_precip"], None),
        ("temp_positive_correlation", above(r["r_temp"], 0.2), r["r_temp"], None),
        ("precip_classes_differ", kruskal is not None and kruskal < 0.05, kruskal, None),
        ("age_rank_correlation", age["rho"] is not None and abs(age["rho"]) > 0.2 and age["p_value"] < 0.05, age["rho"], None),
        ("strong_correlations", strong > 0, float(strong), None),
        ("mean_above_median", mean is not None and mean > 1.1 * median, mean / median if median else None, None),
        ("outliers_above_5pct", above(box["outlier_rate"] if box else None, 0.05), box["outlier_rate"] if box else None, None),
    ]
    cells = temporal.month_cells(temporal.clean_dates(df, TARGET, date))
    top = lambda found: sorted(found.items(), key=lambda kv: (-kv[1].mean, kv[0]))
    seasons = top(temporal.merge_cells(cells, lambda c: temporal.season_of(c.month)))
    months = top(temporal.merge_cells(cells, lambda c: c.month))[:3]
    rows.append(("peak_season", bool(seasons), seasons[0][1].mean if seasons else None, seasons[0][0] if seasons else None))
    rows.append(("peak_months", bool(months), months[0][1].mean if months else None, ",".join(str(m) for m, _ in months) or None))
    return df.sparkSession.createDataFrame(rows, "rule string, fired boolean, value double, label string")


def stats_rollup(df: DataFrame) -> DataFrame:
    """Key findings as (finding, label, value): trend, peak season, top
    department and top-5 concentration, strongest correlation, outlier
    severity, number of significant Kruskal tests."""
    tr = tests.linear_trend(df, TARGET, "date_sinistre").select(
        F.lit("significant_trend").alias("finding"), (F.col("p_value") < 0.05).cast("string").alias("label"),
        F.col("slope_per_year").alias("value"))
    cells = temporal.month_cells(temporal.clean_dates(df, TARGET, "date_sinistre"))
    seasons = temporal.merge_cells(cells, lambda c: temporal.season_of(c.month))
    best = [("peak_season", k, seasons[k].mean) for k in sorted(seasons, key=lambda k: (-seasons[k].mean, k))[:1]]
    peak = df.sparkSession.createDataFrame(best, "finding string, label string, value double")
    dep = temporal.spatial_departments(df, TARGET, digits=None)
    top = dep.where(F.col("rank_mean") == 1).select(F.lit("top_department").alias("finding"), F.col("departement").alias("label"),
                                                    F.col("mean").alias("value"))
    conc = dep.limit(1).select(F.lit("top5_volume_pct").alias("finding"), F.lit(None).cast("string").alias("label"),
                               F.col("top5_volume_pct").alias("value"))
    corr = correlation.corr_with_target(df, TARGET, [c for c in profile.numeric_columns(df) if c != TARGET], 0.0)
    strongest = corr.orderBy(F.desc("correlation_abs"), "variable").limit(1).select(
        F.lit("strongest_correlation").alias("finding"), F.col("variable").alias("label"), F.col("correlation").alias("value"))
    om = binning.outliers_multi(df, TARGET).select(F.lit("outlier_severity").alias("finding"), F.col("severity").alias("label"),
                                                   F.col("iqr_rate_pct").alias("value"))
    ks = [tests.kruskal_wallis(df, g, TARGET).select("p_value") for g in ("statut_sinistre", "type_mur_batiment", "risque_rga_gcl")]
    sig = union_all(ks).agg(F.lit("significant_tests").alias("finding"), F.lit(None).cast("string").alias("label"),
                            F.count(F.when(F.col("p_value") < 0.05, 1)).cast("double").alias("value"))
    return union_all([tr, peak, top, conc, strongest, om, sig])


# ---- variables ---------------------------------------------------------------

def variable_availability(df: DataFrame, catalogue: Mapping[str, Sequence[str]], importance: Mapping[str, str],
                          min_completeness: float = 0.0) -> DataFrame:
    """Per catalogue group: variables expected, available (present with a
    non-null value), missing, rate, mean completeness of the present ones,
    importance class, ready when more than half are available."""
    spark = df.sparkSession
    rows = [(g, v) for g, vs in catalogue.items() for v in vs]
    cat = spark.createDataFrame(rows, "grp string, variable string")
    present = [v for _, v in rows if v in df.columns]
    mp = profile.missing_profile(df.select(*present)) if present else None
    j = cat.join(F.broadcast(mp), "variable", "left") if mp is not None else cat.withColumn("completeness_pct", F.lit(None))
    avail = F.coalesce(F.col("completeness_pct") > min_completeness, F.lit(False))
    imp = spark.createDataFrame(list(importance.items()), "grp string, importance string")
    g = j.groupBy("grp").agg(F.count(F.lit(1)).cast("bigint").alias("expected"), F.sum(avail.cast("int")).cast("bigint").alias("available"),
                             F.avg("completeness_pct").alias("mean_completeness"))
    g = g.withColumn("missing", F.col("expected") - F.col("available")).withColumn("rate", F.col("available") / F.col("expected"))
    return g.join(F.broadcast(imp), "grp", "left").withColumn("ready", F.col("rate") > 0.5)


def variable_importance(df: DataFrame, catalogue: Mapping[str, Sequence[str]], max_levels: int = 10) -> DataFrame:
    """Per catalogue variable: score and kind - |Pearson| for numbers, F for
    text (at most ``max_levels`` levels; 0 unless p < .05), |t| for booleans (0
    unless p < .05) - with completeness and distinct count, ranked overall; and
    its group's mean and highest score and the group's rank by mean.

    One scan gives the table all of it comes from: rows, amounts, their mean and
    squared differences by (variable, value), combined before the shuffle. A
    cheaper scan before it finds centres, so that the co-moments lose no digits."""
    types = dict(df.dtypes)
    group = {v: g for g, vs in catalogue.items() for v in vs if v in types}
    if not group:
        return df.sparkSession.createDataFrame([], _IMPORTANCE)
    kind = {v: "abs_t" if types[v] == "boolean" else "anova_f" if types[v] == "string" else "abs_pearson" for v in group}
    numbers = [v for v in group if kind[v] == "abs_pearson"]
    y = to_double(TARGET)
    centre = df.agg(F.count(F.lit(1)).alias("_rows"), F.coalesce(F.avg(y), F.lit(0.0)).alias("_y"), *[F.avg(to_double(v)).alias(v) for v in numbers]).first()
    long = df.select((y - F.lit(centre["_y"])).alias("_y"), *[F.col(v).cast("string").alias(v) for v in group]).unpivot(["_y"], list(group), "variable", "value")
    cells = long.where(F.col("value").isNotNull()).groupBy("variable", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count("_y").alias("ny"), F.avg("_y").alias("m"), (F.var_pop("_y") * F.count("_y")).alias("m2"))
    at = F.col("value").try_cast("double") - F.coalesce(F.try_element_at(F.create_map(*[F.lit(z) for v in numbers for z in (v, centre[v])]), F.col("variable")), F.lit(0.0)) if numbers else F.lit(0.0)
    big = F.col("ny") >= 3
    n, m = F.col("ny"), F.coalesce("m", F.lit(0.0))
    one = cells.withColumn("x", F.when(F.col("ny") > 0, at)).groupBy("variable").agg(
        F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct"), F.sum("ny").alias("N"),
        F.sum(n * m).alias("sy"), F.sum(F.col("m2") + n * m * m).alias("syy"),
        F.sum(n * F.col("x")).alias("sx"), F.sum(n * F.col("x") * F.col("x")).alias("sxx"), F.sum(n * F.col("x") * m).alias("sxy"),
        F.count(F.when(big, 1)).alias("k"), F.sum(F.when(big, n)).alias("kN"), F.sum(F.when(big, n * m)).alias("ks"),
        F.sum(F.when(big, n * m * m)).alias("kss"), F.sum(F.when(big, F.col("m2"))).alias("kw")).collect()
    seen = {r["variable"]: r for r in one}
    rows = []
    for v, g in group.items():
        r = seen.get(v)
        score = _importance(kind[v], r, max_levels) if r else 0.0
        rows.append((g, v, kind[v], score, (r["present"] if r else 0) * 100.0 / centre["_rows"] if centre["_rows"] else None, r["distinct"] if r else 0))
    of = {g: [r[3] for r in rows if r[0] == g] for g in dict.fromkeys(group.values())}
    mean = {g: sum(s) / len(s) for g, s in of.items()}
    place = {g: i for i, g in enumerate(sorted(of, key=lambda g: (-mean[g], g)), 1)}
    rows.sort(key=lambda r: (-r[3], r[1]))
    return df.sparkSession.createDataFrame([(*r, i, mean[r[0]], max(of[r[0]]), place[r[0]]) for i, r in enumerate(rows, 1)], _IMPORTANCE)


_IMPORTANCE = ("grp string, variable string, kind string, score double, completeness_pct double, distinct bigint, rank int, "
               "group_mean_score double, group_max_score double, group_rank int")


def _importance(kind: str, r, max_levels: int) -> float:
    """The score of one variable from its sums."""
    if kind == "abs_pearson":
        n = r["N"]
        if not n:
            return 0.0
        sxx, syy = r["sxx"] - r["sx"] ** 2 / n, r["syy"] - r["sy"] ** 2 / n
        sxy = r["sxy"] - r["sx"] * r["sy"] / n
        return abs(sxy) / math.sqrt(sxx * syy) if sxx > 0 and syy > 0 else 0.0
    k, n = r["k"], r["kN"]
    if (k != 2 if kind == "abs_t" else k < 2 or r["distinct"] > max_levels) or n <= k or not r["kw"]:
        return 0.0
    f = (r["kss"] - r["ks"] ** 2 / n) / (k - 1) / (r["kw"] / (n - k))
    if f_sf(f, k - 1, n - k) >= 0.05:
        return 0.0
    return math.sqrt(f) if kind == "abs_t" else f  # two groups: F is the square of t


def risk_segmentation(df: DataFrame, ref_year: int = 2025, seed: int = 42, n_init: int = 10) -> DataFrame:
    """KMeans on the available scores (climate, building, exposure);
    k = min(4, max(2, n // 100)); best of ``n_init`` seeds by cost; segments
    numbered by mean amount; count / mean / median / std and centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from . import drought as D

    d = D.score_exposure(D.score_building(D.score_climate(df), ref_year))
    feats = ["climate_risk_score", "building_vulnerability_score", "exposure_score"]
    x = d.select(*feats, to_double(TARGET).alias("montant")).na.drop(subset=feats)
    n = x.count()
    if n < 10:
        return df.sparkSession.createDataFrame([], "segment int, count bigint, mean double, median double, std double")
    k = min(4, max(2, n // 100))
    va = VectorAssembler(inputCols=feats, outputCol="features")
    xv = va.transform(x)
    best = None
    for i in range(n_init):
        m = KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="_seg").fit(xv)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    p = best.transform(xv)
    s = summary.summarize(p, "montant", ["_seg"], ("count", "mean", "std"), {"median": 0.5})
    from pyspark.sql import Window
    centres = df.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(best.clusterCenters())],
                                              "_seg int, " + ", ".join(f"centre_{f} double" for f in feats))
    s = s.join(F.broadcast(centres), "_seg")
    # k <= 4 rows: number segments by mean amount
    return s.withColumn("segment", F.row_number().over(Window.orderBy("mean", "_seg")) - 1).drop("_seg").withColumn(
        "count", F.col("count").cast("bigint"))


def _cut(polygon: list, w: list) -> list:
    """The part of a convex polygon where the linear function with these values
    at its corners is not above 0."""
    out = []
    for (p, wp), (r, wr) in zip(zip(polygon, w), zip(polygon[1:] + polygon[:1], w[1:] + w[:1])):
        if wp <= 0:
            out.append(p)
        if (wp < 0 < wr) or (wr < 0 < wp):
            t = wp / (wp - wr)
            out.append((p[0] + t * (r[0] - p[0]), p[1] + t * (r[1] - p[1])))
    return out


def _centroid(polygon: list) -> tuple[float, float]:
    (x0, y0), area, cx, cy = polygon[0], 0.0, 0.0, 0.0
    for (x1, y1), (x2, y2) in zip(polygon[1:], polygon[2:]):
        c = (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)
        area, cx, cy = area + c, cx + c * (x1 + x2 - 2 * x0), cy + c * (y1 + y2 - 2 * y0)
    if not area:
        return sum(p[0] for p in polygon) / len(polygon), sum(p[1] for p in polygon) / len(polygon)
    return x0 + cx / area / 3, y0 + cy / area / 3


def quantile_regression(df: DataFrame, x: str, y: str, q: float = 0.5, max_iter: int = 500, tol: float = 1e-11) -> DataFrame:
    """Slope and intercept of the q-th conditional quantile of y on x, by
    cutting planes on the loss in standardised units. The minimum lies in a
    convex polygon; each iteration is one distributed aggregate of the loss and
    its slopes at the centroid and at points around it over the (persisted)
    two-column data, and each of them cuts the polygon. It ends when no point
    left can lower the mean loss by more than ``tol`` of it (or 1e-14 of the
    standard deviation of y); a fit that does not get there in ``max_iter``
    iterations raises. No rows give nulls. Where several lines reach the
    minimum (a median between two values), the one found is one of them.

    Standard errors and p come from :func:`_slope_inference`."""
    with scratch_table(df.select(to_double(x).alias("x"), to_double(y).alias("y")).na.drop(), "quantreg") as d:
        n, mx, my, sx, sy = d.agg(F.count(F.lit(1)), F.avg("x"), F.avg("y"), F.stddev_pop("x"), F.stddev_pop("y")).first()
        a = b = None
        it, done = 0, False
        if n:
            sx, sy = sx or 1.0, sy or 1.0
            u, v = (F.col("x") - F.lit(mx)) / F.lit(sx), (F.col("y") - F.lit(my)) / F.lit(sy)

            def losses(points):
                parts = []
                for pa, pb in points:
                    r = v - F.lit(pa) - F.lit(pb) * u
                    psi = F.when(r > 0, F.lit(float(q))).when(r < 0, F.lit(float(q) - 1)).otherwise(F.lit(0.0))
                    parts += [F.avg(psi * r), -F.avg(psi), -F.avg(psi * u)]
                row = d.agg(*(p.alias(f"p{i}") for i, p in enumerate(parts))).first()
                return [tuple(row[3 * i:3 * i + 3]) for i in range(len(points))]

            side = 16.0
            while not done:
                polygon = [(-side, -side), (side, -side), (side, side), (-side, side)]
                best, at, lower = float("inf"), (0.0, 0.0), 0.0
                while not done:
                    if it == max_iter:
                        raise RuntimeError(f"quantile_regression: no minimum after {max_iter} iterations (loss {best}, at least {lower})")
                    it += 1
                    c = _centroid(polygon)
                    some = polygon[::max(1, len(polygon) // 4)][:4]
                    points = [c] + [((c[0] + p[0]) / 2, (c[1] + p[1]) / 2) for p in some]
                    seen = losses(points)
                    for p, (f, _, _) in zip(points, seen):
                        if f < best:
                            best, at = f, p
                    slack = 1e-14 + 0.1 * tol * best
                    for (pa, pb), (f, ga, gb) in zip(points, seen):
                        plane = [f + ga * (va - pa) + gb * (vb - pb) for va, vb in polygon]
                        lower = max(lower, min(min(plane), best))
                        left = _cut(polygon, [w - best - slack for w in plane])
                        if len(left) >= 3:
                            polygon = left
                    done = best - lower <= tol * best + 1e-14
                if max(map(abs, at)) > 0.9 * side:  # the minimum may lie outside
                    side, done = 100 * side, False
            b = at[1] * sy / sx
            a = my + sy * at[0] - b * mx
        se = t = p = None
        if n and n > 2:
            se, t, p = _slope_inference(d, q, a, b, n, sy)
    return df.sparkSession.createDataFrame([(float(q), b, a, se, t, p, it, done)], "quantile double, slope double, intercept double, "
                                            "slope_std_err double, slope_t double, slope_p double, iterations int, converged boolean")


def _slope_inference(d: DataFrame, q: float, a: float, b: float, n: int, sy: float) -> tuple[float | None, float | None, float | None]:
    """Standard error, t and two-sided p (n - 2 df) of the slope of a fitted
    quantile line, from one aggregate at the line: the density of the residuals
    at 0 by an Epanechnikov kernel of Hall-Sheather bandwidth, and the sandwich
    (X'X)^-1 X'DX (X'X)^-1 with D = (q / f)^2 above the line, ((1 - q) / f)^2
    elsewhere. Nulls when the residuals have no spread."""
    normal = statistics.NormalDist()
    z = normal.inv_cdf(q)
    h = n ** (-1 / 3) * normal.inv_cdf(0.975) ** (2 / 3) * (1.5 * normal.pdf(z) ** 2 / (2 * z * z + 1)) ** (1 / 3)
    e = F.col("y") - F.lit(a) - F.lit(b) * F.col("x")
    low, high = ranks.quantile_values(d.select(e.alias("e")), "e", [0.25, 0.75])
    if not (0 < q - h and q + h < 1) or high <= low:
        return None, None, None
    width = min(sy, (high - low) / 1.34) * (normal.inv_cdf(q + h) - normal.inv_cdf(q - h))
    u = e / F.lit(width)
    above = F.when(e > 0, 1.0).otherwise(0.0)
    v = F.col("x")
    row = d.agg(F.sum(F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0)), F.sum(v), F.sum(v * v), F.sum(above), F.sum(above * v), F.sum(above * v * v)).first()
    kernel, sx, sxx, k, kx, kxx = row
    density, det = kernel / (n * width), n * sxx - sx * sx
    if not density or det <= 0:
        return None, None, None
    up, down = (q / density) ** 2, ((1 - q) / density) ** 2
    m0, m1, m2 = (up * s + down * (t - s) for s, t in ((k, n), (kx, sx), (kxx, sxx)))
    # second row of (X'X)^-1 is (-sx, n) / det
    var = (sx * sx * m0 - 2 * sx * n * m1 + n * n * m2) / (det * det)
    if var <= 0:
        return None, None, None
    se = math.sqrt(var)
    return se, b / se, t_sf2(b / se, n - 2)
