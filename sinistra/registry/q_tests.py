"""Association, rank tests and effect sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.casting import boolify_nullable
from ..operators import tests
from ..operators.lookup import RGA_ORDER
from . import register
from .common import C, TARGET
from .sqlsnips import SIG, avg_rank, corr_p, dunn_sql, f_p, kruskal_sql, mann_whitney_sql, t_p

R6 = lambda c: F.round(F.col(c), 6).alias(c)


@register("kruskal_wallis", "WITH " + kruskal_sql("claims", "statut_sinistre", "montant_charge_brut", "exp(-H / 2)") + f"""
SELECT round(H, 6) AS statistic, CAST(k AS BIGINT) AS groups_count, CAST(N AS BIGINT) AS n,
       round((H - k + 1) / (N - 1), 6) AS epsilon_sq, round(p, 6) AS p_value,
       {SIG.format(p='p')} AS significance, p < 0.05 AS significant
FROM _kp""")
def q_kruskal(spark, sf):
    k = tests.kruskal_wallis(C(spark, sf), "statut_sinistre", TARGET)
    return k.select(R6("statistic"), "groups_count", "n", R6("epsilon_sq"), R6("p_value"), "significance", "significant")


@register("spearman", f"""
WITH d AS (SELECT CAST(surface_police AS DOUBLE) AS x, montant_charge_brut AS y FROM claims
           WHERE surface_police IS NOT NULL AND montant_charge_brut IS NOT NULL),
r AS (SELECT {avg_rank('x')} AS rx, {avg_rank('y')} AS ry FROM d),
o AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM r)
SELECT CAST(n AS BIGINT) AS n, round(rho, 6) AS rho, round({corr_p('rho', 'CAST(n AS DOUBLE)')}, 6) AS p_value FROM o""")
def q_spearman(spark, sf):
    s = tests.spearman(C(spark, sf), "surface_police", TARGET)
    return s.select("n", R6("rho"), R6("p_value"))


@register("mann_whitney", f"""WITH{mann_whitney_sql('claims', 'risk_flag', 'montant_charge_brut')}
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(U, 6) AS U, round(z, 6) AS z, round(2 * U / (n1 * n2) - 1, 6) AS cliffs_delta,
       round(p_value, 6) AS p_value FROM _mw""")
def q_mann_whitney(spark, sf):
    m = tests.mann_whitney(C(spark, sf), "risk_flag", TARGET)
    return m.select("n1", "n2", R6("U"), R6("z"), R6("cliffs_delta"), R6("p_value"))


_PAIRS = [(a, b) for i, a in enumerate(RGA_ORDER) for b in RGA_ORDER[i + 1:]]
_PAIRS_SQL = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_PAIRS))


@register("cliffs_delta", f"""
WITH p(pair, level_a, level_b) AS (VALUES {_PAIRS_SQL}),
d AS (SELECT risque_rga_gcl AS g, montant_charge_brut AS x FROM claims WHERE risque_rga_gcl IS NOT NULL AND montant_charge_brut IS NOT NULL),
c AS (SELECT p.pair, p.level_a, p.level_b,
             CAST((SELECT count(*) FROM d a, d b WHERE a.g = p.level_a AND b.g = p.level_b AND a.x > b.x) AS DOUBLE) AS gt,
             CAST((SELECT count(*) FROM d a, d b WHERE a.g = p.level_a AND b.g = p.level_b AND a.x < b.x) AS DOUBLE) AS lt,
             (SELECT count(*) FROM d WHERE g = p.level_a) AS na, (SELECT count(*) FROM d WHERE g = p.level_b) AS nb
      FROM p)
SELECT CAST(pair AS INTEGER) AS pair, level_a, level_b, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b,
       round((gt - lt) / (na * nb), 6) AS delta FROM c""")
def q_cliffs(spark, sf):
    c = tests.cliffs_delta_pairs(C(spark, sf), "risque_rga_gcl", TARGET, _PAIRS)
    return c.select("pair", "level_a", "level_b", "n_a", "n_b", R6("delta"))


@register("dunn_posthoc", f"""WITH{dunn_sql('claims', 'risque_rga_gcl', 'montant_charge_brut')}
SELECT level_a, level_b, round(z, 6) AS z, round(p_value, 6) AS p_value, round(p_holm, 6) AS p_holm FROM _dh""")
def q_dunn(spark, sf):
    d = tests.dunn_posthoc(C(spark, sf), "risque_rga_gcl", TARGET)
    return d.select("level_a", "level_b", R6("z"), R6("p_value"), R6("p_holm"))


@register("anova_f", f"""
WITH d AS (SELECT type_mur_batiment AS g, montant_charge_brut AS x FROM claims WHERE type_mur_batiment IS NOT NULL AND montant_charge_brut IS NOT NULL),
g AS (SELECT g, count(*) AS n, avg(x) AS m FROM d GROUP BY g HAVING count(*) >= 3),
d2 AS (SELECT d.x, g.m FROM d JOIN g USING (g)),
o AS (SELECT avg(x) AS gm FROM d2),
r AS (SELECT (SELECT count(*) FROM g) AS k, (SELECT count(*) FROM d2) AS n, (SELECT sum(n * (m - gm) * (m - gm)) FROM g, o) AS ssb,
             (SELECT sum((x - m) * (x - m)) FROM d2) AS ssw),
f AS (SELECT k, n, (ssb / (k - 1)) / (ssw / (n - k)) AS F FROM r)
SELECT CAST(k AS BIGINT) AS groups_count, CAST(n AS BIGINT) AS n, round(F, 6) AS F, CAST(k - 1 AS BIGINT) AS df_between,
       CAST(n - k AS BIGINT) AS df_within, round({f_p('F', 'CAST(k - 1 AS DOUBLE)', 'CAST(n - k AS DOUBLE)')}, 6) AS p_value FROM f""")
def q_anova(spark, sf):
    a = tests.anova_f(C(spark, sf), "type_mur_batiment", TARGET, max_levels=10)
    return a.select("groups_count", "n", R6("F"), "df_between", "df_within", R6("p_value"))


@register("t_test", f"""
WITH d AS (SELECT risk_flag AS f, montant_charge_brut AS x FROM claims WHERE risk_flag IS NOT NULL AND montant_charge_brut IS NOT NULL),
s AS (SELECT CAST(count(*) FILTER (WHERE f) AS DOUBLE) AS n1, avg(x) FILTER (WHERE f) AS m1, var_samp(x) FILTER (WHERE f) AS v1,
             CAST(count(*) FILTER (WHERE NOT f) AS DOUBLE) AS n2, avg(x) FILTER (WHERE NOT f) AS m2, var_samp(x) FILTER (WHERE NOT f) AS v2 FROM d),
t AS (SELECT n1, n2, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t, n1 + n2 - 2 AS df FROM s)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(t, 6) AS t, round(df, 6) AS df, round({t_p('t', 'df')}, 6) AS p_value FROM t""")
def q_t_test(spark, sf):
    t = tests.t_test(C(spark, sf), "risk_flag", TARGET)
    return t.select("n1", "n2", R6("t"), R6("df"), R6("p_value"))


@register("jarque_bera", """
WITH m AS (SELECT count(x) AS n, avg(x) AS mu FROM (SELECT montant_charge_brut AS x FROM claims)),
c AS (SELECT avg(power(x - mu, 2)) AS m2, avg(power(x - mu, 3)) AS m3, avg(power(x - mu, 4)) AS m4, any_value(n) AS n
      FROM (SELECT montant_charge_brut AS x FROM claims), m WHERE x IS NOT NULL),
j AS (SELECT n, m3 / power(m2, 1.5) AS s, m4 / (m2 * m2) - 3 AS k FROM c)
SELECT CAST(n AS BIGINT) AS n, round(n / 6.0 * (s * s + k * k / 4), 6) AS jb, round(exp(-(n / 6.0 * (s * s + k * k / 4)) / 2), 6) AS p_value FROM j""")
def q_jarque_bera(spark, sf):
    j = tests.jarque_bera(C(spark, sf), TARGET)
    return j.select("n", R6("jb"), R6("p_value"))


@register("linear_trend", f"""
WITH d AS (SELECT montant_charge_brut AS y, date_sinistre AS dt FROM claims WHERE montant_charge_brut IS NOT NULL AND date_sinistre IS NOT NULL),
x AS (SELECT y, floor((epoch_us(dt) - epoch_us((SELECT min(dt) FROM d))) / 86400e6) AS x FROM d),
o AS (SELECT count(*) AS n, regr_slope(y, x) AS b, corr(x, y) AS r FROM x)
SELECT CAST(n AS BIGINT) AS n, round(b, 6) AS slope_per_day, round(b * 365.25, 6) AS slope_per_year, round(power(r, 2), 6) AS r_squared,
       round({corr_p('r', 'CAST(n AS DOUBLE)')}, 6) AS p_value FROM o""")
def q_linear_trend(spark, sf):
    t = tests.linear_trend(C(spark, sf), TARGET, "date_sinistre")
    return t.select("n", R6("slope_per_day"), R6("slope_per_year"), R6("r_squared"), R6("p_value"))


from ..operators import correlation  # noqa: E402
from .q_aggregates import NUM, rnd  # noqa: E402
from .q_windows import _corr_sql  # noqa: E402

_NUM_X = [c for c in NUM if c != TARGET]


@register("corr_with_target", _corr_sql(_NUM_X, 0.005))
def q_corr_target(spark, sf):
    c = correlation.corr_with_target(C(spark, sf), TARGET, _NUM_X, threshold=0.005)
    return rnd(c, 6, skip=("missing_pct",))


@register("corr_matrix", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, round(corr({a}, {b}) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL), 6) AS r FROM claims"
    for i, a in enumerate(NUM) for b in NUM[i:]))
def q_corr_matrix(spark, sf):
    return rnd(correlation.corr_matrix(C(spark, sf), NUM), 6)


@register("yearly_trend_flag", """
WITH y AS (SELECT year(date_sinistre) AS yr, avg(montant_charge_brut) AS m FROM claims WHERE montant_charge_brut IS NOT NULL GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS years, round(corr(yr, m), 6) AS r, count(*) > 1 AND abs(corr(yr, m)) > 0.5 AS trend_flag FROM y""")
def q_yearly_trend(spark, sf):
    d = C(spark, sf).where(F.col(TARGET).isNotNull())
    y = d.groupBy(F.year("date_sinistre").alias("yr")).agg(F.avg(TARGET).alias("m"))
    from ..functions.stats import pair_corr
    one = y.agg(F.count(F.lit(1)).cast("bigint").alias("years"), pair_corr(F.col("yr").cast("double"), F.col("m")).alias("r"))
    return rnd(one.withColumn("trend_flag", (F.col("years") > 1) & (F.abs("r") > 0.5)), 6)


@register("polyfit_line", """
WITH d AS (SELECT surface_police AS x, montant_charge_brut AS y FROM claims WHERE surface_police IS NOT NULL AND montant_charge_brut IS NOT NULL)
SELECT CAST(count(*) AS BIGINT) AS n, round(CASE WHEN count(*) > 10 THEN regr_slope(y, x) END, 6) AS slope,
       round(CASE WHEN count(*) > 10 THEN regr_intercept(y, x) END, 4) AS intercept FROM d""")
def q_polyfit(spark, sf):
    d = C(spark, sf).where(F.col("surface_police").isNotNull() & F.col(TARGET).isNotNull())
    one = d.agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.regr_slope(TARGET, "surface_police").alias("slope"),
                F.regr_intercept(TARGET, "surface_police").alias("intercept"))
    return one.select("n", F.round(F.when(F.col("n") > 10, F.col("slope")), 6).alias("slope"),
                      F.round(F.when(F.col("n") > 10, F.col("intercept")), 4).alias("intercept"))
