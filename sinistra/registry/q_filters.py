"""Filter keys. Each returns the whole filtered claims table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from ..plans.flagship import filtered_claims
from . import register
from .common import C, TARGET
from .q_aggregates import rnd

ALL = "*"


@register("filter_valid_claim", "SELECT * FROM claims WHERE lower(trim(est_dans_sin_cluster)) IN ('1','true','t','yes','y','vrai','oui') OR (lower(trim(est_dans_sin_cluster)) NOT IN ('0','false','f','no','n','faux','non') AND length(est_dans_sin_cluster) > 0)")
def q_valid(spark, sf):
    return filters.filter_valid_claim(C(spark, sf), "est_dans_sin_cluster")


@register("filter_closed", "SELECT * FROM claims WHERE lower(statut_sinistre) IN ('clos', 'fermé', 'closed')")
def q_closed(spark, sf):
    return filters.filter_closed(C(spark, sf))


@register("filter_amount_range", "SELECT * FROM claims WHERE montant_charge_brut >= 100000 AND montant_charge_brut <= 400000")
def q_amount(spark, sf):
    return filters.filter_amount_range(C(spark, sf), TARGET, 100000, 400000)


@register("filter_geocoded", "SELECT * FROM claims WHERE coalesce(risk_flag, false)")
def q_geocoded(spark, sf):
    return filters.filter_geocoded(C(spark, sf), "risk_flag")


@register("filter_date_range", "SELECT * FROM claims WHERE date_sinistre >= TIMESTAMP '1996-01-01' AND date_sinistre <= TIMESTAMP '1999-12-31'")
def q_dates(spark, sf):
    return filters.filter_date_range(C(spark, sf), "date_sinistre", "1996-01-01", "1999-12-31")


@register("filter_risk_types", "SELECT * FROM claims WHERE risque_rga_gcl IN ('fort', 'maximal')")
def q_risk_types(spark, sf):
    return filters.filter_risk_types(C(spark, sf), "risque_rga_gcl", ["fort", "maximal"])


@register("filter_surface_range", "SELECT * FROM claims WHERE surface_police >= 10 AND surface_police <= 1000")
def q_surface(spark, sf):
    return filters.filter_surface_range(C(spark, sf), "surface_police", 10, 1000)


@register("dedup_claims", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY police ORDER BY cod_sin) AS rn FROM claims) WHERE rn = 1""")
def q_dedup(spark, sf):
    return filters.dedup_claims(C(spark, sf), ["police"], order_by=["cod_sin"])


@register("filter_domain_ranges", """
SELECT * FROM claims WHERE montant_charge_brut > 0 AND 2025 - annee_construction_batiment BETWEEN 0 AND 200
  AND nb_pieces_police BETWEEN 0 AND 20 AND nb_etages_batiment BETWEEN 0 AND 30 AND annee_construction_batiment > 1800""")
def q_domain_ranges(spark, sf):
    d = C(spark, sf)
    return d.where(filters.p_range(TARGET, 0, lo_strict=True, df=d) & filters.building_age_bounds("annee_construction_batiment", 2025, 0, 200, d)
                   & filters.p_range("nb_pieces_police", 0, 20, df=d) & filters.p_range("nb_etages_batiment", 0, 30, df=d)
                   & filters.p_range("annee_construction_batiment", 1800, lo_strict=True, df=d))


@register("drop_null_target", "SELECT * FROM claims WHERE engagements IS NOT NULL")
def q_drop_null(spark, sf):
    return filters.drop_null_target(C(spark, sf), "engagements")


@register("filter_extreme_iqr", """
WITH q AS (SELECT quantile_cont(weather_precip_mean, 0.25) AS q1, quantile_cont(weather_precip_mean, 0.75) AS q3 FROM claims),
a AS (SELECT bool_or(weather_precip_mean < q1 - 1.5 * (q3 - q1) OR weather_precip_mean > q3 + 1.5 * (q3 - q1)) AS anyo FROM claims, q)
SELECT claims.* FROM claims, q, a
WHERE NOT coalesce(anyo, false) OR (weather_precip_mean >= q1 - 3 * (q3 - q1) AND weather_precip_mean <= q3 + 3 * (q3 - q1))""")
def q_extreme(spark, sf):
    return filters.filter_extreme_iqr(C(spark, sf), "weather_precip_mean")


@register("having_min_count", """
SELECT ville, CAST(count(*) AS BIGINT) AS n, round(avg(montant_charge_brut), 4) AS mean FROM claims
GROUP BY ville HAVING count(*) >= 600""")
def q_having(spark, sf):
    g = C(spark, sf).groupBy("ville").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.avg(TARGET).alias("mean"))
    return rnd(filters.having_min_count(g, 600, "n"))


_AUDIT_STEPS = [
    ("valid_claim", "lower(trim(est_dans_sin_cluster)) IN ('1','true','t','yes','y','vrai','oui')"),
    ("closed", "lower(statut_sinistre) IN ('clos', 'fermé', 'closed')"),
    ("amount_range", "montant_charge_brut >= 100000 AND montant_charge_brut <= 400000"),
    ("date_range", "date_sinistre >= TIMESTAMP '1996-01-01' AND date_sinistre <= TIMESTAMP '2000-12-31'"),
    ("surface_range", "surface_police >= 10 AND surface_police <= 1000"),
]


def _audit_sql():
    conds, parts = [], ["SELECT 0 AS step, 'input' AS filter, (SELECT count(*) FROM claims) AS remaining"]
    for i, (name, c) in enumerate(_AUDIT_STEPS, 1):
        conds.append(f"({c})")
        parts.append(f"SELECT {i}, '{name}', (SELECT count(*) FROM claims WHERE {' AND '.join(conds)})")
    n = len(_AUDIT_STEPS) + 1
    parts.append(f"SELECT {n}, 'dedup', (SELECT count(*) FROM (SELECT DISTINCT police, cod_sin FROM claims WHERE {' AND '.join(conds)}))")
    return f"""WITH s AS ({' UNION ALL '.join(parts)}),
l AS (SELECT step, filter, remaining, lag(remaining) OVER (ORDER BY step) AS prev, first_value(remaining) OVER (ORDER BY step) AS s0 FROM s)
SELECT CAST(step AS INTEGER) AS step, filter, CAST(coalesce(prev - remaining, 0) AS BIGINT) AS removed, CAST(remaining AS BIGINT) AS remaining,
       round(remaining * 100.0 / prev, 1) AS retention, round(remaining * 100.0 / s0, 1) AS overall_retention FROM l"""


@register("filter_audit", _audit_sql())
def q_audit(spark, sf):
    d = C(spark, sf)
    steps = [
        ("valid_claim", filters.p_valid_claim(d, "est_dans_sin_cluster")),
        ("closed", filters.p_closed()),
        ("amount_range", filters.p_amount_range(TARGET, 100000, 400000)),
        ("date_range", filters.p_date_range("date_sinistre", "1996-01-01", "2000-12-31")),
        ("surface_range", filters.p_range("surface_police", 10, 1000)),
    ]
    return filters.filter_audit(d, steps, dedup_keys=["police", "cod_sin"])
