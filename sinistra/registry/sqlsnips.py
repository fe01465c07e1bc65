"""DuckDB SQL fragments shared by the oracles."""

SIG = """CASE WHEN {p} IS NULL THEN NULL WHEN {p} < 0.001 THEN 'Très significatif'
 WHEN {p} < 0.01 THEN 'Significatif' WHEN {p} < 0.05 THEN 'Modérément significatif'
 ELSE 'Non significatif' END"""


def avg_rank(x: str, part: str = "") -> str:
    """Average rank of ``x`` (ties share), optionally per partition."""
    pb = f"PARTITION BY {part} " if part else ""
    pb2 = f"PARTITION BY {part + ', ' if part else ''}{x}"
    return f"(rank() OVER ({pb}ORDER BY {x}) + (count(*) OVER ({pb2}) - 1) / 2.0)"


def kruskal_sql(src: str, g: str, x: str, p_expr: str) -> str:
    """Kruskal-Wallis over ``src`` (a CTE name) with groups of >= 3 rows."""
    return f"""
_kd AS (SELECT {g} AS g, {x} AS x FROM {src} WHERE {g} IS NOT NULL AND {x} IS NOT NULL),
_kk AS (SELECT g FROM _kd GROUP BY g HAVING count(*) >= 3),
_kd2 AS (SELECT _kd.* FROM _kd JOIN _kk USING (g)),
_kr AS (SELECT g, x, {avg_rank('x')} AS rk FROM _kd2),
_kt AS (SELECT CAST(count(*) AS DOUBLE) AS c FROM _kd2 GROUP BY x),
_ks AS (SELECT g, count(*) AS n, sum(rk) AS R FROM _kr GROUP BY g),
_ko AS (SELECT CAST(sum(n) AS DOUBLE) AS N, count(*) AS k, sum(R * R / n) AS S FROM _ks),
_kties AS (SELECT sum(c * c * c - c) AS T FROM _kt),
_kh AS (SELECT CASE WHEN k >= 2 THEN (12.0 / (N * (N + 1)) * S - 3 * (N + 1)) / (1 - T / (N * N * N - N)) END AS H,
               k, N FROM _ko, _kties),
_kp AS (SELECT H, k, N, {p_expr} AS p FROM _kh)"""


def _simpson(f: str, a: str, b: str, steps: int = 4000) -> str:
    """Integral of ``f``, an expression of x, from a to b."""
    h = f"(({b}) - ({a})) / {steps}.0"
    term = f.replace("{x}", f"(({a}) + i * ({h}))")
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * ({term}))) * ({h}) / 3.0)"


def norm_p(z: str) -> str:
    """Two-sided normal p by quadrature of the density beyond |z|."""
    tail = _simpson("exp(-0.5 * {x} * {x})", f"abs({z})", f"abs({z}) + 12.0")
    return f"(CASE WHEN ({z}) IS NOT NULL THEN 2.0 * {tail} / sqrt(2.0 * pi()) END)"


def t_p(t: str, df: str) -> str:
    """Two-sided Student t p: with x = sqrt(df) tan(a) the density is that of
    cos(a) ^ (df - 1)."""
    lo = f"atan(abs({t}) / sqrt({df}))"
    tail = _simpson(f"exp((({df}) - 1) * ln(greatest(cos({{x}}), 1e-300)))", lo, f"least(pi() / 2, {lo} + 40.0 / sqrt({df}))")
    return f"(CASE WHEN ({t}) IS NOT NULL AND ({df}) > 0 THEN 2.0 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {tail} END)"


def f_p(f: str, d1: str, d2: str) -> str:
    """Upper tail of F: the incomplete beta integral at x = d2 / (d2 + d1 f) in
    s = -ln of the share of x."""
    a, b, x = f"(({d2}) / 2.0)", f"(({d1}) / 2.0)", f"(({d2}) / (({d2}) + ({d1}) * ({f})))"
    body = _simpson(f"exp(-{a} * {{x}}) * power(1.0 - {x} * exp(-{{x}}), {b} - 1.0)", "0.0", f"45.0 / {a}")
    head = f"exp({a} * ln({x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))"
    one = t_p(f"sqrt({f})", d2)  # one numerator degree of freedom: the square of a t
    return f"(CASE WHEN ({f}) > 0 THEN CASE WHEN ({d1}) = 1 THEN {one} ELSE {head} * {body} END WHEN ({f}) IS NOT NULL THEN 1.0 END)"


def chi2_p(x: str, k: str) -> str:
    """Upper tail of chi-square; one degree of freedom through the normal."""
    tail = _simpson(f"exp((({k}) / 2.0 - 1) * ln({{x}}) - {{x}} / 2.0 - ({k}) / 2.0 * ln(2.0) - lgamma(({k}) / 2.0))", f"greatest({x}, 1e-12)", f"({x}) + 120.0")
    return f"(CASE WHEN ({x}) IS NULL OR ({k}) <= 0 THEN NULL WHEN ({k}) = 1 THEN {norm_p(f'sqrt(greatest({x}, 0.0))')} ELSE {tail} END)"


def corr_p(r: str, n: str) -> str:
    """Two-sided p of a correlation (t with n - 2 df)."""
    t = f"(({r}) * sqrt((({n}) - 2) / (1.0 - ({r}) * ({r}))))"
    return f"(CASE WHEN abs({r}) >= 1 THEN 0.0 WHEN ({n}) > 2 THEN {t_p(t, f'(({n}) - 2.0)')} END)"


def mann_whitney_sql(src: str, flag: str, x: str) -> str:
    """CTEs over ``src``: ``_mw`` with n1, n2, U, z and p_value (asymptotic,
    continuity and tie correction) of the rows where ``flag`` holds."""
    return f"""
_md AS (SELECT {flag} AS f, {x} AS x FROM {src} WHERE {flag} IS NOT NULL AND {x} IS NOT NULL),
_mr AS (SELECT f, {avg_rank('x')} AS rk FROM _md),
_mt AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM _md GROUP BY x)),
_ms AS (SELECT CAST(count(*) FILTER (WHERE f) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE NOT f) AS DOUBLE) AS n2, sum(rk) FILTER (WHERE f) AS R1 FROM _mr),
_mu AS (SELECT n1, n2, R1 - n1 * (n1 + 1) / 2 AS U, ties FROM _ms, _mt),
_mz AS (SELECT *, (greatest(U, n1 * n2 - U) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM _mu),
_mw AS (SELECT *, CASE WHEN z < 0 THEN 1.0 ELSE {norm_p('z')} END AS p_value FROM _mz)"""


def dunn_sql(src: str, g: str, x: str) -> str:
    """CTEs over ``src``: ``_dh`` with level_a, level_b, z, p_value, p_holm."""
    return f"""
_dd AS (SELECT {g} AS g, {x} AS x FROM {src} WHERE {g} IS NOT NULL AND {x} IS NOT NULL
        AND {g} IN (SELECT {g} FROM {src} WHERE {x} IS NOT NULL GROUP BY {g} HAVING count(*) >= 3)),
_dr AS (SELECT g, {avg_rank('x')} AS rk FROM _dd),
_ds AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, avg(rk) AS m FROM _dr GROUP BY g),
_dt AS (SELECT sum(c * c * c - c) AS ties, sum(c) AS total FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM _dd GROUP BY x)),
_dz AS (SELECT a.g AS level_a, b.g AS level_b, (a.m - b.m) / sqrt((total * (total + 1) / 12 - ties / (12 * (total - 1))) * (1 / a.n + 1 / b.n)) AS z
        FROM _ds a JOIN _ds b ON a.g < b.g, _dt),
_dp AS (SELECT *, {norm_p('z')} AS p_value FROM _dz),
_dq AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value, level_a, level_b) + 1) * p_value) AS adj FROM _dp),
_dh AS (SELECT level_a, level_b, z, p_value, max(adj) OVER (ORDER BY p_value, level_a, level_b) AS p_holm FROM _dq)"""


def welch_sql(src: str, flag: str, x: str) -> str:
    """CTEs over ``src``: ``_wt`` with t and p_value of the rows where ``flag``
    holds against the others, variances unequal."""
    side = lambda f, c: f"{f} FILTER (WHERE {c})"
    return f"""
_wd AS (SELECT {flag} AS f, {x} AS x FROM {src} WHERE {flag} IS NOT NULL AND {x} IS NOT NULL),
_ws AS (SELECT {side('avg(x)', 'f')} - {side('avg(x)', 'NOT f')} AS m, {side('var_samp(x)', 'f')} / {side('count(*)', 'f')} AS a,
               {side('var_samp(x)', 'NOT f')} / {side('count(*)', 'NOT f')} AS b, {side('count(*)', 'f')} AS n1, {side('count(*)', 'NOT f')} AS n2 FROM _wd),
_wz AS (SELECT m / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS df FROM _ws),
_wt AS (SELECT t, df, {t_p('t', 'df')} AS p_value FROM _wz)"""
