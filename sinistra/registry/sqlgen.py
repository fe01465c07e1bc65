"""DuckDB SQL builders for the tidy ``(part, level, metric, value)`` oracles
of the domain analyses. They mirror the building blocks of
``sinistra.plans.drought`` one by one."""

from __future__ import annotations

from collections.abc import Sequence

from .sqlsnips import avg_rank, chi2_p, corr_p, dunn_sql, kruskal_sql, mann_whitney_sql, welch_sql

_Q = {"median": 0.5, "p90": 0.9, "p95": 0.95, "q25": 0.25, "q75": 0.75}
_M = {"count": "count(y)", "mean": "avg(y)", "std": "stddev_samp(y)", "min": "min(y)", "max": "max(y)", "n": "count(*)"}


def _metric(m: str) -> str:
    if m in _M:
        return _M[m]
    return f"quantile_cont(y, {_Q[m]})"


def tidy(part: str, select_sql: str, metrics: Sequence[str], level: str | None = "level", digits: int | None = 4,
         part_col: str = "part") -> str:
    """``select_sql`` returns columns level (optional) and the metrics; one
    output row per (level, metric), nulls kept."""
    lv = level if level and level != "level" else ("CAST(level AS VARCHAR)" if level else "CAST(NULL AS VARCHAR)")
    val = (lambda m: f"round(CAST({m} AS DOUBLE), {digits})") if digits is not None else (lambda m: f"CAST({m} AS DOUBLE)")
    rows = " UNION ALL ".join(
        f"SELECT '{part}' AS {part_col}, {lv} AS level, '{m}' AS metric, {val(m)} AS value FROM _t" for m in metrics)
    return f"SELECT * FROM (WITH _t AS ({select_sql}) {rows})"


def level_stats(part: str, src: str, level_expr: str, labels: Sequence[str] | None, metrics: Sequence[str]) -> str:
    """Per-level statistics of y over ``src`` (a subquery with column y);
    with labels, every label is reported (count 0 when empty)."""
    aggs = ", ".join(f"{_metric(m)} AS {m}" for m in metrics)
    s = f"SELECT {level_expr} AS level, {aggs} FROM ({src}) WHERE {level_expr} IS NOT NULL GROUP BY 1"
    if labels is None:
        return tidy(part, s, metrics)
    lv = ", ".join(f"('{v}')" for v in labels)
    sel = ", ".join(f"coalesce(s.{m}, 0) AS {m}" if m == "count" else f"s.{m}" for m in metrics)
    spine = f"SELECT lv.level, {sel} FROM (VALUES {lv}) lv(level) LEFT JOIN ({s}) s ON s.level = lv.level"
    return tidy(part, spine, metrics)


def pearson(part: str, src: str, x: str, name: str = "correlation") -> str:
    return tidy(part, f"SELECT corr({x}, y) AS {name} FROM ({src}) WHERE {x} IS NOT NULL AND y IS NOT NULL", [name], None)


def spearman_rho(part: str, src: str, x: str) -> str:
    r = f"SELECT {avg_rank(x)} AS rx, {avg_rank('y')} AS ry FROM ({src}) WHERE {x} IS NOT NULL AND y IS NOT NULL"
    one = f"SELECT corr(rx, ry) AS rho, CAST(count(*) AS DOUBLE) AS n FROM ({r})"
    return tidy(part, f"SELECT rho, {corr_p('rho', 'n')} AS p_value FROM ({one})", ["rho", "p_value"], None)


def kruskal_gated(part: str, src: str, level_expr: str, n_levels: int | None) -> str:
    """H with tie correction and its p, null unless >= 2 groups all with >= 3 rows
    (and, with n_levels, all levels present)."""
    gate = f"min(n) >= 3 AND count(*) >= 2" + (f" AND count(*) = {n_levels}" if n_levels else "")
    d = f"SELECT {level_expr} AS g, y AS x FROM ({src}) WHERE {level_expr} IS NOT NULL AND y IS NOT NULL"
    h = f"""SELECT CASE WHEN ({gate.replace('min(n)', '(SELECT min(n) FROM sz)').replace('count(*)', '(SELECT count(*) FROM sz)')})
      THEN (12.0 / (N * (N + 1)) * S - 3 * (N + 1)) / (1 - T / (N * N * N - N)) END AS statistic, (SELECT count(*) FROM sz) - 1.0 AS k FROM
      (SELECT CAST(sum(n) AS DOUBLE) AS N, sum(R * R / n) AS S FROM rs), (SELECT sum(c * c * c - c) AS T FROM tt)"""
    body = f"""WITH d AS ({d}), sz AS (SELECT g, count(*) AS n FROM d GROUP BY g),
rk AS (SELECT g, {avg_rank('x')} AS r FROM d), rs AS (SELECT g, count(*) AS n, sum(r) AS R FROM rk GROUP BY g),
tt AS (SELECT CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY x), hh AS ({h}) SELECT statistic, {chi2_p('statistic', 'k')} AS p_value FROM hh"""
    return tidy(part, body, ["statistic", "p_value"], None)


def cut(x: str, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> str:
    def lit(e):
        return "'-infinity'::DOUBLE" if e == float("-inf") else ("'infinity'::DOUBLE" if e == float("inf") else repr(float(e)))
    parts = []
    for i, lab in enumerate(labels):
        lo = f"{x} >= {lit(edges[0])}" if (i == 0 and include_lowest) else f"{x} > {lit(edges[i])}"
        parts.append(f"WHEN {lo} AND {x} <= {lit(edges[i + 1])} THEN '{lab}'")
    return f"(CASE {' '.join(parts)} END)"


def qcut(x: str, src: str, labels: Sequence[str]) -> str:
    """Quartile label of x with exact edges over ``src``."""
    e = [f"(SELECT quantile_cont({x}, {p}) FROM ({src}))" for p in (0, 0.25, 0.5, 0.75, 1)]
    whens = [f"WHEN {x} >= {e[0]} AND {x} <= {e[1]} THEN '{labels[0]}'"] + [
        f"WHEN {x} > {e[i]} AND {x} <= {e[i + 1]} THEN '{labels[i]}'" for i in range(1, 4)]
    return f"(CASE {' '.join(whens)} END)"


def union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


def tidy_keys(analysis: str, sql: str, keys: Sequence[str], metrics: Sequence[str]) -> str:
    """Any result query -> (analysis, level, metric, value), level = keys
    joined with '|', values as they are (no second rounding)."""
    lv = ("concat_ws('|', " + ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys) + ")") if keys else None
    return tidy(analysis, sql, metrics, level=lv, digits=None, part_col="analysis")


def tagged(analysis: str, sql: str) -> str:
    return f"SELECT '{analysis}' AS analysis, * FROM ({sql})"


def robust(part: str, src: str) -> str:
    """Size, median, IQR, trimmed mean, mean and std of y by ``level``."""
    body = f"""WITH _o AS (SELECT level, y, row_number() OVER (PARTITION BY level ORDER BY y) - 1 AS pos, count(*) OVER (PARTITION BY level) AS n FROM ({src}))
SELECT level, count(*) AS n, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr,
       avg(y) FILTER (WHERE n < 20 OR (pos >= floor(n * 0.05) AND pos < greatest(floor(n * 0.95), 1))) AS trimmed_mean, avg(y) AS mean, stddev_samp(y) AS std
FROM _o GROUP BY level"""
    return tidy(part, body, ["n", "median", "iqr", "trimmed_mean", "mean", "std"])


def kruskal(part: str, src: str) -> str:
    """H, p, epsilon squared over all rows and group count; groups of ``level``
    with at least 3 rows."""
    body = f"""WITH _src AS ({src}),{kruskal_sql('_src', 'level', 'y', chi2_p('H', '(k - 1.0)'))}
SELECT H AS statistic, p AS p_value, (H - k + 1) / ((SELECT count(*) FROM _src) - 1) AS epsilon_sq, k AS groups_count FROM _kp"""
    return tidy(part, body, ["statistic", "p_value", "epsilon_sq", "groups_count"], None)


def spearman(part: str, src: str, x: str, monotone: bool = False) -> str:
    body = f"""SELECT rho, p_value, CAST(rho > 0 AND p_value < 0.05 AS INTEGER) AS monotone FROM (SELECT rho, {corr_p('rho', 'n')} AS p_value FROM
      (SELECT corr(rx, ry) AS rho, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {avg_rank(x)} AS rx, {avg_rank('y')} AS ry FROM ({src}))))"""
    return tidy(part, body, ["rho", "p_value"] + (["monotone"] if monotone else []), None)


def dunn(part: str, src: str) -> str:
    body = f"WITH _src AS ({src}),{dunn_sql('_src', 'level', 'y')} SELECT level_a || '|' || level_b AS level, z, p_value, p_holm FROM _dh"
    return tidy(part, body, ["z", "p_value", "p_holm"])


def cliffs(part: str, src: str, pairs: str) -> str:
    """Cliff's delta of each pair of ``pairs`` (a query with a, b), from the
    ranks within the pair; null with fewer than 3 rows on a side."""
    body = f"""WITH _src AS ({src}), _pr AS ({pairs}),
_pd AS (SELECT a, b, CASE WHEN level = a THEN 1.0 ELSE 0.0 END AS is_a, {avg_rank('y', 'a, b')} AS rk FROM _pr JOIN _src ON level = a OR level = b),
_ps AS (SELECT a, b, sum(is_a) AS na, sum(1 - is_a) AS nb, sum(is_a * rk) AS ra FROM _pd GROUP BY a, b)
SELECT a || '|' || b AS level, CASE WHEN na >= 3 AND nb >= 3 THEN 2 * (ra - na * (na + 1) / 2) / (na * nb) - 1 END AS delta FROM _ps"""
    return tidy(part, body, ["delta"])


def two_sides(part: str, src: str) -> str:
    """Both sides of ``f``: sizes, medians, IQRs, trimmed means, difference of
    medians and ratio of means of y."""
    body = f"""WITH _o AS (SELECT f, y, row_number() OVER (PARTITION BY f ORDER BY y) - 1 AS pos, count(*) OVER (PARTITION BY f) AS n FROM ({src})),
_s AS (SELECT f, count(*) AS n, avg(y) AS m, quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr,
              avg(y) FILTER (WHERE n < 20 OR (pos >= floor(n * 0.05) AND pos < greatest(floor(n * 0.95), 1))) AS tm FROM _o GROUP BY f)
SELECT max(n) FILTER (WHERE NOT f) AS n_false, max(n) FILTER (WHERE f) AS n_true, max(med) FILTER (WHERE NOT f) AS median_false,
       max(med) FILTER (WHERE f) AS median_true, max(iqr) FILTER (WHERE NOT f) AS iqr_false, max(iqr) FILTER (WHERE f) AS iqr_true,
       max(tm) FILTER (WHERE NOT f) AS mean_trimmed_false, max(tm) FILTER (WHERE f) AS mean_trimmed_true,
       max(med) FILTER (WHERE f) - max(med) FILTER (WHERE NOT f) AS median_diff, max(m) FILTER (WHERE f) / max(m) FILTER (WHERE NOT f) AS ratio_means FROM _s"""
    return tidy(part, body, ["n_false", "n_true", "median_false", "median_true", "iqr_false", "iqr_true", "mean_trimmed_false", "mean_trimmed_true",
                             "median_diff", "ratio_means"], None)


def mann_whitney(part: str, src: str) -> str:
    body = f"WITH _src AS ({src}),{mann_whitney_sql('_src', 'f', 'y')} SELECT U, p_value, 2 * U / (n1 * n2) - 1 AS cliffs_delta FROM _mw"
    return tidy(part, body, ["U", "p_value", "cliffs_delta"], None)


def welch_log(part: str, src: str) -> str:
    body = f"WITH _src AS (SELECT f, ln(1 + y) AS y FROM ({src})),{welch_sql('_src', 'f', 'y')} SELECT t AS log_t, p_value AS log_t_p FROM _wt"
    return tidy(part, body, ["log_t", "log_t_p"], None)


def winsorized(src: str) -> str:
    """``src`` with y clipped to its 1 % and 99 % quantiles."""
    return f"SELECT * REPLACE (least(greatest(y, lo), hi) AS y) FROM (SELECT *, quantile_cont(y, 0.01) OVER () AS lo, quantile_cont(y, 0.99) OVER () AS hi FROM ({src}))"
