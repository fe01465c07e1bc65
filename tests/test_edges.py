"""Edge semantics on the hand-made tables of FIXTURES.md §3 and the golden
values of §4 (special functions, quartile ties, Cliff's delta, months)."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sinistra.functions import casting, dates, special
from sinistra.operators import binning, ranks, summary, temporal, tests


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_numbers(spark):
    d = spark.createDataFrame([(s,) for s in ["12", " 7 ", "12,5", "1 234,50 €", "nan", "", "abc", "1e3", None]], "s string")
    got = [r[0] for r in d.select(casting.to_double(F.trim("s"))).collect()]
    assert got == [12.0, 7.0, None, None, None, None, None, 1000.0, None]
    eu = [r[0] for r in d.select(casting.clean_european_number("s")).collect()]
    assert eu[:4] == [12.0, 7.0, 12.5, 1234.5]


def test_flags_two_readers(spark):
    vals = ["oui", "NON", "Vrai", "t", "0", "1", "2", "peut-être", "", None]
    d = spark.createDataFrame([(v,) for v in vals], "f string")
    a = [r[0] for r in d.select(casting.boolify("f")).collect()]
    b = [r[0] for r in d.select(casting.boolify_nullable("f")).collect()]
    assert a == [True, False, True, True, False, True, True, True, False, False]
    assert b == [True, False, True, None, False, True, True, None, None, None]


def test_dates(spark):
    d = spark.createDataFrame([(v,) for v in ["2022-07-01", "31/12/2022", "bad", None, "2024-12-31 10:00:00"]], "d string")
    got = [r[0] for r in d.select(casting.to_timestamp_any("d")).collect()]
    assert str(got[0]) == "2022-07-01 00:00:00" and str(got[1]) == "2022-12-31 00:00:00"
    assert got[2] is None and got[3] is None
    from sinistra.operators.filters import p_date_range
    t = d.select(casting.to_timestamp_any("d").alias("x"))
    kept = t.where(p_date_range("x", "2022-01-01", "2024-12-31")).count()
    assert kept == 2  # midnight end bound excludes 10:00 on the last day


def test_edges_lowest(spark):
    d = spark.createDataFrame([(float(v),) if v is not None else (None,) for v in [0, 20, 20.5, 40, 60, 100, None]], "x double")
    inc = [r[0] for r in d.select(binning.cut_expr(F.col("x"), [0, 20, 40, 60, math.inf], ["a", "b", "c", "d"], True)).collect()]
    exc = [r[0] for r in d.select(binning.cut_expr(F.col("x"), [0, 20, 40, 60, 100, math.inf], ["a", "b", "c", "d", "e"])).collect()]
    assert inc == ["a", "a", "b", "b", "c", "d", None]
    assert exc == [None, "a", "b", "b", "c", "d", None]


def test_quartile_ties(spark):
    d = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 2, 3, 4, 5, 9]], "x double")
    q = binning.qcut_quartiles(d, "x", 4, out="q").groupBy("q").count()
    got = {r["q"]: r["count"] for r in q.collect()}
    assert got == {"Q1": 4, "Q3": 2, "Q4": 2}


def test_constant_correlation(spark):
    from sinistra.functions.stats import pair_corr
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    r = d.agg(pair_corr(F.col("x"), F.col("y")).alias("r"), F.regr_slope("y", "x").alias("s")).first()
    assert r["r"] is None and r["s"] is None


def test_small_groups_moments(spark):
    data = [("g1", 1.0), ("g2", 1.0), ("g2", 2.0), ("g3", 1.0), ("g3", 2.0), ("g3", 4.0),
            ("g4", 1.0), ("g4", 2.0), ("g4", 4.0), ("g4", 8.0)]
    d = spark.createDataFrame(data, "g string, x double")
    s = {r["g"]: r for r in summary.summarize(d, "x", ["g"], ("count", "std", "skew", "kurt")).collect()}
    assert s["g1"]["std"] is None
    assert s["g2"]["skew"] is None and s["g3"]["kurt"] is None
    p = pd.Series([1.0, 2.0, 4.0, 8.0])
    assert abs(s["g4"]["skew"] - p.skew()) < 1e-12 and abs(s["g4"]["kurt"] - p.kurt()) < 1e-12


def test_cliffs_delta_definition(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 4.0), ("b", 1.0)], "g string, x double")
    r = tests.cliffs_delta_pairs(d, "g", "x", [("a", "b")], min_n=1).first()
    assert abs(r["delta"] - 2 / 3) < 1e-12
    d2 = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0)], "g string, x double")
    assert tests.cliffs_delta_pairs(d2, "g", "x", [("a", "b")], min_n=1).first()["delta"] == 0.0


def test_months_spine(spark):
    d = spark.createDataFrame([("2023-01-15", 10.0), ("2023-03-02", 20.0), ("2023-03-05", 30.0), ("2023-12-01", 5.0)],
                              "d string, x double").select(F.col("d").cast("timestamp_ntz").alias("d"), "x")
    m = temporal.monthly_series(d, "x", "d", "sum", min_count=2).orderBy("month").collect()
    assert len(m) == 12
    vals = [r["x_sum"] for r in m]
    assert vals[2] == 50.0 and all(v is None for i, v in enumerate(vals) if i != 2)
    s = temporal.seasonality(d, "x", "d").first()
    assert s["summer_vs_winter"] is None  # no summer month: average over months present


def test_postal(spark):
    d = spark.createDataFrame([(v,) for v in ["01000", "1000", "75001", "2A004", None, "123456"]], "c string")
    assert [r[0] for r in d.select(dates.department("c")).collect()] == ["01", "01", "75", "2A", None, "12"]


@pytest.mark.parametrize("rho,n,p", [(-0.14778079468285782, 94, 0.15519035109491755),
                                     (0.1187840829364205, 73, 0.31686354285113855),
                                     (0.19717316822234662, 94, 0.056801966262999756)])
def test_spearman_golden_p(rho, n, p):
    t = rho * math.sqrt((n - 2) / (1 - rho * rho))
    assert abs(special.t_sf2(t, n - 2) - p) < 1e-12


def test_pvalue_udfs(spark):
    d = spark.createDataFrame([(3.0, 2.0, 1.96)], "h double, k double, z double")
    r = d.select(special.chi2_pvalue("h", "k").alias("c"), special.norm_pvalue("z").alias("n")).first()
    assert abs(r["c"] - math.exp(-1.5)) < 1e-12 and abs(r["n"] - 0.04999579029644087) < 1e-12


def test_golden_iqr_and_moments(spark):
    # the 9 amounts of the committed golden run are not copied here; the
    # quartile rule is checked on values with the same structure instead
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0]
    d = spark.createDataFrame([(v,) for v in vals], "x double")
    o = binning.outliers_iqr(d, "x").first()
    s = pd.Series(vals)
    assert o["q1"] == s.quantile(.25) and o["q3"] == s.quantile(.75)
    assert o["outlier_count"] == 1 and abs(o["std"] - s.std()) < 1e-9


def test_duplicate_keys_null_equal(spark):
    from sinistra.operators.filters import dedup_claims
    d = spark.createDataFrame([("a", "1", 1), ("a", "1", 2), (None, None, 3), (None, None, 4), ("b", None, 5)],
                              "police string, cod_sin string, n int")
    got = sorted(rows(dedup_claims(d, ["police", "cod_sin"], order_by=["n"]), "police", "cod_sin", "n"), key=str)
    assert got == sorted([("a", "1", 1), (None, None, 3), ("b", None, 5)], key=str)


def test_rank_paths_agree(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    p = pd.DataFrame({"g": rng.choice(["x", "y"], 2000), "v": np.round(rng.normal(0, 1, 2000), 1)})
    p.loc[:700, "v"] = 0.5  # one value holding a third of the rows
    d = spark.createDataFrame(p)
    a = ranks.exact_quantiles(d, "v", [0.1, 0.5, 0.9], ["g"], names=["a", "b", "c"]).toPandas().sort_values("g")
    b = ranks.exact_quantiles(d, "v", [0.1, 0.5, 0.9], ["g"], names=["a", "b", "c"], buckets=16).toPandas().sort_values("g")
    e = p.groupby("g")["v"].quantile([0.1, 0.5, 0.9]).unstack().values
    assert np.allclose(a[["a", "b", "c"]].values, e) and np.allclose(b[["a", "b", "c"]].values, e)


def test_mann_whitney_exact_small(spark):
    data = [(True, v) for v in (1.0, 2.0, 3.0)] + [(False, v) for v in (4.0, 5.0, 6.0, 7.0)]
    d = spark.createDataFrame(data, "f boolean, x double")
    r = tests.mann_whitney(d, "f", "x", first=True).first()
    assert r["U"] == 0.0 and r["exact"] and abs(r["p_value"] - 2 / 35) < 1e-12
    # with a tie the normal approximation is used
    d2 = spark.createDataFrame(data + [(True, 4.0)], "f boolean, x double")
    r2 = tests.mann_whitney(d2, "f", "x", first=True).first()
    assert not r2["exact"] and 0 < r2["p_value"] < 1


def test_mann_whitney_exact_counts():
    from itertools import combinations

    from sinistra.functions.special import mw_exact_sf

    for m, n in ((1, 5), (2, 7), (4, 4), (3, 9)):
        us = [sum(c) - m * (m + 1) // 2 for c in combinations(range(1, m + n + 1), m)]
        for k in range(m * n + 2):
            assert mw_exact_sf(k, m, n) == pytest.approx(sum(u >= k for u in us) / len(us), abs=1e-15)
    assert mw_exact_sf(4 * 10**9 + 1, 8, 10**9) == pytest.approx(0.5, abs=1e-8)  # no table of n1 * n2


def test_tails_keep_digits_at_scale():
    from sinistra.functions.special import f_sf, gammaincc, norm_sf2, t_sf2

    for df in (1e8, 1e10, 1e12):
        assert t_sf2(2.0, df) == pytest.approx(norm_sf2(2.0), rel=1e-7)
        assert f_sf(1.5, 4, df) == pytest.approx(gammaincc(2.0, 3.0), rel=1e-7)
    assert t_sf2(2.0, 1e6) == pytest.approx(t_sf2(2.0, 999_999.0), rel=1e-8)


def test_epsilon_squared_counts_small_groups(spark):
    """Rows of a group below ``min_n`` take no part in H but in epsilon squared."""
    from sinistra.operators.tests import kruskal_wallis

    rows = [("a", float(i)) for i in range(0, 20, 2)] + [("b", float(i)) for i in range(1, 20, 2)] + [("c", 30.0), ("c", 31.0)]
    r = kruskal_wallis(spark.createDataFrame(rows, "g string, v double"), "g", "v").first()
    assert (r.groups_count, r.n) == (2, 20)
    assert r.epsilon_sq == pytest.approx((r.statistic - 1) / 21)


def test_penalties_match_their_objective(spark):
    """One feature with mean 0 and population variance 1: the minimum of
    1/(2n) |y - bz|^2 + L1 |b| + L2/2 b^2 is (z.y/n - L1) / (1 + L2)."""
    import numpy as np
    from pyspark.ml.feature import VectorAssembler

    from sinistra.operators import models

    x = np.array([-2.0, -1.0, 0.0, 1.0, 2.0, 3.0])
    z = (x - x.mean()) / x.std()
    y = 3 * z + np.array([0.1, -0.2, 0.3, 0.0, -0.1, -0.1])
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(z, y)], "x double, label double")
    d = VectorAssembler(inputCols=["x"], outputCol="features").transform(d)
    for name, (l1, l2) in {"ridge": (0, 1 / 6), "lasso": (1, 0), "elastic_net": (0.5, 0.5)}.items():
        got = models.estimator(name, d).fit(d).coefficients[0]
        assert got == pytest.approx((z @ y / 6 - l1) / (1 + l2), rel=1e-4), name


def test_two_writers_publish_one_table(spark):
    """The second writer of a table leaves nothing behind, neither beside it
    nor inside it."""
    import os
    import tempfile

    from sinistra.sources.claims import publish

    jvm = spark.sparkContext._jvm
    base = tempfile.mkdtemp(prefix="publish-", dir="/tmp")
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in (1, 2):
        spark.range(10).write.parquet(f"{base}/t.tmp-{k}")
        publish(fs, path, f"{base}/t.tmp-{k}", f"{base}/t")
    os.makedirs(f"{base}/t/t.tmp-3")  # as a rename onto the folder would leave it
    publish(fs, path, f"{base}/t.tmp-3", f"{base}/t")
    assert [f for f in os.listdir(base) if f.startswith("t")] == ["t"]
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{base}/t").count() == 10


@pytest.mark.parametrize("q", [0.5, 0.9])
def test_quantile_regression_minimum(spark, q):
    """The loss is that of the best line through two of the points."""
    import random

    from sinistra.plans.suites import quantile_regression

    rnd = random.Random(2)
    pts = [(float(rnd.randint(1, 9)), rnd.expovariate(1) * 4000 + 300 * rnd.random()) for _ in range(60)]
    loss = lambda a, b: sum(max(q * r, (q - 1) * r) for x, y in pts for r in [y - a - b * x])
    best = min(loss(y - s * x, s) for n, (x, y) in enumerate(pts) for x2, y2 in pts[:n] if x2 != x for s in [(y2 - y) / (x2 - x)])
    d = spark.createDataFrame(pts, "x double, y double")
    r = quantile_regression(d, "x", "y", q).first()
    assert r.converged and abs(loss(r.intercept, r.slope) - best) <= 1e-9 * best
    with pytest.raises(RuntimeError):
        quantile_regression(d, "x", "y", q, max_iter=2)
    assert quantile_regression(d.limit(0), "x", "y", q).first().slope is None


def test_sinks_hold_all_numeric_columns(spark, sf_dir):
    from sinistra.registry import load_all
    from sinistra.registry.q_aggregates import NUM

    keys = load_all()
    assert {r.variable for r in keys["sink_json"].build(spark, sf_dir).collect()} == set(NUM)
    got = keys["sink_result_tables"].build(spark, sf_dir).collect()
    assert {r.variable for r in got if r.table == "describe"} == set(NUM)
    assert sum(r.table == "group_statut" for r in got) > 1


@pytest.mark.parametrize("q", [0.5, 0.9])
def test_quantile_regression_p(spark, q):
    """Kernel density at the fitted line and sandwich covariance, written out."""
    import math
    import random
    import statistics

    import numpy as np

    from sinistra.functions.special import t_sf2
    from sinistra.plans.suites import quantile_regression

    rnd = random.Random(8)
    pts = [(float(rnd.randint(0, 3)), 1000 + 5 * k + rnd.expovariate(1) * 90) for k in range(200)]
    r = quantile_regression(spark.createDataFrame(pts, "x double, y double"), "x", "y", q).first()
    x, y = np.array(pts).T
    n, nd = len(x), statistics.NormalDist()
    z = nd.inv_cdf(q)
    h = n ** (-1 / 3) * nd.inv_cdf(0.975) ** (2 / 3) * (1.5 * nd.pdf(z) ** 2 / (2 * z * z + 1)) ** (1 / 3)
    e = y - r.intercept - r.slope * x
    w = min(y.std(), (np.quantile(e, 0.75) - np.quantile(e, 0.25)) / 1.34) * (nd.inv_cdf(q + h) - nd.inv_cdf(q - h))
    u = e / w
    f = np.where(np.abs(u) <= 1, 0.75 * (1 - u * u), 0).sum() / (n * w)
    big = np.column_stack([np.ones(n), x])
    d = np.where(e > 0, (q / f) ** 2, ((1 - q) / f) ** 2)
    inv = np.linalg.inv(big.T @ big)
    se = math.sqrt((inv @ (big.T * d) @ big @ inv)[1, 1])
    assert r.slope_std_err == pytest.approx(se, rel=1e-6) and r.slope_t == pytest.approx(r.slope / se, rel=1e-6)
    assert r.slope_p == pytest.approx(t_sf2(r.slope / se, n - 2), rel=1e-6)
    flat = spark.createDataFrame([(float(i), 1.0) for i in range(9)], "x double, y double")
    assert quantile_regression(flat, "x", "y", q).first().slope_p is None


@pytest.mark.parametrize("n", [30, 4000])
def test_density_error(spark, n):
    """Within 1e-4 of the largest density of the sum over all values."""
    import numpy as np

    from sinistra.operators import charts

    rnd = np.random.default_rng(n)
    x = np.concatenate([rnd.normal(0, 1, n // 2), rnd.lognormal(1, 1.5, n - n // 2)])
    got = charts.density_grid(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double"), "v").orderBy("x").toPandas()
    h = x.std(ddof=1) * n ** -0.2
    want = np.exp(-0.5 * ((got.x.to_numpy()[:, None] - x) / h) ** 2).sum(1) / (n * h * np.sqrt(2 * np.pi))
    assert len(got) == 200 and np.abs(got.density - want).max() < 1e-4 * want.max()
    assert charts.density_grid(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").count() == 0


def test_split_join_of_hot_levels(spark, monkeypatch):
    """One path for few levels, another for many; null keys match nothing."""
    from collections import Counter

    from sinistra.operators import levels

    fact = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"l{i % 90}", i) for i in range(400)] + [(None, 1)], "k string, v int")
    dim = spark.createDataFrame([("hot", 1), *[(f"l{i}", i) for i in range(0, 90, 2)], ("unused", 9)], "k string, code int")
    want = {how: Counter(map(tuple, fact.join(dim, "k", how).collect())) for how in ("left", "inner", "left_semi", "left_anti")}
    for limit, heavy in ((10_000, 1000), (5, 1), (5, 20)):
        monkeypatch.setattr(levels, "MAX_MAP", limit)
        monkeypatch.setattr(levels.small_table, "__defaults__", (limit,))
        monkeypatch.setattr(levels, "HEAVY", heavy)
        for how, rows in want.items():
            assert Counter(map(tuple, levels.split_join(fact, dim, "k", how).collect())) == rows, (limit, how)


def test_rows_stay_where_they_are(spark, sf_dir):
    """With broadcast joins off, encoding exchanges no row of the fact table."""
    from sinistra.operators import features
    from sinistra.registry.common import C

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = C(spark, sf_dir).select("cod_sin", "type_mur_batiment")
        state = features.fit_label_encoder(d, ["type_mur_batiment"])
        plan = features.apply_label_encoder(d, state, ["type_mur_batiment"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_bounds_are_pushed_down(spark, sf_dir):
    from sinistra.registry import load_all

    keys = load_all()
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    pushed = lambda k: keys[k].build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("]")[0]
    assert "In(statut_sinistre" in pushed("filter_closed")
    got = pushed("filter_domain_ranges")
    for c in ("montant_charge_brut", "annee_construction_batiment", "nb_pieces_police", "nb_etages_batiment"):
        assert f"GreaterThan({c}" in got or f"GreaterThanOrEqual({c}" in got, (c, got)


def test_onehot_has_a_bound(spark):
    from sinistra.operators import features

    d = spark.createDataFrame([(f"v{i}",) for i in range(30)] + [("v0",)], "c string")
    with pytest.raises(ValueError):
        features.encode_onehot(d, "c", max_levels=10)
    assert features.encode_onehot(d, "c", max_levels=10, min_freq=2).columns == ["c", "c_v0"]
