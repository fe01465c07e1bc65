"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's result is forced with the ``noop`` sink (every row computed, no
driver collect); the figure per query is the median of 3 warm runs. The
one-off materialisation of the claims table is reported separately
(``claims_build``, cold). ``pandas`` holds the seconds of the same questions in
single-process pandas on the same files. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "group_stats",           # flagship: cost by risk level (exact median)
    "describe_numeric",      # 10 columns, moments + 5 exact quantiles each
    "filter_audit",          # 6 filter steps counted in one pass + dedup
    "dedup_claims",
    "kruskal_wallis",        # distributed average ranks
    "spearman",
    "corr_with_target",
    "outliers_multi",
    "monthly_series",
    "temporal_breakdowns",
    "clean_claims",          # clip + impute + text + derived columns
    "climate_precip",        # composite domain analysis
]


def pandas_baseline(folder: str, runs: int) -> dict:
    """The same questions in single-process pandas over the same claims files,
    the columns read anew each time; those that pandas answers in a few calls."""
    import numpy as np
    import pandas as pd

    from sinistra.registry.common import DATE, TARGET
    from sinistra.registry.q_aggregates import NUM

    read = lambda *cols: pd.read_parquet(folder, columns=list(cols))
    ranked = lambda d: d.rank(method="average")

    def group_stats():
        return read("risque_rga_gcl", TARGET).groupby("risque_rga_gcl")[TARGET].agg(["count", "mean", "median", "std", "min", "max"])

    def describe_numeric():
        d = read(*NUM)
        return d.describe(percentiles=[0.05, 0.25, 0.5, 0.75, 0.95]), d.skew(), d.kurt()

    def spearman():
        return ranked(read("surface_police", TARGET).dropna()).corr()

    def kruskal_wallis():
        d = read("statut_sinistre", TARGET).dropna()
        return ranked(d[TARGET]).groupby(d["statut_sinistre"]).agg(["count", "sum"])

    def corr_with_target():
        return read(*NUM).corr()[TARGET]

    def outliers_multi():
        x = read(TARGET)[TARGET].dropna()
        q = x.quantile([0.05, 0.25, 0.5, 0.75, 0.95, 0.99])
        return q, (x - q[0.5]).abs().median(), x.mean(), x.std(ddof=0), [(x > v).sum() for v in q]

    def monthly_series():
        d = read(DATE, TARGET)
        return d.groupby(d[DATE].dt.to_period("M"))[TARGET].agg(["count", "sum"])

    def temporal_breakdowns():
        d = read(DATE, TARGET).dropna()
        keys = (d[DATE].dt.year, (d[DATE].dt.month % 12) // 3, d[DATE].dt.month)
        return [d.groupby(k)[TARGET].agg(["count", "mean", "median", "std"]) for k in keys]

    def dedup_claims():
        d = pd.read_parquet(folder)
        return d.sort_values("cod_sin").drop_duplicates("police")

    def clean_claims():
        d = pd.read_parquet(folder)
        for c in NUM:
            lo, hi = np.nanquantile(d[c].astype(float), [0.01, 0.99])
            v = d[c].astype(float).clip(lo, hi)
            d[c] = v.fillna(v.median())
        for c in d.select_dtypes("object"):
            d[c] = d[c].fillna("Inconnu").str.strip().str.upper()
        return d

    out = {}
    for f in (group_stats, describe_numeric, spearman, kruskal_wallis, corr_with_target, outliers_multi, monthly_series, temporal_breakdowns, dedup_claims, clean_claims):
        samples = []
        for _ in range(runs):
            t = time.time()
            f()
            samples.append(time.time() - t)
        out[f.__name__] = round(statistics.median(samples), 3)
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from sinistra.registry import load_all
    from sinistra.session import local_session
    from sinistra.sources.claims import claims_table

    spark = local_session(cpus, shuffle_partitions=cpus, app="sinistra-bench")
    entries = load_all()
    t = time.time()
    claims_table(spark, sf_dir).write.format("noop").mode("overwrite").save()
    build = time.time() - t
    times = {}
    for k in HEADLINE:
        samples = []
        for _ in range(runs):
            t = time.time()
            entries[k].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.time() - t)
        times[k] = round(statistics.median(samples), 3)
    (files,) = {os.path.dirname(f.replace("file://", "").replace("file:", "")) for f in claims_table(spark, sf_dir).inputFiles()}
    baseline = pandas_baseline(files, runs)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "claims_build": round(build, 3),
        "pandas": baseline,
        "sf": sf,
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
