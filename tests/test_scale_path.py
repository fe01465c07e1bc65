"""The order statistics as they run at scale, on the oracle queries that depend
on them: coarse sketches and small brackets make several narrowing scans, many
value ranges the rank table."""

import pytest

from sinistra.operators import ranks, selection
from sinistra.registry import load_all

from .oracle import compare, duck

KEYS = ["group_stats", "describe_numeric", "kruskal_wallis", "spearman", "mann_whitney", "cliffs_delta",
        "trimmed_mean", "group_robust_summary", "outliers_multi", "clean_claims", "qcut_quartiles"]


@pytest.mark.parametrize("key", KEYS)
def test_narrow_path(spark, sf_dir, key, monkeypatch):
    monkeypatch.setattr(selection, "ACCURACY", 200)
    monkeypatch.setattr(selection, "INSIDE", 10)
    monkeypatch.setattr(ranks, "_n_buckets", lambda df, buckets: buckets or 64)
    e = load_all()[key]
    reason = compare(e.build(spark, sf_dir).toPandas(), duck(e.sql, sf_dir))
    assert reason is None, reason
