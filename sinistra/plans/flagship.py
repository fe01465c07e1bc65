"""The flagship question: what does a claim cost by risk level?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, lookup, summary
from ..sources.claims import claims_table as claims

TARGET = "montant_charge_brut"


def filtered_claims(spark: SparkSession, sf_dir: str, lo: float = 100000, hi: float = 400000,
                    start: str = "1996-01-01", end: str = "2000-12-31") -> DataFrame:
    df = claims(spark, sf_dir)
    df = filters.filter_closed(df)
    df = filters.filter_amount_range(df, TARGET, lo, hi)
    df = filters.filter_date_range(df, "date_sinistre", start, end)
    return filters.dedup_claims(df, ["police", "cod_sin"])


def cost_by_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = filtered_claims(spark, sf_dir)
    df = lookup.lookup_map(df, "risque_rga_gcl", lookup.RGA_SYNONYMS, "rga")
    s = summary.summarize(df.where(F.col("rga").isNotNull()), TARGET, ["rga"],
                          ("count", "mean", "std"), {"median": 0.5})
    dim = lookup.dimension(spark, lookup.RGA_ORDER, "level", "ord")
    out = lookup.category_spine(s, dim, "rga", "level")
    return out.select(
        "ord", "rga", "count",
        *[F.round(c, 2).alias(c) for c in ("mean", "median", "std")],
    )
