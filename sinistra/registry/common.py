"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.claims import claims_table as claims

TARGET = "montant_charge_brut"
DATE = "date_sinistre"


def C(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims table every analysis reads."""
    return claims(spark, sf_dir)


def r(col, digits: int = 6) -> str:
    """SQL rounding used on both sides of the oracle."""
    return f"round({col}, {digits})"
