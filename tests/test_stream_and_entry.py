"""Streaming monthly aggregates against the batch form, and the driver
contract of __spark_entry__."""

import uuid

from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from sinistra.session import ensure_checkpoint_dir
from sinistra.streaming import monthly


def test_stream_matches_batch(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    agg = monthly.monthly_aggregates(monthly.read_claims_stream(spark, sf_dir, ev.schema, glob="events.parquet"), "ts", "value")
    name = f"m_{uuid.uuid4().hex[:8]}"
    ck = f"{ensure_checkpoint_dir(spark)}/stream-{name}"
    q = monthly.run_to_table(agg, name, ck)
    q.processAllAvailable()
    q.stop()
    got = {r["month"]: (r["count"], round(r["sum"], 6)) for r in spark.table(name).collect()}
    exp = {r["month"]: (r["c"], round(r["s"], 6)) for r in ev.groupBy(F.date_trunc("month", F.col("ts").cast("timestamp")).alias("month"))
           .agg(F.count("value").alias("c"), F.sum("value").alias("s")).collect()}
    assert got == exp


def test_entry_contract(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and [r["rga"] for r in sorted(rows, key=lambda r: r["ord"])] == ["faible", "moyen", "fort", "maximal"]
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 150
