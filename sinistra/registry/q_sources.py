"""Source and sink keys. CSV/JSON inputs are written by Spark
from the claims table (the test data is Parquet only), then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.casting import to_double
from ..sources import io
from ..sources.claims import _digest, claims_table, materialize
from . import register
from .common import C, TARGET
from .q_aggregates import _DESC, _union, NUM, rnd

CSV_COLS = "police STRING, cod_sin STRING, montant_charge_brut DOUBLE, statut_sinistre STRING, risque_rga_gcl STRING, cpostal STRING, surface_police DOUBLE"


def _csv(spark, sf, sep=";"):
    """Claims subset as CSV text (';' separated, dates as dd/MM/yyyy, missing
    risk written as the token NA)."""
    def build():
        d = claims_table(spark, sf)
        return d.select("police", "cod_sin", "montant_charge_brut", "statut_sinistre",
                        F.coalesce("risque_rga_gcl", F.lit("NA")).alias("risque_rga_gcl"), "cpostal", "surface_police",
                        F.date_format("date_sinistre", "dd/MM/yyyy").alias("date_sinistre"))
    return materialize(spark, f"claims-{_digest(spark, sf)}.csv", build, "csv", {"header": True, "sep": sep})


@register("scan_dispatch", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders", claims=False)
def q_scan_dispatch(spark, sf):
    return io.scan_dispatch(spark, f"{sf}/orders.parquet")


@register("scan_parquet", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem", claims=False)
def q_scan_parquet(spark, sf):
    return io.scan_parquet(spark, f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@register("scan_csv", """SELECT police, cod_sin, montant_charge_brut, statut_sinistre, risque_rga_gcl, cpostal, surface_police FROM claims""")
def q_scan_csv(spark, sf):
    p = _csv(spark, sf)
    schema = CSV_COLS + ", date_sinistre STRING"
    return io.scan_csv(spark, p, schema=schema, sep=";").drop("date_sinistre")


@register("scan_typed", """SELECT police, cod_sin, montant_charge_brut, cpostal, date_sinistre FROM claims""")
def q_scan_typed(spark, sf):
    p = _csv(spark, sf)
    d = io.scan_typed(spark, p, {"montant_charge_brut": "double", "police": "string", "cod_sin": "string",
                                 "cpostal": "string"}, dates=["date_sinistre"], sep=";")
    return d.select("police", "cod_sin", "montant_charge_brut", "cpostal", "date_sinistre")


@register("normalize_headers", "SELECT police, cod_sin, montant_charge_brut FROM claims")
def q_normalize_headers(spark, sf):
    d = C(spark, sf).select(F.col("police").alias(" police "), F.col("cod_sin").alias("cod_sin  "),
                            F.col(TARGET).alias("\tmontant_charge_brut"))
    return io.normalize_headers(d)


def input_profile(df, target):
    """Input check: columns, numeric columns, rows, target null share and
    the >50 % flag; distinct target values, listed when fewer than 10, else
    min / max / mean."""
    from ..operators.profile import numeric_columns

    x = to_double(target)
    vals = df.select(x.alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").count()
    dv = vals.agg(F.count(F.lit(1)).alias("distinct"))
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.count(x).alias("_nn"), F.min(x).alias("min"), F.max(x).alias("max"),
                 F.avg(x).alias("mean"))
    out = one.crossJoin(dv)
    few = F.col("distinct") < 10
    return out.select(
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.col("rows").cast("bigint").alias("rows"),
        F.try_divide((F.col("rows") - F.col("_nn")) * 1.0, F.col("rows")).alias("target_null_share"),
        (F.try_divide((F.col("rows") - F.col("_nn")) * 1.0, F.col("rows")) > 0.5).alias("target_mostly_null"),
        F.col("distinct").cast("bigint").alias("target_distinct"),
        F.when(~few, F.col("min")).alias("min"), F.when(~few, F.col("max")).alias("max"), F.when(~few, F.col("mean")).alias("mean"),
    )


@register("input_profile", """
SELECT CAST(21 AS BIGINT) AS columns, CAST(10 AS BIGINT) AS numeric_columns, CAST(count(*) AS BIGINT) AS rows,
       round((count(*) - count(engagements)) * 1.0 / count(*), 4) AS target_null_share,
       (count(*) - count(engagements)) * 1.0 / count(*) > 0.5 AS target_mostly_null,
       CAST(count(DISTINCT engagements) AS BIGINT) AS target_distinct,
       round(min(engagements), 4) AS min, round(max(engagements), 4) AS max, round(avg(engagements), 4) AS mean FROM claims""")
def q_input_profile(spark, sf):
    return rnd(input_profile(C(spark, sf), "engagements"))


def _out(spark, stem, suffix=""):
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sinks/{stem}-{uuid.uuid4().hex}{suffix}"


@register("sink_csv", "SELECT * FROM claims")
def q_sink_csv(spark, sf):
    """Every row and column, read back with the types they had."""
    d = C(spark, sf)
    p = io.sink_csv(d, _out(spark, "claims", ".csv"))
    return spark.read.schema(d.schema).option("header", True).csv(p)


def _describe_sql():
    return f"SELECT 'describe' AS \"table\", CAST(NULL AS VARCHAR) AS statut_sinistre, * FROM ({_union(NUM, _DESC)})"


def _group_sql():
    return """SELECT 'group_statut' AS "table", statut_sinistre, CAST(count(montant_charge_brut) AS BIGINT) AS count, round(avg(montant_charge_brut), 4) AS mean,
 round(quantile_cont(montant_charge_brut, 0.5), 4) AS median, round(stddev_samp(montant_charge_brut), 4) AS std, round(min(montant_charge_brut), 4) AS min,
 round(max(montant_charge_brut), 4) AS max, round(count(montant_charge_brut) * 100.0 / sum(count(montant_charge_brut)) OVER (), 1) AS percentage
 FROM claims WHERE statut_sinistre IS NOT NULL AND montant_charge_brut IS NOT NULL GROUP BY statut_sinistre"""


@register("sink_result_tables", f"SELECT * FROM ({_group_sql()}) UNION ALL BY NAME SELECT * FROM ({_describe_sql()})")
def q_sink_tables(spark, sf):
    """All tables read back, one below the other with the name of each."""
    from ..operators import profile, summary

    d = C(spark, sf)
    out = _out(spark, "results")
    tables = {"group_statut": rnd(summary.group_stats(d, "statut_sinistre", TARGET, digits=None), skip=("percentage",)),
              "describe": rnd(profile.describe_numeric(d, NUM))}
    io.sink_result_tables(tables, out, "csv")
    first, *more = [spark.read.schema(t.schema).option("header", True).csv(f"{out}/{name}").withColumn("table", F.lit(name)) for name, t in tables.items()]
    for t in more:
        first = first.unionByName(t, allowMissingColumns=True)
    return first


@register("sink_json", _union(NUM, _DESC))
def q_sink_json(spark, sf):
    from ..operators import profile

    d = rnd(profile.describe_numeric(C(spark, sf), NUM))
    p = io.sink_json(d, _out(spark, "describe", ".json"))
    return spark.read.schema(d.schema).json(p)
