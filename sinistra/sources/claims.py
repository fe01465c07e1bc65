"""The ``claims`` table the analyses run on, derived from the test tables.

One row per order: orders ⋈ customer ⋈ nation, left join the per-order
lineitem aggregate. The same derivation is given as DuckDB SQL
(``CLAIMS_CTE``) for the oracle.

Plan at scale: lineitem is aggregated per ``l_orderkey`` with a map-side
partial aggregate, so the shuffle carries one row per (task, order); the
result is already hash-partitioned on the order key, so the left join to
orders reuses that exchange. customer joins on its key by shuffle; nation
is a fixed 25-row dimension that Spark's size check broadcasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("engagements"),
        F.sum("l_quantity").alias("surface_police"),
        (F.round(F.avg("l_quantity"), 4) * 5).alias("surface_batiment"),
        F.count(F.lit(1)).alias("nb_etages_batiment"),
        F.max("l_linenumber").alias("nb_pieces_police"),
        F.round(F.avg("l_discount") * 400, 4).alias("weather_precip_mean"),
        F.round(F.avg("l_tax") * 500, 4).alias("weather_temp_mean"),
        F.max("l_shipdate").alias("date_cloture_sinistre"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims view of FIXTURES.md §2 (21 columns)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    li = lineitem_per_order(spark, sf_dir)
    prio = F.substring("o_orderpriority", 1, 1)
    j = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(li, o.o_orderkey == li.l_orderkey, "left")
    )
    return j.select(
        F.col("o_custkey").cast("string").alias("police"),
        F.col("o_orderkey").cast("string").alias("cod_sin"),
        F.col("o_totalprice").alias("montant_charge_brut"),
        F.col("o_orderdate").alias("date_sinistre"),
        F.col("date_cloture_sinistre"),
        F.when(F.col("o_orderstatus") == "F", "Clos")
        .when(F.col("o_orderstatus") == "P", "Fermé")
        .otherwise("Ouvert")
        .alias("statut_sinistre"),
        F.when(prio == "1", "maximal")
        .when(prio == "2", "fort")
        .when(prio == "3", "moyen")
        .when(prio == "5", "faible")
        .alias("risque_rga_gcl"),
        F.col("c_acctbal").alias("prime"),
        "engagements",
        "surface_police",
        "surface_batiment",
        "nb_etages_batiment",
        "nb_pieces_police",
        F.lower("c_mktsegment").alias("type_mur_batiment"),
        (F.lit(1900) + F.col("o_custkey") % 125).alias("annee_construction_batiment"),
        F.lpad((F.col("c_nationkey") * 1000 + F.col("o_custkey") % 1000).cast("string"), 5, "0").alias("cpostal"),
        F.col("n_name").alias("ville"),
        "weather_precip_mean",
        "weather_temp_mean",
        F.when(F.col("o_orderkey") % 5 == 0, "non").otherwise("oui").alias("est_dans_sin_cluster"),
        (F.col("o_orderkey") % 3 == 0).alias("risk_flag"),
    )


CLAIMS_CTE = """
_li AS (
  SELECT l_orderkey,
         round(sum(l_extendedprice), 2) AS engagements,
         sum(l_quantity) AS surface_police,
         round(avg(l_quantity), 4) * 5 AS surface_batiment,
         count(*) AS nb_etages_batiment,
         max(l_linenumber) AS nb_pieces_police,
         round(avg(l_discount) * 400, 4) AS weather_precip_mean,
         round(avg(l_tax) * 500, 4) AS weather_temp_mean,
         max(l_shipdate) AS date_cloture_sinistre
  FROM lineitem GROUP BY l_orderkey
),
claims AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS police,
         CAST(o.o_orderkey AS VARCHAR) AS cod_sin,
         o.o_totalprice AS montant_charge_brut,
         o.o_orderdate AS date_sinistre,
         l.date_cloture_sinistre,
         CASE o.o_orderstatus WHEN 'F' THEN 'Clos' WHEN 'P' THEN 'Fermé' ELSE 'Ouvert' END AS statut_sinistre,
         CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'maximal' WHEN '2' THEN 'fort'
              WHEN '3' THEN 'moyen' WHEN '5' THEN 'faible' END AS risque_rga_gcl,
         c.c_acctbal AS prime,
         l.engagements, l.surface_police, l.surface_batiment, l.nb_etages_batiment, l.nb_pieces_police,
         lower(c.c_mktsegment) AS type_mur_batiment,
         1900 + o.o_custkey % 125 AS annee_construction_batiment,
         lpad(CAST(c.c_nationkey * 1000 + o.o_custkey % 1000 AS VARCHAR), 5, '0') AS cpostal,
         n.n_name AS ville,
         l.weather_precip_mean, l.weather_temp_mean,
         CASE WHEN o.o_orderkey % 5 = 0 THEN 'non' ELSE 'oui' END AS est_dans_sin_cluster,
         o.o_orderkey % 3 = 0 AS risk_flag
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN _li l ON l.l_orderkey = o.o_orderkey
)"""


def with_claims(sql: str) -> str:
    """Prefix a query over ``claims`` with the CTE that defines it. The query
    may start with its own ``WITH``; its CTEs are appended."""
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + CLAIMS_CTE + ",\n" + body[4:].lstrip()
    return "WITH " + CLAIMS_CTE + "\n" + body


def _digest(spark: SparkSession, sf_dir: str) -> str:
    import hashlib

    h = hashlib.sha1(sf_dir.encode())
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in ("orders", "customer", "nation", "lineitem"):
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        # a file lists itself, a folder its part files
        for st in p.getFileSystem(conf).listStatus(p):
            h.update(f"{name}:{st.getPath().getName()}:{st.getLen()}:{st.getModificationTime()}".encode())
    return h.hexdigest()[:16]


def materialize(spark: SparkSession, name: str, build, fmt: str = "parquet", options: dict | None = None) -> str:
    """Write ``build()`` once under ``<checkpoint dir>/tables/<name>`` and return
    the path. The write goes to a temporary folder published by an atomic
    rename, so concurrent or failed runs never leave a half table behind."""
    import uuid

    from ..session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}"
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(conf)
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        tmp = f"{path}.tmp-{uuid.uuid4().hex}"
        build().write.mode("overwrite").options(**(options or {})).format(fmt).save(tmp)
        publish(fs, jvm.org.apache.hadoop.fs.Path, tmp, path)
    return path


def publish(fs, hadoop_path, tmp: str, path: str) -> None:
    """Rename ``tmp`` to ``path`` unless another writer was first. A rename
    onto a folder that appeared in between moves ``tmp`` inside it: that copy
    is taken out again, so the published folder holds one writer's files."""
    src, dst = hadoop_path(tmp), hadoop_path(path)
    fs.mkdirs(dst.getParent())
    if fs.exists(dst) or not fs.rename(src, dst):
        fs.delete(src, True)
    inside = hadoop_path(dst, src.getName())
    if fs.exists(inside):
        fs.delete(inside, True)


def claims_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims view written once as Parquet under the shared checkpoint
    folder and read back: every analysis then scans a columnar table (with
    pruning and pushdown) instead of re-running the join, and lineage is cut
    at a table that survives executor loss. Keyed by the inputs' sizes and
    modification times."""
    path = materialize(spark, f"claims-{_digest(spark, sf_dir)}", lambda: claims(spark, sf_dir))
    return spark.read.parquet(path)
