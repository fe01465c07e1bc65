"""Connected components of an edge list, as DataFrame operations.

Alternating large-star and small-star steps (Kiveris et al., 2014) hang every
vertex below the smallest of its component. Each step is an aggregation with a
map-side part and a join; nothing reaches the driver but two sums a round, and
each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect the neighbours of each vertex (those above it, or those below it
    and itself) to the smallest of them."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    hung = both.join(low, "u")
    if large:
        out = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of edges (u, v): the smallest vertex that is
    reachable, itself included. Loops and repeated edges do no harm; no edges
    give no rows."""
    edges = scratch(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        edges = scratch(_star(_star(edges, True), False), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
