"""Monthly claim aggregates on a stream: the same sums, counts and means as
``monthly_mean_count_sum``, maintained by Structured Streaming over new
files, with a watermark so finished months are emitted once and their
state is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_claims_stream(spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet",
                       glob: str | None = None, max_files_per_trigger: int = 64) -> DataFrame:
    """New files of ``folder`` (optionally only those matching ``glob``)."""
    r = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(folder)


def monthly_aggregates(stream: DataFrame, ts: str, value: str, watermark: str = "31 days") -> DataFrame:
    """Per calendar month: count, sum and mean of ``value``. The watermark is on
    the month itself, which is the grouping key, so that finished months are
    emitted once in append mode and their state is dropped: a month is finished
    when it begins more than ``watermark`` before the latest month seen."""
    s = stream.withColumn("month", F.date_trunc("month", F.col(ts).cast("timestamp"))).withWatermark("month", watermark)
    return s.groupBy("month").agg(F.count(F.col(value)).alias("count"), F.sum(value).alias("sum"), F.avg(value).alias("mean"))


def run_to_table(agg: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Start the query into an in-memory table (tests, notebooks) with its
    checkpoint in the shared folder; returns the StreamingQuery."""
    return agg.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
