"""Readers and writers: format chosen by suffix, CSV with null tokens and a
typed schema, JDBC, result-table sinks. Thin, declarative ``spark.read`` /
``df.write`` calls - the engine does the scanning."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.casting import NULL_TOKENS, null_tokens_to_null

SUFFIX_FORMATS = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".txt": "csv", ".json": "json",
                  ".jsonl": "json", ".orc": "orc", ".csv.gz": "csv", ".csv.bz2": "csv"}


def format_of(path: str) -> str:
    p = path.lower().rstrip("/")
    for suf in sorted(SUFFIX_FORMATS, key=len, reverse=True):
        if p.endswith(suf):
            return SUFFIX_FORMATS[suf]
    raise ValueError(f"unsupported file type: {path}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scan_dispatch(spark: SparkSession, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """Reader by suffix; a missing path or an unknown suffix raises."""
    fmt = format_of(path)
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if fmt == "csv":
        return scan_csv(spark, path, schema=schema, **options)
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return normalize_headers(r.options(**options).load(path))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",",
             encoding: str = "UTF-8", null_tokens: Sequence[str] = NULL_TOKENS, header: bool = True,
             mode: str = "PERMISSIVE", **options) -> DataFrame:
    """CSV with a declared schema (no inference pass over the data). Text
    columns equal to any null token become null (``nullValue`` takes one)."""
    r = spark.read.option("header", header).option("sep", sep).option("encoding", encoding).option("mode", mode)
    r = r.options(**options)
    if schema is not None:
        r = r.schema(schema)
    df = normalize_headers(r.csv(path))
    return df.select(*[null_tokens_to_null(c, null_tokens).alias(c) if t == "string" else F.col(f"`{c}`")
                       for c, t in df.dtypes])


def scan_typed(spark: SparkSession, path: str, dtypes: Mapping[str, str], dates: Sequence[str] = (),
               date_formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy"),
               **csv_options) -> DataFrame:
    """Read every column as text, then apply type hints (ids stay strings,
    numbers by ``try_cast``, dates by the first matching format)."""
    from ..functions.casting import to_timestamp_any

    raw = scan_csv(spark, path, **csv_options) if format_of(path) == "csv" else scan_dispatch(spark, path)
    out = []
    for c in raw.columns:
        if c in dates:
            out.append(to_timestamp_any(c, date_formats).alias(c))
        elif c in dtypes:
            out.append(F.col(c).try_cast(dtypes[c]).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return raw.select(*out)


def scan_jdbc(spark: SparkSession, url: str, query: str, properties: Mapping[str, str] | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """Database query through the JDBC source; with a partition column the
    read is split into ``num_partitions`` parallel range queries."""
    r = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    if partition_column:
        r = (r.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
             .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", num_partitions))
    else:
        r = r.option("query", query)
    return r.load()


def normalize_headers(df: DataFrame) -> DataFrame:
    """Strip surrounding blanks from column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def sink_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", header).csv(path)
    return path


def sink_result_tables(tables: Mapping[str, DataFrame], out_dir: str, fmt: str = "parquet",
                       mode: str = "overwrite") -> list[str]:
    """One folder per result table (``out_dir/name``)."""
    paths = []
    for name, t in tables.items():
        p = os.path.join(out_dir, name)
        w = t.write.mode(mode)
        if fmt == "csv":
            w = w.option("header", True)
        w.format(fmt).save(p)
        paths.append(p)
    return paths


def sink_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path
