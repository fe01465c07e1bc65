"""Helpers shared by the operators: inputs, shared scratch tables, and
per-worker state."""

from __future__ import annotations

import sys
import types
import uuid
import zlib
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Exactly (doc_id long, text string); a null text counts as empty. Other
    columns, whatever their names, are left behind here."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it
    back: lineage is cut at files that every executor can see."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_bytes(spark: SparkSession, limit: str = "4m"):
    """Jobs started inside pass Arrow batches of at most ``limit`` to Python
    (one row at least), so a task's memory follows bytes and not the 10,000
    rows of long texts that a batch holds by default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def doc_crc(col: str = "doc_id") -> Column:
    """crc32 of an id's decimal text, the key of the train / held-out folds."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def crc32_sql(text: str) -> str:
    """DuckDB form of the unsigned crc32 of a text's UTF-8 bytes, folded half
    a byte at a time (the low half first) over a table of 16 remainders."""
    table = []
    for r in range(16):
        for _ in range(4):
            r = r >> 1 ^ (0xEDB88320 if r & 1 else 0)
        table.append(r)
    halves = f"flatten(list_transform(range(1, 1 + 2 * strlen({text}), 2), lambda i: [instr('0123456789ABCDEF', hex({text})[i + 1]) - 1, instr('0123456789ABCDEF', hex({text})[i]) - 1]))"
    step = f"xor(crc >> 4, ({table}::BIGINT[])[CAST(xor(crc, half) & 15 AS INTEGER) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {halves}::BIGINT[]), lambda crc, half: {step}))"


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, train: Column, per_class: int) -> tuple[list[str], list[int], float]:
    """Texts and 0/1 labels to fit a classifier on, and the share of label 1
    among all training labels. At most ``per_class`` documents of each class,
    those whose id has the smallest hash, so the driver's part is bounded.
    Rows with a null id or label are left out; of several labels of one
    document the largest counts; a text is taken once."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).dropna().filter(train)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).filter("y IN (0, 1)")
    count = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(count.values())
    order = [F.xxhash64(F.col("doc_id"), F.lit(11)), F.col("doc_id")]
    ids = [known.filter(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    picked = id_text(docs).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    rows = sorted(picked.collect(), key=lambda r: (hash_order(r.doc_id), r.doc_id))
    once = {r.doc_id: r for r in rows}
    return [r.text for r in once.values()], [r.y for r in once.values()], count.get(1, 0) / total if total else 0.5


def hash_order(i: int) -> int:
    """A fixed shuffle of ids for the driver's small samples."""
    return zlib.crc32(f"order {i}".encode())


def worker_state(name: str, make):
    """One object per Python worker process, kept over its tasks (tokenizers,
    word caches). It only saves time: results never depend on it."""
    held = sys.modules.setdefault("_sinistra_llm_state", types.ModuleType("_sinistra_llm_state")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, read where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)
