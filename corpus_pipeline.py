"""The corpus pipeline: quality filter, line dedup, near-duplicate documents,
personal data, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over everything its
predecessor kept. All but the last return the columns of ``documents``; the
last returns the packed pieces with their token ids. ``run`` writes each
stage's result as Parquet into the shared checkpoint folder and reads it back.

Edge cases: documents with a null text are scored like empty ones by the quality
filter and pass the other stages as they are (packing takes them as empty); rows
with a null id pass every stage; rows that repeat are near duplicates of each
other, but rows that share an id are one document there and stay together; a
document of which line dedup leaves nothing goes; an empty table stays empty in
every stage; other columns than those of ``documents`` are kept up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sinistra.llm import line_dedup, ngram_join, packing, pii, quality
from sinistra.llm.common import doc_crc, read, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts. It learns from the
    labels outside the held-out fold."""
    model = quality.train(docs, read(spark, sf_dir, "labels"), train=doc_crc() % 5 != 0)
    return quality.keep(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat or nearly repeat earlier ones."""
    return line_dedup.dedup_documents(docs, line_dedup.MANY_EDITS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8)."""
    return ngram_join.keep_first(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("packing", packed),
]

#: stages 1, 4 and 5 have no SQL form; tests compare each with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
