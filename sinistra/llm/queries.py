"""The registered queries of this subpackage and their SQL. Each derives the
columns of its contract from the operator's own results."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from . import bpe, importance, line_dedup, manifest, merkle, ngram_join, packing, pii, piece_bpe, quality, token_counts, topk, toxicity
from .common import doc_crc, read


def op1_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"), line_dedup.MANY_EDITS)


def op2_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), with_ids=False)


def op3_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


SQL_OP3 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
s AS (SELECT DISTINCT list_sort(g) AS g, min(doc_id) OVER (PARTITION BY list_sort(g)) AS k, len(g) AS n FROM g WHERE len(g) > 0),
e AS (SELECT k, n, unnest(g) AS t FROM s),
o AS (SELECT a.k AS a, b.k AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.k < b.k AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY a.k, b.k),
l AS (SELECT a, b FROM o WHERE 100 * c >= 90 * (na + nb - c)),
x AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(v, root) AS (SELECT k, k FROM s UNION SELECT x.b, r.root FROM r JOIN x ON x.a = r.v),
m AS (SELECT v, min(root) AS root FROM r GROUP BY v)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, CASE WHEN len(g.g) = 0 THEN g.doc_id ELSE m.root END AS component_id
FROM g LEFT JOIN s ON s.g = list_sort(g.g) LEFT JOIN m ON m.v = s.k"""


def op4_pii(spark, sf_dir):
    found = pii.find(read(spark, sf_dir, "documents"))
    joined = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))))
    base = F.filter("spans", lambda x: x.kind.isin(*pii.BASE))
    of_kind = lambda k: F.filter("spans", lambda x: x.kind == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_merkle(spark, sf_dir):
    df = merkle.with_edited(read(spark, sf_dir, "documents"))
    return df.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.array_join(F.transform("changed", lambda s: s.section.cast("string")), ",").alias("changed"))


def op6_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), train=doc_crc() % 5 != 0)
    return quality.score(docs, model).select("doc_id", (doc_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_byte_bpe(spark, sf_dir):
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op9_topk(spark, sf_dir):
    return topk.exact_topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL_OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def op10_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, read(spark, sf_dir, "labels"), train=doc_crc() % 4 != 2)
    return scored.select("doc_id", (doc_crc() % 4 == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op11_piece_bpe(spark, sf_dir):
    return piece_bpe.round_trip(read(spark, sf_dir, "documents"))


def op12_manifest(spark, sf_dir):
    return manifest.verified(read(spark, sf_dir, "documents"))


def op13_resampling(spark, sf_dir):
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_packing, op3_ngram_join, op4_pii, op5_merkle, op6_quality, op7_byte_bpe, op8_token_counts, op9_topk, op10_toxicity, op11_piece_bpe, op12_manifest, op13_resampling)} | {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {"op3_ngram_join": SQL_OP3, "op5_merkle": merkle.SQL, "op9_topk": SQL_OP9, "op12_manifest": manifest.SQL, "op13_resampling": importance.SQL}
