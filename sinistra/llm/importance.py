"""Target-distribution importance resampling.

Each n-gram falls into a bucket by its crc32. Its gain is the log ratio of the
bucket's smoothed frequency in the target texts to that in the documents, a
document's weight the mean gain of its n-grams. Weights plus fixed Gumbel noise
by id draw documents as a sample in proportion to exp(weight).

A batch of texts interns its n-grams in an open-addressed numpy table: the key
is the xxhash64, an equal key counts only with equal bytes, a taken slot sends
the n-gram one slot on. A slot holds its n-gram's bucket and count; the slots of
all occurrences gather the gains. One pass counts buckets (at most ``buckets``
rows a task), a second one scores.

Edge cases: null and empty texts have no words: weight 0, never drawn; very
long texts are taken in parts of about ``PART`` bytes; ties go to the smaller
id; repeated rows are separate documents; rows with a null id count as texts
but have no score and are not drawn; an empty table gives no rows, an empty
target a flat one; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, scratch
from .numbering import numbered

#: bytes of text interned together
PART = 1_500_000
#: bytes as a word has them: A-Z lower-cased, every byte outside words a blank
_WORD = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def _same(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes at a and b are equal."""
    total = np.cumsum(size)
    if not len(size):
        return np.empty(0, bool)
    inner = np.arange(total[-1]) - np.repeat(total - size, size)
    differ = buf[np.repeat(a, size) + inner] != buf[np.repeat(b, size) + inner]
    return np.add.reduceat(differ, total - size, dtype=np.int64) == 0


def intern(buf: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each n-gram, one n-gram of each slot). ``size`` is never 0."""
    m = len(keys)
    mask = np.uint64((1 << max(4, (2 * m - 1).bit_length())) - 1)
    table = np.full(int(mask) + 1, -1, np.int64)
    owner = np.empty(m, np.int64)
    todo, at = np.arange(m), keys & mask
    while len(todo):
        held = table[at]
        free = held < 0
        table[at[free]] = todo[free]  # of several newcomers one stays
        held = table[at]
        ok = (keys[held] == keys[todo]) & (size[held] == size[todo])
        other = np.flatnonzero(ok & (held != todo))
        ok[other] = _same(buf, start[held[other]], start[todo[other]], size[todo[other]])
        owner[todo[ok]] = held[ok]
        todo, at = todo[~ok], (at[~ok] + np.uint64(1)) & mask
    first = np.flatnonzero(owner == np.arange(m))
    slot = np.empty(m, np.int64)
    slot[first] = np.arange(len(first))
    return slot[owner], first


class Part:
    """N-grams of parts of some texts: their slots, buckets and counts."""

    def __init__(self, parts: list[tuple[int, list[bytes], int]], n: int, buckets: int):
        from xxhash import xxh64_intdigest

        words = [w for _, ws, _ in parts for w in ws]
        raw = b" ".join(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(length + 1) - length - 1
        many = np.array([len(ws) for _, ws, _ in parts], np.int64)
        part = np.repeat(np.arange(len(parts)), many)
        fresh = np.arange(len(words)) - np.repeat(np.cumsum(many) - many, many) >= np.repeat([c for _, _, c in parts], many)
        starts, sizes, owners, keys = [], [], [], []
        for k in range(1, n + 1):
            i = np.arange(max(0, len(words) - k + 1))
            i = i[(part[i] == part[i + k - 1]) & fresh[i + k - 1]]
            starts.append(begin[i])
            sizes.append(begin[i + k - 1] + length[i + k - 1] - begin[i])
            owners.append(part[i])
            grams = (raw[a:a + s] for a, s in zip(starts[-1].tolist(), sizes[-1].tolist()))
            keys.append(np.fromiter(map(xxh64_intdigest, grams), np.uint64, len(i)))
        start, size, key = map(np.concatenate, (starts, sizes, keys))
        self.slot, first = intern(np.frombuffer(raw, np.uint8), start, size, key)
        self.bucket = np.fromiter((zlib.crc32(raw[a:a + s]) % buckets for a, s in zip(start[first].tolist(), size[first].tolist())), np.int64, len(first))
        self.count = np.bincount(self.slot, minlength=len(first))
        self.row = np.array([r for r, _, _ in parts], np.int64)[np.concatenate(owners)]


def _parts(texts: list[bytes | None], n: int) -> Iterator[list[tuple[int, list[bytes], int]]]:
    """(row, words, words repeated from the part before) of about PART bytes."""
    group, size = [], 0
    for row, text in enumerate(texts):
        text, at, tail = (text or b"").translate(_WORD), 0, []
        while at < len(text):
            end = text.find(b" ", at + PART)
            end = len(text) if end < 0 else end
            words = tail + text[at:end].split()
            group.append((row, words, len(tail)))
            tail = words[len(words) - n + 1:] if n > 1 else []
            size += end - at
            at = end
            if size > PART:
                yield group
                group, size = [], 0
    if group:
        yield group


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Occurrences of n-grams of 1 to n words a bucket, over every ``text``."""

    def run(batches):
        seen = np.zeros(buckets, np.int64)
        for b in batches:
            for group in _parts(b.column("text").cast(pa.binary()).to_pylist(), n):
                p = Part(group, n, buckets)
                seen += np.bincount(p.bucket, p.count, buckets).astype(np.int64)
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(seen[hit])], names=["bucket", "n"])

    got = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    seen = np.zeros(buckets, np.int64)
    for r in got.collect():  # at most ``buckets`` rows
        seen[r.bucket] = r.n
    return seen


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) a bucket, add-one smoothed."""
    s, t = (int(x.sum()) + len(x) for x in (source, target))
    ratio = [(b + 1.0) * s / ((a + 1.0) * t) for a, b in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain) of every row."""

    def run(batches):
        for b in batches:
            total, seen, words = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for group in _parts(b.column("text").cast(pa.binary()).to_pylist(), n):
                p = Part(group, n, len(gain))
                np.add.at(total, p.row, gain[p.bucket][p.slot])
                np.add.at(seen, p.row, 1)
                for row, ws, again in group:
                    words[row] += len(ws) - again
            weight = np.where(seen > 0, total // np.maximum(seen, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(seen), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variate) fixed by seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null for
    those not drawn. ``percent`` of the documents with ``min_words`` words are."""
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    rows = weights(docs, gain, n).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = scratch(rows.withColumn("able", F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)), "weights")
    able = rows.filter("able").withColumn("all", F.lit(0)).withColumn("lowest", -F.col("score"))
    placed = numbered(able, "all", ["lowest", "doc_id", "weight", "n_features"])
    drawn = F.col("pos") < F.floor(F.col("n") * percent / 100)
    out = placed.withColumn("rank", F.when(drawn, F.col("pos") + 1).cast("long"))
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    return out.select(cols).unionByName(rows.filter("NOT able").withColumn("rank", F.lit(None).cast("long")).select(cols))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: the registered parameters (single words, 10,000 buckets, 10 percent) in SQL
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
o AS (SELECT r, unnest(w) AS f FROM d),
q AS (SELECT unnest({_WORDS}) AS f FROM benchmark),
v AS MATERIALIZED (SELECT f, {crc32_sql("f")} % 10000 AS bucket FROM (SELECT f FROM o UNION SELECT f FROM q)),
s AS (SELECT bucket, count(*) AS s FROM o JOIN v USING (f) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM q JOIN v USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS gain
  FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
m AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM o JOIN v USING (f) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT d.r, doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, (('0x' || substring(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM d LEFT JOIN m ON m.r = d.r),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score, n_features >= 20 AND doc_id IS NOT NULL AS able FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY able) AS n FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN able AND k <= floor(10 * n / 100) THEN k END AS rank FROM z"""
