"""Operators 11 to 13 against the library, brute force and their SQL, with
nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sinistra.llm import importance, manifest, numbering, piece_bpe, queries
from sinistra.llm.common import crc32_sql, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, node string, n int, score double, weight string, able string"
PARTS = ["alpha", "Beta", "the ", "ing", "ng", " ", "  ", "   ", "\t", "\n", "é", "日", "本語", "🙂", "▁", "<s>", "<0x0A>", "==", "á", "\x00", "0x1", "Ünïcode ", ". "]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _rows():
    rnd = random.Random(11)
    texts = [None, "", " ", "\n\n a \n", "word", "UPPER", "é" * 70, " " * 40, "a" * 5000, "ng" * 700, "x y " * 9000, "ten words " * 10, "ten words " * 10]
    texts += ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 200))) for _ in range(150)]
    rows = [(i, t, rnd.choice(["en", None, ""]), rnd.choice(["web", "web", "web", "é", None, "", "one %d" % (i // 40)]), rnd.choice([None, len(t or "")]), "t", 1, "n", 2, 0.5, "w", "a") for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], rows[20], (None, "no id but some twenty words " * 5, "en", "web", 3, *[None] * 7), (None, None, None, None, None, *[None] * 7)]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_", df.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
    return con.execute(sql)


# --- 11: SentencePiece -------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(piece_bpe.MODEL))


@pytest.fixture(scope="module")
def coder():
    return piece_bpe.PieceCoder(tokenizer_path(piece_bpe.MODEL))


def test_round_trip(docs, rows, nothing, library):
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "")
        want[r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")] += 1
    assert bag(piece_bpe.round_trip(docs)) == want
    assert piece_bpe.round_trip(nothing).count() == 0


def test_encode_then_decode(docs, rows, library):
    encoded = piece_bpe.encode(docs).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r.doc_id: r.ids for r in encoded.collect()}
    text = {r.doc_id: r.text for r in piece_bpe.decode(encoded).collect()}
    for i, t, *_ in rows:
        if i is not None:
            assert got[i] == library.encode(t or "") and text[i] == (library.decode(got[i]) if got[i] else "")


def _ids(coder, text):
    return [i for g in piece_bpe._groups(coder, [text]) for ids in coder.encode([p for _, p, _ in g]) for i in ids.tolist()]


@pytest.mark.parametrize("part", [40, 500_000])
def test_pieces_of_odd_texts(coder, library, monkeypatch, part):
    monkeypatch.setattr(piece_bpe, "PART", part)
    rnd = random.Random(part)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += [" " * k for k in range(70)] + ["ng" * 500, " a" * 300, "a" * 3000, "=" * 1000, "\n" * 100, " " * 5000 + "x", "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzABC0189", k=20_000))]
    assert [_ids(coder, t) for t in texts] == library.encode(texts)


def test_a_long_text_without_blanks(coder, library):
    text = "".join(chr(0x4E00 + i * 7 % 0x5000) + ("" if i % 300 else "。") for i in range(1_300_000))
    assert _ids(coder, text) == library.encode(text)


def test_decoding_any_ids(coder, library):
    rnd = random.Random(4)
    some = [0, 1, 2, 13, 228, 229, 132, 138, 259, 264, 300, 28705]
    for _ in range(5000):
        ids = [rnd.choice(some + [rnd.randrange(32000)] * 3 + [rnd.randrange(3, 259)] * 2) for _ in range(rnd.randint(0, 8))]
        assert coder.decode(np.array(ids, np.int64)).decode() == library.decode(ids)


def test_a_forgetful_cache_changes_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE_WORDS", 3)
    texts = ["some words here", "and there", "some words here", "é 日本"] * 3
    assert [_ids(coder, t) for t in texts] == library.encode(texts)


# --- 12: manifest ------------------------------------------------------------

def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _levels(nodes):
    """All levels of one tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def _climb(levels, at, node):
    siblings = ""
    for level in levels[:-1]:
        lo = at // 16 * 16
        run = level[lo:lo + 16]
        left, right = "".join(run[:at - lo]), "".join(run[at - lo + 1:])
        siblings, node, at = siblings + left + right, sha(left + node + right), at // 16
    return siblings, node


def expected_manifest(rows):
    trees = {}
    for i, text, lang, source, n, *_ in rows:
        fields = lambda t: sha("".join(map(_field, (i, source, lang, n, t))))  # noqa: E731, B023
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        lower = text and re.sub("[A-Z]", lambda m: m[0].lower(), text)
        trees.setdefault(source, []).append((i is not None, i or 0, fields(text), i, fields(lower) if tampered else fields(text)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: _levels([x[2] for x in sorted(trees[s])]) for s in names}
    top = _levels([levels[s][-1][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for at, (_, _, leaf, i, other) in enumerate(sorted(trees[s])):
            low, node = _climb(levels[s], at, other)
            high, folded = _climb(top, k, node)
            out[i, leaf, levels[s][-1][0], top[-1][0], sha(low + high), folded, folded == top[-1][0]] += 1
    return out


def test_manifest(docs, rows, nothing):
    want = expected_manifest(rows)
    got = manifest.verified(docs)
    assert bag(got) == want
    assert {k[-1] for k in want} == {True, False}
    assert manifest.verified(nothing).count() == 0
    assert Counter(duck(manifest.SQL, documents=docs.select(*manifest.FIELDS)).fetchall()) == want


@pytest.mark.parametrize("depth,n", [(0, 16 * 16 + 1), (0, 700), (1, 16 * 16 * 3 + 37), (1, 16 * 16 * 16 + 16 * 16 + 17), (1, 16), (1, 1)])
def test_butterfly_rounds(spark, monkeypatch, depth, n):
    monkeypatch.setattr(manifest, "DEPTH", depth)
    monkeypatch.setattr(manifest, "BLOCK", 16**depth)
    rows = [(i, f"Text {i}", "en", "s" if i % 40 else f"t{i}", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert bag(manifest.verified(docs)) == expected_manifest(rows)


def test_changed_rows_only_fail(docs):
    got = manifest.manifest(docs, F.col("doc_id") == 30, F.lit("other")).filter("doc_id IS NOT NULL").withColumn("folded", manifest.fold(F.coalesce("other", "leaf"), F.col("path")))
    assert all((r.folded == r.root) == (r.doc_id != 30) for r in got.collect())


def test_numbering(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), (F.col("id") % 11).alias("x"), F.lit(1).alias("y"))
    got = numbering.numbered(df, "g", ["x", "y"]).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("pos")
        assert part.pos.tolist() == list(range(len(part))) and part.x.is_monotonic_increasing and set(part.n) == {len(part)}


# --- 13: importance resampling -----------------------------------------------

def expected_draw(rows, target, n=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([r[1] for r in rows], target))
    total = [sum(c.values()) + buckets for c in (s, t)]
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total[0] / ((s[b] + 1) * total[1])))
    out, able = [], []
    for i, text, *_ in rows:
        words, fs = features(text)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        score = None
        if i is not None:
            h = int(sha(f"{seed}:{i}")[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if words >= min_words:
                able.append((-score, i, len(out)))
        out.append([i, len(fs), weight, score, None])
    for rank, (_, _, at) in enumerate(sorted(able)[:len(able) * percent // 100], 1):
        out[at][4] = rank
    return Counter(map(tuple, out))


TARGET = ["alpha beta alpha", "the ing", None, "", "日 ünïcode 0x1 " * 30]


@pytest.mark.parametrize("n,buckets,percent,part", [(1, 10_000, 10, 1_500_000), (2, 97, 40, 60), (3, 10_000, 100, 1_500_000), (3, 500, 100, 200)])
def test_resampling(spark, docs, rows, nothing, monkeypatch, n, buckets, percent, part):
    monkeypatch.setattr(importance, "PART", part)
    target = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TARGET)], "item_id long, text string, n int")
    got = importance.resample(docs, target, n=n, buckets=buckets, percent=percent)
    assert bag(got) == expected_draw(rows, TARGET, n, buckets, percent)
    if n == 1:
        assert Counter(duck(importance.SQL, documents=docs.select("doc_id", "text"), benchmark=target).fetchall()) == bag(got)
        assert importance.resample(nothing, target).count() == 0
        assert importance.resample(docs, nothing).count() == len(rows)


def test_interning_verifies_bytes():
    """Equal keys of different n-grams, and full runs of taken slots."""
    rnd = random.Random(1)
    grams = [rnd.choice([b"a", b"b", b"ab", b"ba", b"abc"]) for _ in range(400)]
    raw = b" ".join(grams)
    size = np.array([len(g) for g in grams])
    start = np.cumsum(size + 1) - size - 1
    for keys in (np.zeros(400, np.uint64), np.full(400, 2**64 - 1, np.uint64), np.array([len(g) for g in grams], np.uint64)):
        slot, first = importance.intern(np.frombuffer(raw, np.uint8), start, size, keys)
        assert [grams[first[s]] for s in slot] == grams and len(first) == 5


def test_crc32_in_sql():
    for t in ["", "0", "12345", "héllo 日本 ' x"]:
        quoted = "'" + t.replace("'", "''") + "'"
        assert duck(f"SELECT {crc32_sql(quoted)}").fetchone()[0] == zlib.crc32(t.encode())


def test_registered():
    assert {"op11_piece_bpe", "op12_manifest", "op13_resampling"} <= set(queries.QUERIES)
    assert {"op12_manifest", "op13_resampling"} <= set(queries.SQL)
