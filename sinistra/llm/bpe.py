"""Byte-level BPE by ranks: encoding and decoding.

Inside each task DuckDB contracts the distinct pre-tokens: token-position rows
join the merge table, the leftmost pair of minimum rank of each word is
contracted, and a recursive query repeats that until no word has a pair left.
Its rounds cost the square of a word's length, so words of more than
``LONG_WORD`` bytes take the same contractions in the same order from a heap.
Words go to DuckDB by their bytes, not by their number, so a long text without
blanks takes no more memory than other texts.
An ordered aggregation of the vocabulary's bytes decodes. A text is the
concatenation of its pre-tokens, so documents are assembled from their words.

Edge cases: null and empty texts have no tokens (the digests are those of the
empty string); special-token strings are ordinary text; runs of white space,
one very long word and every Unicode character are exact; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, tokenizer_path, worker_state
from .words import SPACES, WordTable, owner, slices, tile

#: spans kept per worker before the table starts anew
CACHE_WORDS = 1_000_000
BATCH_WORDS = 40_000
#: bytes of words that one recursive query contracts together
BATCH_BYTES = 1_000_000
#: bytes of the longest word that the recursive query contracts (below 2^20, its positions)
LONG_WORD = 256

#: One step: pairs of neighbours look up their rank; a word's smallest
#: (rank, position) is contracted; a word without a pair is final.
CONTRACT = """
WITH RECURSIVE t AS (
  SELECT key, tok, false AS fin FROM start_rows
  UNION ALL
  (WITH pairs AS MATERIALIZED (
     SELECT key, tok, nxt, (CAST(m.rank AS BIGINT) << 20) | (key & 1048575) AS k
     FROM (SELECT key, tok, lead(tok) OVER (ORDER BY key) AS ntok, lead(key) OVER (ORDER BY key) AS nxt FROM t WHERE NOT fin)
     LEFT JOIN merges m ON m.l = tok AND m.r = ntok AND (nxt >> 20) = (key >> 20)),
   best AS (SELECT key >> 20 AS w, min(k) AS k, arg_min(nxt, k) AS eaten FROM pairs GROUP BY 1)
   SELECT key, CASE WHEN (key & 1048575) = (best.k & 1048575) THEN best.k >> 20 ELSE tok END, best.k IS NULL
   FROM pairs JOIN best ON (key >> 20) = best.w WHERE best.k IS NULL OR key <> best.eaten))
"""
ENCODE = CONTRACT + "SELECT key >> 20 AS w, list(CAST(tok AS INTEGER) ORDER BY key) AS ids FROM t WHERE fin GROUP BY 1"
DECODE = """
SELECT w, string_agg(v.hex, '' ORDER BY pos) AS hex
FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM words) JOIN vocab v USING (id) GROUP BY w"""


def pattern() -> str:
    """The public pre-token pattern with \\s spelled out as White_Space."""
    import public_tokenizers

    return public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACES}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankCoder:
    """Encodes and decodes distinct words in an in-process DuckDB."""

    def __init__(self, path: str):
        import duckdb
        import regex

        self.ranks = ranks(path)
        self.find = regex.compile(pattern()).findall
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        r = self.ranks
        merges = [(r[t[:i]], r[t[i:]], n) for t, n in r.items() for i in range(1, len(t)) if t[:i] in r and t[i:] in r]
        cols = [pa.array(c, pa.int32()) for c in zip(*merges)]
        self._table("merges", pa.table(cols, names=["l", "r", "rank"]))
        self._table("vocab", pa.table({"id": pa.array(r.values(), pa.int32()), "hex": pa.array([t.hex() for t in r])}))
        self.byte = np.array([r[bytes([b])] for b in range(256)], np.int32)
        # a span's ids as decimal text with a blank before each, its decoded bytes, its ids
        self.table = WordTable(self.learn, [(np.uint8, True), (np.uint8, True), (np.int32, True)], CACHE_WORDS)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def words(self, words: list[bytes]) -> tuple[dict[bytes, list[int]], dict[bytes, bytes]]:
        """Ids of each distinct word, and the bytes those ids decode to."""
        ids = {w: [self.ranks[w]] for w in words if w in self.ranks}
        todo = [w for w in words if w not in ids]
        ids.update((w, self.long_word(w)) for w in todo if len(w) > LONG_WORD)
        todo = [w for w in todo if w not in ids]
        total = np.cumsum([0] + [len(w) for w in todo])
        lo = 0
        while lo < len(todo):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + BATCH_BYTES, "right")) - 1)
            ids.update(self.contract(todo[lo:hi]))
            lo = hi
        return ids, self.decoded(words, ids)

    def contract(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words, by the recursive query."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(size) - size
        key = (np.repeat(np.arange(len(words), dtype=np.int64), size) << 20) | (np.arange(len(flat)) - np.repeat(first, size))
        self._table("start_rows", pa.table({"key": key, "tok": self.byte[flat]}))
        got = self.db.sql(ENCODE).to_arrow_table()
        return dict(zip((words[w] for w in got.column("w").to_pylist()), got.column("ids").to_pylist()))

    def decoded(self, words: list[bytes], ids: dict[bytes, list[int]]) -> dict[bytes, bytes]:
        """The bytes that each word's ids decode to, at most BATCH_BYTES ids
        together; a longer word is decoded in pieces."""
        if sum(map(len, words)) <= BATCH_BYTES:  # no word has more ids than bytes
            return {words[w]: b for w, b in self._decode([ids[w] for w in words])}
        out: dict[bytes, list[bytes]] = {w: [] for w in words}
        owner, pieces, size = [], [], 0
        for w in words:
            for lo in range(0, len(ids[w]), BATCH_BYTES):
                piece = ids[w][lo:lo + BATCH_BYTES]
                if size + len(piece) > BATCH_BYTES and pieces:
                    for n, b in sorted(self._decode(pieces)):
                        out[owner[n]].append(b)
                    owner, pieces, size = [], [], 0
                owner.append(w)
                pieces.append(piece)
                size += len(piece)
        for n, b in sorted(self._decode(pieces)):
            out[owner[n]].append(b)
        return {w: b"".join(p) for w, p in out.items()}

    def _decode(self, pieces: list[list[int]]) -> list[tuple[int, bytes]]:
        self._table("words", pa.table({"w": pa.array(range(len(pieces)), pa.int64()), "ids": pa.array(pieces, pa.list_(pa.int32()))}))
        back = self.db.sql(DECODE).to_arrow_table()
        return list(zip(back.column("w").to_pylist(), map(bytes.fromhex, back.column("hex").to_pylist())))

    def long_word(self, word: bytes) -> list[int]:
        """Ids of one word of any length: the leftmost pair of minimum rank is
        contracted until none is left, in n log n steps."""
        n, rank = len(word), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [r << 40 | p for p in range(n - 1) if (r := rank(word[p:p + 2])) is not None]
        heapify(heap)
        while heap:
            best = heappop(heap)
            p = best & (1 << 40) - 1
            mid = after[p]
            # a pair that is gone: eaten, at the end, or with another neighbour
            if mid < 0 or mid >= n or rank(word[p:after[mid]]) != best >> 40:
                continue
            end = after[p] = after[mid]
            after[mid] = -1
            before[end] = p
            for left in (before[p], p):
                if left >= 0 and after[left] < n and (r := rank(word[left:after[after[left]]])) is not None:
                    heappush(heap, r << 40 | left)
        ids, p = [], 0
        while p < n:
            ids.append(self.ranks[word[p:after[p]]])
            p = after[p]
        return ids

    def learn(self, spans: list[bytes]) -> list:
        text, back, ids = [], [], []
        for lo in range(0, len(spans), BATCH_WORDS):
            part = [[w.encode() for w in self.find(u.decode())] for u in spans[lo:lo + BATCH_WORDS]]
            found, decoded = self.words(list({w for ws in part for w in ws}))
            shown = {w: "".join([f" {i}" for i in v]).encode() for w, v in found.items()}
            text += [b"".join([shown[w] for w in ws]) for ws in part]
            back += [b"".join([decoded[w] for w in ws]) for ws in part]
            ids += [[i for w in ws for i in found[w]] for ws in part]
        runs = [(np.frombuffer(b"".join(v), np.uint8), np.array([len(x) for x in v], np.int64)) for v in (text, back)]
        return [*runs, (np.array([i for v in ids for i in v], np.int32), np.array([len(v) for v in ids], np.int64))]

    def documents(self, buf: np.ndarray, offs: np.ndarray, *cols: int) -> list[tuple[np.ndarray, list[int]]]:
        """For each column wanted: the values of all documents in a row, and
        where each document's begin."""
        starts = tile(buf, offs)
        cut = owner(starts, offs)
        rows = self.table.find(buf, starts, np.concatenate((starts[1:], [len(buf)])).astype(np.int64)) if len(starts) else starts
        return [(v, e.tolist()) for v, e in (self.table.run(c, rows, cut) for c in cols)]


def _coder(vocabulary: str) -> RankCoder:
    return worker_state(f"ranks:{vocabulary}", lambda: RankCoder(tokenizer_path(vocabulary)))


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches):
        coder = _coder(vocabulary)
        for ids, buf, offs in slices(batches):
            ((flat, edge),) = coder.documents(buf, offs, 2)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat))], names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, bytes of (doc_id, ids)."""

    def run(batches):
        coder = _coder(vocabulary)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                coder._table("words", pa.table({"w": pa.array(range(part.num_rows), pa.int64()), "ids": part.column("ids")}))
                got = coder.db.sql(DECODE).to_arrow_table()
                text = dict(zip(got.column("w").to_pylist(), got.column("hex").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([bytes.fromhex(text.get(i, "")) for i in range(part.num_rows)], pa.binary())], names=["doc_id", "bytes"])

    return encoded.selectExpr("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a blank),
    decoded_sha256: encodes each text, then decodes the ids."""

    def run(batches):
        coder = _coder(vocabulary)
        for ids, buf, offs in slices(batches):
            (text, te), (back, be), (_, n) = coder.documents(buf, offs, 0, 1, 2)
            text, back = memoryview(text.tobytes()), memoryview(back.tobytes())
            a = [hashlib.sha256(text[x + 1:y]).hexdigest() for x, y in zip(te, te[1:])]
            d = [hashlib.sha256(back[x:y]).hexdigest() for x, y in zip(be, be[1:])]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(n), pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
