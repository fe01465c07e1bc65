"""Bounded-space online packing of tokenized documents into fixed windows.

Every input partition keeps at most ``open_windows`` windows. A piece goes to
the window it fills best; when none has room, the fullest window is emitted,
after the head of the piece has topped it up if the gap is worth a cut. What is
still open when the partition ends is merged in groups of ``merge_fan``
partitions by first-fit decreasing, so a merge task holds a bounded number of
windows however large the input.

Edge cases: a null or empty text is the end token alone; texts longer than a
window fill whole windows and leave a remainder; repeated rows are packed once
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bytes, id_text, scratch, tokenizer_path, worker_state
from .words import WordTable, gather, owner, slices, tile

#: words kept per worker before the table starts anew
CACHE_WORDS = 200_000
#: bytes of text encoded at once
SLICE_BYTES = 750_000
#: Words of these letters are the same after NFC, and lower-case letter by letter
_SIMPLE = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


class WordEncoder:
    """Token ids of words. The vocabulary's pre-tokens never span a blank, so a
    text is the concatenation of its words. Plain words are merged together,
    one merge a round for all of them, by the ranks of the vocabulary file;
    all other spans go through the tokenizers library one by one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path) as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in pairs], np.int64) for k in (0, 1))
        self._hash_pairs((left << 20) | right, np.array([vocab[a + b] for a, b in pairs], np.int64))
        shown = byte_signs()
        self.inner = np.array([vocab[c] for c in shown], np.int64)
        self.final = np.array([vocab[c + "</w>"] for c in shown], np.int64)
        self.table = WordTable(self.learn, [(np.uint32, True)], CACHE_WORDS)

    def _hash_pairs(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """Small open tables: what collides in one goes to the next."""
        rank = np.arange(len(keys), dtype=np.int64)
        self.tables = []
        while len(keys):
            bits = 19 if not self.tables else 16
            mul = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED27 * len(self.tables))
            slot = (keys.astype(np.uint64) * mul) >> np.uint64(64 - bits)
            _, keep = np.unique(slot, return_index=True)
            key, value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
            key[slot[keep]] = keys[keep]
            value[slot[keep]] = (rank[keep] << 20) | merged[keep]
            self.tables.append((mul, np.uint64(64 - bits), key, value))
            rest = np.ones(len(keys), bool)
            rest[keep] = False
            keys, merged, rank = keys[rest], merged[rest], rank[rest]

    def _pairs(self, keys: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair, or a very large number."""
        out = np.full(len(keys), 1 << 60, np.int64)
        u = keys.astype(np.uint64)
        for mul, shift, key, value in self.tables:
            slot = (u * mul) >> shift
            hit = key[slot] == keys
            out[hit] = value[slot[hit]]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, and how many each has: each round contracts the leftmost pair of lowest
        rank of every word that still has one."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        tok = self.inner[raw]
        last = np.cumsum(size) - 1
        tok[last] = self.final[raw[last]]
        word = np.repeat(np.arange(len(words)), size)
        done_tok, done_word = [], []
        while len(tok):
            rank = np.full(len(tok), 1 << 60, np.int64)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self._pairs((tok[inside] << 20) | tok[inside + 1])
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.concatenate((first, [len(tok)])))
            low = np.minimum.reduceat(rank, first)
            live = np.repeat(low < 1 << 60, count)
            if not live.all():
                done_tok.append(tok[~live])
                done_word.append(word[~live])
            hits = np.flatnonzero(live & (rank == np.repeat(low, count)))
            if not len(hits):
                break
            hits = hits[np.concatenate(([True], word[hits][1:] != word[hits][:-1]))]  # leftmost
            tok[hits] = rank[hits] & 0xFFFFF
            live[hits + 1] = False
            tok, word = tok[live], word[live]
        tok, word = np.concatenate(done_tok), np.concatenate(done_word)
        return tok[np.argsort(word, kind="stable")].astype(np.uint32), np.bincount(word, minlength=len(words))

    def learn(self, spans: list[bytes]) -> list:
        texts = [b.decode().strip(" \n") for b in spans]
        plain = [bool(_SIMPLE.fullmatch(t)) for t in texts]
        flat, size = np.empty(0, np.uint32), np.empty(0, np.int64)
        if any(plain):
            flat, size = self.merge([t.lower().encode() for t, p in zip(texts, plain) if p])
        other = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False)]
        flat = np.concatenate([flat, *other])
        size = np.concatenate((size, np.array([len(v) for v in other], np.int64)))
        place = np.argsort(np.argsort(~np.array(plain), kind="stable"))  # back to the order of the spans
        return [(gather(flat, (np.cumsum(size) - size)[place], size[place]), size[place])]

    def documents(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents, and where each document's begin."""
        starts = tile(buf, offs)
        cut = owner(starts, offs)
        rows = self.table.find(buf, starts, np.concatenate((starts[1:], [len(buf)])).astype(np.int64)) if len(starts) else starts
        return self.table.run(0, rows, cut)


def byte_signs() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Windows:
    """The open windows of one partition: [fill, pieces]."""

    def __init__(self, size: int, count: int, min_cut: int):
        self.size, self.count, self.min_cut = size, count, min_cut
        self.open: list[list] = []

    def add(self, doc_id, ids: bytes) -> Iterator[list]:
        """Place one document; yields the pieces of each window that closes."""
        total, start = len(ids) // 4, 0
        while start < total:
            need = min(total - start, self.size)
            best = max((w for w in self.open if w[0] + need <= self.size), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.count:
                best = [0, []]
                self.open.append(best)
            if best is None:  # none fits: top up and emit the fullest
                best = max(self.open, key=lambda w: w[0])
                gap = self.size - best[0]
                if gap < self.min_cut:
                    self.open.remove(best)
                    yield best[1]
                    continue
                need = gap
            best[1].append((doc_id, start, need, ids[4 * start:4 * (start + need)], total, best[0]))
            best[0] += need
            start += need
            if best[0] == self.size:
                self.open.remove(best)
                yield best[1]


def _schema(with_ids: bool) -> T.StructType:
    s = T.StructType()
    for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        s = s.add(n, T.LongType())
    return s.add("ids", T.ArrayType(T.IntegerType())) if with_ids else s


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, size: int = 4096, open_windows: int = 32,
         min_cut: int = 16, merge_fan: int = 32, with_ids: bool = True) -> DataFrame:
    """Pieces of documents: doc_id, start (ids of the document before the
    piece), length, ids_crc32, doc_tokens, sequence_id, offset (in the
    sequence), and the ids themselves if ``with_ids``."""

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        pa.default_memory_pool().release_unused()  # what earlier stages left in this worker
        enc = worker_state(f"words:{vocabulary}", lambda: WordEncoder(tokenizer_path(vocabulary)))
        end = array("I", [end_id]).tobytes()
        win, closed = Windows(size, open_windows, min_cut), 0
        rows: list[tuple] = []

        def table(rows):
            cols = list(zip(*rows))
            out = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.bool_())]
            if with_ids:
                flat = pa.array(memoryview(b"".join(cols[8])).cast("i"), pa.int32())
                ends = [0]
                for n in cols[2]:
                    ends.append(ends[-1] + n)
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "closed"] + ["ids"] * with_ids
            return pa.RecordBatch.from_arrays(out, names=names)

        def put(pieces, done):
            nonlocal closed
            sid = (pid << 32) | closed
            closed += 1
            rows.extend((d, s, n, zlib.crc32(b), t, sid, o, done, b) for d, s, n, b, t, o in pieces)

        for ids, buf, offs in slices(batches, SLICE_BYTES):
            flat, cut = enc.documents(buf, offs)
            raw, cut = flat.astype("<u4").tobytes(), (4 * cut).tolist()
            for k, d in enumerate(ids.to_pylist()):
                for pieces in win.add(d, raw[cut[k]:cut[k + 1]] + end):
                    put(pieces, True)
            if rows:
                yield table(rows)
                rows.clear()
        for w in win.open:
            put(w[1], False)
        if rows:
            yield table(rows)

    full = _schema(with_ids)
    flagged = T.StructType(full.fields[:7] + [T.StructField("closed", T.BooleanType())] + full.fields[7:])
    with arrow_bytes(docs.sparkSession):
        placed = scratch(id_text(docs).mapInArrow(online, flagged), "packed")
    whole = placed.filter("closed").select(*full.names)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """First-fit decreasing over the pieces of a bounded group of windows."""
        pdf = pdf.sort_values(["length", "doc_id", "start", "sequence_id", "offset"], ascending=[False, True, True, True, True], kind="stable")
        fills: list[int] = []
        seq, off = [], []
        for n in pdf["length"].tolist():
            k = next((i for i, f in enumerate(fills) if f + n <= size), len(fills))
            if k == len(fills):
                fills.append(0)
            seq.append((1 << 62) | (int(key[0]) << 32) | k)
            off.append(fills[k])
            fills[k] += n
        return pdf.assign(sequence_id=seq, offset=off)[full.names]

    group = F.floor(F.shiftright("sequence_id", 32) / F.lit(merge_fan)).alias("grp")
    left = placed.filter(~F.col("closed")).select(*full.names).groupBy(group).applyInPandas(merge, full)
    return whole.unionByName(left)
