"""Vectorised words of many texts: byte buffers instead of Python strings.

A slice of an Arrow text column becomes one uint8 buffer with document
offsets. Words are spans of it, known by a 64-bit hash; what an operator knows
of a word (ids, counts, scores) sits in a bounded ``WordTable`` and is gathered
for all occurrences at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .common import worker_state

#: Unicode White_Space, as \s of the public patterns means it
SPACES = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNIT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; kept by the process, not by this
    module, which travels with every function that uses it."""
    held = worker_state("powers", dict)
    if len(held.get(base, ())) <= n:
        p = np.full(max(n + 1, 1 << 20), base, np.uint64)
        p[0] = 1
        held[base] = np.multiply.accumulate(p)
    return held[base][:n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, wherever it stands."""
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power(_BASE, len(buf))[:len(buf)], out=run[1:])
    h = (run[ends] - run[starts]) * _power(_INVERSE, len(buf))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 1_500_000) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, buffer, offsets): documents of about ``max_bytes`` together, or one
    longer text alone, so memory does not follow the Arrow batch."""
    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text").cast(pa.large_string())
        if not len(texts):
            continue
        _, where, data = texts.buffers()
        offs = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
            hi = min(hi, len(texts), lo + 20_000)
            yield ids.slice(lo, hi - lo), raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
            lo = hi


def owner(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Index of the first span of each document and one past the last."""
    return np.searchsorted(starts, offs, "left")


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_BLANK = _class(b" \n")
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)))
_SIGN = _class(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
_RARE = _class(b"\t\x0b\x0c\r\xc2\xe1\xe2\xe3")
_WHITE = _class(b"\t\n\x0b\x0c\r ")


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words: runs of bytes other than blanks (0x20, 0x09-0x0D), by document."""
    ink = ~_WHITE[buf]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    cut = offs[(offs > 0) & (offs < len(buf))]  # documents touch in the buffer
    first[cut] |= ink[cut]
    last[cut - 1] |= ink[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def tile(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of spans that tile the documents and pre-tokenize alone: a span
    starts at each white-space run, and where ASCII letters and signs meet
    (the apostrophe, which contractions use, is no sign here). Texts with
    blanks in a row or other white space are cut by the regular expression."""
    if not len(buf):
        return np.empty(0, np.int64)
    blank, letter, sign = _BLANK[buf], _LETTER[buf], _SIGN[buf]
    start = blank.copy()
    start[1:] |= (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
    start[offs[:-1][offs[:-1] < len(buf)]] = True
    odd = blank.copy()
    odd[:-1] &= blank[1:]
    ends = offs[1:][offs[1:] > 0] - 1
    odd[ends] = blank[ends]
    rare = np.flatnonzero(_RARE[buf])
    if len(rare):
        b, n = buf, len(buf) - 1
        x, y, z = b[rare], b[np.minimum(rare + 1, n)], b[np.minimum(rare + 2, n)]
        white = x < 0x20
        white |= (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
        white |= (x == 0xE1) & (y == 0x9A) & (z == 0x80)
        white |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
        white |= (x == 0xE2) & (y == 0x81) & (z == 0x9F)
        white |= (x == 0xE3) & (y == 0x80) & (z == 0x80)
        odd[rare[white]] = True
    hits = np.flatnonzero(odd)
    for d in np.unique(np.searchsorted(offs, hits, "right") - 1).tolist():
        lo, hi = int(offs[d]), int(offs[d + 1])
        start[lo:hi] = False
        at = lo
        for u in _UNIT.findall(buf[lo:hi].tobytes().decode()):
            start[at] = True
            at += len(u.encode())
    return np.flatnonzero(start)


def gather(flat: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenation of flat[off[i]:off[i] + size[i]]."""
    if not len(off):
        return flat[:0]
    total = np.cumsum(size)
    return flat[np.repeat(off - (total - size), size) + np.arange(total[-1])]


class WordTable:
    """Bounded memory of words: hash -> row; each column holds either one
    number or one run of values a word. ``learn(words)`` gives the columns of
    new words: numbers, or (all runs in a row, their lengths)."""

    def __init__(self, learn: Callable[[list[bytes]], list], runs: list, limit: int):
        self.learn, self.runs, self.limit = learn, runs, limit
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.cols = [(np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)) if run else np.empty(0, kind) for kind, run in self.runs]

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of each span; unknown words are learned."""
        uniq, first, inverse = np.unique(span_hash(buf, starts, ends), return_index=True, return_inverse=True)
        keys = uniq.tolist()
        if len(self.rows) + len(keys) > self.limit:
            self.clear()
        new = [i for i, k in enumerate(keys) if k not in self.rows]
        if new:
            at = first[new]
            got = self.learn([buf[a:b].tobytes() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            base = len(self.rows)
            self.rows.update((keys[i], base + n) for n, i in enumerate(new))
            for c, ((kind, run), values) in enumerate(zip(self.runs, got)):
                if run:
                    flat, off, size = self.cols[c]
                    added, more = values
                    self.cols[c] = np.concatenate((flat, added.astype(kind))), np.concatenate((off, len(flat) + np.cumsum(more) - more)), np.concatenate((size, more))
                else:
                    self.cols[c] = np.concatenate((self.cols[c], np.asarray(values, kind)))
        get = self.rows.__getitem__
        return np.fromiter(map(get, keys), np.int64, len(keys))[inverse]

    def run(self, c: int, rows: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of column c for all rows in order, and where each document
        (rows[cut[i]:cut[i + 1]]) begins in them."""
        flat, off, size = self.cols[c]
        n = size[rows]
        edge = np.concatenate(([0], np.cumsum(n)))
        return gather(flat, off[rows], n), edge[cut]


def sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sum of values[cut[i]:cut[i + 1]]."""
    edge = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return edge[cut[1:]] - edge[cut[:-1]]
