"""SentencePiece BPE: encoding and decoding by vectorised merge rounds.

The text, blanks written as U+2581 and one more in front, is a row of symbols:
one for each code point. No piece spans two neighbours that stand side by side
in no piece of the vocabulary, so the row is cut there. The distinct stretches
of a task are contracted together in flat numpy arrays: every round finds each
segment's smallest pair rank, contracts all its pairs of that rank from the
left at once, compacts the arrays and cuts segments where no piece can span any
more, until no pair remains. Contracting at once equals the library's agenda
(best score first, then leftmost) unless a contraction makes a pair that must
come before the rest of the round; such a segment (mostly runs of blanks, whose
pieces share one score) is finished by an agenda of its own.

A code point without a piece becomes the pieces of its UTF-8 bytes. Decoding
joins the pieces' bytes, drops the blank in front, and replaces what is no
UTF-8 by U+FFFD.

Edge cases: null and empty texts have no tokens (the digests are those of the
empty string); control pieces in a text are ordinary text; long texts are
encoded in parts of about ``PART`` code points that end at such a cut, so memory
follows the longest stretch without one; rows with a null id and repeated rows
pass through, one result a row; an empty table gives no rows; other columns are
ignored. A model that is no BPE model, rewrites characters, removes blanks or
has user-defined or unused pieces raises ValueError.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, tokenizer_path, worker_state
from .words import gather

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
#: code points encoded together, and distinct stretches (or their code points) remembered per worker
PART = 500_000
CACHE_WORDS = 300_000
CACHE_CHARS = 8_000_000
BYTE_ERRORS = "one-byte-at-a-time"
NONE = np.int32(2**30)  # no piece for this pair, but a longer one spans it
CUT = np.int32(2**31 - 1)  # no piece spans this pair


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, raw[at:at + n]
            at += n


def read_model(path: str) -> tuple[list[str], np.ndarray, list[int]]:
    """Pieces, scores and types (1 normal, 2 unknown, 3 control, 6 byte)."""
    pieces, scores, kinds = [], [], []
    trainer, normalizer = {}, {}
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                one = dict(_fields(value))
                pieces.append(one[1].decode())
                scores.append(np.frombuffer(one.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(one.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
    plain = normalizer.get(2, b"") == b"" and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
    if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or not plain or set(kinds) - {1, 2, 3, 6}:
        raise ValueError("not a BPE model with byte fallback, a blank in front and unchanged characters")
    return pieces, np.array(scores), kinds


class PieceCoder:
    def __init__(self, path: str):
        self.pieces, scores, kinds = read_model(path)
        self.kinds = np.array(kinds, np.int8)
        normal = [i for i, k in enumerate(kinds) if k == 1]
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        self.rank = {self.pieces[i]: (order[scores[i]], i) for i in normal}
        byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 6}
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, (_, i) in self.rank.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self._pairs()
        # what each id decodes to, and its decimal text with a comma in front
        unknown = " ⁇ ".encode()
        shown = [bytes([int(p[3:5], 16)]) if k == 6 else unknown if k == 2 else b"" if k == 3 else p.replace(BLANK, " ").encode() for p, k in zip(self.pieces, kinds)]
        self.shown = self._table(shown)
        self.decimal = self._table([b",%d" % i for i in range(len(self.pieces))])
        codecs.register_error(BYTE_ERRORS, lambda e: ("\ufffd", e.start + 1))
        self._forget()

    @staticmethod
    def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(v) for v in values], np.int64)
        return np.frombuffer(b"".join(values), np.uint8), np.cumsum(size) - size, size

    def _pairs(self) -> None:
        """Every pair of pieces that stands side by side in a piece: the rank
        and id of the pair itself, or NONE where only longer pieces hold it."""
        ids = {p: i for p, (_, i) in self.rank.items()}
        spans = {}
        for t in ids:
            inside = [[(j, ids[t[i:j]]) for j in range(i + 1, len(t) + 1) if t[i:j] in ids] for i in range(len(t))] + [[]]
            spans.update((((a, b), t[i:k]) for i in range(len(t)) for j, a in inside[i] for k, b in inside[j]))
        keys = np.array([a * len(self.pieces) + b for a, b in spans], np.int64)
        sort = np.argsort(keys)
        none = (int(NONE), -1)
        got = np.array([self.rank.get(t, none) for t in spans.values()], np.int32)[sort]
        self.keys, self.key_rank, self.key_id = keys[sort], got[:, 0].copy(), got[:, 1].copy()
        # hashed pairs of code points that some piece holds: more may pass, none is missed
        self.beside = np.zeros(1 << 22, bool)
        chars = [(ord(x), ord(y)) for t in ids for x, y in zip(t, t[1:])]
        a, b = np.array(chars, np.uint32).T
        self.beside[self._hash(a, b)] = True

    @staticmethod
    def _hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA77)) >> np.uint32(10)

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.chars = 0
        self.flat, self.off, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or NONE, CUT) and id of each pair."""
        key = a.astype(np.int64) * len(self.pieces) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.key_rank[at], CUT), np.where(hit, self.key_id[at], -1)

    def agenda(self, symbols: list[int]) -> list[int]:
        """One segment in the library's order: best rank, then leftmost."""
        text = [self.pieces[i] for i in symbols]
        n = len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank.get
        heap = [(r[0], i, text[i] + text[i + 1]) for i in range(n - 1) if (r := rank(text[i] + text[i + 1]))]
        heapify(heap)
        while heap:
            _, i, both = heappop(heap)
            j = after[i]
            if not text[i] or j >= n or text[i] + text[j] != both:
                continue
            text[i], text[j] = both, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (r := rank(text[x] + text[y])):
                    heappush(heap, (r[0], x, text[x] + text[y]))
        return [rank(t)[1] for t in text if t]

    def contract(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        edge = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        sym, out = self.of_char[chars], np.full(len(chars), -2, np.int32)
        place = np.arange(len(chars))
        rank, made = np.full(len(chars), CUT, np.int32), np.full(len(chars), -1, np.int32)
        rank[:-1], made[:-1] = self.lookup(sym[:-1], sym[1:])
        rank[edge[1:] - 1] = CUT
        while len(sym):
            first = np.concatenate(([0], np.flatnonzero(rank == CUT)[:-1] + 1))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.concatenate((first, [len(sym)])))
            open_ = best < NONE
            live = np.repeat(open_, size)
            if not open_.all():  # segments without a pair are final
                out[place[~live]] = sym[~live]
                sym, place, rank, made = sym[live], place[live], rank[live], made[live]
                best, size = best[open_], size[open_]
                if not len(sym):
                    break
            seg = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(rank == best[seg])
            fresh = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(seg[at]) != 0)))
            run = np.flatnonzero(fresh)
            at = at[(np.arange(len(at)) - run[np.cumsum(fresh) - 1]) % 2 == 0]
            new, own, limit = made[at], seg[at], best[seg[at]]
            # a contraction before the last of its segment must not make an earlier pair
            more = np.concatenate((own[1:] == own[:-1], [False]))
            left = sym[np.maximum(at - 1, 0)]
            touch = np.concatenate(([False], at[1:] - at[:-1] == 2))
            left = np.where(touch, np.concatenate(([0], new[:-1])), left)
            has_left = (at > 0) & (seg[np.maximum(at - 1, 0)] == own)
            nxt = np.minimum(at + 2, len(sym) - 1)
            has_right = (at + 2 < len(sym)) & (seg[nxt] == own)
            early = more & ((has_left & (self.lookup(left, new)[0] <= limit)) | (has_right & (self.lookup(new, sym[nxt])[0] <= limit)))
            gone = np.zeros(len(sym), bool)
            if early.any():
                begin = np.cumsum(size) - size
                for s in np.unique(own[early]).tolist():
                    lo, hi = int(begin[s]), int(begin[s] + size[s])
                    ids = self.agenda(sym[lo:hi].tolist())
                    out[place[lo:lo + len(ids)]] = ids
                    gone[lo:hi] = True
                keep = ~gone[at]
                at, new = at[keep], new[keep]
            sym[at], rank[at] = new, rank[at + 1]
            gone[at + 1] = True
            where = np.cumsum(~gone) - 1
            sym, place, rank = sym[~gone], place[~gone], rank[~gone]
            made = made[~gone]
            if not len(sym):
                break
            # only pairs beside a contraction are new; a cut stays one
            changed = where[at]
            changed = np.concatenate((changed, changed[changed > 0] - 1))
            changed = changed[rank[changed] != CUT]
            rank[changed], made[changed] = self.lookup(sym[changed], sym[changed + 1])
        # a code point without a piece gives one id a byte
        kept = np.flatnonzero(out != -2)
        ids, code = out[kept], chars[kept]
        odd = ids == -1
        width = np.where(odd, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1).astype(np.int64)
        total = np.cumsum(width)
        flat = np.repeat(ids, width)
        raw = np.frombuffer("".join(map(chr, code[odd].tolist())).encode(), np.uint8)
        flat[np.repeat(odd, width)] = self.byte[raw]
        start = np.concatenate(([0], total))[np.searchsorted(kept, edge)]
        return flat, np.diff(start)

    def parts(self, text: str) -> Iterator[str]:
        """The normalised text, cut where no piece can span."""
        text = (BLANK + text.replace(" ", BLANK)) if text else ""
        at = 0
        while len(text) - at > PART:
            end = at + PART
            while end < len(text):
                window = text[end - 1:end + PART]
                cuts = self.cuts(window)
                if len(cuts):
                    end += int(cuts[0]) - 1
                    break
                end += len(window) - 1
            yield text[at:end]
            at = end
        if at < len(text):
            yield text[at:]

    def cuts(self, text: str) -> np.ndarray:
        u = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.flatnonzero(~self.beside[self._hash(u[:-1], u[1:])]) + 1

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of each part of a normalised text."""
        text = "".join(parts)
        if not text:
            return [np.empty(0, np.int32)] * len(parts)
        edge = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        starts = np.union1d(np.concatenate((self.cuts(text), [0])), edge[:-1][np.diff(edge) > 0])
        ends = starts.tolist()[1:] + [len(text)]
        words = [text[a:b] for a, b in zip(starts.tolist(), ends)]
        if len(self.rows) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if new:
            flat, size = self.contract(new)
            base = len(self.rows)
            self.rows.update((w, base + i) for i, w in enumerate(new))
            self.chars += sum(map(len, new))
            self.off = np.concatenate((self.off, len(self.flat) + np.cumsum(size) - size))
            self.flat, self.size = np.concatenate((self.flat, flat)), np.concatenate((self.size, size))
        rows = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        n = self.size[rows]
        ids = gather(self.flat, self.off[rows], n)
        cut = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, edge)]
        return [ids[a:b] for a, b in zip(cut.tolist(), cut.tolist()[1:])]

    def decode(self, ids: np.ndarray, first: bool = True) -> bytes:
        """UTF-8 of the decoded text; ``first``: the ids begin a text."""
        apart = np.flatnonzero(self.kinds[ids] == 3)
        if len(apart):  # a control piece shows nothing, but ends a run of byte pieces
            runs = [r[self.kinds[r] != 3] for r in np.split(ids, apart)]
            runs = [r for r in runs if len(r)]
            return b"".join(self.decode(r, first and k == 0) for k, r in enumerate(runs))
        flat, off, size = self.shown
        raw = gather(flat, off[ids], size[ids]).tobytes()
        if first and len(ids) and self.pieces[int(ids[0])].startswith(BLANK):
            raw = raw[1:]
        # each byte that is part of no character becomes U+FFFD
        return raw.decode("utf-8", BYTE_ERRORS).encode()


def _coder(model: str) -> PieceCoder:
    return worker_state(f"pieces:{model}", lambda: PieceCoder(tokenizer_path(model)))


def _groups(coder: PieceCoder, texts: list[str]) -> Iterator[list[tuple[int, str, bool]]]:
    """(row, part, first) of all texts, about PART code points together."""
    group, size = [], 0
    for row, text in enumerate(texts):
        for k, part in enumerate(coder.parts(text)):
            group.append((row, part, k == 0))
            size += len(part)
            if size > PART:
                yield group
                group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches):
        coder = _coder(model)
        for b in batches:
            ids = [[] for _ in range(b.num_rows)]
            for group in _groups(coder, b.column("text").to_pylist()):
                for (row, _, _), got in zip(group, coder.encode([p for _, p, _ in group])):
                    ids[row].append(got)
            flat = [np.concatenate(x) if x else np.empty(0, np.int32) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(flat, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of (doc_id, ids); null ids give an empty text."""

    def run(batches):
        coder = _coder(model)
        for b in batches:
            text = [coder.decode(np.array(x or [], np.int64)).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas) and
    decoded_sha256: each text is encoded, then its ids are decoded."""

    def run(batches):
        coder = _coder(model)
        flat, off, size = coder.decimal
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            shown, back = ([hashlib.sha256() for _ in range(b.num_rows)] for _ in range(2))
            for group in _groups(coder, b.column("text").to_pylist()):
                for (row, _, first), ids in zip(group, coder.encode([p for _, p, _ in group])):
                    n[row] += len(ids)
                    shown[row].update(gather(flat, off[ids], size[ids])[int(first):].tobytes())
                    back[row].update(coder.decode(ids, first))
            cols = [b.column("doc_id"), pa.array(n), pa.array([h.hexdigest() for h in shown]), pa.array([h.hexdigest() for h in back])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
