"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte n-grams (3 to 5, with word ends) and itself; every
n-gram has an embedding, a word is the mean of its n-grams' and a window of
``WINDOW`` words the mean of its words'. Embeddings and the softmax above them
are trained together, in numpy, on a bounded sample of labelled documents;
misspelt words share most n-grams with the words they stand for. Only some
windows of a toxic document are toxic, so training runs twice: the second time
a toxic document is represented by the windows the first model finds worst.

A document's score is the calibrated log-odds of its worst window. At scoring
time the layers collapse to one number per n-gram bucket, so a word's part is
computed once per slice of texts.

Edge cases: a null or empty text, or one without letters or digits, gets the
calibrated score of "no window"; repeated rows get equal scores; an empty table
gives no rows; without labels of both classes scores are the base rate; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, labelled_sample
from .words import _BASE, _BYTE, _INVERSE, _power, gather, mix, owner, slices, span_hash

WINDOW = 8
#: an n-gram needs so many documents, and that share of them
MIN_DOCS = 5
MIN_SHARE = 0.02
#: training passes, and the quantile of clean windows that a toxic document's further windows must exceed
PASSES = 3
CLEAN = 0.995
DECAY = 1e-6
#: documents of each class in the training sample
PER_CLASS = 1200
THRESHOLD = 0.3
BITS = 18
DIM = 4
_INK = np.zeros(256, bool)
_INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def lower(buf: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 capitals in UTF-8."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    if len(buf) > 1:
        two = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[two] += 32
    return out


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters and digits, by document."""
    ink = _INK[buf]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    cut = offs[(offs > 0) & (offs < len(buf))]
    first[cut] |= ink[cut]
    last[cut - 1] |= ink[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def subwords(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every n-gram of ``<word>`` and of the word."""
    size = ends - starts
    total = size + 2
    off = np.cumsum(total) - total
    flat = np.full(int(total.sum()), 60, np.uint8)
    inner = np.repeat(off + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    flat[inner] = gather(buf, starts, size)
    flat[off + total - 1] = 62
    run = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * _power(_BASE, len(flat))[:len(flat)], out=run[1:])
    inv = _power(_INVERSE, len(flat))
    word = np.repeat(np.arange(len(starts)), total)
    left = np.repeat(off + total, total) - np.arange(len(flat))
    which, bucket = [np.arange(len(starts))], [mix(span_hash(buf, starts, ends)) >> np.uint64(64 - BITS)]
    for n in (3, 4, 5):
        at = np.flatnonzero(left >= n)
        h = (run[at + n] - run[at]) * inv[at]
        which.append(word[at])
        bucket.append(mix(h + np.uint64(n)) >> np.uint64(64 - BITS))
    return np.concatenate(which), np.concatenate(bucket).astype(np.int64)


def windows(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window, and the first window of each document and
    one past the last. Documents are cut every WINDOW words."""
    count = -(-np.diff(cut) // WINDOW)
    edge = np.concatenate(([0], np.cumsum(count)))
    return np.repeat(cut[:-1] - edge[:-1] * WINDOW, count) + np.arange(edge[-1]) * WINDOW, edge


def mean_by(values: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Column means of ``values`` by ``key``."""
    size = np.maximum(np.bincount(key, minlength=n), 1)
    return np.stack([np.bincount(key, v, n) / size for v in values.T], 1)


class Model:
    def __init__(self, bucket_odds: np.ndarray, bias: float, slope: float, shift: float, empty: float):
        self.odds, self.bias, self.slope, self.shift, self.empty = bucket_odds, bias, slope, shift, empty

    def window_odds(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buf = lower(buf)
        starts, ends = words_of(buf, offs)
        cut = owner(starts, offs)
        first, edge = windows(cut)
        if not len(starts):
            return np.empty(0), edge
        _, at, inverse = np.unique(span_hash(buf, starts, ends), return_index=True, return_inverse=True)
        which, bucket = subwords(buf, starts[at], ends[at])
        word = np.bincount(which, self.odds[bucket], len(at)) / np.bincount(which, minlength=len(at))
        size = np.diff(np.concatenate((first, [len(starts)])))
        return np.add.reduceat(word[inverse], first) / size + self.bias, edge

    def worst(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        odds, edge = self.window_odds(buf, offs)
        out = np.full(len(edge) - 1, np.nan)
        full = np.diff(edge) > 0
        if full.any():
            out[full] = np.maximum.reduceat(odds, edge[:-1][full])
        return out

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = self.worst(buf, offs)
        return np.where(np.isnan(z), self.empty, 1 / (1 + np.exp(-np.clip(self.slope * np.nan_to_num(z) + self.shift, -30, 30))))


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def calibrate(z: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float]:
    """Logistic regression on one number, by Newton's method, with the usual
    smoothed targets; classes are weighted to the share ``rate`` of label 1."""
    mid, wide = float(np.median(z)), float(np.std(np.clip(z, *np.quantile(z, [0.01, 0.99])))) or 1.0
    u = np.clip((z - mid) / wide, -8, 8)
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    class_w = np.where(y > 0, rate / max(pos, 1), (1 - rate) / max(neg, 1)) * len(y)
    a, b = 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        w = class_w * p * (1 - p)
        r = class_w * (p - t)
        g = np.array([(r * u).sum(), r.sum()])
        h = np.array([[(w * u * u).sum() + 1e-3, (w * u).sum()], [(w * u).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    a, b = a / wide, b - a * mid / wide
    return float(a), float(b)


def _train(which, bucket, size, inverse, first, label, weight, epochs, rate=0.2, batch=2048, seed=7):
    """Embeddings, softmax weights and biases by Adam on batches of windows:
    log-odds by bucket and the bias. ``size``: all n-grams of each word."""
    rng = np.random.default_rng(seed)
    used, gram = np.unique(bucket, return_inverse=True)
    order = np.argsort(which, kind="stable")
    gram = gram[order]
    n_gram = np.bincount(which, minlength=len(size))
    gram_off = np.cumsum(n_gram) - n_gram
    length = np.diff(np.concatenate((first, [len(inverse)])))
    emb = rng.normal(0, 0.1, (len(used), DIM))
    top = rng.normal(0, 0.5, (DIM, 2))
    bias = np.zeros(2)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (emb, top, bias)]
    pick = np.flatnonzero(weight > 0)
    weight = weight * len(pick) / weight.sum()
    target = np.eye(2)[label]
    t = 0
    for _ in range(epochs):
        pick = rng.permutation(pick)
        for lo in range(0, len(pick), batch):
            win = pick[lo:lo + batch]
            t += 1
            words, at = np.unique(gather(inverse, first[win], length[win]), return_inverse=True)
            win_of = np.repeat(np.arange(len(win)), length[win])
            grams = gather(gram, gram_off[words], n_gram[words])
            word_of = np.repeat(np.arange(len(words)), n_gram[words])
            vec = np.stack([np.bincount(word_of, e, len(words)) for e in emb[grams].T], 1) / size[words][:, None]
            doc = np.stack([np.bincount(win_of, v, len(win)) for v in vec[at].T], 1) / length[win][:, None]
            z = doc @ top + bias
            p = np.exp(z - z.max(1, keepdims=True))
            dz = (p / p.sum(1, keepdims=True) - target[win]) * (weight[win] / len(win))[:, None]
            back = (dz @ top.T / length[win][:, None])[win_of]
            back = np.stack([np.bincount(at, g, len(words)) for g in back.T], 1) / size[words][:, None]
            d_emb = np.stack([np.bincount(grams, g, len(used)) for g in back[word_of].T], 1)
            for k, (x, g) in enumerate(((emb, d_emb), (top, doc.T @ dz), (bias, dz.sum(0)))):
                g = g + DECAY * x * (k < 2)
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    odds = np.zeros(1 << BITS)
    odds[used] = emb @ (top[:, 1] - top[:, 0])
    return odds, float(bias[1] - bias[0])


def fit(texts: list[str], labels: list[int], rate: float | None = None, epochs: int = 6) -> Model:
    """Trains on two thirds of the documents, calibrates on the rest. ``rate``
    is the share of label 1 where the model will be used; the sample may have
    another."""
    y = np.array(labels, np.int64)
    rate = rate if rate is not None else float(y.mean()) if len(y) else 0.5
    if len(y) < 6 or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), rate)
    held = np.arange(len(y)) % 3 == 2
    docs = [t for t, h in zip(texts, held) if not h]
    label = y[~held]
    buf, offs = _buffer(docs)
    buf = lower(buf)
    starts, ends = words_of(buf, offs)
    cut = owner(starts, offs)
    first, edge = windows(cut)
    _, at, inverse = np.unique(span_hash(buf, starts, ends), return_index=True, return_inverse=True)
    which, bucket = subwords(buf, starts[at], ends[at])
    n_win = np.diff(edge)
    # an n-gram of few documents says little of the next one
    word_doc = np.unique(inverse * np.int64(len(docs)) + np.repeat(np.arange(len(docs)), np.diff(cut)))
    n_docs = np.bincount(word_doc // len(docs), minlength=len(at))
    common = np.bincount(bucket, n_docs[which], 1 << BITS) >= max(MIN_DOCS, MIN_SHARE * len(docs))
    size = np.bincount(which, minlength=len(at))
    which, bucket = which[common[bucket]], bucket[common[bucket]]
    doc_of = np.repeat(np.arange(len(docs)), n_win)
    wl = label[doc_of]
    weight = np.where(wl == 1, 0.5 / max(1, (wl == 1).sum()), 0.5 / max(1, (wl == 0).sum()))
    length = np.diff(np.concatenate((first, [len(starts)])))
    for again in range(PASSES):
        odds, bias = _train(which, bucket, size, inverse, first, wl, weight, epochs)
        if again == PASSES - 1:
            break
        word = np.bincount(which, odds[bucket], len(at)) / size
        z = np.add.reduceat(word[inverse], first) / length + bias
        # from now on a toxic document stands for its worst windows only
        worst = np.full(len(docs), -np.inf)
        np.maximum.at(worst, doc_of, z)
        keep = (wl == 0) | (z == worst[doc_of]) | (z > np.quantile(z[wl == 0], CLEAN))
        weight = np.where(wl == 1, keep * 0.5 / max(1, (keep & (wl == 1)).sum()), 0.5 / max(1, (wl == 0).sum()))
    model = Model(odds, bias, 1.0, 0.0, rate)
    cal = [(t, v) for t, v, h in zip(texts, y.tolist(), held) if h]
    z = model.worst(*_buffer([t for t, _ in cal]))
    seen = ~np.isnan(z)
    model.slope, model.shift = calibrate(z[seen], np.array([v for _, v in cal])[seen].astype(float), rate)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document."""

    def run(batches):
        for ids, buf, offs in slices(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.scores(buf, offs))], names=["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxic", train: Column | None = None, per_class: int = PER_CLASS) -> DataFrame:
    """Fit on the labelled documents for which ``train`` holds (default: all),
    then score every document: doc_id, score."""
    texts, y, rate = labelled_sample(docs, labels, column, F.lit(True) if train is None else train, per_class)
    return score(docs, fit(texts, y, rate))
