"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
text. A document is compressed in blocks with each of them; how much smaller
the good dictionary makes it, relative to the larger of both sizes, is the
feature, for the whole document and for its least good block. Logistic
regression on held-back labelled documents turns both into a probability.

Edge cases: a null or empty text has both differences 0; whole texts of any
length are compressed, block by block; repeated rows get equal scores; an
empty table gives no rows; with fewer than ``MIN_LABELS`` labels of a class
every score is the share of label 1 (0.5 without labels); other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, labelled_sample
from .words import slices

BLOCK = 512
DICT_BYTES = 112_640
LEVEL = 3
#: documents of each class in the training sample
PER_CLASS = 3000
MIN_LABELS = 8
THRESHOLD = 0.3


def blocks(raw: bytes) -> list[bytes]:
    """Blocks of BLOCK bytes; a short last one joins the one before."""
    n = max(1, len(raw) // BLOCK)
    return [raw[i * BLOCK:(i + 1) * BLOCK if i < n - 1 else None] for i in range(n)]


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary trained on blocks; with too little text to train
    on, the text itself."""
    import zstandard as zs

    try:
        return zs.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


class Compressors:
    """The pair of compressors of one task."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zs

        self.pair = []
        for d in (good, bad):
            own = zs.ZstdCompressionDict(d)
            own.precompute_compress(level=LEVEL)
            self.pair.append(zs.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def features(self, raw: bytes) -> tuple[float, float]:
        if not raw:
            return 0.0, 0.0
        good_by, bad_by = self.pair
        good = bad = 0
        worst = 1.0
        for b in blocks(raw):
            g, d = len(good_by(b)), len(bad_by(b))
            good, bad = good + g, bad + d
            worst = min(worst, (d - g) / max(d, g))
        return (bad - good) / max(bad, good), worst


def logistic(x: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray:
    """Weights (with the constant last) of a logistic regression by Newton's
    method; classes are weighted to the share ``rate`` of label 1."""
    a = np.column_stack((x, np.ones(len(x))))
    cw = np.where(y > 0, rate / max(1, (y > 0).sum()), (1 - rate) / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(a.shape[1])
    ridge = 0.01 * np.eye(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (cw * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (cw * (p - y)) + ridge @ w)
        w = w - np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights

    def scores(self, raws: list[bytes], with_: Compressors) -> np.ndarray:
        x = np.array([with_.features(r) for r in raws]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:2] + self.weights[2], -30, 30)))


def fit(texts: list[str], labels: list[int], rate: float) -> Model:
    """Dictionaries from one half of the sample, the regression on the other."""
    raw, y = [t.encode() for t in texts], np.array(labels, int)
    if min((y == 1).sum(), (y == 0).sum()) < MIN_LABELS:
        return Model(b"", b"", np.array([0.0, 0.0, np.log((rate + 1e-3) / (1 - rate + 1e-3))]))
    built = np.zeros(len(y), bool)
    for v in (0, 1):
        built[np.flatnonzero(y == v)[::2]] = True
    good, bad = (dictionary([b for r, k, b_ in zip(raw, y, built) if b_ and k == v for b in blocks(r)]) for v in (1, 0))
    model = Model(good, bad, np.zeros(3))
    with_ = Compressors(good, bad)
    x = np.array([with_.features(r) for r, b in zip(raw, built) if not b])
    model.weights = logistic(x, y[~built], rate)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every document."""

    def run(batches):
        with_ = Compressors(model.good, model.bad)
        for ids, buf, offs in slices(batches):
            raw, at = buf.tobytes(), offs.tolist()
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.scores([raw[a:b] for a, b in zip(at, at[1:])], with_))], names=["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", train: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled documents for which ``train`` holds (default: all)."""
    return fit(*labelled_sample(docs, labels, column, F.lit(True) if train is None else train, per_class))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        with_ = Compressors(model.good, model.bad)
        return pd.Series(model.scores([(t or "").encode() for t in texts], with_))

    return docs.filter(scored(F.col("text")) >= threshold)
