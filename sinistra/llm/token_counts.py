"""Token counts under a unigram model, by dynamic programming on a trie.

The distinct pre-tokens of a slice of texts are the terminals of a trie. It is
walked depth first (sorted order), with the forward score of every prefix on
the current path at hand, so a prefix that many words share is scored once. A
terminal stores the number of pieces of its best segmentation.

The pieces are a public byte-level vocabulary, whose 256 bytes make every text
segmentable. A piece of rank r has probability proportional to 1 / (r + 1)
(the vocabulary is ordered by frequency). Costs are whole micro-nats, so ties
are exact; a tie goes to fewer pieces.

Edge cases: null and empty texts count 0; repeated rows give repeated results;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import pattern, ranks
from .common import id_text, tokenizer_path, worker_state
from .words import WordTable, owner, slices, sums, tile

#: spans kept per worker before the table starts anew
CACHE_WORDS = 500_000
#: a score is cost << COUNT_BITS | pieces, so the smaller number wins both
COUNT_BITS = 24


def piece_scores(vocabulary: dict[bytes, int]) -> dict[bytes, int]:
    total = math.log(sum(1 / (r + 1) for r in vocabulary.values()))
    return {t: (round(1e6 * (math.log(r + 1) + total)) << COUNT_BITS) + 1 for t, r in vocabulary.items()}


def trie_counts(words: set[bytes], scores: dict[bytes, int], longest: int) -> dict[bytes, int]:
    """Number of pieces of each word's best segmentation. ``best[i]`` is the
    score of the node at depth i of the path; the next word in order keeps the
    nodes of the prefix it shares."""
    out, prev, best = {}, b"", [0]
    get = scores.get
    far = 1 << 200
    mask = (1 << COUNT_BITS) - 1
    for w in sorted(words):
        same, top = 0, min(len(w), len(prev))
        while same < top and w[same] == prev[same]:
            same += 1
        del best[same + 1:]
        for i in range(same + 1, len(w) + 1):
            low = far
            for j in range(i - longest if i > longest else 0, i):
                s = get(w[j:i])
                if s is not None and best[j] + s < low:
                    low = best[j] + s
            best.append(low)
        out[w] = best[-1] & mask
        prev = w
    return out


class Counter:
    def __init__(self, path: str):
        import regex

        self.scores = piece_scores(ranks(path))
        self.longest = max(map(len, self.scores))
        self.find = regex.compile(pattern()).findall
        self.table = WordTable(self.learn, [(np.int64, False), (np.int64, False)], CACHE_WORDS)

    def learn(self, spans: list[bytes]) -> list:
        parts = [[w.encode() for w in self.find(u.decode())] for u in spans]
        count = trie_counts({w for ws in parts for w in ws}, self.scores, self.longest)
        return [[len(ws) for ws in parts], [sum([count[w] for w in ws]) for ws in parts]]

    def documents(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = tile(buf, offs)
        cut = owner(starts, offs)
        rows = self.table.find(buf, starts, np.concatenate((starts[1:], [len(buf)])).astype(np.int64)) if len(starts) else starts
        return sums(self.table.cols[0][rows], cut), sums(self.table.cols[1][rows], cut)


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_pretokens, n_tokens."""

    def run(batches):
        counter = worker_state(f"unigram:{vocabulary}", lambda: Counter(tokenizer_path(vocabulary)))
        for ids, buf, offs in slices(batches):
            words, pieces = counter.documents(buf, offs)
            yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(pieces)], names=["doc_id", "n_pretokens", "n_tokens"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
