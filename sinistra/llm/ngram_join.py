"""Jaccard self-join of documents on word n-grams, with several global orders.

Documents of equal n-gram sets are one class; only classes are compared. Under
any global order of the n-grams, two sets that reach the threshold share one of
the first few (the prefix). Several orders are used: each begins with the
n-grams that a count over all documents finds rare, and breaks ties by another
hash. The first order's prefixes are indexed, with length and position filters;
a candidate pair must then also share prefix n-grams under the other orders
before the whole sets are intersected.

No group is compared pair by pair when it is large. An index entry with more
than ``BLOCK`` classes is hot: its classes are first compared with one of them
only; what that connects needs no more comparison among itself, and only pairs
of different components go on to the filters. The result is exact: every link
either was verified or joins classes that verified links already connect.

n-grams and sets are known by 64-bit hashes. The counts are a table of 2 ** 20
counters, whatever the input, and only steer the orders.

Edge cases: a null or empty text, or one of blanks only, has an empty set,
links with nothing and is its own component; with fewer than n words the whole
sequence is the one n-gram; rows with a null id are left out; rows that share
an id are one vertex, but each row is returned; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, scratch
from .components import components
from .words import mix, owner, slices, span_hash, word_spans

COUNTERS = 1 << 20
CHUNK = 1 << 14
#: classes of one index entry that are compared pair by pair
BLOCK = 64
#: bits of the filter that picks the sets needed for verification
PICK_BITS = 1 << 24
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def gram_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all documents, document by document in
    ascending order, and where each document's begin."""
    buf = _UPPER[buf]
    starts, ends = word_spans(buf, offs)
    cut = owner(starts, offs)
    word = span_hash(buf, starts, ends)
    count = np.diff(cut)
    doc = np.repeat(np.arange(len(count)), count)
    rest = cut[1:][doc] - np.arange(len(word))  # words from here to the end
    short = count < n
    lead = np.flatnonzero((rest >= n) | (short[doc] & (rest == count[doc])))
    h = np.zeros(len(lead), np.uint64)
    for k in range(n):
        has = rest[lead] > k
        h[has] += word[lead[has] + k] * _MUL[k % 5] + np.uint64(k + 1)
        h = mix(h)
    order = np.lexsort((h, doc[lead]))
    h, d = h[order], doc[lead][order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[first], d[first]
    return h, np.searchsorted(d, np.arange(len(count) + 1))


def set_keys(grams: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set."""
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(grams ^ _MUL[1]))))
    return mix((run[cut[1:]] - run[cut[:-1]]) + np.diff(cut).astype(np.uint64) * _MUL[2]).view(np.int64)


def order_keys(grams: np.ndarray, classes: np.ndarray, which: int) -> np.ndarray:
    """Rank keys of the global order ``which``: rare n-grams first."""
    level = classes[(grams >> np.uint64(44)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(58)) | (mix(grams + _MUL[which]) >> np.uint64(6))


def prefix_size(n, percent: int):
    return n - (n * percent + 99) // 100 + 1


def _counts(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, k) of every document, and the rarity class of each counter:
    the bit length of the count there beyond what chance explains."""

    def run(batches):
        table = np.zeros(COUNTERS, np.int64)
        for ids, buf, offs in slices(batches):
            grams, cut = gram_sets(buf, offs, n)
            table += np.bincount((grams >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
            none = pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(cut), pa.int32()), pa.array(set_keys(grams, cut)), *none], names=["doc_id", "n", "k", "chunk", "counts"])
        for c in np.flatnonzero(table.reshape(-1, CHUNK).any(1)):
            part = table[c * CHUNK:(c + 1) * CHUNK].tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([c], pa.int32()), pa.array([part])], names=["doc_id", "n", "k", "chunk", "counts"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for b in pdf["counts"]:
            total += np.frombuffer(b, np.int64)
        return pd.DataFrame({"chunk": [key[0]], "counts": [total.tobytes()]})

    both = scratch(docs.mapInArrow(run, "doc_id long, n int, k long, chunk int, counts binary"), "sets")
    parts = both.filter("chunk IS NOT NULL").select("chunk", "counts")
    # summed in groups of bounded size first, so no group grows with the input's partitions
    some = parts.withColumn("part", F.floor(F.rand(5) * 64)).groupBy("chunk", "part").applyInPandas(add, "chunk int, counts binary")
    table = np.zeros(COUNTERS, np.int64)
    for r in some.groupBy("chunk").applyInPandas(add, "chunk int, counts binary").toLocalIterator():
        table[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.int64)
    chance = table.sum() / COUNTERS  # what unrelated n-grams put on a counter, and 4 deviations
    above = np.maximum(table - chance - 4 * np.sqrt(chance) - 1, 0)
    classes = np.minimum(np.ceil(np.log2(above + 1)), 63).astype(np.uint8)
    return both.filter("chunk IS NULL").select("doc_id", "n", "k"), classes


def _index(docs: DataFrame, n: int, percent: int, classes: np.ndarray) -> DataFrame:
    """Prefix entries of the first order: gram, k, n, pos and the n-gram before
    it in the prefix (0 for the first). A task emits each set once."""

    def run(batches):
        seen: set = set()
        for _, buf, offs in slices(batches):
            grams, cut = gram_sets(buf, offs, n)
            size, keys = np.diff(cut), set_keys(grams, cut)
            new = np.zeros(len(size), bool)
            for i, k in enumerate(keys.tolist()):
                if size[i] and k not in seen:
                    seen.add(k)
                    new[i] = True
            doc = np.repeat(np.arange(len(size)), size)
            keep = new[doc]
            grams, doc = grams[keep], doc[keep]
            order = np.lexsort((order_keys(grams, classes, 0), doc))
            grams, doc = grams[order], doc[order]
            pos = np.arange(len(doc)) - np.searchsorted(doc, doc)
            before = np.where(pos > 0, np.roll(grams, 1), np.uint64(0))
            lead = pos < prefix_size(size[doc], percent)
            grams, doc, pos, before = grams[lead], doc[lead], pos[lead], before[lead]
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(keys[doc]), pa.array(size[doc], pa.int32()), pa.array(pos, pa.int32()), pa.array(before.view(np.int64))], names=["gram", "k", "n", "pos", "before"])

    return docs.mapInArrow(run, "gram long, k long, n int, pos int, before long")


def may_link(na, pa_, nb, pb, percent: int):
    """Length and position filters for entries with sizes na, nb at positions
    pa_, pb of the prefixes; the same form serves arrays and columns."""
    need = percent * (na + nb)
    return ((100 + percent) * (na - pa_) >= need) & ((100 + percent) * (nb - pb) >= need) & (100 * na >= percent * nb) & (100 * nb >= percent * na)


def _blocks(index: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a < b) of entries with up to BLOCK classes, and the
    rows of hot entries (hot true; a is the class): a, b, hot, gram, n, pos.

    Two classes whose prefixes have the same n-gram before this one met in its
    entry as well, at positions that pass the filters more easily. So a pair is
    listed only where the n-grams before differ, not once for each n-gram that
    two like prefixes share."""
    names = ["a", "b", "hot", "gram", "n", "pos"]

    def rows(a, b, hot, gram, n, pos):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), hot)), pa.array(gram, pa.int64()), pa.array(n, pa.int32()), pa.array(pos, pa.int32())], names=names)

    def run(batches):
        held = None  # the rows of the last gram so far; of a hot gram none are held
        hot_gram = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "k", "n", "pos", "before")]
            if hot_gram is not None:
                more = cols[0] == hot_gram
                if more.any():
                    g, k, n, p, _ = (c[more] for c in cols)
                    yield rows(k, k, True, g, n, p)
                    cols = [c[~more] for c in cols]
                if len(cols[0]):
                    hot_gram = None
            if held is not None:
                cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
            held = None
            if not len(cols[0]):
                continue
            first = np.flatnonzero(np.concatenate(([True], cols[0][1:] != cols[0][:-1])))
            size = np.diff(np.concatenate((first, [len(cols[0])])))
            if size[-1] > BLOCK:
                hot_gram = int(cols[0][-1])
            else:  # the next batch may go on with it
                held = [c[first[-1]:] for c in cols]
                cols, first, size = [c[:first[-1]] for c in cols], first[:-1], size[:-1]
            yield from emit(cols, first, size)
        if held is not None:
            yield from emit(held, np.array([0]), np.array([len(held[0])]))

    def emit(cols, first, size):
        big = np.repeat(size > BLOCK, size)
        if big.any():
            g, k, n, p, _ = (c[big] for c in cols)
            yield rows(k, k, True, g, n, p)
        _, k, n, p, before = cols
        out_a, out_b = [], []
        for s in np.unique(size[(size > 1) & (size <= BLOCK)]).tolist():
            at = first[size == s]
            i, j = np.triu_indices(s, 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            met = (p[x] > 0) & (p[y] > 0) & (before[x] == before[y])
            ok = ~met & (k[x] != k[y]) & may_link(n[x].astype(np.int64), p[x], n[y].astype(np.int64), p[y], percent)
            out_a.append(np.minimum(k[x], k[y])[ok])
            out_b.append(np.maximum(k[x], k[y])[ok])
        if out_a:
            pairs = np.unique(np.stack((np.concatenate(out_a), np.concatenate(out_b))), axis=1)
            if pairs.shape[1]:
                none = [None] * pairs.shape[1]
                yield rows(pairs[0], pairs[1], False, none, none, none)

    return index.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "a long, b long, hot boolean, gram long, n int, pos int")


def _picked(docs: DataFrame, wanted: DataFrame, n: int, columns, schema: str, name: str) -> DataFrame:
    """``columns(grams)`` of the wanted classes (k), once each. A bitmap of
    fixed size picks them while the texts are read; what it lets through
    besides is dropped by the joins that follow."""
    slot = (F.pmod(F.col("k"), F.lit(PICK_BITS)) + 1).alias("slot")  # the bitmap functions count from 1
    packed = wanted.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    pick = np.zeros(PICK_BITS // 8 + 4096, np.uint8)
    for r in packed.toLocalIterator():
        pick[(r.bucket - 1) * 4096:r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)

    def run(batches):
        seen: set = set()
        for _, buf, offs in slices(batches):
            grams, cut = gram_sets(buf, offs, n)
            keys = set_keys(grams, cut)
            at = np.mod(keys, PICK_BITS)
            hit = (pick[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            out = []
            for i in np.flatnonzero(hit & (np.diff(cut) > 0)).tolist():
                k = int(keys[i])
                if k not in seen:
                    seen.add(k)
                    out.append((k, *columns(grams[cut[i]:cut[i + 1]])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["k"] + [c.split()[0] for c in schema.split(", ")])

    return scratch(docs.mapInArrow(run, f"k long, {schema}").dropDuplicates(["k"]), name)


def _beside(pairs: DataFrame, sets: DataFrame, *cols: str) -> DataFrame:
    """Columns of both classes of each pair."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("k").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in cols)), side)
    return pairs


def brief(grams: np.ndarray, classes: np.ndarray, which: int) -> np.ndarray:
    """The upper halves of n-grams' rank keys under an order, ascending: what
    pairs carry of a prefix. Two n-grams of one half make a filter let through
    more, never less."""
    return np.sort((order_keys(grams, classes, which) >> np.uint64(32)).astype(np.uint32))


def few_missing(x: np.ndarray, y: np.ndarray, nx: int, ny: int, percent: int) -> bool:
    """Whether prefixes x and y of one order (as by ``brief``) allow the
    threshold: they share an n-gram, and where both prefixes are complete (below
    the smaller of their last keys) neither misses more n-grams than its set may."""
    in_y = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
    if not in_y.any():
        return False
    in_x = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
    limit = min(x[-1], y[-1])
    need = -(-percent * (nx + ny) // (100 + percent))
    return (~in_y & (x < limit)).sum() <= nx - need and (~in_x & (y < limit)).sum() <= ny - need


def _sieved(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes under the second and the third order allow the
    threshold."""

    @F.pandas_udf("boolean")
    def allowed(na: pd.Series, nb: pd.Series, a2: pd.Series, b2: pd.Series, a3: pd.Series, b3: pd.Series) -> pd.Series:
        def one(p, q, i, j):
            return few_missing(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32), i, j, percent)

        return pd.Series([one(p, q, i, j) and one(r, s, i, j) for i, j, p, q, r, s in zip(na.tolist(), nb.tolist(), a2, b2, a3, b3)], dtype=bool)

    return _beside(pairs, prefixes, "n", "second", "third").filter(allowed("a_n", "b_n", "a_second", "b_second", "a_third", "b_third")).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, prefixes: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v): pairs that pass the filters of the other orders and whose
    whole sets reach the threshold."""

    @F.pandas_udf("boolean")
    def reach(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            u, v = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = np.concatenate((u, v))
            both.sort()
            same = int((both[1:] == both[:-1]).sum())
            out.append(100 * same >= percent * (len(u) + len(v) - same))
        return pd.Series(out, dtype=bool)

    left = scratch(_sieved(pairs, prefixes, percent), "sieved")
    either = left.select(F.col("a").alias("k")).unionByName(left.select(F.col("b").alias("k")))
    sets = _picked(docs, either, n, lambda g: (g.tobytes(),), "grams binary", "grams")
    return _beside(left, sets, "grams").filter(reach("a_grams", "b_grams")).select(F.col("a").alias("u"), F.col("b").alias("v"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach)
    of every document: two link when their n-gram sets have a Jaccard
    similarity of at least ``percent`` / 100."""
    docs = id_text(docs).filter("doc_id IS NOT NULL")
    classed, classes = _counts(docs, n)
    blocks = scratch(_blocks(_index(docs, n, percent, classes), percent), "blocks")
    pairs = blocks.filter(~F.col("hot")).select("a", "b")
    hot = blocks.filter("hot").select("gram", F.col("a").alias("k"), "n", "pos").dropDuplicates(["gram", "k"])
    hot = scratch(hot, "hot")
    wanted = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).unionByName(hot.select("k"))

    def ends(g: np.ndarray) -> tuple:
        p = prefix_size(len(g), percent)
        return (len(g), *(brief(g, classes, w)[:p].tobytes() for w in (3, 4)))

    prefixes = _picked(docs, wanted, n, ends, "n long, second binary, third binary", "prefixes")
    verified = lambda some: _verified(some, docs, prefixes, n, percent)
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    filters = lambda s, t: may_link(F.col(f"{s}n").cast("long"), F.col(f"{s}pos"), F.col(f"{t}n").cast("long"), F.col(f"{t}pos"), percent)
    links = pairs.distinct()
    if not hot.isEmpty():
        # hot entries: all against the class whose entry stands first in its prefix
        centre = hot.groupBy("gram").agg(F.min(F.struct("pos", "k", "n")).alias("c"))
        star = hot.join(centre.select("gram", F.col("c.pos").alias("c_pos"), F.col("c.k").alias("c_k"), F.col("c.n").alias("c_n")), "gram")
        star = star.filter((F.col("k") != F.col("c_k")) & filters("", "c_")).select(*ordered("k", "c_k")).distinct()
        near = scratch(verified(star), "star_links")
        root = components(near)
        # then pairs of different components only
        rooted = hot.join(root.withColumnRenamed("id", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
        mixed = rooted.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("gram")
        rooted = rooted.join(mixed, "gram", "left_semi")
        other = rooted.select("gram", *(F.col(c).alias(f"o_{c}") for c in ("k", "n", "pos", "root")))
        rest = rooted.join(other, "gram").filter((F.col("k") < F.col("o_k")) & (F.col("root") != F.col("o_root")) & filters("", "o_")).select(*ordered("k", "o_k"))
        links = verified(pairs.unionByName(rest).distinct()).unionByName(near)
    else:
        links = verified(links)
    roots = components(links)
    of_class = classed.filter("n > 0").groupBy("k").agg(F.min("doc_id").alias("lead")).join(roots.withColumnRenamed("id", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    lead = of_class.groupBy("root").agg(F.min("lead").alias("component_id"))
    found = of_class.join(lead, "root").select("k", "component_id")
    empty = F.col("n") == 0
    return classed.join(found, "k", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """All columns of the documents that have the smallest id of their
    component; rows with a null id stay."""
    later = jaccard_components(docs, n, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(later, docs["doc_id"].cast("long") == later["__id"], "left_anti")
