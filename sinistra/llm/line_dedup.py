"""Near-duplicate lines, by a segment-partition edit join in DataFrame functions.

Two lines are near copies when at most k code points are changed, added or taken
away between them. k is one for every ``PER_EDIT`` code points of the shorter
line, at least 1 and at most ``edits`` (``EDITS`` by default; ``MANY_EDITS`` in
the registered query and the pipeline).

Lines are put in classes of about the same length, so that k is one number in a
class. A line has k + 1 segments of one length, the first ones counted from its
beginning, the others from its end. k edits leave some segment i whole that has
exactly i edits before it and at most k - i after it, so it stands at most
min(i, k - i) places further left or right in the other line. A segment is known
by a substring of it, which begins at its first blank (at its beginning if there
is none near): where it begins depends on the segment's text alone, so the places
where a moved segment may stand mostly name the same substring. A line enters an
index by (class, segment, substring) with its own segments, and with what may be
a segment of a line that is not longer, in its own class and in the next lower
one when it is less than k longer than that. A pair that meets is verified by a
banded edit distance: Spark's own, or with ``bit_parallel`` the bit-parallel one
over what is left between the pair's common ends. Both keep the same lines. As
column expressions the latter costs 4 to 30 milliseconds a pair and went beyond
the check tool's time (see the README), so it is not the default.

Lines in an entry of more than ``CROWD`` lines are told apart in the join:
by parities of the numbers of neighbouring code points and by how often each
letter stands in them, none of which k edits change by much. Of the entries that
two of them both own, they meet in one.

Only the question whether an earlier line is a near copy of a line matters. The
lines of an entry are ordered by first occurrence and meet the first ``BLOCK`` of
them, then those not yet found meet the next block, ``GROWTH`` times as long, and
so on. So entries of many near copies end after the first blocks; an entry with
very many lines that are no near copies of each other costs the square of their
number.

An occurrence of a line is dropped when it is not the line's first (by doc_id,
then position), or when a line that first occurs earlier is a near copy of it.
Lines of fewer than ``MIN_CHARS`` code points go as exact repeats only: they are
not looked up for near copies. Empty lines stay, as they part paragraphs.

Lines are known by 64-bit hashes; pairs are verified on their text.

Edge cases: a null text stays null with 0 lines; an empty text is one empty
line, which stays; rows with a null id are left out by ``dedup_lines`` and pass
``dedup_documents`` as they are; rows that share an id are one document (a line
that goes from one goes from the same position of the others); an empty table
gives no rows; other columns are ignored by ``dedup_lines`` and kept by
``dedup_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

EDITS = 1
#: edits at most in the registered query and in the pipeline
MANY_EDITS = 5
#: code points of a line for each edit
PER_EDIT = 20
MIN_CHARS = 20
BLOCK = 1
PICK_BITS = 1 << 24
#: each block of an entry is so many times as long as the one before
GROWTH = 4
#: the lines of an entry with more than so many are told apart by parities and letters first
CROWD = 5
LETTERS = "abcdefghijklmnopqrstuvwxyz ,."
#: a segment from this many code points on is known by a substring that begins at a blank
ROOMY = 20
ROOM = 3


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line, h, m of all lines that are not empty."""
    one = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return one.withColumn("m", F.length("line")).filter(F.col("m") > 0).withColumn("h", F.xxhash64("line"))


def allowed(m: Column, edits: int) -> Column:
    """Edits between a line of m code points and one that is not shorter."""
    return F.greatest(F.lit(1), F.least(F.lit(edits), F.floor(m / PER_EDIT))).cast("int")


def _least(m: Column, edits: int) -> Column:
    """Length of the shortest lines in the class of a line: a multiple of
    PER_EDIT while k still grows, then m down to its three highest bits."""
    low = F.length(F.bin(m)) - 3
    wide = m - F.pmod(m, F.call_function("shiftleft", F.lit(1), F.greatest(low, F.lit(0))))
    fine = m - F.pmod(m, F.lit(PER_EDIT))
    return F.greatest(F.lit(MIN_CHARS), F.when(m < PER_EDIT * edits, fine).otherwise(F.greatest(F.lit(PER_EDIT * edits), wide))).cast("int")


def places(k: int) -> list[tuple[int, bool, int]]:
    """(segment, whether it stands at the end of the line, segments between it
    and that end). As many edits as there are segments between may have moved it."""
    return [(i, 2 * i > k, min(i, k - i)) for i in range(k + 1)]


def entries(lines: DataFrame, edits: int) -> DataFrame:
    """key, h, m, own: one row for each substring of a line (h, line, m) that
    stands for a segment of it (own) or may stand for one of a near copy's."""
    by_k = F.array(*(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(end).alias("end"), F.lit(d).alias("d")) for i, end, d in places(k))) for k in range(1, edits + 1)))
    low = lines.withColumn("low", _least(F.col("m"), edits))
    below = _least(F.col("low") - 1, edits)
    reach = (F.col("low") > MIN_CHARS) & (F.col("m") - F.col("low") < allowed(below, edits))
    w = low.withColumn("class", F.explode(F.when(reach, F.array(F.col("low"), below)).otherwise(F.array("low"))))
    w = w.withColumn("k", allowed(F.col("class"), edits)).withColumn("q", F.floor(F.col("class") / (F.col("k") + 1)).cast("int"))
    w = w.withColumn("at", F.explode(F.get(by_k, F.col("k") - 1)))
    # the segment with the code points by which it may have moved on both sides
    start = F.when(F.col("at.end"), F.col("m") - (F.col("at.d") + 1) * F.col("q") - F.col("at.d")).otherwise(F.col("at.i") * F.col("q") - F.col("at.d"))
    w = w.select("h", "m", "class", (F.col("class") == F.col("low")).alias("in"), F.col("at.i").alias("i"), F.col("at.d").alias("d"), "q", _room(F.col("q")).alias("room"), F.substring("line", start + 1, F.col("q") + 2 * F.col("at.d")).alias("part"))
    begins = F.array(_mark(F.lit(0)))
    for d in range(1, edits // 2 + 1):
        begins = F.when(F.col("d") == d, F.array_distinct(F.array(*(_mark(F.lit(s)) for s in range(2 * d + 1))))).otherwise(begins)
    w = w.withColumn("p", F.explode(begins))
    gram = F.substring("part", F.col("p") + 1, F.col("q") - F.col("room"))
    return w.select(F.xxhash64("class", "i", gram).alias("key"), "h", "m", (F.col("in") & (F.col("p") == _mark(F.col("d")))).alias("own"))


def _room(q: Column) -> Column:
    """Code points at the beginning of a segment of q among which its substring may begin."""
    return F.when(q >= ROOMY, F.floor(q / ROOM)).otherwise(F.lit(0)).cast("int")


def _mark(s: Column) -> Column:
    """Where the substring that stands for the segment from s on begins: at its
    first blank, if there is room for one, or at s. This depends on the segment's
    text only, so segments moved by a few code points mostly name one substring."""
    at = F.call_function("locate", F.lit(" "), F.col("part"), s + 1)
    return F.when((at > s) & (at <= s + 1 + F.col("room")), at - 1).otherwise(s)


def edit_distance_at_most(longer: Column, shorter: Column, edits: int = EDITS, limit: Column | None = None) -> Column:
    """Whether two arrays of code points, the first at most ``edits`` longer,
    are within so many edits (or ``limit``, which is no more). Bit b of a vector is the row c - edits + b of
    column c; rows before the first count downwards, so the band needs no
    special case. The distance is followed along the diagonal of the result."""
    width = 2 * edits + 1
    mask = (1 << width) - 1
    gap = F.size(longer) - F.size(shorter)

    def column(state: Column, at: Column) -> Column:
        char = F.get(shorter, at)
        eq = F.lit(0)
        for b in range(width):
            eq = eq + F.when(F.get(longer, at - edits + b) == char, F.lit(1 << b)).otherwise(F.lit(0))
        return F.struct(state["vp"].alias("vp"), state["vn"].alias("vn"), state["score"].alias("score"), eq.alias("eq"))

    def advance(s: Column) -> Column:
        vp = F.shiftright(s["vp"], 1).bitwiseOR(F.lit(1 << (width - 1)))
        vn = F.shiftright(s["vn"], 1)
        eq = s["eq"]
        zero = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(mask))
        up = F.shiftleft(vn.bitwiseOR(F.lit(mask).bitwiseXOR(zero.bitwiseOR(vp).bitwiseAND(F.lit(mask)))), 1).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(mask))
        down = F.shiftleft(zero.bitwiseAND(vp), 1).bitwiseAND(F.lit(mask))
        return F.struct(
            down.bitwiseOR(F.lit(mask).bitwiseXOR(zero.bitwiseOR(up))).alias("vp"),
            zero.bitwiseAND(up).alias("vn"),
            (s["score"] + 1 - F.shiftright(zero, edits).bitwiseAND(F.lit(1)) * F.when(gap == 0, 1).otherwise(0)
             - F.when(gap == 0, 0).otherwise(_bit_above(zero, gap, edits))).alias("score"))

    start = F.struct(F.lit(sum(1 << b for b in range(edits + 1, width))).alias("vp"), F.lit((1 << (edits + 1)) - 1).alias("vn"), gap.cast("int").alias("score"))
    steps = F.sequence(F.lit(0), F.size(shorter) - 1)
    run = F.aggregate(F.when(F.size(shorter) > 0, steps).otherwise(F.array().cast("array<int>")), start, lambda s, at: advance(column(s, at)), lambda s: s["score"])
    return (gap >= 0) & (gap <= edits) & (run <= (F.lit(edits) if limit is None else limit))


def _bit_above(zero: Column, gap: Column, edits: int) -> Column:
    """Bit ``edits + gap`` of a vector, for gaps from 1 on."""
    out = F.lit(0)
    for g in range(1, edits + 1):
        out = F.when(gap == g, F.shiftright(zero, edits + g).bitwiseAND(F.lit(1))).otherwise(out)
    return out


def _common(a: Column, b: Column, most: Column, part) -> Column:
    """Code points that two texts share from one end, at most ``most``: the
    unknown rest is halved until nothing is left. ``part``: a text's code points
    from one place to another, counted from that end."""

    def halve(w: Column, _) -> Column:
        mid = F.floor((w["lo"] + w["hi"] + 1) / 2).cast("int")
        same = part(a, w["lo"], mid) == part(b, w["lo"], mid)
        return F.struct(F.when(same, mid).otherwise(w["lo"]).alias("lo"), F.when(same, w["hi"]).otherwise(mid - 1).alias("hi"))

    steps = F.sequence(F.lit(0), F.length(F.bin(most)))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), most.cast("int").alias("hi")), halve, lambda w: w["lo"])


def within(a: str, b: str, limit: str, edits: int) -> Column:
    """Whether the texts in two columns are within ``limit`` (at most ``edits``)
    edits: what they share at their ends goes, the rest is followed by the
    banded bit-parallel distance. Each step is a lambda over one element, as
    Spark would work out a plain expression anew wherever it is used."""
    longer = F.length(a) >= F.length(b)
    texts = F.array(F.struct(F.when(longer, F.col(a)).otherwise(F.col(b)).alias("x"), F.when(longer, F.col(b)).otherwise(F.col(a)).alias("y")))

    def head(s: Column) -> Column:
        n = _common(s["x"], s["y"], F.length(s["y"]), lambda t, lo, hi: F.substring(t, lo + 1, hi - lo))
        return F.struct(s["x"].alias("x"), s["y"].alias("y"), n.alias("n"))

    def cut_head(s: Column) -> Column:
        return F.struct(F.substring(s["x"], s["n"] + 1, F.length(s["x"])).alias("x"), F.substring(s["y"], s["n"] + 1, F.length(s["y"])).alias("y"))

    def tail(s: Column) -> Column:
        n = _common(s["x"], s["y"], F.length(s["y"]), lambda t, lo, hi: F.substring(t, F.length(t) - hi + 1, hi - lo))
        return F.struct(s["x"].alias("x"), s["y"].alias("y"), n.alias("n"))

    def points(s: Column) -> Column:
        left = lambda t: F.substring(t, F.lit(1), F.length(t) - s["n"])
        signs = lambda t: F.when(F.length(t) > 0, F.split(t, "")).otherwise(F.array().cast("array<string>"))
        return F.struct(signs(left(s["x"])).alias("x"), signs(left(s["y"])).alias("y"))

    for step in (head, cut_head, tail, points):
        texts = F.transform(texts, step)
    return F.get(F.transform(texts, lambda s: edit_distance_at_most(s["x"], s["y"], edits, F.col(limit))), 0)


def pair_parities(line: Column) -> Column:
    """64 bits: for each class of neighbouring code points whether their number
    in a line is odd. One edit changes at most four such pairs."""
    signs = F.split(line, "")
    n = F.size(signs) - 1
    # shiftleft looks at the last six bits of its second argument
    bit = lambda x, y: F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(x, y))
    both = F.zip_with(F.slice(signs, F.lit(1), n), F.slice(signs, F.lit(2), n), bit)
    return F.aggregate(both, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseXOR(b))


def letter_counts(line: Column) -> Column:
    """How often each of ``LETTERS`` stands in a line. One edit takes away at
    most one letter and adds at most one."""
    return F.array(*((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("int") for c in LETTERS))


def _like(k: Column) -> Column:
    """Whether two lines (odd, bag and e_odd, e_bag) may be within k edits; true
    where one of them has no parities."""
    more = lambda a, b: sum(F.greatest(F.get(a, F.lit(i)) - F.get(b, F.lit(i)), F.lit(0)) for i in range(len(LETTERS)))
    bits = F.bit_count(F.col("odd").bitwiseXOR(F.col("e_odd"))) <= 4 * k
    return F.coalesce(bits & (more("bag", "e_bag") <= k) & (more("e_bag", "bag") <= k), F.lit(True))


def _bitmap(hashes: DataFrame) -> DataFrame:
    """One row: a fixed-size array of 64-bit words with a bit for each hash."""
    words = PICK_BITS // 64
    slot = F.pmod("h", F.lit(PICK_BITS))
    one = F.lit(1).cast("long")
    some = hashes.select(F.floor(slot / 64).cast("long").alias("id"), F.pmod(slot, F.lit(64)).cast("int").alias("bit")).groupBy("id").agg(F.bit_or(F.call_function("shiftleft", one, F.col("bit"))).alias("bits"))
    every = hashes.sparkSession.range(words).join(some, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda x: x.bits).alias("words"))


def _picked(docs: DataFrame, hashes: DataFrame, how: str) -> DataFrame:
    """h, line, m of the lines whose hash a bitmap holds (left_semi; some others
    too) or does not (left_anti). Its size does not depend on the data."""
    slot = F.pmod("h", F.lit(PICK_BITS))
    hit = F.bit_get(F.get("words", F.floor(slot / 64).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1
    long = lines_of(docs).filter(F.col("m") >= MIN_CHARS).select("h", "line", "m")
    return long.join(F.broadcast(_bitmap(hashes)), hit, how)


def _once(lines: DataFrame) -> DataFrame:
    return lines.groupBy("h").agg(F.first("line").alias("line"), F.first("m").alias("m"))


def first_lines(places: DataFrame) -> DataFrame:
    """h, first (doc_id, pos), n (occurrences) of every line, from doc_id, pos, h."""
    place = F.struct(F.col("doc_id"), F.col("pos"))
    return scratch(places.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")), "first_lines")


def _ranked(docs: DataFrame, first: DataFrame, edits: int) -> DataFrame:
    """key, h, m, own, rank (by first occurrence, from 0) of the lines that
    share an entry with another one. Only texts that occur again are moved to
    be taken once."""
    again = first.filter("n > 1").select("h")
    lines = _picked(docs, again, "left_anti").unionByName(_once(_picked(docs, again, "left_semi")))
    # both uses of the rows need all columns, so they are dealt out once
    rows = entries(lines, edits).select("key", "h", (F.col("m") * F.lit(2) + F.col("own").cast("int")).alias("mo")).repartition("key")
    shared = rows.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y"), F.max(F.col("mo") % 2).alias("any")).filter("x <> y AND any = 1").select("key")
    met = rows.join(shared, "key").groupBy("key", "h").agg(F.max("mo").alias("mo")).join(first.select("h", "first"), "h")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("first", "h")) - 1
    own = (F.col("mo") % 2 == 1).alias("own")
    return scratch(met.select("key", "h", F.floor(F.col("mo") / 2).cast("int").alias("m"), own, rank.alias("rank")), "met")


def late_copies(docs: DataFrame, first: DataFrame, edits: int, bit_parallel: bool = False) -> DataFrame:
    """h of the lines that are near copies of one that first occurs earlier."""
    near = within("line", "e_line", "k", edits) if bit_parallel else F.expr("levenshtein(line, e_line, k) >= 0")
    ranked = _ranked(docs, first, edits)
    met = ranked.select("h").distinct()
    text = scratch(_once(_picked(docs, met, "left_semi")).select("h", "line"), "lines")
    # the signs go along with the entries, so a pair that differs in too much ends in the join
    crowded = ranked.join(ranked.filter(F.col("rank") >= CROWD).select("key").distinct(), "key", "left_semi").select("h").distinct()
    signs = scratch(text.join(crowded, "h", "left_semi").select("h", pair_parities(F.col("line")).alias("odd"), letter_counts(F.col("line")).alias("bag")), "signs")
    own = ranked.filter("own").join(crowded, "h", "left_semi").groupBy("h").agg(F.collect_set("key").alias("keys"))
    ranked = scratch(ranked.join(signs.join(own, "h", "left"), "h", "left"), "signed")
    left, found, lo, step = ranked.filter("rank > 0"), [], 0, BLOCK
    while not left.isEmpty():
        early = ranked.filter((F.col("rank") >= lo) & (F.col("rank") < lo + step)).select("key", F.col("h").alias("e"), F.col("m").alias("em"), F.col("own").alias("eown"), F.col("rank").alias("erank"), F.col("odd").alias("e_odd"), F.col("bag").alias("e_bag"), F.col("keys").alias("e_keys"))
        k = allowed(F.least("m", "em"), edits)
        index = F.when(F.col("m") < F.col("em"), F.col("own")).when(F.col("m") > F.col("em"), F.col("eown")).otherwise(F.col("own") | F.col("eown"))
        # two lines that share several own entries meet in one of them
        once = F.coalesce(F.array_min(F.array_intersect("keys", "e_keys")) == F.col("key"), F.lit(True))
        pairs = left.join(early, "key").filter((F.col("erank") < F.col("rank")) & index & (F.abs(F.col("m") - F.col("em")) <= k) & _like(k) & once).select("h", "e", k.alias("k")).distinct()
        both = pairs.join(text.select("h", "line"), "h").join(text.select(F.col("h").alias("e"), F.col("line").alias("e_line")), "e")
        found.append(scratch(both.filter(near).select("h").distinct(), "late"))
        lo, step = lo + step, GROWTH * step
        left = scratch(left.filter(F.col("rank") > lo).join(found[-1], "h", "left_anti"), "left")
    out = first.select("h").limit(0)
    for f in found:
        out = out.unionByName(f)
    return out.distinct()


def dropped_lines(docs: DataFrame, edits: int = EDITS, bit_parallel: bool = False) -> DataFrame:
    """doc_id, dropped: positions of the lines that repeat an earlier one or
    are a near copy of one."""
    occurrences = scratch(lines_of(docs).select("doc_id", "pos", "h"), "occurrences")
    first = first_lines(occurrences)
    late = late_copies(docs, first, edits, bit_parallel).withColumn("late", F.lit(True))
    known = first.select("h", "first").join(late, "h", "left")
    gone = occurrences.join(known, "h").filter(F.col("late") | (F.col("first") != F.struct("doc_id", "pos")))
    return gone.groupBy("doc_id").agg(F.collect_list("pos").alias("dropped"))


def _kept(dropped: str) -> tuple[Column, Column]:
    """All lines, and the text without the dropped ones."""
    parts = F.split("text", "\n", -1)
    left = F.filter(parts, lambda _, i: ~F.array_contains(dropped, i))
    return parts, F.when(F.col(dropped).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, bit_parallel: bool = False) -> DataFrame:
    """doc_id, text without the dropped lines, n_lines, n_dropped."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    marked = docs.join(dropped_lines(docs.filter("text IS NOT NULL"), edits, bit_parallel), "doc_id", "left")
    parts, kept = _kept("dropped")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    return marked.select("doc_id", kept.alias("text"), n.alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup_documents(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """All columns of ``docs`` with the dropped lines taken out of ``text``
    (and ``n_chars``, if there, counted anew). A document of which nothing is
    left goes; one that was empty before stays."""
    used = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    gone = dropped_lines(used, edits).select(F.col("doc_id").alias("__id"), F.col("dropped").alias("__dropped"))
    marked = docs.join(gone, docs["doc_id"].cast("long") == gone["__id"], "left")
    _, kept = _kept("__dropped")
    marked = marked.withColumn("__kept", kept).filter(F.col("__dropped").isNull() | (F.col("__kept") != ""))
    fresh = {"text": F.col("__kept"), "n_chars": F.length("__kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return marked.select(*(F.when(F.col("__dropped").isNull(), F.col(c)).otherwise(fresh[c]).alias(c) if c in fresh else F.col(c) for c in docs.columns))
