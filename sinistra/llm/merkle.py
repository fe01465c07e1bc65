"""Merkle fingerprints of documents, in DataFrame functions only.

Paragraphs are the lines of a text, cut after the signs that end a clause
(``CLAUSE``), so every cut depends on the text beside it alone and an insertion
changes one paragraph, however long the line. Each has its MD5. A section ends after a paragraph whose hash begins
with 0 or 1 (one in eight), so an edit moves no section boundary beyond the
next such paragraph; a section's hash is that of its paragraphs' hashes, the
root's that of the sections' hashes. Equal texts have equal roots; two trees
are compared from the root down, and only sections that differ need be opened:
``changed`` lists those of a text that another one lacks.

A fingerprint is ``root/section:paragraphs;section:paragraphs...`` with the
root in full, 16 hex digits a section and 8 a paragraph. The likeness of two is
the Dice coefficient of their sets of paragraph hashes.

Edge cases: a null text is empty; an empty text is one tree without sections,
and its likeness to another empty one is 1, to others 0; rows with a null id
have no place in the order and are left out of ``with_edited``; of rows that
share an id the order is that of their texts; one row alone is its own next;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, scratch

#: a paragraph: up to the signs that end a clause, the blank and line break after them, or a line
ENDS = ".!?;:,。！？；：，、"
CLAUSE = rf"[^\n{ENDS}]*(?:[{ENDS}]+ ?\n?|\n)|[^\n{ENDS}]+"
#: documents of a range of ids that one task compares with their neighbours
RANGE_ROWS = 4096


def paragraphs(text: Column) -> Column:
    """MD5 of each paragraph, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(0)), lambda p: F.md5(p.cast("binary")))


def section_ends(leaves: Column) -> Column:
    """1-based position of the last paragraph of each section."""
    n = F.size(leaves)
    every = F.transform(leaves, lambda p, i: F.when((p < "2") | (i == n - 1), i + 1))
    return F.filter(every, lambda i: i.isNotNull())


def sections(leaves: Column, ends: Column) -> Column:
    """The paragraph hashes of each section."""
    start = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0))
    return F.transform(ends, lambda e, k: F.slice(leaves, start(k) + 1, e - start(k)))


def _md5(parts: Column) -> Column:
    return F.md5(F.array_join(parts, "").cast("binary"))


def fingerprint(leaves: Column, parts: Column, hashes: Column) -> Column:
    shown = F.zip_with(hashes, parts, lambda h, s: F.concat(F.substring(h, 1, 16), F.lit(":"), F.array_join(F.transform(s, lambda p: F.substring(p, 1, 8)), "")))
    return F.concat(_md5(hashes), F.lit("/"), F.array_join(shown, ";"))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out`` and ``<out>_leaves``. One projection a level, so that no
    level is computed twice."""
    leaves, ends, parts, hashes = (f"{out}_{x}" for x in ("leaves", "ends", "parts", "hashes"))
    df = df.withColumn(leaves, paragraphs(F.col(text)))
    df = df.withColumn(ends, section_ends(F.col(leaves)))
    df = df.withColumn(parts, sections(F.col(leaves), F.col(ends)))
    df = df.withColumn(hashes, F.transform(parts, _md5))
    return df.withColumn(out, fingerprint(F.col(leaves), F.col(parts), F.col(hashes))).drop(ends, parts, hashes)


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of paragraph hashes."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def differing_sections(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``changed``: the sections of fingerprint ``a`` that ``b`` lacks
    (1-based position and hash); none when the roots are equal."""
    parts = lambda c: F.transform(F.split(F.element_at(F.split(c, "/"), 2), ";"), lambda s: F.element_at(F.split(s, ":"), 1))
    here = F.transform(parts(a), lambda h, i: F.struct((i + 1).alias("section"), h.alias("hash")))
    none = F.array().cast("array<struct<section:int,hash:string>>")
    same = F.element_at(F.split(a, "/"), 1) == F.element_at(F.split(b, "/"), 1)
    return df.withColumn("changed", F.when(same, none).otherwise(F.filter(here, lambda s: (s.hash != "") & ~F.array_contains(parts(b), s.hash))))


def next_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by ascending id;
    after the last comes the first. Ids are dealt to ranges; each range also
    gets the first document of the range after it, and a window in the range
    looks one row ahead."""
    docs = id_text(docs).filter("doc_id IS NOT NULL")
    ids = docs.select("doc_id").distinct()
    ranges = max(1, -(-ids.count() // RANGE_ROWS))
    dealt = scratch(ids.repartitionByRange(ranges, "doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    edges = dealt.groupBy("part").agg(F.min("doc_id").alias("doc_id"))
    before = F.lag("part").over(Window.orderBy("part"))  # one row a range
    last = edges.agg(F.max("part").alias("last"))
    ahead = edges.withColumn("before", before).crossJoin(F.broadcast(last)).select("doc_id", F.coalesce("before", "last").alias("part"), F.lit(True).alias("ahead"))
    place = dealt.withColumn("ahead", F.lit(False)).unionByName(ahead)
    order = Window.partitionBy("part").orderBy("ahead", F.when(F.col("ahead"), 0).otherwise(F.col("doc_id")), "text")
    return docs.join(place, "doc_id").withColumn("next_text", F.lead("text").over(order)).filter(~F.col("ahead")).select("doc_id", "text", "next_text")


def with_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its text with the last
    floor(n / 2) code points replaced by the first as many (or all) of the next
    document, and beside the next document's: doc_id, n_chars, edited,
    fingerprint, edited_fingerprint, near_edited, near_next, and ``changed``:
    the document's sections that the edited text lacks."""
    df = next_texts(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    df = with_fingerprint(df, "text", "fingerprint")
    df = with_fingerprint(df, "edited", "edited_fingerprint")
    df = df.withColumn("next_leaves", paragraphs(F.col("next_text")))
    near = lambda c: likeness(F.col("fingerprint_leaves"), F.col(c))
    df = differing_sections(df, "fingerprint", "edited_fingerprint")
    return df.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", near("edited_fingerprint_leaves").alias("near_edited"), near("next_leaves").alias("near_next"), "changed")


def _tree_sql(text: str, name: str, src: str) -> str:
    """CTEs of one fingerprint for the SQL form."""
    return f"""
{name}1 AS (SELECT *, list_transform(regexp_extract_all({text}, '{CLAUSE}'), lambda p: md5(p)) AS {name}_l FROM {src}),
{name}2 AS (SELECT *, list_filter(range(1, len({name}_l) + 1), lambda i: {name}_l[i] < '2' OR i = len({name}_l)) AS {name}_e FROM {name}1),
{name}3 AS (SELECT *, list_transform(range(1, len({name}_e) + 1), lambda k: {name}_l[(CASE WHEN k = 1 THEN 0 ELSE {name}_e[k - 1] END) + 1 : {name}_e[k]]) AS {name}_p FROM {name}2),
{name} AS (SELECT *, md5(coalesce(array_to_string(list_transform({name}_p, lambda s: md5(array_to_string(s, ''))), ''), '')) || '/' ||
  coalesce(array_to_string(list_transform({name}_p, lambda s: substring(md5(array_to_string(s, '')), 1, 16) || ':' || array_to_string(list_transform(s, lambda p: substring(p, 1, 8)), '')), ';'), '') AS {name}_f FROM {name}3)"""


def _sections_sql(name: str) -> str:
    return f"list_transform({name}_p, lambda s: substring(md5(array_to_string(s, '')), 1, 16))"


def _root_sql(name: str) -> str:
    return f"split_part({name}_f, '/', 1)"


def _dice_sql(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct({a})) + len(list_distinct({b})) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len(list_distinct({a})) + len(list_distinct({b}))) END::DOUBLE"


SQL = (
    "WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),\n"
    "n AS (SELECT *, CAST(length(text) AS BIGINT) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next_text FROM d),\n"
    "x AS (SELECT *, substring(text, 1, n_chars - n_chars // 2) || substring(next_text, 1, n_chars // 2) AS edited FROM n),"
    + _tree_sql("text", "a", "x") + "," + _tree_sql("edited", "b", "a") + "," + _tree_sql("next_text", "c", "b")
    + f"\nSELECT doc_id, n_chars, sha256(edited) AS edited_sha256, a_f AS fingerprint, b_f AS edited_fingerprint, {_dice_sql('a_l', 'b_l')} AS near_edited, {_dice_sql('a_l', 'c_l')} AS near_next,"
    + f" CASE WHEN {_root_sql('a')} = {_root_sql('b')} THEN '' ELSE coalesce(array_to_string(list_filter(range(1, len(a_p) + 1), lambda i: NOT list_contains({_sections_sql('b')}, {_sections_sql('a')}[i])), ','), '') END AS changed FROM c"
)
