"""Merkle manifest of a dataset by butterfly exchange.

Every row is a leaf; the leaves of a group (a source), by id, are the bottom of
a tree of fanout 16, and the groups' roots the bottom of one more. Positions cut
a tree into aligned partitions of 16 ** 3 leaves. A partition hashes its own
three levels. Then the partitions swap subtree roots round by round: in round r
those that agree in all base-16 digits of their number but digit r meet, and
every member gets the (at most 15) sibling roots and hashes their parent
itself. After log16(partitions) rounds each partition holds the root and its
own upper proof; no pass goes back down. A last subtree with too few partitions
answers through repeats of those it has. Any other work is one range sort of
digests; texts move nowhere.

A path is an array of (l, r): the siblings left and right of a node, joined,
from the leaf to the root. All digests are lowercase hex sha256.

Edge cases: a null field of any column is ``-``, an empty one ``0:``; a null
source is a group of its own, first of all; a null id stands before all others;
rows with one id stand in the order of their leaves, equal rows are equal
leaves side by side; very long texts are hashed where they lie; a single row
is its own root, with an empty proof; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_sql, doc_crc, scratch
from .numbering import numbered

FANOUT = 16
#: levels of the tree that lie inside one partition
DEPTH = 3
BLOCK = FANOUT**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _no_path() -> Column:
    return F.array().cast("array<struct<l:string,r:string>>")


def _hash(parts: Column) -> Column:
    return F.sha2(parts.cast("binary"), 256)


def shown(digest: str) -> Column:
    """The hex text of a binary digest; digests of rows are stored in binary."""
    return F.lower(F.hex(digest))


def field(c: Column) -> Column:
    """UTF-8 byte count, a colon and the value; ``-`` for null."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(text: Column | None = None) -> Column:
    """Digest of a row of documents, with another text if given."""
    whole = [F.col(f).cast("long") if f in ("doc_id", "n_chars") else F.col(f) for f in FIELDS[:-1]]
    return _hash(F.concat(*map(field, whole), field(F.col("text") if text is None else text)))


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, node, lambda acc, p: _hash(F.concat(p.l, acc, p.r)))


def proof(path: Column) -> Column:
    """All siblings, level by level from the leaf, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p.l, p.r)), "")


def _step(df: DataFrame, group: list[str], place: Column, mine: Column, digit: Column, more: Column) -> DataFrame:
    """One level up: ``node`` becomes the hash of its run, ``path`` grows by
    its siblings. ``group``: the columns of a run; ``place`` orders it; ``mine``:
    rows that stand for a node of it; ``more``: several nodes remain."""
    run = F.sort_array(F.collect_list(F.when(mine, F.struct(place.alias("at"), F.col("node").alias("node")))).over(Window.partitionBy(*group)))
    df = df.withColumn("_run", F.transform(run, lambda x: x.node))
    left, right = F.slice("_run", F.lit(1), digit), F.slice("_run", digit + 2, F.lit(FANOUT))
    step = F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r"))
    df = df.withColumn("path", F.when(more, F.concat("path", F.array(step))).otherwise(F.col("path")))
    return df.withColumn("node", F.when(more, _hash(F.array_join("_run", ""))).otherwise(F.col("node"))).drop("_run")


def _digit(c: str, level: int) -> Column:
    return (F.floor(F.col(c) / FANOUT**level) % FANOUT).cast("int")


def in_partitions(nodes: DataFrame) -> DataFrame:
    """tree, pos, n, leaf and more: adds ``path`` and ``node``, where every row
    climbs the levels of its own partition ``block``. One shuffle and one sort
    serve all levels."""
    df = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    runs = [f"_run{k}" for k in range(DEPTH - 1, 0, -1)]
    for k, c in zip(range(DEPTH - 1, 0, -1), runs):
        df = df.withColumn(c, F.floor(F.col("pos") / FANOUT**k))
    df = df.repartition("tree", "block").sortWithinPartitions("tree", "block", *runs)
    df = df.withColumn("node", shown("leaf")).withColumn("path", _no_path())
    for k in range(DEPTH):
        df = _step(df, ["tree", "block", *runs[:DEPTH - 1 - k]], F.col("pos"), F.col("pos") % FANOUT**k == 0, _digit("pos", k), F.col("n") > FANOUT**k)
    return df.drop(*runs)


def butterfly(blocks: DataFrame) -> DataFrame:
    """tree, block, node, n (leaves of the tree): adds ``path`` above the
    partition, and ``node`` becomes the tree's root."""
    blocks = scratch(blocks.withColumn("parts", F.ceil(F.col("n") / BLOCK)), "blocks").withColumn("path", _no_path())
    most = blocks.agg(F.max("parts")).first()[0] or 0
    level, size = 0, 1
    while size < most:
        subtree = F.floor(F.col("block") / size)
        last = F.floor((F.col("parts") - 1) / size)
        short = F.col("parts") - last * size
        # members of a short last subtree also answer for the numbers it lacks
        answers = (subtree == last) & (short < size) & (last % FANOUT != 0)
        low = F.col("block") % size
        lows = F.when(answers, F.sequence(low, F.lit(size - 1).cast("long"), short)).otherwise(F.array(low))
        met = blocks.withColumn("_low", F.explode(lows)).withColumn("_group", F.floor(F.col("block") / (size * FANOUT)))
        met = _step(met, ["tree", "_group", "_low"], F.col("block"), F.lit(True), _digit("block", level), F.col("parts") > size)
        blocks = met.filter(F.col("_low") == low).drop("_low", "_group")
        level, size = level + 1, size * FANOUT
    return scratch(blocks, "butterfly")


def paths(nodes: DataFrame, above=None) -> DataFrame:
    """tree, pos, n, leaf and more: adds ``path`` to the root, ``root`` and
    ``subroot``. ``above``: gives for the trees' roots (tree, leaf) the path
    and root of a tree over them; none: each tree's root is the root."""
    nodes = scratch(nodes, "nodes")
    blocks = in_partitions(nodes).filter(F.col("pos") % BLOCK == 0).select("tree", "block", "node", "n")
    upper = butterfly(blocks).select("tree", "block", F.col("node").alias("subroot"), F.col("path").alias("_up"))
    if above is None:
        upper = upper.withColumn("root", F.col("subroot"))
    else:
        top = above(upper.filter("block = 0").select("tree", F.unhex("subroot").alias("leaf")))
        upper = upper.join(top, "tree").withColumn("_up", F.concat("_up", "_top")).drop("_top")
    joined = in_partitions(nodes).drop("node").join(upper, ["tree", "block"])
    return joined.withColumn("path", F.concat("path", "_up")).drop("_up", "block")


def _over_sources(subroots: DataFrame) -> DataFrame:
    """tree, root and _top (path) of the tree over all trees' roots."""
    one = numbered(subroots.withColumnRenamed("tree", "name").withColumn("tree", F.lit("")), "tree", ["name"])
    got = paths(one)
    return got.select(F.col("name").alias("tree"), "root", F.col("path").alias("_top"))


def manifest(docs: DataFrame, changed: Column | None = None, changed_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path of every row, and ``other``: the leaf
    of the row with ``changed_text`` where ``changed`` holds, else null."""
    other = F.lit(None).cast("binary") if changed is None else F.when(changed, F.unhex(leaf(changed_text)))
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))  # null first
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), F.unhex(leaf()).alias("leaf"), other.alias("other"))
    got = paths(numbered(rows, "tree", ["doc_id", "leaf"]), _over_sources)
    return got.select("doc_id", shown("leaf").alias("leaf"), "subroot", "root", "path", shown("other").alias("other"))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest with the check of a tampered copy: where 5 divides the id's
    crc32 the text's A-Z are lower-cased there."""
    df = manifest(docs, doc_crc() % 5 == 0, lower_ascii(F.col("text")))
    df = df.withColumn("proof_sha256", _hash(proof(F.col("path")))).withColumn("folded_root", fold(F.coalesce("other", "leaf"), F.col("path")))
    return df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_levels(src: str, name: str, levels: int) -> str:
    """CTEs of a forest whose leaves are ``src`` (tree, pos, node, n): runs of
    each level, and ``<name>_root`` (tree, node)."""
    parts = [f"{name}0 AS (SELECT tree, pos, node, n FROM {src})"]
    for k in range(levels):
        parts.append(f"{name}_run{k} AS (SELECT tree, pos // {FANOUT} AS run, list(node ORDER BY pos) AS nodes, any_value(n) AS n FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        parts.append(f"{name}{k + 1} AS (SELECT tree, run AS pos, sha256(array_to_string(nodes, '')) AS node, (n + {FANOUT - 1}) // {FANOUT} AS n FROM {name}_run{k})")
    tops = " UNION ALL ".join(f"SELECT tree, node FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return ",\n".join([*parts, f"{name}_root AS ({tops})"])


def _sql_climb(src: str, out: str, name: str, levels: int) -> str:
    """CTEs that add a row's siblings to ``proof`` and fold ``folded``, by its
    ``tree`` and ``pos``, through all levels of the forest."""
    parts, last = [], src
    for k in range(levels):
        here = f"{out}{k}" if k < levels - 1 else out
        at = f"CAST((r.pos // {FANOUT**k}) % {FANOUT} AS INTEGER)"
        left, right = f"array_to_string(u.nodes[1:{at}], '')", f"array_to_string(u.nodes[{at} + 2:], '')"
        parts.append(f"""{here} AS (SELECT r.* EXCLUDE (proof, folded), CASE WHEN u.nodes IS NULL THEN r.proof ELSE r.proof || {left} || {right} END AS proof,
  CASE WHEN u.nodes IS NULL THEN r.folded ELSE sha256({left} || r.folded || {right}) END AS folded
  FROM {last} r LEFT JOIN {name}_run{k} u ON u.tree = r.tree AND u.run = r.pos // {FANOUT**(k + 1)})""")
        last = here
    return ",\n".join(parts)


#: levels that the SQL form writes out: up to 16 ** 6 rows a source, and sources
SQL_LEVELS = 6
_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
_LEAF = lambda text: "sha256(" + " || ".join(map(_FIELD, (*FIELDS[:-1], text))) + ")"
SQL = f"""WITH d AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {_LEAF('text')} AS leaf,
  CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents),
x AS (SELECT *, leaf AS node, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_sql_levels("x", "a", SQL_LEVELS)},
s AS (SELECT '' AS tree, tree AS name, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM a_root),
{_sql_levels("s", "b", SQL_LEVELS)},
y AS (SELECT *, '' AS proof, coalesce(other, leaf) AS folded FROM x),
{_sql_climb("y", "z", "a", SQL_LEVELS)},
t AS (SELECT z.doc_id, z.leaf, s.node AS subroot, s.tree, s.pos, z.proof, z.folded FROM z JOIN s ON s.name = z.tree),
{_sql_climb("t", "w", "b", SQL_LEVELS)}
SELECT doc_id, leaf, subroot, b_root.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b_root.node AS verified
FROM w JOIN b_root USING (tree)"""
