"""Operator 13, a Merkle manifest of a table, with a proof for every row, by nested-interval labels.

A row is a leaf; the leaves of a source are numbered in order of their ids. A node carries the interval of leaf numbers that it covers:
a node of level L covers 16 ** L numbers, so its interval's begin names its bucket. Ancestors are attached level by level, from
the root down: a join on the bucket of the level above, kept where the parent's interval contains the node's. What the parent's
interval covers before and after the node's own are its siblings. The roots of the sources are the leaves of one more tree.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_PATH = "array<struct<left:string,right:string>>"


@dataclass(frozen=True)
class MerkleSettings:
    """fields: columns that a leaf covers, in this order; group: the column whose values get a tree each; order: the column that orders leaves; fanout: children of a node."""

    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "source"
    order: str = "doc_id"
    fanout: int = 16


def digest_of(*values: Column) -> Column:
    """sha256 of the values one after the other, each as its UTF-8 byte count, a colon and itself, or "-" if null."""
    told = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[told(v.cast("string")) for v in values]), 256)


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["digest"]), "")


def _siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """What the parent's interval covers before lo and from hi on."""
    return F.struct(_joined(F.filter(kids, lambda k: k["hi"] <= lo)).alias("left"), _joined(F.filter(kids, lambda k: k["lo"] >= hi)).alias("right"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, materialized, with lo (the row's number within its tree, from 0), hi = lo + 1 and n (rows of the tree).

    Rows are dealt by ranges of (tree, order) and sorted within tasks, so one tree may spread over many; a table of one row
    for each task and tree in it says where the numbers of a task begin.
    """
    keys = [F.asc("tree"), *[F.asc_nulls_first(c) for c in order]]
    placed = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    runs = placed.groupBy("tree", task.alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("held"))
    of_tree = Window.partitionBy("tree")
    before = F.sum("held").over(of_tree.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("tree").alias("of"), F.col("task").alias("of_task"), (F.col("first") - F.coalesce(before, F.lit(0))).alias("zero"), F.sum("held").over(of_tree).alias("n"))
    found = placed.join(runs, (F.col("tree") == F.col("of")) & (task == F.col("of_task")))
    lo = F.col("at") - F.col("zero")
    return materialize(found.select(*rows.columns, lo.alias("lo"), (lo + 1).alias("hi"), "n"))


def grow(leaves: DataFrame, carry: list[str], fanout: int) -> list[DataFrame]:
    """The inner nodes of all trees by level, from the lowest: tree, n, lo, hi, digest and kids (their intervals, digests and, of leaves, the columns in carry).

    A tree has nodes on a level while the level below holds several; there is one job for each level, on a 16th of the rows.
    """
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes, width = [], leaves, 1
    while width < largest:
        kid = F.struct("lo", "hi", "digest", *([] if levels else carry))
        runs = nodes.filter(F.col("n") > width).groupBy("tree", "n", F.floor(F.col("lo") / F.lit(width * fanout)).alias("bucket")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
        nodes = materialize(runs.select("tree", "n", F.element_at("kids", 1)["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), F.sha2(_joined(F.col("kids")), 256).alias("digest"), "kids"))
        levels.append(nodes)
        width *= fanout
    return levels


def tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """tree and digest of the node that covers all of its tree; a lone leaf is its own."""
    found = leaves.filter("n = 1").select("tree", "digest")
    for nodes in levels:
        found = found.union(nodes.filter("hi - lo = n").select("tree", "digest"))
    return found


def descend(leaves: DataFrame, levels: list[DataFrame], carry: list[str], above: DataFrame, fanout: int) -> DataFrame:
    """For every leaf: tree, digest, the columns in carry, path (what lies left and right of it and of each ancestor in their parents, upwards) and the columns of above.

    above: one row for each tree, with its path beyond the tree and other columns, which all leaves of the tree get.
    """
    given = [c for c in above.columns if c not in ("tree", "path")]
    parents, width = None, fanout ** len(levels)
    for nodes in reversed(levels):
        own = ["tree", "lo", "hi", "kids"]
        rows = nodes.filter("hi - lo = n").join(above, "tree").select(*own, "path", *given)
        if parents is not None:
            up = parents.select(F.col("tree").alias("up_tree"), F.floor(F.col("lo") / F.lit(width * fanout)).alias("up_bucket"), F.col("lo").alias("up_lo"), F.col("hi").alias("up_hi"), F.col("kids").alias("up_kids"), "path", *given)
            inside = (F.col("tree") == F.col("up_tree")) & (F.floor(F.col("lo") / F.lit(width * fanout)) == F.col("up_bucket")) & (F.col("up_lo") <= F.col("lo")) & (F.col("hi") <= F.col("up_hi"))
            path = F.concat(F.array(_siblings(F.col("up_kids"), F.col("lo"), F.col("hi"))), F.col("path"))
            rows = rows.unionByName(nodes.filter("hi - lo < n").join(up, inside).select(*own, path.alias("path"), *given))
        parents, width = rows, width // fanout
    alone = leaves.filter("n = 1").join(above, "tree").select("tree", "digest", *carry, "path", *given)
    if parents is None:
        return alone
    each = parents.select("tree", "kids", "path", *given, F.explode("kids").alias("kid"))
    path = F.concat(F.array(_siblings(F.col("kids"), F.col("kid.lo"), F.col("kid.hi"))), F.col("path"))
    return alone.unionByName(each.select("tree", "kid.digest", *[f"kid.{c}" for c in carry], path.alias("path"), *given))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf gives with the siblings on its path."""
    return F.aggregate(path, leaf, lambda digest, p: F.sha2(F.concat(p["left"], digest, p["right"]), 256))


def proof_of(path: Column) -> Column:
    """All siblings on a path, one after the other."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def merkle_manifest(docs: DataFrame, settings: MerkleSettings = MerkleSettings(), altered: Column | None = None) -> DataFrame:
    """One row per row of docs: the order column, group, leaf, subroot, root, path, proof_sha256, folded_root and verified.

    altered: digest of a leaf to be verified in place of the row's own (null: the row's own); folded_root is what it gives with the
    original siblings, verified whether that is the root. A null group is a tree of its own, before all others; nulls in the
    order column come first; rows that are equal in it are ordered by leaf, so rows that repeat are leaves side by side. A null field is told
    from an empty one. Long texts are hashed whole. Other columns play no part; an empty table gives no rows.

    Texts are hashed where they are read; what is shuffled has two digests a row. No task holds a whole source.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(settings.group).cast("string")), F.lit(""))
    leaf = digest_of(*[F.col(f) for f in settings.fields])
    slim = docs.select(tree.alias("tree"), F.col(settings.order).alias("at_id"), F.col(settings.group).alias("group"), leaf.alias("digest"), (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
    carry = ["at_id", "group", "altered"]
    leaves = numbered(materialize(slim), ["at_id", "digest"])
    levels = grow(leaves, carry, settings.fanout)
    # the trees' roots are the leaves of a tree of all
    roots = numbered(materialize(tops(leaves, levels).select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest")), ["member"])
    upper = grow(roots, ["member"], settings.fanout)
    top = tops(roots, upper).select("tree", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    above = descend(roots, upper, ["member"], top, settings.fanout).select(F.col("member").alias("tree"), "path", "root", F.col("digest").alias("subroot"))
    rows = descend(leaves, levels, carry, materialize(above), settings.fanout)
    rows = rows.withColumn("folded_root", folded(F.col("path"), F.coalesce("altered", "digest")))
    return rows.select(
        F.col("at_id").alias(settings.order), F.col("group").alias(settings.group), F.col("digest").alias("leaf"), "subroot", "root", "path",
        F.sha2(proof_of(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def lowered(docs: DataFrame, settings: MerkleSettings = MerkleSettings(), text: str = "text", one_in: int = 5) -> Column:
    """The digest of a row with its text's A-Z lower-cased, where one_in divides crc32 of the id as text; null elsewhere and for null ids."""
    fields = [F.translate(F.col(f), ascii_uppercase, ascii_lowercase) if f == text else F.col(f) for f in settings.fields]
    return F.when(F.crc32(F.col(settings.order).cast("string")) % one_in == 0, digest_of(*fields))


#: The same rows by recursion over levels, and over the levels above each leaf.
SQL = """
WITH RECURSIVE d AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS crc,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS altered FROM d),
r AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (SELECT source, 0 AS level, k, n, leaf AS digest FROM r
    UNION ALL SELECT source, level + 1, k // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY k)) FROM t WHERE n > 1 GROUP BY source, level, k // 16, n),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, k, n, subroot AS digest FROM s
    UNION ALL SELECT level + 1, k // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY k)) FROM u WHERE n > 1 GROUP BY level, k // 16, n),
p AS (SELECT id, source, 0 AS level, k, n, '' AS proof, coalesce(altered, leaf) AS folded FROM r
    UNION ALL SELECT p.id, p.source, p.level + 1, p.k // 16, (p.n + 15) // 16, p.proof || coalesce(string_agg(t.digest, '' ORDER BY t.k) FILTER (WHERE t.k <> p.k), ''),
    sha256(string_agg(CASE WHEN t.k = p.k THEN p.folded ELSE t.digest END, '' ORDER BY t.k))
    FROM p JOIN t ON t.source IS NOT DISTINCT FROM p.source AND t.level = p.level AND t.k // 16 = p.k // 16 WHERE p.n > 1 GROUP BY p.id, p.source, p.level, p.k, p.n, p.proof, p.folded),
q AS (SELECT p.id, 0 AS level, s.k, s.n, p.proof, p.folded FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source WHERE p.n = 1
    UNION ALL SELECT q.id, q.level + 1, q.k // 16, (q.n + 15) // 16, q.proof || coalesce(string_agg(u.digest, '' ORDER BY u.k) FILTER (WHERE u.k <> q.k), ''),
    sha256(string_agg(CASE WHEN u.k = q.k THEN q.folded ELSE u.digest END, '' ORDER BY u.k))
    FROM q JOIN u ON u.level = q.level AND u.k // 16 = q.k // 16 WHERE q.n > 1 GROUP BY q.id, q.level, q.k, q.n, q.proof, q.folded)
SELECT r.doc_id, r.leaf, s.subroot, v.digest AS root, sha256(q.proof) AS proof_sha256, q.folded AS folded_root, q.folded = v.digest AS verified
FROM r JOIN q ON r.id = q.id AND q.n = 1 JOIN s ON r.source IS NOT DISTINCT FROM s.source JOIN u v ON v.n = 1
"""
