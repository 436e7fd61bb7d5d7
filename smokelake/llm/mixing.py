"""Operator 2, mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame functions alone. A source's target is the smaller of its cap and weight times the water level; the level is
found on the table of sources, in the order in which sources reach their cap. Every document is taken floor(target / size)
times; for the rest of the target, documents in seeded order are taken once more, until it is filled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, unused


@dataclass(frozen=True)
class MixSettings:
    """weights: of the sources by code point (null last), repeating; max_epochs: a target's cap in sizes of its source; seed: of the order."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    max_epochs: float = 3.0
    seed: int = 11


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """sources: one row each with source and source_size. Adds weight and target; targets share the sum of all sizes.

    Clamping what exceeds its cap and resharing the rest by weight, until nothing exceeds, ends at one level L with target
    = min(cap, weight * L). In order of cap / weight the sources before a point are clamped, so L follows from running sums.
    The windows run over the table of sources, not over documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    rows = sources.withColumn("weight", F.get(weights, F.pmod(place, F.lit(len(settings.weights))).cast("int")))
    rows = rows.withColumn("cap", F.lit(settings.max_epochs) * F.col("source_size"))
    all_rows = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "total": F.sum("source_size").over(all_rows).cast("double"),
        "w_left": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "cap_used": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
    })
    level = (F.col("total") - F.col("cap_used")) / F.col("w_left")
    # while a source is below its share, clamping it raises the level of the rest; from the first that isn't, levels fall
    rows = rows.withColumn("level", F.max(level).over(all_rows))
    return rows.select("source", "source_size", "weight", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, settings: MixSettings = MixSettings(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target (its source's), copies (times taken) and taken (words taken).

    A null text has size 0; a null source is a source of its own, after all others. Documents of size 0 fill nothing; they
    get the whole repetitions and never a fractional one. Ties
    in the seeded order (rows that repeat an id) go by id and size; repeated rows stay rows of their own. An empty table
    gives no rows. The order is md5(seed, id), so reruns agree. Each source's taken words differ from its target by at
    most half of its largest document. Other columns are not returned.

    A source may hold most rows: the rest is spread over 65,536 slots by a prefix of the hash. Sums by slot come first, in
    two steps, and only documents of the one slot where the rest ends are ordered one by one.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(settings.seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    # a source that is never null and keeps the order: "s" and the name, or "t"
    named = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("t"))
    slim = materialize(docs.select(F.col(doc_id).alias("doc_id"), named.alias("source"), n_words(text).alias("size"), key.alias("key")))
    slots2 = slim.groupBy("source", F.substring("key", 1, 2).alias("s1"), F.substring("key", 1, 4).alias("s2")).agg(F.sum("size").alias("words"))
    slots2 = materialize(slots2)
    slots1 = slots2.groupBy("source", "s1").agg(F.sum("words").alias("words"))
    targets = water_fill(slots1.groupBy("source").agg(F.sum("words").alias("source_size")), settings)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = materialize(targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))

    def states(slots: DataFrame, by: list[str], order: str) -> DataFrame:
        """state: 1 where the rest ends behind the slot, 0 where before it, 2 where in it; begin: words of the source before the slot."""
        before = F.sum("words").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        rows = slots.withColumn("begin", F.col("base") + F.coalesce(before, F.lit(0)))
        return rows.withColumn("state", F.when(F.col("begin") + F.col("words") <= F.col("rest"), 1).when(F.col("begin") >= F.col("rest"), 0).otherwise(2))

    one = states(slots1.join(targets.select("source", "rest"), "source").withColumn("base", F.lit(0).cast("long")), ["source"], "s1")
    two = slots2.join(one.select("source", "s1", "rest", F.col("begin").alias("base"), F.col("state").alias("outer")), ["source", "s1"])
    inner = states(two.filter("outer = 2"), ["source", "s1"], "s2").select("source", "s2", "begin", "state", "rest")
    outer = two.filter("outer <> 2").select("source", "s2", F.col("base").alias("begin"), F.col("outer").alias("state"), "rest")
    placed = slim.withColumn("s2", F.substring("key", 1, 4)).join(inner.unionByName(outer), ["source", "s2"])
    before = F.sum("size").over(Window.partitionBy("source", "s2").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    so_far = F.col("begin") + F.coalesce(before, F.lit(0))
    last = placed.filter("state = 2").withColumn("extra", F.when(2 * so_far + F.col("size") <= 2 * F.col("rest"), 1).otherwise(0))
    rows = last.unionByName(placed.filter("state <> 2").withColumn("extra", F.col("state")))
    rows = rows.select("source", "doc_id", "size", F.when(F.col("size") > 0, F.col("extra")).otherwise(0).alias("extra"))
    rows = rows.join(targets.select("source", "source_size", "target", "whole"), "source")
    copies = (F.col("whole") + F.col("extra")).cast("int")
    plain = F.when(F.col("source") != "t", F.expr("substring(source, 2)"))
    return rows.select("doc_id", "size", plain.alias("source"), "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, settings: MixSettings = MixSettings(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus: each document as many times as mix() takes it, with the columns of docs, whatever their names.

    Ids are taken to be unique; rows of one id (or without one) share the largest of their numbers of copies. Nulls, ties
    and empty texts as in mix(); an empty table gives no rows.
    """
    at, copies, copy = (unused(docs, c) for c in ("_mix_id", "_mix_copies", "_mix_copy"))
    taken = mix(docs, settings, doc_id, text, source).groupBy(F.col("doc_id").alias(at)).agg(F.max("copies").alias(copies))
    rows = docs.join(taken.hint("shuffle_hash"), F.col(doc_id).eqNullSafe(F.col(at))).filter(F.col(copies) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


#: The same rows by one running sum over each source, for comparison.
SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('11|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM d GROUP BY source),
a AS (SELECT *, 3e0 * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS w_left,
    coalesce(sum(3e0 * source_size) OVER b, 0) AS cap_used FROM s WINDOW b AS (ORDER BY 3e0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (total - cap_used) / w_left AS level FROM a WHERE weight * ((total - cap_used) / w_left) <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM a, l),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
    FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * so_far + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
