"""Operator 6, line dedup by an exact set-similarity join.

A line is the set of its distinct words in lower case. Words are ordered by length, which stands for rarity, the longest
first, then by hash. A set's tokens are the pairs of words that follow each other in that order; two sets that reach the threshold share
a token of their prefixes (see lines_of). Equal sets are one class, kept at its first place. Sets that share a token pass length filters and a bound
by bit signatures; what is left is verified on the sets themselves. A line goes if a line before it, by document (its id,
then the hash of its text) and place, reaches the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, forget, settled, unused

#: Numbers of blocks that a band of sizes may have.
_BAND = 1 << 20
#: Between words.
_SPACE = r"[\x20\x09-\x0D]+"
#: The bit signature of a set, 64 bits in each column.
_MASKS = ["m0", "m1"]


@dataclass(frozen=True)
class LineSettings:
    """tenths: the Jaccard threshold in tenths, 7 to 10; few: candidates that a line of a token tries at first.

    cold: a token of at most so many lines has one group of lines; block: lines of a block of the other tokens' groups;
    broadcast: most rows of a table that is broadcast. buckets_log2 has no effect: words are no longer counted.
    """

    tenths: int = 8
    buckets_log2: int = 22
    few: int = 3
    cold: int = 4096
    block: int = 2048
    broadcast: int = 200_000


    def __post_init__(self):
        if not 7 <= self.tenths <= 10:
            raise ValueError("tenths must be 7 to 10: below, linked sets need not share a token")


def _code(word: Column) -> Column:
    """A number for a word, smaller for longer ones: 7 bits of its length and 56 of a hash."""
    length = F.least(F.octet_length(word), F.lit(127)).cast("long")
    return F.shiftleft(F.lit(127).cast("long") - length, 56).bitwiseOR(F.xxhash64(word).bitwiseAND(F.lit((1 << 56) - 1)))


def worded(docs: DataFrame, wanted: str | None = None) -> DataFrame:
    """docs: id, t, text. Every line with a word: id, t, pos (its place) and w (the numbers of its distinct words, in order). wanted names a column with the places asked for.

    Outer generators keep Spark from computing their input twice, once for a filter on its size.
    """
    lines = docs.select("id", "t", *([wanted] if wanted else []), F.posexplode_outer(F.split(F.lower("text"), "\n")).alias("pos", "line"))
    if wanted:
        lines = lines.filter(F.array_contains(wanted, F.col("pos")))
    w = F.sort_array(F.array_except(F.transform(F.split("line", _SPACE), _code), F.array(_code(F.lit("")))))
    return lines.select("id", "t", "pos", F.explode_outer(F.array(F.struct(w.alias("w")))).alias("x")).select("id", "t", "pos", F.col("x.w").alias("w")).filter("size(w) > 0")


def lines_of(docs: DataFrame) -> DataFrame:
    """Every line with a word: id, t, pos, n (distinct words), sid (equal for equal sets; two different ones meet with the chance of 64-bit hashes) and the bit signature."""

    def mask(high: int) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate("w", F.lit(0).cast("long"), lambda m, x: F.when(x.bitwiseAND(F.lit(64)) == 64 * high, m.bitwiseOR(bit(x))).otherwise(m))

    return worded(docs).select("id", "t", "pos", F.size("w").alias("n"), F.xxhash64("w").alias("sid"), *[mask(k).alias(m) for k, m in enumerate(_MASKS)])


def prefix_length(n: Column, tenths: int) -> Column:
    """Tokens of a set of n words, of which a linked set has one among its own first ones.

    Let a words be in x alone and b in y alone. Of the n - 1 pairs of neighbours in x, each word of the first kind breaks two at most and each
    of the second kind one, so n - 1 - 2a - b are shared, and of as many of y: 2a + b + 1 of x, in the order of their first words, hold a shared one if the
    prefix of y is as long as it needs. With m words in y, a shared part of tenths * (n + m) / (10 + tenths) or more
    leaves 2n + m - 3 * tenths * (n + m) / (10 + tenths) for 2a + b, most for the smallest m.
    """
    m = F.ceil(tenths * n / F.lit(10))
    return F.floor(((10 + tenths) * (2 * n + m) - 3 * tenths * (n + m)) / F.lit(10 + tenths)).cast("int") + 1


def tokens_of(docs: DataFrame, s: LineSettings) -> DataFrame:
    """(key, sid): the tokens of every line's prefix. Smaller sets than those that can have a linked one have none: they link with equal ones alone."""
    n = F.size("w")
    lines = worded(docs).select(F.xxhash64("w").alias("sid"), "w", F.when(10 * n >= s.tenths * (n + 1), F.least(prefix_length(n, s.tenths), n - 1)).alias("first"))
    pairs = F.arrays_zip(F.call_function("slice", F.col("w"), F.lit(1), F.col("first")), F.call_function("slice", F.col("w"), F.lit(2), F.col("first")))
    return lines.select("sid", F.explode_outer(pairs).alias("z")).filter("z IS NOT NULL").select(F.xxhash64("z").alias("key"), "sid")


def shared_tokens(docs: DataFrame, s: LineSettings) -> DataFrame:
    """tokens_of(), less the tokens of one class alone: each row that has a neighbour of another class."""
    of = Window.partitionBy("key").orderBy("sid")
    rows = tokens_of(docs, s).withColumns({"before": F.lag("sid").over(of), "after": F.lead("sid").over(of)})
    return rows.filter("before <> sid OR after <> sid").select("key", "sid").distinct()


def dealt_keys(lines: DataFrame, s: LineSettings) -> tuple[DataFrame, list[DataFrame]]:
    """(rows, tables that they read). One row for each of a line's keys, and for each pair of blocks (p <= q) that the line's block is in. A key that is rare (the first `cold` ones of a line are) has one block; how many another one needs is counted. Where it needs more than three, each band of sizes has its own, and meets its own band and the next ones alone."""
    carried = [c for c in lines.columns if c not in ("id", "t", "pos", "n", "sid", "keys", "skip", "cold")]
    place = F.col("t").bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(F.col("pos").cast("long")).alias("place")
    rows = lines.filter("keys IS NOT NULL").select("id", place, "sid", "n", "cold", "skip", *carried, F.posexplode("keys").alias("k", "key")).withColumn("i", F.col("k") + F.col("skip"))
    columns = ["key", "n", "i", "sid", "id", "place", *carried]
    hot = settled(rows.filter("k >= cold").select(*columns))
    made = [hot]
    # sizes of a pair differ by the threshold at most, so they lie in one band or in two next to each other; the base is a little larger, against rounding
    band = F.floor(F.log("n") / F.lit(np.log(max(10 / s.tenths, 1.25)) * (1 + 1e-9))).cast("int")
    held = hot.groupBy("key", band.alias("band")).agg(F.count("*").alias("held")).groupBy("key")
    size = lambda n: F.ceil(n / F.lit(s.block)).cast("int")
    blocks = settled(held.agg(size(F.sum("held")).alias("blocks"), F.collect_list(F.struct("band", size(F.col("held")).alias("blocks"))).alias("bands")))
    hot = hot.join(checked(blocks, s.broadcast), "key").withColumn("band", F.when(F.col("blocks") > 3, band).otherwise(0))
    bands = F.when(F.col("blocks") > 3, F.filter("bands", lambda b: F.abs(b["band"] - F.col("band")) <= 1)).otherwise(F.array(F.struct(F.lit(0).alias("band"), F.col("blocks").alias("blocks"))))
    hot = hot.withColumn("bands", bands)
    own = F.filter("bands", lambda b: b["band"] == F.col("band"))[0]["blocks"]
    first = lambda b: b * F.lit(_BAND)
    hot = hot.withColumn("mine", (first(F.col("band")) + F.pmod(F.xxhash64("sid"), own)).cast("int"))
    hot = hot.withColumn("other", F.explode(F.flatten(F.transform("bands", lambda b: F.sequence(first(b["band"]), first(b["band"]) + b["blocks"] - 1)))))
    hot = hot.select(*columns, F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "mine")
    zero = F.lit(0)
    return rows.filter("k < cold").select(*columns, zero.alias("p"), zero.alias("q"), zero.alias("mine")).unionByName(hot), [*made, blocks]


def _fits(s: LineSettings, a, b) -> Column:
    """Whether the sizes and bit signatures of two classes (structs, or columns by name) leave room for the threshold."""
    only = lambda x, y: sum((F.bit_count(x[m].bitwiseAND(F.bitwise_not(y[m]))) for m in _MASKS), F.lit(0))
    both = F.least(a["n"] - only(a, b), b["n"] - only(b, a))
    return (10 + s.tenths) * both >= s.tenths * (a["n"] + b["n"])


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, s: LineSettings) -> DataFrame:
    """The classes b of pairs (a, b) whose sets reach the threshold, read from the texts of their first places. Materialized, and what it took is deleted."""
    sids = settled(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct())
    ends = classes.select("sid", "f").join(checked(sids, s.broadcast), "sid")
    wanted = settled(ends.groupBy(F.col("f.id").alias("id"), F.col("f.t").alias("t")).agg(F.collect_set("f.pos").alias("places")))
    found = worded(docs.join(checked(wanted, s.broadcast), ["id", "t"]), "places").select(F.xxhash64("w").alias("sid"), "w")
    words = settled(found.dropDuplicates(["sid"]))
    both = F.size(F.array_intersect("wa", "wb"))
    reached = (10 + s.tenths) * both >= s.tenths * (F.size("wa") + F.size("wb"))
    good = settled(pairs.join(words.toDF("a", "wa"), "a").join(words.toDF("b", "wb"), "b").filter(reached).select(F.col("b").alias("sid")).distinct())
    forget(sids, wanted, words)
    return good


def removed_lines(docs: DataFrame, settings: LineSettings = LineSettings()) -> DataFrame:
    """docs: id and t (long; the order of documents) and text. Returns id, t and gone, the places of the lines that go.

    A line needs one line before it that reaches the threshold. Of each token's lines it tries the first one and the ones just before it, a few at first; only lines that
    have more candidates and still stay meet all of them. So many variants of one line cost pairs in proportion to their number.
    """
    s = settings
    shared = settled(shared_tokens(docs, s))
    lines = settled(lines_of(docs))
    # the order of places: id, the upper half of t, the line's number
    first = F.min(F.struct("id", F.shiftright("t", 32).alias("u"), "pos", "t"))
    classes = settled(lines.groupBy("sid").agg(first.alias("f"), F.count("*").alias("lines"), *[F.min(c).alias(c) for c in ("n", *_MASKS)]))
    places = ["f.id", "f.u", "f.pos"]
    rows = shared.join(classes.select("sid", "n", *_MASKS, *places), "sid")
    of = Window.partitionBy("key")
    by_place = of.orderBy("id", "u", "pos", "sid")
    one, at = F.struct("sid", "n", *_MASKS, F.struct("id", "u", "pos").alias("at")), F.struct("id", "u", "pos")
    tries = F.array(F.first(one).over(by_place), *[F.lag(one, k).over(by_place) for k in range(1, s.few)])
    rows = rows.select("key", "sid", "n", *_MASKS, at.alias("at"), F.row_number().over(by_place).alias("nth"), F.count("*").over(of).alias("held"), tries.alias("tries"))
    # one row for a token's line: what it tries, and whether its group has more than each line tries
    own = {c: F.col(c) for c in ("n", *_MASKS)}
    fit = F.array_distinct(F.transform(F.filter("tries", lambda a: (a["sid"] != F.col("sid")) & (a["at"] < F.col("at")) & _fits(s, a, own)), lambda a: a["sid"]))
    rows = rows.select("key", "sid", (F.col("nth") > s.few + 1).alias("more"), "held", F.explode_outer(F.array(fit)).alias("a"))
    rows = settled(rows.filter((F.size("a") > 0) | (F.col("held") > s.few + 1)))
    forget(shared)
    some = settled(rows.select(F.explode("a").alias("a"), F.col("sid").alias("b")).distinct())
    gone = verified(some, docs, classes, s)
    forget(some)
    still = settled(rows.filter("more").select("sid").distinct().join(gone, "sid", "left_anti"))
    if not still.isEmpty():
        keyed = F.sort_array(F.collect_list(F.struct((F.col("held") > s.cold).alias("hot"), "key")))
        group = rows.filter(F.col("held") > s.few + 1).groupBy("sid").agg(keyed.alias("keyed")).join(classes.select("sid", "n", *_MASKS, *places), "sid")
        group = group.select("id", F.shiftleft("u", 32).alias("t"), "pos", "n", "sid", F.col("keyed.key").alias("keys"), F.lit(0).alias("skip"), F.size(F.filter("keyed", lambda x: ~x["hot"])).alias("cold"), F.col("keyed.key").alias("among"), *_MASKS)
        group = settled(group)
        forget(rows)
        keys, made = dealt_keys(group, s)
        a, b = keys.alias("a"), keys.join(checked(still, s.broadcast), "sid").alias("b")
        tile = (F.col("a.key") == F.col("b.key")) & (F.col("a.p") == F.col("b.p")) & (F.col("a.q") == F.col("b.q"))
        before = (F.col("a.id") < F.col("b.id")) | ((F.col("a.id") == F.col("b.id")) & (F.col("a.place") < F.col("b.place")))
        once = (F.col("a.p") == F.col("a.q")) | (F.col("a.mine") != F.col("b.mine"))
        side = lambda x: {c: F.col(f"{x}.{c}") for c in ("n", *_MASKS)}
        # a pair that shares several tokens is taken at the smallest one alone
        least = F.col("a.key") == F.array_min(F.array_intersect("a.among", "b.among"))
        rest = settled(a.join(b, tile & before & once & _fits(s, side("a"), side("b")) & least).select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).distinct())
        forget(group, *made)
        more = verified(rest, docs, classes, s)
        gone, old = settled(gone.union(more)), gone
        forget(rest, more, old)
    else:
        forget(rows)
    forget(still)

    decided = classes.join(checked(gone, s.broadcast).withColumn("all", F.lit(True)), "sid", "left").filter("all OR lines > 1").select("sid", "f", "all")
    decided = settled(decided)
    forget(classes, gone)
    out = lines.select("sid", "id", "t", "pos").join(checked(decided, s.broadcast), "sid").filter("all OR NOT (id = f.id AND shiftright(t, 32) = f.u AND pos = f.pos)")
    found = settled(out.groupBy("id", "t").agg(F.collect_set("pos").alias("gone")))
    forget(lines, decided)
    return found


def line_dedup(docs: DataFrame, settings: LineSettings = LineSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with text less the lines that go, and n_lines and n_removed.

    Lines end at line breaks; a line without words matches nothing and stays. Null texts stay null, with 0 lines; an empty
    text is one line. A document is an id with a text: rows that repeat both are at the same places, so neither is before the
    other and their equal lines stay in both; rows of one id with different texts, and those without an id, are documents of
    their own, in the order of the texts' hashes. Whole numbers are compared as long integers, other ids by their 64-bit hash; null is the smallest. An empty table
    gives no rows. Long texts are processed whole. Other columns pass through, whatever their names; those named like the
    new ones are replaced. Words are compared by 56 bits of a hash, equal sets by 64.
    """
    at_id, at_t, at_gone = (unused(docs, c) for c in ("_line_id", "_line_t", "_line_gone"))
    whole = docs.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    doc = F.coalesce(F.col(doc_id).cast("long") if whole else F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id)), F.lit(-(1 << 63)))
    h = F.xxhash64(text)
    gone = removed_lines(docs.select(doc.alias("id"), h.alias("t"), F.col(text).alias("text")), settings)
    rows = docs.withColumns({at_id: doc, at_t: h}).join(checked(gone, settings.broadcast).toDF(at_id, at_t, at_gone), [at_id, at_t], "left")
    parts = F.split(F.col(text), "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains(at_gone, i))
    taken: Column = F.col(at_gone).isNotNull()
    rows = rows.withColumns({"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)), "n_removed": F.when(taken, F.size(at_gone)).otherwise(0)})
    return rows.withColumn(text, F.when(taken, F.concat_ws("\n", kept)).otherwise(F.col(text))).drop(at_id, at_t, at_gone)
