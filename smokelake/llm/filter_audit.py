"""Operator 11, an audit of how filters interact.

A document that fails a set of filters survives every subset of filters that avoids this set. Of five filters there are 32
subsets, so a document becomes a 32-bit word of those that it survives. Positional popcounts over the words (how many have
bit 0, bit 1 and so on) are the survivors of every subset; carry-save adders count 32 positions at once. What a filter
removes at any place of any order is a difference of two of these counts.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import appended

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
_UPPER, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
#: For each set of failed filters, the word of the subsets that the document survives.
SURVIVES = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], dtype=np.uint32)


@dataclass(frozen=True)
class AuditRules:
    """A: under min_words words. B: distinct words under min_distinct percent. C: capitals over max_capitals percent of the code points. D: any symbol. E: a copy of a smaller id's text."""

    min_words: int = 100
    min_distinct: int = 80
    max_capitals: int = 10


def failures(text: str | None, rules: AuditRules) -> int:
    """Bits 0 to 3: whether the text fails A, B, C and D."""
    text = text or ""
    data = text.encode("utf-8")
    words = data.split()  # bytes split at ASCII white space alone
    a = len(words) < rules.min_words
    b = 100 * len(set(words)) < rules.min_distinct * len(words)
    c = 100 * (len(data) - len(data.translate(None, _UPPER))) > rules.max_capitals * len(text)
    d = len(data.translate(None, _SYMBOLS)) < len(data)
    return a | b << 1 | c << 2 | d << 3


def positional_counts(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each of the 32 bits is set, a word counting as often as times says.

    Carry-save: at each power of two, three words become a sum word and a carry word until one is left, whose bits are
    the digits of all 32 counts; the carries belong to the next power. A word enters at the powers that make up its times.
    """
    counts, carried, power = np.zeros(SUBSETS, dtype=np.int64), words[:0], 0
    while len(words) or len(carried):
        column, carries = np.concatenate((carried, words[(times & 1) == 1])), []
        while len(column) > 1:
            third = len(column) // 3
            if third:
                a, b, c = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
                half = a ^ b
                carries.append((a & b) | (c & half))
                column = np.concatenate((half ^ c, column[3 * third :]))
            else:
                carries.append(column[:1] & column[1:])
                column = column[:1] ^ column[1:]
        if len(column):
            counts += (column[0] >> np.arange(SUBSETS, dtype=np.uint32) & np.uint32(1)).astype(np.int64) << power
        carried, power, times = np.concatenate(carries) if carries else words[:0], power + 1, times >> 1
        words, times = words[times > 0], times[times > 0]
    return counts


def survival_words(docs: DataFrame, labels: DataFrame, rules: AuditRules = AuditRules(), doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, good, toxic, failed (bits of the filters A to E) and times: how many documents have this row's text and are alike in all that.

    A text is known by a digest of 128 bits. Rows of a hot text meet as counts: map-side sums leave one row for each task,
    part and label. Null texts are empty texts, null parts the empty part; a row without an id fails E never and makes no
    other row fail it, and has no labels. Rows that repeat an id are documents of their own, none a copy of the other.
    A document is good (toxic) if any label row of its id says so.
    """
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text"))

    def make():
        def columns(texts: list[str | None]) -> list[list]:
            return [[hashlib.blake2b((t or "").encode("utf-8"), digest_size=16).digest() for t in texts], [failures(t, rules) for t in texts]]

        return columns

    slim = appended(own, "text", "digest binary, failed int", make, carry=["id", "part"])
    # rows without an id are dealt by the task they come from
    slim = slim.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.concat(F.lit("p"), F.spark_partition_id().cast("string"))))
    marks = labels.groupBy(F.concat(F.lit("="), F.col("doc_id").cast("string")).alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    joined = slim.join(marks.filter("key IS NOT NULL"), "key", "left").select("key", "id", "part", "digest", "failed", *flags)
    ids = joined.groupBy("key", "id", "part", "digest", "failed", "good", "toxic").agg(F.count("*").alias("times"))
    alike = ids.groupBy("digest", "failed", "part", "good", "toxic").agg(
        F.sum("times").alias("n"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "times"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("times"))), F.lit(0)).alias("unnamed"),
    )
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    fresh = F.col("unnamed") + F.when(F.col("first.id") == smallest, F.col("first.times")).otherwise(F.lit(0))
    both = F.array(F.struct(F.col("failed"), F.col("fresh").alias("times")), F.struct(F.col("failed").bitwiseOR(F.lit(16)).alias("failed"), (F.col("n") - F.col("fresh")).alias("times")))
    rows = alike.withColumn("fresh", fresh).select("part", "good", "toxic", F.explode(both).alias("w"))
    return rows.select("part", "good", "toxic", "w.failed", "w.times").filter("times > 0")


def subset_survivors(words: DataFrame) -> DataFrame:
    """part, and arrays alive, good and toxic: by subset of filters (bit 0: A), how many documents of the part, and of these labels, survive it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            codes = parts.indices.to_numpy(zero_copy_only=False)
            good, toxic, failed, times = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
            order = np.argsort(codes, kind="stable")
            for code, rows in zip(parts.dictionary.to_pylist(), np.split(order, np.searchsorted(codes[order], np.arange(1, len(parts.dictionary)))), strict=True):
                survives, n = SURVIVES[failed[rows]], times[rows]
                found = [positional_counts(survives[m], n[m]) for m in (slice(None), good[rows].astype(bool), toxic[rows].astype(bool))]
                sums[code] = sums.get(code, 0) + np.stack(found)
        if sums:
            columns = [pa.array([s[k].tolist() for s in sums.values()], type=pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.string()), *columns], names=["part", "alive", "good", "toxic"])

    counted = words.select("part", "good", "toxic", "failed", F.col("times").cast("long")).mapInArrow(work, "part string, alive array<long>, good array<long>, toxic array<long>")
    return counted.groupBy("part").agg(*[F.array(*[F.sum(F.col(c)[s]) for s in range(SUBSETS)]).alias(c) for c in ("alive", "good", "toxic")])


def _shapley(bit: int) -> Column:
    """What a filter removes, summed over all orders: of the orders in which just a given subset precedes it there are |S|! (4 - |S|)!."""
    rest = [s for s in range(SUBSETS) if not s & bit]
    terms = [F.lit(math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count())) * (F.col("alive")[s] - F.col("alive")[s | bit]) for s in rest]
    return sum(terms[1:], terms[0])


def audit(survivors: DataFrame) -> DataFrame:
    """All orders of the filters for each part: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(FILTERS)])
    of_filter = survivors.withColumn("shapleys", F.array(*[_shapley(1 << k) for k in range(len(FILTERS))]))
    rows = of_filter.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def subset(letters: Column) -> Column:
        bits = [F.when(F.contains(letters, F.lit(f)), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(FILTERS)]
        return sum(bits[1:], bits[0])

    prefix = lambda n: F.substring(F.col("filter_order"), F.lit(1), n)
    rows = rows.withColumns({"after": subset(prefix(F.col("step"))), "before": subset(prefix(F.col("step") - 1))})
    at = lambda counts, s: F.get(F.col(counts), s)
    own = F.col("after") - F.col("before")
    lost = {c: at(c, F.col("before")) - at(c, F.col("after")) for c in ("alive", "good", "toxic")}
    return rows.select(
        "part", "filter_order", "step",
        at("alive", F.col("after")).alias("kept"),
        lost["alive"].alias("removed"),
        (at("alive", F.lit(0)) - at("alive", own) - lost["alive"]).alias("redundant"),
        (at("alive", F.lit(SUBSETS - 1) - own) - at("alive", F.lit(SUBSETS - 1))).alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        F.get(F.col("shapleys"), F.instr(F.lit(FILTERS), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))) - 1).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, rules: AuditRules = AuditRules()) -> DataFrame:
    """600 rows for each part: what every filter does at every place of every order of the five filters.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic. Counts are of documents within the part; copies (E) are of
    the whole table. Nulls, repeated rows and ids: see survival_words(). Texts are measured whole. An empty table gives no
    rows, empty labels give zeros; other columns, whatever their names, play no part.
    """
    return audit(subset_survivors(survival_words(docs, labels, rules)))


#: The same rows by counting every subset's survivors one by one.
SQL = """
WITH d AS (SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
f AS (SELECT part, CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(e AS INT) AS failed,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND l.toxic = 1) AS toxic FROM w),
n AS (SELECT part, s, count(*) FILTER (failed & s = 0) AS alive, count(*) FILTER (failed & s = 0 AND good) AS good, count(*) FILTER (failed & s = 0 AND toxic) AS toxic
    FROM f, range(32) r(s) GROUP BY part, s),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c)
    JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
p AS (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS letter,
    list_sum(list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda k: CASE WHEN k = '' THEN 0 ELSE 1 << (ascii(k) - 65) END)) AS before,
    1 << (ascii(substr(filter_order, step, 1)) - 65) AS own FROM o, range(1, 6) r(step)),
q AS (SELECT b.part, p.filter_order, p.step, p.letter, a.alive AS kept, b.alive - a.alive AS removed, z.alive - y.alive AS failing, u.alive - v.alive AS unique_fails,
    b.good - a.good AS good_lost, b.toxic - a.toxic AS toxic_lost
    FROM p JOIN n b ON b.s = coalesce(p.before, 0) JOIN n a ON a.part = b.part AND a.s = coalesce(p.before, 0) + p.own JOIN n z ON z.part = b.part AND z.s = 0
    JOIN n y ON y.part = b.part AND y.s = p.own JOIN n u ON u.part = b.part AND u.s = 31 - p.own JOIN n v ON v.part = b.part AND v.s = 31)
SELECT part, filter_order, step, kept, removed, failing - removed AS redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM q
"""
