"""Operator 12, benchmark decontamination by one Aho-Corasick automaton.

Items and documents are normalised alike: words in lower case with one blank between them. The automaton holds blocks of
the items' words: any window of 10 words of an item has within it a whole block of 5 words that begins at a multiple of 5,
so one scan of a document finds a block of every window that occurs. Each find names a place of an item; the words around it are
compared there, and runs of 10 words or more are hits. The automaton has as many nodes as the items have characters, a
tenth of one over all windows. Hits are mapped back to the original text as spans of code points.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, materialize

#: A word is a run of ASCII digits and letters and of all characters beyond ASCII; A-Z count as a-z.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_SPANS = "array<struct<first_word:int,end_word:int,begin:int,end:int>>"
#: Adds a span to disjoint ones before it.
_UNITED = f"""aggregate(spans, cast(array() as {_SPANS}), (x, y) -> if(size(x) > 0 and y.first_word <= element_at(x, -1).end_word,
    concat(slice(x, 1, size(x) - 1), array(named_struct('first_word', element_at(x, -1).first_word, 'end_word', greatest(element_at(x, -1).end_word, y.end_word),
    'begin', element_at(x, -1).begin, 'end', greatest(element_at(x, -1).end, y.end)))), concat(x, array(y))))"""


@dataclass(frozen=True)
class Decontamination:
    """window: words of a window; part_chars: most characters of items in one automaton (about 60 bytes of memory each); more items make more automata."""

    window: int = 10
    part_chars: int = 2_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_NORMAL).split(b" ") if text else []


class Automaton:
    """Blocks of items' words, and where in which item each of them lies. items: (name, text)."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int):
        self.window, self.step = window, max(window // 2, 1)
        self.items: list[tuple[str, list[bytes], int]] = []  # name, words, length of a window
        places: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for name, text in items:
            words = [w for w in words_of(text) if w]
            if words:
                k, size = len(self.items), min(window, len(words))
                self.items.append((name, words, size))
                blocks = [(0, size)] if size < window else [(a, a + self.step) for a in range(0, len(words) - self.step + 1, self.step)]
                for a, b in blocks:
                    places[b" %b " % b" ".join(words[a:b])].append((k, a))
        self.automaton = ahocorasick.Automaton()
        for block, found in places.items():
            self.automaton.add_word(block.decode("latin-1"), (block.count(b" ") - 1, found))
        if places:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Words of the text, runs of words that are hit (disjoint, ascending), and names of items with a window in it."""
        words = [w for w in words_of(text) if w]
        if not words or not self.items:
            return len(words), [], []
        # bytes as code points: UTF-8 can be compared byte by byte, and blanks bound every block
        joined = b" %b " % b" ".join(words)
        finds = list(self.automaton.iter(joined.decode("latin-1")))
        if not finds:
            return len(words), [], []
        runs, names = [], set()
        seen: dict[tuple[int, int], int] = {}  # item and diagonal: the first word behind what was compared
        index, last = 0, 0
        for end, (length, places) in finds:
            index, last = index + joined.count(b" ", last, end), end  # blanks before the last one of the find
            begin = index - length
            for k, at in places:
                name, item, size = self.items[k]
                if begin < seen.get((k, begin - at), 0):
                    continue
                a, b, d = begin, begin + length, at - begin
                while a > 0 and a + d > 0 and words[a - 1] == item[a + d - 1]:
                    a -= 1
                while b < len(words) and b + d < len(item) and words[b] == item[b + d]:
                    b += 1
                seen[(k, begin - at)] = b
                if b - a >= size:
                    runs.append((a, b))
                    names.add(name)
        return len(words), merged(runs), sorted(names)


def merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans_of(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words with their code points in the text; ends are exclusive."""
    places = [m.span() for m in _WORD.finditer(text)] if runs else []
    return [{"first_word": a, "end_word": b, "begin": places[a][0], "end": places[b - 1][1]} for a, b in runs]


def _scan(docs: DataFrame, text: str, items: list[tuple[str, str]], settings: Decontamination, carry: list[str] | None) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        automaton = Automaton(sent.value, settings.window)

        def columns(texts: list[str | None]) -> list[list]:
            found = [automaton.hits(t) for t in texts]
            spans = [spans_of(t, runs) for t, (_, runs, _) in zip(texts, found, strict=True)]
            return [[n for n, _, _ in found], [sum(b - a for a, b in runs) for _, runs, _ in found], [names for _, _, names in found], spans]

        return columns

    return appended(docs, text, f"n_words long, n_hit long, items array<string>, spans {_SPANS}", make, carry)


def item_parts(benchmark: DataFrame, settings: Decontamination, item_id: str = "item_id", text: str = "text") -> list[DataFrame]:
    """The items in parts, each bounded in characters, but for a single longer item. Of a part's texts, equal ones of an item count once."""
    own = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).filter("text <> ''").distinct()
    chars = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # dealt by hash at half the bound, so that a part rarely is above it
    n = 1 if chars <= settings.part_chars else -(-2 * chars // settings.part_chars)
    return [own] if n == 1 else [own.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Decontamination = Decontamination(), text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add n_words, n_hit (words inside an occurrence of a window), items (array of the ids, as strings, of items with a window there), spans (of the hits, in words and in code points of the original text) and contaminated.

    benchmark: item_id, text. A window is `window` consecutive words of an item; an item of fewer words, but not none, is one.
    Null and empty texts have no words, on either side; a null item id reads as the empty text; rows that repeat an item
    id are texts of one item. Long texts are scanned whole, repeated rows give repeated results, an empty table gives no rows, an empty
    benchmark no hits. Other columns pass through (those named in carry, or all); those named like the new ones are replaced.

    Items are sent to the tasks; their characters are counted first. Where they exceed part_chars, each part of them is scanned
    for by itself; what is found (contaminated texts alone) meets by the text's digest and is joined to the rows.
    """
    parts = item_parts(benchmark, settings)
    send = lambda part: [(r.item, r.text) for r in part.toLocalIterator()]
    added = ["n_words", "n_hit", "items", "spans"]
    kept = [c for c in docs.columns if (carry is None or c in carry) and c.lower() not in {*added, "contaminated"}]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], F.col(f"`{text}`").alias("t"))
    names = [f"c{k}" for k in range(len(kept))]
    if len(parts) == 1:
        rows = _scan(plain, "t", send(parts[0]), settings, names)
    else:
        key = F.sha2(F.col("t").cast("binary"), 256).alias("key")
        found = [materialize(_scan(plain.select("t"), "t", send(p), settings, ["t"]).filter("n_hit > 0").select(key, "items", "spans").distinct()) for p in parts]
        of_text = reduce(DataFrame.union, found).groupBy("key").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "spans")])
        of_text = of_text.withColumn("spans", F.expr(_UNITED))
        counted = appended(plain, "t", "n_words long", lambda: lambda texts: [[sum(map(bool, words_of(t))) for t in texts]], [*names, "t"])
        rows = counted.select(*names, key, "n_words").join(of_text, "key", "left")
        rows = rows.withColumn("n_hit", F.expr("coalesce(aggregate(spans, 0L, (x, y) -> x + y.end_word - y.first_word), 0L)"))
        rows = rows.withColumns({c: F.coalesce(F.col(c), F.array().cast(kind)) for c, kind in (("items", "array<string>"), ("spans", _SPANS))})
    return rows.select(*names, *added).toDF(*kept, *added).withColumn("contaminated", F.col("n_hit") > 0)


#: The same rows by a join of all windows.
SQL = """
WITH n AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w
    FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dk AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS w FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM n, dk WHERE len(ws) >= k)),
o AS (SELECT dw.doc_id, dw.k, dw.i, bw.item FROM dw JOIN bw ON bw.k = dw.k AND bw.w = dw.w),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT n.doc_id, CAST(len(n.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM n LEFT JOIN h ON n.doc_id = h.doc_id LEFT JOIN t ON n.doc_id = t.doc_id
"""
