"""Operator 5, n-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

A document is its set of word shingles (64-bit hashes, sorted). Two sets that link agree in at least one shingle of their
prefixes under any common order of shingles; frequent shingles come last in that order. A tile holds the sets that a prefix
shingle brings together; sets that link lie in one size band or in two neighbouring ones. Within tiles, sets
are compared by bitmaps: the bits that one has and the other lacks bound the overlap from above. What the bound lets pass
is verified on the sorted arrays.

Equal sets are one class from the start. A tile of few classes lists its pairs of fitting sizes; where the first shared
shingle stands in both sets bounds their overlap, too. The classes of a larger tile are first compared with the centre of their band; then only
those that lie in different components so far meet, in blocks of bounded size. So a group of copies costs
links in proportion to its size, and no link between different texts is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import checked, forget, settled, slices
from .graph import components
from .words import Powers, hashed_words, mixed

_BASE = np.uint64(Powers.base)
_LOWER = np.array([b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)], dtype=np.uint64)


@dataclass(frozen=True)
class JaccardSettings:
    """shingle: words of a shingle; percent: sets link when 100 * intersection >= percent * union; bits: most of a bitmap (a power of two).

    few: most rows of a tile that lists its pairs; hot: most shingles that are moved to the end of the order because they are
    frequent (a fixed bound of what is broadcast; any choice of them gives the same result); salts: parts into which the rows of a
    hot shingle are dealt; centres: those that a set of large tiles is compared with at first; block: rows of a block of a tile; broadcast: most rows of a table that is broadcast.
    """

    shingle: int = 4
    percent: int = 85
    bits: int = 1 << 16
    few: int = 16
    hot: int = 1 << 17
    salts: int = 64
    centres: int = 3
    block: int = 512
    broadcast: int = 200_000

    def prefix(self, n: int) -> int:
        """Elements of the prefix of a set of n."""
        return n - -(-self.percent * n // 100) + 1

    def band(self, n: str) -> Column:
        """Sizes that differ by no more than sets that link may lie in one band or in two neighbouring ones."""
        return F.floor(F.log(F.col(n).cast("double")) / F.lit(float(np.log(100 / self.percent)) * 1.000001)).cast("int")


def shingle_set(text: str | bytes | None, s: JaccardSettings, powers: Powers) -> np.ndarray:
    """Sorted hashes of the distinct shingles of the whole text; with fewer words than a shingle has, of the whole sequence."""
    data = np.frombuffer(text.encode("utf-8") if isinstance(text, str) else text or b"", dtype=np.uint8)
    _, h = hashed_words(data, _LOWER, powers)
    if not len(h):
        return np.empty(0, np.uint64)
    k = min(s.shingle, len(h))
    n = len(h) - k + 1
    rolled = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        rolled = rolled * _BASE + h[j : j + n]
    return np.unique(mixed(rolled))


def set_id(a: np.ndarray) -> int:
    """Equal sets have equal ids; with the size beside it, two different sets that meet are out of reach."""
    return int.from_bytes(hashlib.md5(a.tobytes()).digest()[:8], "little", signed=True)


def bitmap(a: np.ndarray, s: JaccardSettings) -> bytes:
    """Four to eight bits for each element, a power of two between 256 and s.bits."""
    bits = max(256, min(s.bits, 1 << (4 * len(a) - 1).bit_length()))
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(a >> np.uint64(20)).astype(np.int64) & (bits - 1)] = 1
    return np.packbits(flags).tobytes()


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes as bitmaps of fewer bytes: the hash loses its upper bits, so halves are united."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return np.ascontiguousarray(maps).view(np.uint64)


def may_link(a: np.ndarray, b: np.ndarray, na, nb, percent: int) -> np.ndarray:
    """Pairs of rows of two tables of bytes (or one row and a table) whose upper bound of the overlap reaches the threshold. Bits set on one side alone stand for at least as many elements that the other lacks."""
    width = min(a.shape[1], b.shape[1])
    a, b = folded(a, width), folded(b, width)
    only_a = np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64)
    most = np.minimum(na - only_a, nb - only_b)
    return (100 + percent) * most >= percent * (na + nb)


def class_table(docs: DataFrame, s: JaccardSettings) -> DataFrame:
    """docs: doc_id and text. Returns doc_id, t (hash of the text), n, sid and map of every document."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for lo, hi in slices(batch.column(2), 1 << 20):
                sets = [shingle_set(text, s, powers) for text in batch.column(2).slice(lo, hi - lo).to_pylist()]
                n, sid, maps = zip(*((len(a), set_id(a), bitmap(a, s)) if len(a) else (0, None, None) for a in sets), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int32()), pa.array(sid, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "t", "n", "sid", "map"])

    return rows.mapInArrow(measure, T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("t long, n int, sid long, map binary")]))


def hot_keys(docs: DataFrame, s: JaccardSettings) -> np.ndarray:
    """The shingles that most prefixes hold by the order of hashes alone: those of more rows than a small tile has, counted over all documents, s.hot at most."""
    often = prefix_keys(docs, np.empty(0, np.uint64), s).groupBy("key").count().filter(F.col("count") > s.few)
    rows = often.orderBy(F.desc("count"), "key").limit(s.hot).agg(F.collect_list("key").alias("keys")).first()
    return np.sort(np.array(rows["keys"], dtype=np.int64).view(np.uint64))


def prefix_keys(docs: DataFrame, hot: np.ndarray, s: JaccardSettings) -> DataFrame:
    """(key, sid, n, i, hot): the prefix shingles of each set and their places, those of the hot list last in the order. A task emits a set once."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen, hot = Powers(), set(), shared.value
        for batch in batches:
            for lo, hi in slices(batch.column(0), 1 << 20):
                sets, keys, last = [], [np.empty(0, np.uint64)], [np.empty(0, bool)]
                for text in batch.column(0).slice(lo, hi - lo).to_pylist():
                    a = shingle_set(text, s, powers)
                    sid = set_id(a) if len(a) else None
                    if sid is None or sid in seen:
                        continue
                    seen.add(sid)
                    is_hot = np.zeros(len(a), bool)
                    if len(hot):
                        at = np.searchsorted(hot, a)
                        at[at == len(hot)] = 0
                        is_hot = hot[at] == a
                    order = np.argsort(is_hot, kind="stable")[: s.prefix(len(a))]
                    keys.append(a[order])
                    last.append(is_hot[order])
                    sets.append((sid, len(a), len(order)))
                sid, n, times = np.array(sets, dtype=np.int64).reshape(-1, 3).T
                places = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                columns = [np.concatenate(keys).view(np.int64), np.repeat(sid, times), np.repeat(n, times).astype(np.int32), places.astype(np.int32), np.concatenate(last)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "sid", "n", "i", "hot"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(measure, "key long, sid long, n int, i int, hot boolean")


def fits(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def shared_keys(rows: DataFrame, s: JaccardSettings) -> DataFrame:
    """(key, sid, n, i, large): the rows whose key another set of a fitting size has, and whether the key has more than few rows.

    Sets of a key are put in order of size, so their neighbours tell; rows of a hot key, dealt by a salt, all stay.
    """
    part = Window.partitionBy("key", F.when(F.col("hot"), F.pmod("sid", F.lit(s.salts)).cast("int")).otherwise(F.lit(0)))
    order = part.orderBy("n", "sid")
    many = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > s.few
    rows = rows.withColumns({"s0": F.lag("sid").over(order), "n0": F.lag("n").over(order), "s1": F.lead("sid").over(order), "n1": F.lead("n").over(order), "large": F.col("hot") | many})
    near = lambda k: (F.col(f"s{k}") != F.col("sid")) & fits(F.col(f"n{k}"), F.col("n"), s.percent)
    return rows.filter(F.col("hot") | F.coalesce(near(0), F.lit(False)) | F.coalesce(near(1), F.lit(False))).select("key", "sid", "n", "i", "large").distinct()


def listed_pairs(keys: DataFrame, s: JaccardSettings) -> DataFrame:
    """Pairs (a, b) of small tiles that fit in size and, by the places of their first shared shingle, in overlap.

    If they share one of a large tile before it, they meet there.
    """
    side = lambda k: keys.select("key", F.col("sid").alias(k), F.col("n").alias(f"n{k}"), F.col("i").alias(f"i{k}"))
    rows = side("a").join(side("b"), "key").filter("a < b").filter(fits(F.col("na"), F.col("nb"), s.percent))
    rows = rows.groupBy("a", "b", "na", "nb").agg(F.min("ia").alias("ia"), F.min("ib").alias("ib"))
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    return rows.filter((100 + s.percent) * most >= s.percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _tables(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a binary column by width: (places, table of bytes)."""
    widths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        part = column.take(pa.array(at))
        yield at, np.frombuffer(part.buffers()[2], dtype=np.uint8)[: len(at) * w].reshape(len(at), w)


class Maps:
    """Bitmaps with a number for each row, in a table of bytes for each width."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, column: pa.Array) -> None:
        self.parts += [(at + self.n, table) for at, table in _tables(column)]
        self.n += len(column)

    def settled(self) -> list[tuple[np.ndarray, np.ndarray]]:
        by_width: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for part in self.parts:
            by_width.setdefault(part[1].shape[1], []).append(part)
        self.parts = [tuple(np.concatenate(x) for x in zip(*v, strict=True)) for v in by_width.values()]
        return self.parts


def by_bitmap(pairs: DataFrame, classes: DataFrame, s: JaccardSettings) -> DataFrame:
    """Pairs (a, b) whose bitmaps leave a link possible."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(lo, 2048) for x in batches for lo in range(0, x.num_rows, 2048)):
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            ok = np.zeros(batch.num_rows, dtype=bool)
            for at, table in _tables(batch.column("ma")):
                for of, other in _tables(batch.column("mb").take(pa.array(at))):
                    rows = at[of]
                    ok[rows] = may_link(table[of], other, na[rows], nb[rows], s.percent)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    left = classes.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("map").alias("ma"))
    right = classes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("map").alias("mb"))
    rows = pairs.join(left, "a").join(right, "b").filter(fits(F.col("na"), F.col("nb"), s.percent))
    return rows.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(passing, "a long, b long")


def verified(pairs: DataFrame, arrays: DataFrame, s: JaccardSettings) -> DataFrame:
    """Pairs (a, b) that link, by intersection of the sorted arrays."""

    def links(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= s.percent * (len(x) + len(y) - both)

    def linking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ok = [links(x, y) for x, y in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist(), strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = arrays.select(F.col("sid").alias("a"), F.col("set").alias("sa")), arrays.select(F.col("sid").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(linking, "a long, b long")


def set_arrays(docs: DataFrame, wanted: DataFrame, s: JaccardSettings) -> DataFrame:
    """sid and set (the sorted array, as bytes) of every class wanted (sid, doc), read from the text of its first document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for lo, hi in slices(batch.column(1), 1 << 20):
                part = batch.slice(lo, hi - lo)
                found = [(w, a.tobytes()) for w, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if set_id(a := shingle_set(t, s, powers)) == w]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], names=["sid", "set"])

    wanted = settled(wanted.select(F.col("doc.doc_id").alias("_id"), F.col("doc.t").alias("t"), "sid"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(checked(wanted, s.broadcast), (rows["t"] == wanted["t"]) & rows["doc_id"].eqNullSafe(wanted["_id"])).select("sid", "text")
    found = settled(rows.mapInArrow(measure, "sid long, set binary").dropDuplicates(["sid"]))  # a document may come in several rows
    forget(wanted)
    return found


def open_tiles(keys: DataFrame, labels: DataFrame, classes: DataFrame, s: JaccardSettings) -> DataFrame:
    """Pairs (a, b), materialized, that share a key, lie in different components, fit in size and pass the bitmaps.

    A key is open while its classes lie in two components or more; the one with most of its classes is the major one, so
    keys of one group of near copies agree on it and their classes meet in one tile, not in one for each key's choice. The classes
    of all open keys with one major component make the tiles of that component, one for each size band; each class is there once. Those
    outside the major component are probes: they meet the tiles of their band and of its neighbours. Both the rows of a
    tile and its probes are dealt into blocks, and a task gets one block of each at a time.
    """
    rows = keys.join(labels.select(F.col("node").alias("sid"), "label"), "sid", "left")
    rows = settled(rows.select("key", "sid", "n", F.coalesce("label", "sid").alias("label")))
    held = rows.groupBy("key", "label").agg(F.count("*").alias("held")).groupBy("key").agg(F.max(F.struct("held", "label")).alias("most"), F.count("*").alias("labels"))
    open_keys = held.filter("labels > 1").select("key", F.col("most.label").alias("major"))
    members = rows.join(open_keys, "key").select("major", "sid", "n", "label").distinct().withColumn("band", s.band("n"))
    members = settled(members)
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("tile")
    probes = members.filter("label <> major").select("major", near, "band", "sid", "n", "label")
    blocks = lambda of: F.ceil(F.count("*") / F.lit(s.block)).cast("int").alias(of)
    sizes = members.groupBy("major", F.col("band").alias("tile")).agg(blocks("own_blocks")).join(probes.groupBy("major", "tile").agg(blocks("probe_blocks")), ["major", "tile"])
    sizes = settled(sizes)
    mapped = classes.select("sid", "map")
    dealt = F.pmod(F.xxhash64("sid"), F.col("mine")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("theirs") - 1))

    def placed(rows: DataFrame, mine: str, theirs: str, block: str, other: str, probe: bool) -> DataFrame:
        rows = rows.join(sizes.withColumnsRenamed({mine: "mine", theirs: "theirs"}), ["major", "tile"]).join(mapped, "sid")
        return rows.select("major", "tile", dealt.alias(block), every.alias(other), F.lit(probe).alias("probe"), "band", "sid", "n", "label", "map")

    own = placed(members.withColumn("tile", F.col("band")), "own_blocks", "probe_blocks", "own", "asking", False)
    both = own.unionByName(placed(probes, "probe_blocks", "own_blocks", "asking", "own", True))
    by = ["major", "tile", "own", "asking"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by task, those of the tile before the probes. Of a task only its tile rows, a block, are held."""
        now, sids, ns, labels, maps = None, [], [], [], Maps()
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in by], axis=1)
            probe = batch.column("probe").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((place[1:] != place[:-1]).any(axis=1) | (probe[1:] != probe[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(probe)], strict=True):
                if lo == hi:
                    continue
                if tuple(place[lo]) != now:
                    now, sids, ns, labels, maps = tuple(place[lo]), [], [], [], Maps()
                part = batch.slice(lo, hi - lo)
                sid, n, label, band = (part.column(c).to_numpy().astype(np.int64) for c in ("sid", "n", "label", "band"))
                if not probe[lo]:
                    sids, ns, labels = [*sids, sid], [*ns, n], [*labels, label]
                    maps.add(part.column("map"))
                elif sids:
                    yield pairs(now, [np.concatenate(x) for x in (sids, ns, labels)], maps.settled(), sid, n, label, band, part.column("map"))

    def pairs(now, own, tables, sid, n, label, band, column) -> pa.RecordBatch:
        own_sid, own_n, own_label = own
        major, tile = now[:2]
        found = [np.empty((0, 2), np.int64)]
        for places, probing in _tables(column):
            for k, p in enumerate(places):
                for at, table in tables:
                    x = own_label[at]
                    # two minor ones meet once: in the upper band, or in their own by the order of ids
                    ok = (x != label[p]) & ((x == major) | (band[p] < tile) | ((band[p] == tile) & (own_sid[at] > sid[p])))
                    ok &= 100 * np.minimum(own_n[at], n[p]) >= s.percent * np.maximum(own_n[at], n[p])
                    rows = np.flatnonzero(ok)
                    if len(rows):
                        hits = at[rows[may_link(probing[k][None], table[rows], n[p], own_n[at[rows]], s.percent)]]
                        found.append(np.stack([np.minimum(own_sid[hits], sid[p]), np.maximum(own_sid[hits], sid[p])], axis=1))
        both = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    found = settled(both.repartition(*by).sortWithinPartitions(*by, "probe").mapInArrow(compare, "a long, b long").distinct())
    forget(rows, members, sizes)
    return found


def jaccard_labels(docs: DataFrame, settings: JaccardSettings = JaccardSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, t (hash of the text), n (set size) and label, equal for those of one component and null without words."""
    s = settings
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ids = settled(class_table(docs, s))
    hot = hot_keys(docs, s)

    shared = settled(shared_keys(prefix_keys(docs, hot, s), s))
    keys = shared.filter("large").select("key", "sid", "n")
    document = F.struct("doc_id", "t")
    classes = ids.filter("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("map").alias("map"), F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), document)), F.min(document)).alias("doc"))
    classes = settled(classes)
    members = classes.select("sid", "doc")

    # small tiles list their pairs; in large ones each set meets the centre of its band
    few = listed_pairs(shared.filter("NOT large"), s)
    banded = keys.select("key", s.band("n").alias("band"), "sid")
    centres = banded.groupBy("key", "band").agg(F.min("sid").alias("a"))
    stars = banded.join(centres, ["key", "band"]).filter("a <> sid").groupBy("a", F.col("sid").alias("b")).agg(F.count("*").alias("keys"))
    # what a set shares with other centres than its first ones is left to the open tiles
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("keys"), "a"))
    stars = stars.withColumn("nth", nth).filter(F.col("nth") <= s.centres).select("a", "b")
    pairs = settled(by_bitmap(stars.union(few).distinct(), classes, s))
    arrays = set_arrays(docs, pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct().join(members, "sid"), s)
    links = settled(verified(pairs, arrays, s))
    forget(pairs)
    labels = components(links)

    crossing = open_tiles(keys, labels, classes, s)
    forget(shared)
    if not crossing.isEmpty():
        wanted = crossing.select(F.col("a").alias("sid")).union(crossing.select("b")).distinct()
        others = set_arrays(docs, wanted.join(arrays.select("sid"), "sid", "left_anti").join(members, "sid"), s)
        more = settled(verified(crossing, arrays.union(others), s))
        forget(others)
        if not more.isEmpty():
            labels = components(links.union(more))
        forget(more)
    forget(crossing, links, arrays, classes)

    named = ids.select("doc_id", "t", "n", "sid").join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    return named.select("doc_id", "t", F.col("n").cast("long").alias("n"), F.coalesce("label", "sid").alias("label"))


def jaccard_components(docs: DataFrame, settings: JaccardSettings = JaccardSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles (set size) and component_id (smallest doc_id reachable by links, itself included).

    Words are maximal runs without ASCII white space, in lower case for A-Z. Documents without words, with null or empty
    text, have n_shingles 0 and are their own component. A text with fewer words than a shingle is one shingle. Rows that
    repeat an id are rows of their own; a null id has a component id of null unless it links with others. An empty table
    gives no rows. Long texts are processed whole. Other columns are not returned.
    """
    named = jaccard_labels(docs, settings, doc_id, text)
    first = named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("first"))
    return named.join(first, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))
