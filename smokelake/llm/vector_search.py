"""Operator 4, exact top-k search by a vector-approximation file.

The file holds the cell of each component of each vector in a few bits, packed, block by block; a cell holds two values or more. A scan
over the cells gives bounds of every score; the kth best lower bound of a query is carried from block to block, and what can't reach it is left. Exact vectors
are then read in the order of the upper bounds: the k first ones, and those whose bound reaches the kth exact score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


@dataclass(frozen=True)
class SearchSettings:
    """k: results of a query; bits: most of a cell in each component, 8 at most; query_block: queries that a task holds; part: vectors that a task scans."""

    k: int = 20
    bits: int = 8
    query_block: int = 512
    part: int = 1 << 18


def whole_steps(vector: str, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as double; null for vectors that are null or hold null or non-finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(v.isNotNull() & finite, F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of integers; shorter vectors end in zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(lengths), lengths.max(initial=0)), dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy()
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m[:, :width] if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def quantised(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """low, size, width and cells: of each component the least value, the values of a cell (two at least, where there are two) and the bits of a cell's number; and the numbers."""
    low = v.min(axis=0)
    span = v.max(axis=0) - low + 1
    size = np.maximum(-(-span // (1 << bits)), np.minimum(span, 2))
    width = np.ceil(np.log2(-(-span // size))).astype(np.int64)
    return low, size, width, (v - low) // size


def _columns(width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component and place of each bit of a packed vector."""
    component = np.repeat(np.arange(len(width)), width)
    return component, np.arange(len(component)) - np.repeat(np.cumsum(width) - width, width)


def packed(cells: np.ndarray, width: np.ndarray) -> bytes:
    component, place = _columns(width)
    return np.packbits(((cells[:, component] >> place) & 1).astype(np.uint8), axis=1).tobytes()


def unpacked(blob: bytes, width: np.ndarray, n: int) -> np.ndarray:
    component, place = _columns(width)
    out = np.zeros((n, len(width)), dtype=np.int64)
    if len(component):
        bits = np.unpackbits(np.frombuffer(blob, dtype=np.uint8).reshape(n, -1), axis=1, count=len(component)).astype(np.int64) << place
        held = np.flatnonzero(width)
        out[:, held] = np.add.reduceat(bits, (np.cumsum(width) - width)[held], axis=1)
    return out


def approximated(rows: DataFrame, bits: int) -> DataFrame:
    """The approximation file: one row for each batch of vectors, with their keys (vec_id, h, r), the least value, cell size and bits of each component, and the packed cells."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                low, size, width, cells = quantised(matrix(part.column("v")), bits)
                keys = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "h", "r")])
                blobs = [x.tobytes() for x in (keys, low, size, width)] + [packed(cells, width)]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=["keys", "low", "size", "width", "cells"])

    return rows.select("vec_id", "h", "r", "v").mapInArrow(pack, "keys binary, low binary, size binary, width binary, cells binary")


class Scan:
    """Queries of a task, with the k best lower bounds so far and the vectors that may still be among the k best."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries.astype(np.float64), k
        self.best = np.full((len(ids), k), -np.inf)
        self.found: list[list[np.ndarray]] = []

    def bounds(self, low: np.ndarray, size: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score of each query with each vector of a block, by the cells alone."""
        q = widened(self.queries, len(low))
        inner = (q * size) @ cells.T.astype(np.float64) + (q @ low)[:, None]
        # beyond 2 ** 52 doubles are rounded: the bounds leave room for it
        most = np.abs(q) @ np.maximum(np.abs(low), np.abs(low + 256.0 * size))
        room = np.where(most < 2.0**52, 0.0, most * 2.0**-44)
        lower = inner + (np.minimum(q, 0) @ (size - 1.0) - room)[:, None]
        return lower, inner + (np.maximum(q, 0) @ (size - 1.0) + room)[:, None]

    def block(self, keys: np.ndarray, low: np.ndarray, size: np.ndarray, cells: np.ndarray) -> None:
        lower, upper = self.bounds(low, size, cells)
        own = self.ids[:, None] == keys[0][None]
        lower[own] = upper[own] = -np.inf
        n = lower.shape[1]
        top = np.partition(lower, n - self.k, axis=1)[:, n - self.k :] if n > self.k else lower
        both = np.concatenate([self.best, top], axis=1)
        self.best = np.partition(both, both.shape[1] - self.k, axis=1)[:, both.shape[1] - self.k :]
        at_q, at_v = np.nonzero((upper >= self.best.min(axis=1)[:, None]) & (upper > -np.inf))
        self.found.append([at_q, *keys[:, at_v], lower[at_q, at_v], upper[at_q, at_v]])

    def rest(self) -> list[np.ndarray]:
        """query_id, vec_id, h, r, lower, upper of what may be among the k best."""
        q, *columns = (np.concatenate(x) for x in zip(*self.found, strict=True))
        stays = columns[-1] >= self.best.min(axis=1)[q]
        return [self.ids[q][stays], *(c[stays] for c in columns)]


def top_k(vectors: DataFrame, is_query: Column, settings: SearchSettings = SearchSettings(), vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """The k rows of highest integer inner product for each query: query_id, rank from 1, vec_id, score; ties to smaller vec_id.

    Rows with a null id, or whose vector is null or holds null or non-finite components, take no part. A query never finds
    rows of its own id. Rows that repeat an id are candidates each; as a query, an id counts once, with its smallest
    vector. In vectors of unequal length the missing components count as 0; an empty vector scores 0. An empty table gives
    no rows. Scores are long integers. Only the named columns are read.

    Equal vectors score alike, so of each only the k + 1 smallest ids (one may be the query's own) can be among k results;
    the others leave before the scan. A task scans a part of the file for a block of queries; both are of bounded size.
    """
    s = settings
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole_steps(vector, scale).alias("v"), is_query.alias("q")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("v"))
    equal = Window.partitionBy("h", "v").orderBy("vec_id")
    exact = materialize(rows.withColumn("r", F.row_number().over(equal)).filter(F.col("r") <= s.k + 1).select("vec_id", "h", "r", "v"))
    asked = materialize(rows.filter("q").groupBy("vec_id").agg(F.min("v").alias("v")))
    file = materialize(approximated(exact, s.bits))

    parts = max(1, -(-exact.count() // s.part))
    groups = max(1, -(-asked.count() // s.query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None)
    dealt = file.select(F.pmod(F.xxhash64("keys"), F.lit(parts)).cast("int").alias("part"), "keys", "low", "size", "width", "cells", none.cast("long").alias("vec_id"), none.cast("array<long>").alias("v"), F.lit(1).alias("kind"))
    dealt = dealt.select(every(groups).alias("g"), "*")
    queries = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), *[none.cast("binary").alias(c) for c in ("keys", "low", "size", "width", "cells")], "vec_id", "v", F.lit(0).alias("kind"))
    both = dealt.unionByName(queries.select(every(parts).alias("part"), "*"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by task (g, part), queries before the file."""
        now, asked, state = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if state is not None and state.found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in state.rest()], names=["query_id", "vec_id", "h", "r", "lower", "upper"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["g"], row["part"]) != now:
                    yield from done()
                    now, asked, state = (row["g"], row["part"]), [], None
                if row["kind"] == 0:
                    asked.append((row["vec_id"], row["v"]))
                    continue
                if state is None:
                    if not asked:
                        continue
                    state = Scan(np.array([i for i, _ in asked], dtype=np.int64), matrix(pa.array([v for _, v in asked], pa.list_(pa.int64()))), s.k)
                low, size, width = (np.frombuffer(row[c], dtype=np.int64) for c in ("low", "size", "width"))
                keys = np.frombuffer(row["keys"], dtype=np.int64).reshape(3, -1)
                state.block(keys, low, size, unpacked(row["cells"], width, keys.shape[1]))
        yield from done()

    tasks = both.repartition("g", "part").sortWithinPartitions("g", "part", "kind")
    left = tasks.mapInArrow(scan, "query_id long, vec_id long, h long, r long, lower double, upper double")
    # the parts of a query meet: bounds of all parts leave less
    by_query = Window.partitionBy("query_id")
    left = left.withColumn("n", F.row_number().over(by_query.orderBy(F.desc("lower")))).withColumn("kth", F.min(F.when(F.col("n") <= s.k, F.col("lower"))).over(by_query))
    left = left.filter(F.col("upper") >= F.col("kth")).withColumn("n", F.row_number().over(by_query.orderBy(F.desc("upper"), "vec_id")))
    left = materialize(left.select("query_id", "vec_id", "h", "r", "upper", "n"))

    def read(pairs: DataFrame) -> DataFrame:
        product = F.aggregate(F.zip_with("qv", "v", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
        found = pairs.join(exact, ["vec_id", "h", "r"]).join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")), "query_id")
        return found.select("query_id", "vec_id", product.alias("score"))

    first = materialize(read(left.filter(F.col("n") <= s.k)))
    certain = first.groupBy("query_id").agg(F.min("score").alias("least"))
    second = left.filter(F.col("n") > s.k).join(certain, "query_id").filter(F.col("upper") >= F.col("least")).drop("least")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(read(second)).withColumn("rank", F.row_number().over(by_score))
    return ranked.filter(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")


#: The same rows by all scores.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
