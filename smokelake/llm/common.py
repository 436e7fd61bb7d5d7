"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A word: a maximal run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; a temporary one is set where there is none on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder, so that a lost executor costs no more than the stage that ran."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Whether the shuffle files of an action go when it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """materialize(), and the shuffle files behind it go at once. They would stay until the driver happens to collect its garbage; the table is read from its own files by then. The session's option is put back."""
    conf = df.sparkSession.conf
    if not conf.isModifiable(_TIDY):
        return materialize(df)
    before = conf.get(_TIDY)
    conf.set(_TIDY, "true")
    try:
        return materialize(df.select("*"))  # planned under the option
    finally:
        conf.set(_TIDY, before)


def forget(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more; Spark itself keeps them for good, unless it is told to clean up."""
    for df in tables:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def checked(df: DataFrame, most: int) -> DataFrame:
    """A materialized table, marked for broadcast if it is counted to be small enough."""
    return F.broadcast(df) if df.count() <= most else df


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(n))


def unit_hash(*cols: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(values: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many bytes at most (a longer value is a run of its own), and of 1,024 rows."""
    lengths = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    ends = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
    rows = np.arange(len(ends)) // 1024
    cuts = np.flatnonzero((ends[1:] != ends[:-1]) | (rows[1:] != rows[:-1])) + 1
    edges = [0, *cuts.tolist(), len(ends)]
    return ((a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if a < b)


def appended(docs: DataFrame, source: str, new: str, make: Callable, carry: Sequence[str] | None = None, most: int = 1 << 20) -> DataFrame:
    """docs (its columns named in carry, or all) with new columns, made in Python from the column source.

    new: names and types, as DDL. make() is called once in each task and returns a function from a list of values to a
    list of columns. A task holds one Arrow batch and works on about `most` bytes at a time. Columns of docs named like the
    new ones are replaced; no temporary column is used.
    """
    added = T.StructType.fromDDL(new)
    taken = {f.name.lower() for f in added}
    kept = [f for f in docs.schema if f.name.lower() not in taken and (carry is None or f.name in carry)]
    names, types = [f.name for f in added], [to_arrow_type(f.dataType) for f in added]
    n_kept = len(kept)
    # a source column that isn't returned, or that gives way to a new one, comes last
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{source}`"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # workers are used again, also by tasks of other stages: what Arrow's pool only keeps goes back
        pa.default_memory_pool().release_unused()
        columns_of = make()
        for batch in batches:
            values = batch.column(n_kept)
            for a, b in slices(values, most):
                columns = columns_of(values.slice(a, b - a).to_pylist())
                arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in range(n_kept)] + arrays, names=[f.name for f in kept] + names)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(work, T.StructType([*kept, *added]))
