"""What the corpus operators share: durable intermediate tables, size-checked broadcasts, grouped Arrow streams."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Java pattern for one run of the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes that a table of numbers may have to be broadcast, reckoned at ROW_BYTES a row and 8 a column; it takes up to twice as much.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 16
#: Bytes of text that a Python worker holds at once, apart from a single longer text.
BATCH_BYTES = 4 << 20

#: Makes Spark delete a query's shuffle files as soon as the query has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only on a local master that names none (tests on one machine)."""
    global _own_dir
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="cinderplan-")
    return _own_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in this application's own part of it."""
    return f"{shared_dir(spark)}/cinderplan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Queries begun within leave no shuffle files behind."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def written(df: DataFrame, name: str, blobs: bool = False) -> tuple[DataFrame, str]:
    """As ``stored``, with the path, for tables that ``discard`` deletes before the job's end.

    blobs: the rows are large and compressed as they are; Parquet's own compression would hold pages of them outside the heap.
    """
    path = new_folder(df.sparkSession, name)
    with cleaning(df.sparkSession):
        (df.write.option("compression", "none") if blobs else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors, is computed once.

    The table lives until ``drop_stored`` is called; a job may call that once its result is written.
    """
    return written(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_stored(spark: SparkSession) -> None:
    """Deletes what ``stored`` and the archive writers have left of this application in the shared folder."""
    discard(spark, f"{shared_dir(spark)}/cinderplan/{spark.sparkContext.applicationId}")


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows take at most ``most`` bytes; beyond that Spark shuffles it.

    For tables of a few numbers a row. df should be stored or cheap, as it is counted.
    """
    rows = most // (ROW_BYTES + 8 * len(df.columns))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


@functools.cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda pad: 0


def release() -> None:
    """Gives the memory that a Python worker has freed back to the system: workers live on and wait beside others."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def pieces(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of ``column``, a row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From sorted batches, tables of whole groups with the rows at which groups start (and the end).

    A table holds at most a batch and one group more, so memory is bounded by the largest group.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in keys)

    def out() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        return table, np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        end = key(batch, batch.num_rows - 1)
        start = batch.num_rows - 1
        if key(batch, 0) == end:
            start = 0
        else:
            same = np.ones(batch.num_rows, dtype=bool)
            for k, v in zip(keys, end, strict=True):
                same &= batch.column(k).to_numpy(zero_copy_only=False) == v
            start = int(np.argmax(same))
        if held and last is not None and (start > 0 or end != last):
            if start > 0:
                held.append(batch.slice(0, start))
            yield out()
            held = [batch.slice(start)]
        elif start > 0:
            held.append(batch.slice(0, start))
            yield out()
            held = [batch.slice(start)]
        else:
            held.append(batch)
        last = end
    if held:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: (node, root), root the smallest id; alternating large and small stars.

    Every round is a join and an aggregation on node ids, stored; the rounds grow with the logarithm of
    a component's size. No component is ever gathered in one place. Self-loops and null ends are ignored.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        e = stored(large, "edges")
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        star = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(star.unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
