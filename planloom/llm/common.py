"""Shared helpers: scratch tables in the cluster's shared folder, and narrow views of input tables."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: Words are runs of anything but ASCII white space (Java, RE2 and Python agree on this class).
WORD = r"[^\x20\x09-\x0D]+"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends in good order."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append((name, path))
    return spark.read.schema(df.schema).parquet(path)


#: Scratch tables of the scopes that are open, the innermost last.
_scopes: list[list[tuple[str, str]]] = []


@contextmanager
def temporary(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Scratch tables written within are deleted at the end, but for those of the names ``kept``; shuffles that only led
    to them go as well, with the driver's next collection of garbage, which is asked for, as are the executors'."""
    _scopes.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        held = _scopes.pop()
        for name, path in held:
            if name in kept:
                if _scopes:
                    _scopes[-1].append((name, path))
                continue
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        gc.collect()
        jvm.System.gc()
        shrink_heaps(spark)


def shrink_heaps(spark: SparkSession) -> None:
    """A full collection in each executor's JVM, whose heap then goes back to what it holds.

    A heap that joins and sorts have grown stays at its limit otherwise, and the Python workers of the next step come on
    top of it.  There is a task for each executor, and idle ones get one each; one that gets none keeps its heap.
    """
    executors = max(1, len(spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()) - 1)  # the driver is listed too
    spark.range(0, executors, 1, executors).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def drop_scratch(df: DataFrame) -> None:
    """Delete a scratch table that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return free memory to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator, rows: int = 1000) -> Iterator:
    """Arrow batches in parts of at most that many rows: what a worker holds as Python objects at a time.

    At the end, memory that is free goes back to the system.
    """
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()


def text_slices(batches: Iterator, column: int | str, rows: int = 1000, size: int = 8 << 20) -> Iterator:
    """Arrow batches in parts of at most that many rows whose texts have at most ``size`` bytes; a longer text is alone."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        k = 0
        while k < batch.num_rows:
            before = total[k - 1] if k else 0
            end = max(k + 1, min(k + rows, int(np.searchsorted(total, before + size, "right"))))
            yield batch.slice(k, end - k)
            k = end
    give_back()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and bare path of a URI, on the driver or an executor."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.removeprefix("file:").replace("///", "/", 1)
    return pafs.FileSystem.from_uri(uri)


#: Rows of an Arrow batch, at most: whole texts go to Python workers some megabytes at a time.
BATCH_ROWS = 1000


def bounded_batches(rows: DataFrame) -> DataFrame:
    """``rows``; from here on the session's Arrow batches have at most ``BATCH_ROWS`` rows.

    A batch stands in the executor's direct memory and in the worker's at a time, so its size bounds both.
    """
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return rows


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (string), whatever else the table holds."""
    return bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def smallest_hashes(rows: DataFrame, group: str, n: int, seed: int, key: str = "doc_id", salts: int = 64) -> DataFrame:
    """Of each group the n rows with the smallest seeded hash of their key: a sample that no order of rows changes.

    A first cut is made within slices of each group, so that what meets in one task for a group is n rows of each
    slice at most, however many rows or partitions there are.
    """
    hashed = rows.withColumn("__h", F.xxhash64(F.lit(seed), key)).withColumn("__s", F.pmod(F.xxhash64(key), F.lit(salts)))
    for by in ((group, "__s"), (group,)):
        order = Window.partitionBy(*by).orderBy("__h", key)
        hashed = hashed.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n)
    return hashed.drop("__h", "__s", "__n")


#: Rows of two longs that may be sent to every task: some 100 MB there, 2 x 16 MB on the wire.
BROADCAST_ROWS = 2_000_000


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not among the distinct ids of ``gone`` (one column); rows without id stay.

    The ids are written and counted first.  Up to ``BROADCAST_ROWS`` go to every task, so that no text crosses the
    network; more are joined by shuffle.
    """
    ids = scratch(gone.toDF("__gone").distinct(), "gone")
    small = ids.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str = "text"):
    """Number of words of a text column, 0 for null, on the JVM alone.

    A word starts where a non-blank byte follows a blank or the start, so it is enough to delete all that follows
    a word's first character and count what is left that is not blank.
    """
    cleaned = F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(cleaned, " ", -1), lambda w: w != "")), F.lit(0)).cast("long")
