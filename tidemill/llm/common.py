"""Helpers shared by the operators: work folders, lineage cuts, Arrow access."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder URI under the cluster's shared ``spark.checkpoint.dir``; it goes when the application ends.

    Only where that setting is unset and all runs in one process (tests), a local temporary folder is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_base()
    base = f"{base.rstrip('/')}/tidemill-{spark.sparkContext.applicationId}"
    if base not in _bases:
        filesystem, path = hadoop(spark, base)
        filesystem.mkdirs(path)
        filesystem.deleteOnExit(path)
        _bases.add(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


_bases: set[str] = set()


@functools.cache
def _local_base() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemill-")


def hadoop(spark: SparkSession, uri: str):
    """(file system, path) of a URI, of whatever store Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


#: Settings of what runs in ``freed``: shuffle files go with their execution; batches for Python are small.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind, and holds little memory beside the heap."""
    before = {k: spark.conf.get(k) for k in LEAN}
    for k, v in LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, path: str, level: int = 3, page: int = 1 << 20) -> DataFrame:
    """``df`` as written to ``path`` and read again; pages of ``page`` bytes are compressed, each by itself."""
    with freed(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", page).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str = "cut", level: int = 3, page: int = 1 << 20) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: ends its lineage there, survives lost executors."""
    return written(df, work_dir(df.sparkSession, name), level, page)


#: Rows of one key beyond which the key's row is sent to all tasks instead of the rows to one.
HOT = 1_000_000


def join_unique(rows: DataFrame, table: DataFrame, key: str, count: str, hot: int | None = None) -> DataFrame:
    """Inner join of rows with a table of one row a key, whose ``count`` says how many of the rows have it.

    Rows of hot keys stay where they are: there are at most (all rows / hot) such keys, so their table
    rows can go to all tasks. The rest meet by key. ``table`` should be a written one, as it is read twice.
    """
    often = table.where(F.col(count) > (HOT if hot is None else hot)).drop(count)
    if often.isEmpty():
        return rows.join(table.drop(count), key)
    often = F.broadcast(often)
    rest = rows.join(often.select(key), key, "left_anti")
    return rows.join(often, key).unionByName(rest.join(table.drop(count), key))


#: Rows of a few numbers that may go to all tasks.
SMALL = 1_000_000


def small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be sent to all tasks if it has at most ``SMALL`` rows; else it meets its partner by key."""
    return F.broadcast(table) if table.count() <= SMALL else table


class Scratch:
    """Named tables of one job in a work folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, work_dir(spark, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            drop_dir(f"{self.folder}/{name}", self.spark)


def drop_dir(uri: str, spark: SparkSession) -> None:
    """Remove a work folder that nothing reads any more."""
    filesystem, path = hadoop(spark, uri)
    filesystem.delete(path, True)


def put_file(uri: str, data: bytes) -> None:
    """Write a file under a temporary name, then move it to ``uri``: a rerun replaces it whole."""
    filesystem, path = pafs.FileSystem.from_uri(uri)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    filesystem.move(temporary, path)


def make_dir(uri: str) -> None:
    filesystem, path = pafs.FileSystem.from_uri(uri)
    filesystem.create_dir(path, recursive=True)


def get_file(uri: str) -> bytes:
    filesystem, path = pafs.FileSystem.from_uri(uri)
    with filesystem.open_input_stream(path, compression=None) as source:
        return source.read()


def tidy() -> None:
    """Give freed memory back to the system: Python workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def give_back(spark: SparkSession) -> None:
    """Executors and driver return the heap that earlier work took: a JVM keeps what it once had, and Python workers run beside it."""
    count = max(spark.sparkContext.defaultParallelism, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size())
    spark.range(0, count, 1, count).selectExpr("reflect('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()
    spark.sparkContext._jvm.System.gc()


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of length n+1 starting at 0, bytes) of a binary or string array; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or data is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return starts - starts[0], np.frombuffer(data, np.uint8)[starts[0] : starts[-1]]


def portions(batches: Iterable[pa.RecordBatch], column: int, size: int = 4 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, and of at most ``size`` bytes in a binary or string column, but for single rows."""
    for batch in batches:
        total, at = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)), 0
        while at < batch.num_rows:
            to = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right"))
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def pieces(batches: Iterable[pa.RecordBatch], rows: int) -> Iterable[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
