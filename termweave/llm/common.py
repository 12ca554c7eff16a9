"""Shared plumbing of the corpus operators: reading, the shared folder, text chunks."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 18
#: A key with this share of the rows, and so many rows at least, is not dealt to one task.
HOT_KEYS, LEAST_HOT = 10_000, 100


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Read one table of a data folder through Spark, whatever store it is in."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Return the folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, is a temporary folder made and used instead; a cluster without it is
    refused, since each executor would write to its own disk.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="termweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """Return a new path in the shared folder; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/termweave/{label}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass

    atexit.register(clean)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage.

    The rows survive the loss of any executor and are computed once however often
    they are used.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held._written = path
    return held


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing will read again."""
    for df in tables:
        delete(df.sparkSession, df._written)


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Join rows with the one row of their key where few keys may hold most of the rows.

    ``right`` has each key once, with the number of its rows on the left as ``size``.
    Keys with a HOT_KEYS-th of all ``total`` rows or more are fewer than HOT_KEYS, so
    they are sent to all tasks and their rows stay where they are; only the rest is
    dealt by key.
    """
    least = max(LEAST_HOT, total // HOT_KEYS)
    hot = right.where(F.col(size) >= least)
    met = left.join(F.broadcast(hot), key)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(size) < least), key)
    return met.unionByName(cold)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Return (bytes, offsets) of a string or binary Arrow array; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.binary() if pa.types.is_large_binary(column.type) else pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends


def runs(ends: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Split rows into ranges of about ``most`` bytes; a longer row stands alone."""
    row, last = 0, len(ends) - 1
    while row < last:
        stop = int(np.searchsorted(ends, ends[row] + most, side="right")) - 1
        stop = min(max(stop, row + 1), last)
        yield row, stop
        row = stop


def salted(spark: SparkSession, least: int = 1) -> int:
    """Return how many partitions a keyed exchange gets here."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def package_path(name: str) -> str:
    """Return where the public tokenizer files of this machine lie."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
