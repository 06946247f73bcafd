"""What the operators share: table reading, scratch tables, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.scratch import materialize, scratch_path

__all__ = ["materialize", "scratch_path"]

#: A word is a run of anything but ASCII white space, in Java's regex syntax.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_tidewell_path", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


#: A side of at most so many rows of a few numbers is broadcast (32 MB or so); a larger one is shuffled.
BROADCAST_ROWS = 2_000_000


def join_checked(df: DataFrame, keys: DataFrame, on: list[str], how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """df joined to a materialised table of narrow rows, which is broadcast only if counted to be small."""
    return df.join(F.broadcast(keys) if keys.count() <= most else keys.hint("shuffle_hash"), on, how)


def null_safe_key(name: str) -> list[Column]:
    """Columns to join on instead of a nullable long column: nulls meet nulls."""
    return [F.col(name).isNull().alias("_key_null"), F.coalesce(F.col(name), F.lit(0)).cast("long").alias("_key")]


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, several to an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def text_slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into slices of about max_bytes of text; null text is empty.

    A slice holds at least one row, so one very long text is a slice of its own. After
    the last one, memory is given back.
    """
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and held + n > max_bytes:
                part = batch.slice(start, i - start)
                yield part, [x or "" for x in part.column(column).to_pylist()]
                start, held = i, 0
            held += int(n)
        if start < len(lengths):
            part = batch.slice(start)
            yield part, [x or "" for x in part.column(column).to_pylist()]
    give_back()


#: Rows of an Arrow batch of whole texts: Spark's own 10,000 of a few kilobytes each are tens of megabytes on both sides of a Python worker.
BATCH_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """df, about to be mapped in Arrow batches: of BATCH_ROWS rows, unless the session asks for fewer."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df
