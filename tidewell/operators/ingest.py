"""Ingest: late entries, arrival numbers, chunks, and the index of blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.scratch import materialize

#: Batches whose running maximum one task orders.
GROUP = 10_000


def late_filter(df: DataFrame, highest_ts: int | None) -> DataFrame:
    """Of one batch, the entries at or after the high-water mark; all if there is none."""
    return df if highest_ts is None else df.where(F.col("ts") >= F.lit(highest_ts).cast("long"))


def running_max(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """df, one row for each integer of order, with the greatest value of all earlier rows, null for the first.

    Rows are dealt in groups of neighbours; only one maximum a group is ordered by one task.
    """
    rows = df.withColumn("_group", F.floor(F.col(order) / GROUP))
    earlier = Window.unboundedPreceding, -1
    tops = rows.groupBy("_group").agg(F.max(value).alias("_top"))
    tops = tops.select("_group", F.max("_top").over(Window.orderBy("_group").rowsBetween(*earlier)).alias("_before"))
    inside = F.max(value).over(Window.partitionBy("_group").orderBy(order).rowsBetween(*earlier))
    return rows.withColumn("_inside", inside).join(tops, "_group").withColumn(out, F.greatest("_before", "_inside")).drop("_group", "_before", "_inside")


def late_filter_batches(df: DataFrame, batch: str = "batch") -> DataFrame:
    """What is kept of many batches that arrive in the order of an integer column.

    An entry is kept if its ts is at least the greatest ts of all earlier batches.
    That equals the mark of kept entries alone, as an entry above the mark is kept.
    The marks are a row a batch; entries are joined to them and not ordered.
    """
    marks = running_max(df.groupBy(batch).agg(F.max("ts").alias("_highest")), batch, "_highest", "_mark")
    kept = df.join(marks.select(batch, "_mark"), batch)
    return kept.where(F.col("_mark").isNull() | (F.col("ts") >= F.col("_mark"))).select(*df.columns)


def numbered(df: DataFrame, order: Sequence[str | Column], out: str = "seq") -> DataFrame:
    """df with the number of each row, from 0, in a total order of columns.

    Rows are range-partitioned and written once; a row's number is its place in
    its partition after the sizes of the partitions before, which are few numbers.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = materialize(placed.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND((1 << 33) - 1)), "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    return placed.join(bases, "_part").withColumn(out, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def chunked(df: DataFrame, size: int, seq: str = "seq", out: str = "chunk") -> DataFrame:
    """df with the number of its chunk: size rows each by arrival, the last one shorter."""
    if size < 1:
        raise ValueError("a chunk holds at least one row")
    return df.withColumn(out, F.floor(F.col(seq) / size).cast("long"))


def block_index(df: DataFrame, chunk: str = "chunk") -> DataFrame:
    """(chunk, rows, lowest_ts, highest_ts) of each chunk."""
    return df.groupBy(chunk).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("lowest_ts"), F.max("ts").alias("highest_ts"))


def first_block_at(index: DataFrame, ts: int, chunk: str = "chunk") -> DataFrame:
    """The first chunk whose highest_ts is at least ts; null if there is none."""
    return index.where(F.col("highest_ts") >= F.lit(ts).cast("long")).agg(F.min(chunk).alias(chunk))
