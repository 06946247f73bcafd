"""A Structured Streaming sink: every micro-batch is one commit of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tidewell.sources.catalog import SeriesCatalog


def append_stream(stream: DataFrame, catalog: SeriesCatalog, name: str, query_id: str) -> DataStreamWriter:
    """A writer of stream (ts, value) into a series; start() it with a checkpointLocation.

    The high-water mark takes late entries out as in any append: entries equal to it
    stay, and there is no delay, which is why no watermark is used. The commit keeps
    query_id and the number of the micro-batch, so one that Spark replays after a
    failure is not appended again.
    """
    catalog.create(name)

    def commit(batch: DataFrame, number: int) -> None:
        catalog.writer(name).append(batch, token=f"{query_id}:{number}")

    return stream.writeStream.foreachBatch(commit)
