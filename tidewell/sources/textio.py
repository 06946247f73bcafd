"""Entries as lines of text and as JSON: export, restore, append bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.errors import BadRequest
from tidewell.functions.lines import line_of, parsed_line
from tidewell.operators.ingest import numbered
from tidewell.sources.catalog import Commit, SeriesCatalog, SeriesReader

#: Rows of a chunk in a restore.
RESTORE_CHUNK = 10
BODY = "entries array<struct<ts: bigint, value: double>>"


def export_lines(entries: DataFrame, from_ts: int = 0) -> DataFrame:
    """One column, line, of rows (ts, value), ascending by ts, then by batch and seq if there are such columns.

    Entries before from_ts are left out: by default those before 1970. Values keep two decimals.
    """
    order = [c for c in ("ts", "batch", "seq") if c in entries.columns]
    return entries.where(F.col("ts") >= from_ts).orderBy(*order).select(line_of(F.col("ts"), F.col("value")).alias("line"))


def write_export(reader: SeriesReader, path: str, from_ts: int = 0) -> None:
    export_lines(reader.scan(from_ts), from_ts).write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (seq, line, entry) of text files: the numbers of lines over all files by path, and what a line says, null if it's malformed.

    Empty lines are malformed. A last line without line end counts. Splits of a file are told apart, so files of any size are read in parallel.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    found = numbered(lines, ["_path", "_block", "_at"]).select("seq", "line")
    return found.withColumn("entry", parsed_line(F.col("line")))


def restore(catalog: SeriesCatalog, name: str, path: str, chunk: int = RESTORE_CHUNK) -> Commit:
    """Make a series of exported lines. Conflict if the name is taken, BadRequest if a line is malformed; then nothing is left of it.

    Late entries are dropped chunk by chunk, so sorted lines are kept whole.
    """
    with catalog.staged(name) as writer:
        lines = read_lines(catalog.spark, path)
        bad = lines.where(F.col("entry").isNull()).limit(1).collect()
        if bad:
            raise BadRequest(f"line {bad[0]['seq'] + 1} is malformed")
        commit = writer.append_in_chunks(lines.select("entry.ts", "entry.value", "seq"), chunk)
    return commit


def entries_of_json(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Rows (seq, ts, value) of JSON documents {"entries": [{"ts": ..., "value": ...}]}, a document a row.

    A malformed document, a missing list, and a missing or null field fail the query.
    """
    parsed = F.from_json(F.col(column), BODY, {"mode": "FAILFAST"})
    listed = F.when(parsed["entries"].isNotNull(), parsed["entries"]).otherwise(F.raise_error(F.lit("entries are missing")).cast("array<struct<ts: bigint, value: double>>"))
    rows = bodies.select(F.posexplode(listed).alias("seq", "e"))
    needed = F.when(F.col("e.ts").isNotNull() & F.col("e.value").isNotNull(), F.col("e")).otherwise(F.raise_error(F.lit("a field is missing")).cast("struct<ts: bigint, value: double>"))
    return rows.select(F.col("seq").cast("long").alias("seq"), needed.alias("e")).select("seq", "e.ts", "e.value")
