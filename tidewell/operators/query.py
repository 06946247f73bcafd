"""The query: scan from a time, bucket, aggregate, order, limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewell.functions.aggregates import aggregate_columns, result_names
from tidewell.functions.buckets import bucket, rfc3339
from tidewell.plans.statement import Statement

#: Limits from here on are no limit: Spark's own is a 32-bit integer.
NO_LIMIT = 2**31 - 1


def scan(df: DataFrame, from_ts: int, until_ts: int | None = None) -> DataFrame:
    """Entries from from_ts on, and before until_ts if given; both reach a Parquet scan as pushed filters."""
    out = df.where(F.col("ts") >= F.lit(from_ts).cast("long"))
    return out if until_ts is None else out.where(F.col("ts") < F.lit(until_ts).cast("long"))


def run(df: DataFrame, statement: Statement, until_ts: int | None = None) -> DataFrame:
    """Rows (ts, an aggregate column each) of the earliest buckets, ascending.

    df needs ts and value, in any order. Buckets without entries give no row.
    Partial sums are taken before the one shuffle, so what moves is a row a bucket
    and task. until_ts may come from limit_bound() of a store.
    """
    rows = scan(df, statement.from_ts, until_ts).select(bucket(F.col("ts"), statement.group_by_ms).alias("ts"), "value")
    rows = rows.groupBy("ts").agg(*aggregate_columns(statement.aggregators)).orderBy("ts")
    return rows.limit(statement.limit) if statement.limit < NO_LIMIT else rows


def tagged_rows(rows: DataFrame, statement: Statement) -> DataFrame:
    """Rows (timestamp, values) of run()'s rows: values is an array of structs, each with the one field of its aggregate set."""
    tags = list(dict.fromkeys(n.capitalize() for n in statement.aggregators))
    cells = []
    for name, column in zip(statement.aggregators, result_names(statement.aggregators), strict=True):
        shown = F.when(~F.isnan(column) & (F.abs(F.col(column)) != float("inf")), F.col(column))
        cells.append(F.struct(*[(shown if t == name.capitalize() else F.lit(None).cast("double")).alias(t) for t in tags]))
    return rows.select(rfc3339(F.col("ts")).alias("timestamp"), F.array(*cells).alias("values"))


def json_document(rows: DataFrame, statement: Statement) -> DataFrame:
    """One JSON line for each row: {"timestamp": ..., "values": [{"Mean": ...}, ...]}."""
    return tagged_rows(rows, statement).select(F.to_json(F.struct("timestamp", "values")).alias("json"))


def counted(df: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """df, and an observation that has the number of its rows in `n` once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen
