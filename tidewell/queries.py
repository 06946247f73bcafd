"""Queries over the driver's tables, a few for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import bucket, register_aggregate, rfc3339
from tidewell.functions.aggregates import aggregate_columns
from tidewell.operators import block_index, chunked, counted, first_block_at, late_filter_batches, numbered, run, scan, tagged_rows
from tidewell.plans import GROUP_BY_MS, Statement
from tidewell.sources import SeriesCatalog, entries_of_json, export_lines, read_lines, restore, write_export
from tidewell.scratch import scratch_path
from tidewell.streaming import append_stream

Query = Callable[[SparkSession, str], DataFrame]
HOUR, DAY, SIXTY_YEARS = GROUP_BY_MS["hour"], GROUP_BY_MS["day"], 1_893_456_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as entries: series, seq, ts, value, user_id. Only the columns that a query uses are read."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("event_type").alias("series"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), "value", "user_id")


def _aggregate(from_: str, group_by: str, aggregators: str, limit: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = run(events(spark, sf_dir), Statement.parse(from_, group_by, aggregators, limit))
        return rows.withColumn("mean", F.round("mean", 6)) if "mean" in rows.columns else rows

    return query


def _aggregate_sql(where: str, width: int, columns: str, limit: int) -> str:
    return f"WITH {EVENTS} SELECT ts - ts % {width} AS ts, {columns} FROM e WHERE {where} GROUP BY 1 ORDER BY 1 LIMIT {limit}"


def scan_from_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(events(spark, sf_dir), 1_704_844_800_000).select("seq", "ts", "value")


def scan_after_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(events(spark, sf_dir), 4_102_444_800_000).select("seq", "ts", "value")


def bucket_negative_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select((F.col("ts") - SIXTY_YEARS).alias("ts"), "value")
    return run(rows, Statement.of(group_by_ms=DAY, aggregators=("min", "max"), limit=10_000))


def bucket_every_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts") - SIXTY_YEARS
    return events(spark, sf_dir).select("seq", *[bucket(ts, w).alias(name) for name, w in GROUP_BY_MS.items()])


def series_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user as a series: daily aggregates of all of them in one pass."""
    rows = events(spark, sf_dir).groupBy("user_id", bucket(F.col("ts"), DAY).alias("ts")).agg(*aggregate_columns(("mean", "max")))
    return rows.withColumn("mean", F.round("mean", 6))


def registered_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_aggregate("range", lambda v: F.max(v) - F.min(v))
    rows = run(events(spark, sf_dir), Statement.parse("0", "hour", "range,max", "100000000"))
    return rows.withColumn("range", F.round("range", 6))


def counted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries a query has read, told by the query itself."""
    rows, seen = counted(scan(events(spark, sf_dir), 1_704_844_800_000))
    run(rows, Statement.parse("0", "day", "max", "100000000")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"],)], "n long")


def _jittered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts") - ((F.col("seq") * 7919) % 7) * 600_000
    return events(spark, sf_dir).select("seq", ts.alias("ts"), "value", F.floor(F.col("seq") / 10).alias("batch"))


def late_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_filter_batches(_jittered(spark, sf_dir)).select("seq", "ts", "value")


def equal_ts_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("seq", bucket(F.col("ts"), HOUR).alias("ts"), "value", F.floor(F.col("seq") / 10).alias("batch"))
    return late_filter_batches(rows).select("seq", "ts", "value")


def _chunks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("seq").alias("event_id"), "ts", "value")
    return chunked(numbered(rows, ["event_id"]), size)


def chunks_of_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, 10).groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"))


def index_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_index(_chunks(spark, sf_dir, 100))


def index_first_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_block_at(block_index(_chunks(spark, sf_dir, 100)), 1_705_000_000_000)


def _stored(spark: SparkSession, sf_dir: str) -> SeriesCatalog:
    """A catalog with one series: events in three appends that overlap, of which the second is late in part and the third, of all events, but for its end."""
    catalog = SeriesCatalog(spark, scratch_path(spark, "catalog"))
    catalog.create("events")
    rows = events(spark, sf_dir).select("ts", "value", "seq")
    for part in (F.col("ts") < 1_705_000_000_000, F.col("ts") >= 1_704_950_000_000, F.lit(True)):
        catalog.writer("events").append(rows.where(part))
    return catalog


def append_then_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).reader("events").scan().select("seq", "ts", "value")


def stored_query_with_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).reader("events").query(Statement.parse("2024-01-03", "hour", "min,max", "20"))


def orders_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another table as a series: many entries of one ts, and arrival that isn't sorted."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = rows.select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_totalprice").alias("value"))
    return run(rows, Statement.of(group_by_ms=DAY, aggregators=("min", "max"), limit=10_000))


def export_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_lines(events(spark, sf_dir))


def export_skips_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return export_lines(rows.withColumn("ts", F.col("ts") - SIXTY_YEARS))


def export_and_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _stored(spark, sf_dir)
    path = scratch_path(spark, "export")
    write_export(catalog.reader("events"), path)
    restore(catalog, "again", path)
    return catalog.reader("again").scan().select("ts", "value")


def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with spaces, further fields and malformed ones, as a restore reads them."""
    rows = events(spark, sf_dir)
    kind = F.col("seq") % 4
    line = F.when(kind == 0, F.concat(F.lit(" "), "ts", F.lit(" ;"), F.col("seq").cast("string"), F.lit(".5 ; more"))).when(kind == 1, F.concat("ts", F.lit("; x"))).when(kind == 2, F.col("ts").cast("string")).otherwise(F.concat("ts", F.lit(";"), F.col("seq").cast("string")))
    path = scratch_path(spark, "lines")
    rows.select(line).write.text(path)
    return read_lines(spark, path).groupBy(F.col("entry").isNotNull().alias("valid")).agg(F.count(F.lit(1)).alias("rows"), F.sum("entry.value").alias("total"))


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = Statement.parse("2024-01-03", "hour", "min,max,min", "50")
    rows = tagged_rows(run(events(spark, sf_dir), statement), statement)
    cell = F.col("values")
    return rows.select("timestamp", cell[0]["Min"].alias("first_min"), cell[1]["Max"].alias("max"), cell[2]["Min"].alias("second_min"))


def times_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = bucket(F.col("ts"), 1000) - SIXTY_YEARS
    return events(spark, sf_dir).select("seq", rfc3339(ts).alias("timestamp"))


def catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = SeriesCatalog(spark, scratch_path(spark, "catalog"))
    for row in events(spark, sf_dir).select("series").distinct().collect():  # the names of event types
        catalog.create(row["series"])
        catalog.create(row["series"])
    return catalog.listed()


def renamed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = SeriesCatalog(spark, scratch_path(spark, "catalog"))
    for row in events(spark, sf_dir).select("series").distinct().collect():  # the names of event types
        catalog.create(row["series"])
        catalog.rename(row["series"], f"{row['series']}.old")
        catalog.rename(row["series"], "nothing")
    return catalog.listed()


def json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as bodies of requests, a hundred each, and read back."""
    entries = F.to_json(F.struct(F.collect_list(F.struct("ts", "value")).alias("entries"))).alias("body")
    bodies = events(spark, sf_dir).groupBy(F.floor(F.col("seq") / 100)).agg(entries)
    return entries_of_json(bodies).select("ts", "value")


def one_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several appends, one commit: each is filtered by those before it."""
    catalog = SeriesCatalog(spark, scratch_path(spark, "catalog"))
    catalog.create("events")
    rows = events(spark, sf_dir).select("ts", "value", "seq")
    with catalog.writer("events").transaction() as tx:
        for until in (1_704_700_000_000, 1_704_900_000_000, 1_705_100_000_000, 4_102_444_800_000):
            tx.append(rows.where(F.col("ts") < until))
    reader = catalog.reader("events")
    return reader.scan().select("seq", "ts", "value", F.lit(reader.snapshot().version).cast("long").alias("version"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come as a stream of files, appended micro-batch by micro-batch."""
    catalog, path = SeriesCatalog(spark, scratch_path(spark, "catalog")), scratch_path(spark, "stream")
    events(spark, sf_dir).select("ts", "value", "seq").write.parquet(path)
    stream = spark.readStream.schema("ts long, value double, seq long").parquet(path)
    append_stream(stream, catalog, "events", "q").option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return catalog.reader("events").scan().select("seq", "ts", "value")


def queries() -> dict[str, Query]:
    return {
        "agg_mean_hour": _aggregate("2024-01-03", "hour", "mean", "1000"),
        "agg_min_minute": _aggregate("0", "minute", "min", "100000000"),
        "agg_max_day": _aggregate("2024-01-01", "day", "max", "1000"),
        "agg_multi_dup": _aggregate("2024-01-10", "hour", "mean,min,max,min", "1000"),
        "limit_first_buckets": _aggregate("1704844800000", "hour", "max", "7"),
        "limit_zero": _aggregate("0", "hour", "max", "0"),
        "scan_from_millis": scan_from_millis,
        "scan_after_end": scan_after_end,
        "bucket_negative_ts": bucket_negative_ts,
        "bucket_every_width": bucket_every_width,
        "series_of_users": series_of_users,
        "registered_aggregate": registered_aggregate,
        "counted_scan": counted_scan,
        "orders_by_day": orders_by_day,
        "late_batches": late_batches,
        "equal_ts_kept": equal_ts_kept,
        "chunks_of_ten": chunks_of_ten,
        "index_of_blocks": index_of_blocks,
        "index_first_block": index_first_block,
        "append_then_scan": append_then_scan,
        "stored_query_with_limit": stored_query_with_limit,
        "export_of_events": export_of_events,
        "export_skips_negative": export_skips_negative,
        "export_and_restore": export_and_restore,
        "parse_lines": parse_lines,
        "json_rows": json_rows,
        "times_rendered": times_rendered,
        "catalog_list": catalog_list,
        "renamed_series": renamed_series,
        "json_bodies": json_bodies,
        "one_transaction": one_transaction,
        "streamed": streamed,
    }


EVENTS = "e AS (SELECT event_type AS series, event_id AS seq, epoch_us(ts) // 1000 AS ts, value, user_id FROM events)"
_JITTERED = "j AS (SELECT seq, ts - ((seq * 7919) % 7) * 600000 AS ts, value, seq // 10 AS batch FROM e)"
_COARSE = f"j AS (SELECT seq, ts - ts % {HOUR} AS ts, value, seq // 10 AS batch FROM e)"
_LATE = "tops AS (SELECT batch, max(ts) AS top FROM j GROUP BY batch), marks AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM tops) SELECT seq, ts, value FROM j JOIN marks USING (batch) WHERE mark IS NULL OR ts >= mark"
_STORED = "a AS (SELECT * FROM e WHERE ts < 1705000000000), b AS (SELECT * FROM e WHERE ts >= 1704950000000 AND ts >= (SELECT max(ts) FROM a)), ab AS (SELECT * FROM a UNION ALL SELECT * FROM b), s AS (SELECT * FROM ab UNION ALL SELECT * FROM e WHERE ts >= (SELECT max(ts) FROM ab))"
_STEPS = "a AS (SELECT * FROM e WHERE ts < 1704700000000), b AS (SELECT * FROM e WHERE ts < 1704900000000 AND ts >= coalesce((SELECT max(ts) FROM a), ts)), ab AS (SELECT * FROM a UNION ALL SELECT * FROM b), c AS (SELECT * FROM e WHERE ts < 1705100000000 AND ts >= coalesce((SELECT max(ts) FROM ab), ts)), abc AS (SELECT * FROM ab UNION ALL SELECT * FROM c), d AS (SELECT * FROM e WHERE ts >= coalesce((SELECT max(ts) FROM abc), ts)), s AS (SELECT * FROM abc UNION ALL SELECT * FROM d)"


def _floored(ts: str, width: int) -> str:
    return f"{ts} - ((({ts}) % {width}) + {width}) % {width}"


def oracle_sql() -> dict[str, str]:
    shifted = f"(ts - {SIXTY_YEARS})"
    numbered_ = "n AS (SELECT seq, ts, value, (row_number() OVER (ORDER BY seq) - 1) AS i FROM e)"
    blocks = f"WITH {EVENTS}, {numbered_}, c AS (SELECT *, i // 100 AS chunk FROM n), x AS (SELECT chunk, count(*) AS rows, min(ts) AS lowest_ts, max(ts) AS highest_ts FROM c GROUP BY chunk)"
    return {
        "agg_mean_hour": _aggregate_sql("ts >= 1704240000000", HOUR, "round(avg(value), 6) AS mean", 1000),
        "agg_min_minute": _aggregate_sql("ts >= 0", GROUP_BY_MS["minute"], "min(value) AS min", 100_000_000),
        "agg_max_day": _aggregate_sql("ts >= 1704067200000", DAY, "max(value) AS max", 1000),
        "agg_multi_dup": _aggregate_sql("ts >= 1704844800000", HOUR, "round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, min(value) AS min_2", 1000),
        "limit_first_buckets": _aggregate_sql("ts >= 1704844800000", HOUR, "max(value) AS max", 7),
        "limit_zero": _aggregate_sql("ts >= 0", HOUR, "max(value) AS max", 0),
        "scan_from_millis": f"WITH {EVENTS} SELECT seq, ts, value FROM e WHERE ts >= 1704844800000",
        "scan_after_end": f"WITH {EVENTS} SELECT seq, ts, value FROM e WHERE ts >= 4102444800000",
        "bucket_negative_ts": f"WITH {EVENTS} SELECT {_floored(shifted, DAY)} AS ts, min(value) AS min, max(value) AS max FROM e GROUP BY 1 ORDER BY 1 LIMIT 10000",
        "bucket_every_width": f"WITH {EVENTS} SELECT seq, " + ", ".join(f"{_floored(shifted, w)} AS {n}" for n, w in GROUP_BY_MS.items()) + " FROM e",
        "series_of_users": f"WITH {EVENTS} SELECT user_id, ts - ts % {DAY} AS ts, round(avg(value), 6) AS mean, max(value) AS max FROM e GROUP BY 1, 2",
        "registered_aggregate": f'WITH {EVENTS} SELECT ts - ts % {HOUR} AS ts, round(max(value) - min(value), 6) AS "range", max(value) AS max FROM e WHERE ts >= 0 GROUP BY 1',
        "counted_scan": f"WITH {EVENTS} SELECT count(*) AS n FROM e WHERE ts >= 1704844800000",
        "orders_by_day": f"WITH o AS (SELECT epoch_us(o_orderdate) // 1000 AS ts, o_totalprice AS value FROM orders) SELECT ts - ts % {DAY} AS ts, min(value) AS min, max(value) AS max FROM o GROUP BY 1 ORDER BY 1 LIMIT 10000",
        "late_batches": f"WITH {EVENTS}, {_JITTERED}, {_LATE}",
        "equal_ts_kept": f"WITH {EVENTS}, {_COARSE}, {_LATE}",
        "chunks_of_ten": f"WITH {EVENTS}, {numbered_}, c AS (SELECT *, i // 10 AS chunk FROM n) SELECT chunk, count(*) AS rows, sum(seq)::BIGINT AS ids FROM c GROUP BY chunk",
        "index_of_blocks": f"{blocks} SELECT chunk, rows, lowest_ts, highest_ts FROM x",
        "index_first_block": f"{blocks} SELECT min(chunk) AS chunk FROM x WHERE highest_ts >= 1705000000000",
        "append_then_scan": f"WITH {EVENTS}, {_STORED} SELECT seq, ts, value FROM s",
        "stored_query_with_limit": f"WITH {EVENTS}, {_STORED} SELECT ts - ts % {HOUR} AS ts, min(value) AS min, max(value) AS max FROM s WHERE ts >= 1704240000000 GROUP BY 1 ORDER BY 1 LIMIT 20",
        "export_of_events": f"WITH {EVENTS} SELECT ts || '; ' || printf('%.2f', value) AS line FROM e WHERE ts >= 0 ORDER BY ts, seq",
        "export_skips_negative": f"WITH {EVENTS} SELECT ts || '; ' || printf('%.2f', value) AS line FROM e WHERE {shifted} >= 0",
        "export_and_restore": f"WITH {EVENTS}, {_STORED} SELECT ts, value FROM s",
        "parse_lines": f"WITH {EVENTS} SELECT seq % 4 IN (0, 3) AS valid, count(*) AS rows, sum(CASE WHEN seq % 4 = 0 THEN seq + 0.5 WHEN seq % 4 = 3 THEN seq END)::DOUBLE AS total FROM e GROUP BY 1",
        "json_rows": f"WITH {EVENTS}, b AS (SELECT ts - ts % {HOUR} AS ts, min(value) AS low, max(value) AS high FROM e WHERE ts >= 1704240000000 GROUP BY 1 ORDER BY 1 LIMIT 50) SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp, low AS first_min, high AS max, low AS second_min FROM b",
        "times_rendered": f"WITH {EVENTS} SELECT seq, strftime(make_timestamp((ts - ts % 1000 - {SIXTY_YEARS}) * 1000), '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp FROM e",
        "catalog_list": "SELECT DISTINCT event_type AS series FROM events ORDER BY 1",
        "renamed_series": "SELECT DISTINCT event_type || '.old' AS series FROM events",
        "json_bodies": f"WITH {EVENTS} SELECT ts, value FROM e",
        "one_transaction": f"WITH {EVENTS}, {_STEPS} SELECT seq, ts, value, 1::BIGINT AS version FROM s",
        "streamed": f"WITH {EVENTS} SELECT seq, ts, value FROM e",
    }
