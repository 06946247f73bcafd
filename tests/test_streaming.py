from tidewell.sources import SeriesCatalog
from tidewell.streaming import append_stream


def test_micro_batches_are_commits(spark, tmp_path):
    catalog = SeriesCatalog(spark, f"file://{tmp_path}/root")
    schema = "ts long, value double"

    def feed(number, *rows):
        spark.createDataFrame([(t, float(v)) for t, v in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{number}")

    def drain():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        query = append_stream(stream, catalog, "t", "q").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(120)

    feed(1, (5, 1), (3, 2))
    drain()
    feed(2, (4, 9), (5, 3), (8, 4))
    drain()
    assert [tuple(r) for r in catalog.reader("t").ordered().collect()] == [(3, 2.0), (5, 1.0), (5, 3.0), (8, 4.0)]
    assert catalog.reader("t").snapshot().version == 2
