"""Append a generated series in one commit, and print how long it took: python examples/append.py ROOT [ENTRIES]."""

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewell.plans.statement import parse_from
from tidewell.sources import SeriesCatalog

if __name__ == "__main__":
    root, n = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 100_000_000
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog = SeriesCatalog(spark, root)
    catalog.create("t")
    start = parse_from("-262000-01-01")
    entries = spark.range(n).select((F.lit(start) + F.col("id") * 1000).alias("ts"), (F.col("id") % 3 + 1).cast("double").alias("value"), F.col("id").alias("seq"))
    began = time.perf_counter()
    commit = catalog.writer("t").append(entries)
    print(f"{commit.rows} entries in {time.perf_counter() - began:.1f} s")
