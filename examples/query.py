"""Daily means of the generated series, ten times: python examples/query.py ROOT."""

import sys
import time

from pyspark.sql import SparkSession

from tidewell.plans import Statement
from tidewell.sources import SeriesCatalog

if __name__ == "__main__":
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    reader = SeriesCatalog(spark, sys.argv[1]).reader("t")
    statement = Statement.parse("-262000-01-01", "day", "mean", "1000")
    for _ in range(10):
        began = time.perf_counter()
        rows = reader.query(statement).collect()
        print(f"{len(rows)} rows in {time.perf_counter() - began:.2f} s")
