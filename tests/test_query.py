import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import bucket, register_aggregate
from tidewell.functions.aggregates import AGGREGATES
from tidewell.operators import counted, json_document, run, tagged_rows
from tidewell.plans import Statement


def ms(text):
    return int(datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.UTC).timestamp()) * 1000


def entries(spark, rows):
    return spark.createDataFrame(rows, "ts long, value double")


def test_hour_means(spark):
    rnd = random.Random(1)
    rows = [(ms("1957-06-03T00:00") + rnd.randrange(40 * 3_600_000), rnd.randrange(-50, 50) / 4) for _ in range(300)]
    start = ms("1957-06-03T05:00")
    want = {}
    for t, v in rows:
        if t >= start:
            want.setdefault(t - t % 3_600_000, []).append(v)
    got = run(entries(spark, rows), Statement.parse(str(start), "hour", "mean", "1000")).collect()
    assert [tuple(r) for r in got] == [(t, pytest.approx(sum(v) / len(v))) for t, v in sorted(want.items())]


def test_buckets_floor_over_all_of_64_bits(spark):
    edge = [0, 1, -1, -(2**63), 2**63 - 1, -3_600_001, ms("1972-01-01T22:59"), ms("1962-01-01T22:32")]
    rnd = random.Random(2)
    values = edge + [rnd.randrange(-(2**63), 2**63) for _ in range(200)]
    for width in (10, 60_000, 3_600_000, 86_400_000):
        got = dict(spark.createDataFrame([(v,) for v in values], "ts long").select("ts", bucket(F.col("ts"), width)).collect())
        for v in values:
            floor = v - v % width
            assert got[v] == (floor if floor >= -(2**63) else v)


def test_limits(spark):
    df = entries(spark, [(i * 60_000, float(i)) for i in range(10)])
    for limit, n in (("0", 0), ("1", 1), ("10", 10), ("11", 10), (str(2**40), 10)):
        got = run(df, Statement.parse("0", "minute", "max", limit)).collect()
        assert [r["ts"] for r in got] == [i * 60_000 for i in range(n)]


def test_repeated_aggregates_and_json(spark):
    statement = Statement.parse("0", "day", "mean,min,max,min", "5")
    rows = run(entries(spark, [(1, 1.0), (2, 4.0)]), statement)
    assert rows.columns == ["ts", "mean", "min", "max", "min_2"]
    assert tuple(rows.first()) == (0, 2.5, 1.0, 4.0, 1.0)
    assert json.loads(json_document(rows, statement).first()["json"]) == {"timestamp": "1970-01-01T00:00:00+00:00", "values": [{"Mean": 2.5}, {"Min": 1.0}, {"Max": 4.0}, {"Min": 1.0}]}


def test_min_and_max_of_odd_values(spark):
    big, nan, inf = 1.7976931348623157e308, math.nan, math.inf
    groups = {0: [nan, 1.0, 2.0], 1: [nan], 2: [inf], 3: [-inf], 4: [inf, -inf, 5.0]}
    df = entries(spark, [(60_000 * k, v) for k, vs in groups.items() for v in vs])
    got = {r["ts"] // 60_000: (r["min"], r["max"]) for r in run(df, Statement.parse("0", "minute", "min,max", "9")).collect()}
    assert got == {0: (1.0, 2.0), 1: (big, -big), 2: (big, inf), 3: (-inf, -big), 4: (-inf, inf)}


def test_json_of_values_that_json_lacks(spark):
    statement = Statement.parse("0", "day", "mean", "5")
    rows = tagged_rows(run(entries(spark, [(1, math.nan)]), statement), statement)
    assert rows.first()["values"][0]["Mean"] is None


def test_empty_input(spark):
    assert run(entries(spark, []), Statement.parse("0", "day", "mean,min,max", "5")).collect() == []


def test_counted_rows(spark):
    df, seen = counted(entries(spark, [(i, 1.0) for i in range(7)]))
    df.collect()
    assert seen.get["n"] == 7


def test_registered_aggregate(spark):
    register_aggregate("spread", lambda v: F.max(v) - F.min(v))
    try:
        assert run(entries(spark, [(1, 1.0), (2, 4.0)]), Statement.parse("0", "day", "spread", "5")).first()["spread"] == 3.0
    finally:
        del AGGREGATES["spread"]
    with pytest.raises(ValueError):
        register_aggregate("a,b", F.max)


def test_filter_reaches_the_scan(spark, tmp_path):
    entries(spark, [(i, 1.0) for i in range(10)]).withColumn("other", F.lit(1)).write.parquet(str(tmp_path / "x"))
    plan = run(spark.read.parquet(str(tmp_path / "x")), Statement.parse("5", "hour", "mean", "3"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,5)" in plan and "ReadSchema: struct<ts:bigint,value:double>" in plan
    assert plan.count("Exchange hashpartitioning") == 1
