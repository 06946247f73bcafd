import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.errors import BadRequest, Conflict
from tidewell.functions import fixed2
from tidewell.functions.lines import parsed_line
from tidewell.sources import SeriesCatalog, entries_of_json, export_lines, restore, textio, write_export


@pytest.fixture
def catalog(spark, tmp_path):
    return SeriesCatalog(spark, f"file://{tmp_path}/root")


def test_two_decimals_of_the_exact_value(spark):
    rnd = random.Random(1)
    values = [1.005, 0.125, 2.675, -0.001, 0.0, -2.5, 1e14 + 0.125, 123456789.995] + [round(rnd.uniform(-1e6, 1e6), rnd.randrange(6)) for _ in range(500)] + [rnd.uniform(-1e9, 1e9) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed2(F.col("v")).alias("t")).collect()
    for v, text in got:
        assert text == f"{v:.2f}"
    odd = spark.createDataFrame([(math.nan,), (math.inf,), (-math.inf,)], "v double").select(fixed2(F.col("v")).alias("t"))
    assert [r["t"] for r in odd.collect()] == ["NaN", "inf", "-inf"]


def test_lines(spark):
    good = {"7; 0.25": (7, 0.25), " -3 ;\t4e2 ": (-3, 400.0), "5;.5;x": (5, 0.5), "6;7.;": (6, 7.0), "1; 2\r": (1, 2.0), "+8; -inf": (8, -math.inf)}
    bad = ["", "7 0.25", "1", ";", "1;", "1; x", "1; 1d", "ts; value", "1.5; 2", "9223372036854775808; 1", "1; 0x10"]
    got = {r["line"]: r["e"] for r in spark.createDataFrame([(x,) for x in [*good, *bad]], "line string").select("line", parsed_line(F.col("line")).alias("e")).collect()}
    assert {k: tuple(got[k]) for k in good} == good
    assert all(got[k] is None for k in bad)


def test_export(spark):
    df = spark.createDataFrame([(9, 0.5), (4, 8.75), (-1, 5.0)], "ts long, value double")
    assert [r["line"] for r in export_lines(df).collect()] == ["4; 8.75", "9; 0.50"]
    assert export_lines(df, -5).count() == 3


def test_restore(spark, catalog, tmp_path):
    (tmp_path / "x.csv").write_text("7; 0.25\n12; -4")
    restore(catalog, "t", f"file://{tmp_path}/x.csv")
    assert [tuple(r) for r in catalog.reader("t").ordered().collect()] == [(7, 0.25), (12, -4.0)]
    with pytest.raises(Conflict):
        restore(catalog, "t", f"file://{tmp_path}/x.csv")
    (tmp_path / "y.csv").write_text("7 0.25\n12; -4\n")
    with pytest.raises(BadRequest):
        restore(catalog, "u", f"file://{tmp_path}/y.csv")
    assert catalog.list() == ["t"] and catalog.root.names("_staging") == []
    (tmp_path / "z.csv").write_text("")
    restore(catalog, "empty", f"file://{tmp_path}/z.csv")
    assert catalog.reader("empty").scan().count() == 0


def test_late_lines_go_by_chunks_of_ten(spark, catalog, tmp_path):
    (tmp_path / "x.csv").write_text("".join(f"{t}; 1\n" for t in [*range(20, 10, -1), 5, 25, 20]))
    restore(catalog, "t", f"file://{tmp_path}/x.csv")
    assert [r["ts"] for r in catalog.reader("t").ordered().collect()] == [*range(11, 21), 20, 25]
    assert textio.RESTORE_CHUNK == 10


def test_round_trip(spark, catalog, tmp_path):
    rnd = random.Random(4)
    rows = sorted((rnd.randrange(0, 10**12), round(rnd.uniform(-100, 100), 2), i) for i in range(500))
    catalog.create("t")
    catalog.writer("t").append(spark.createDataFrame(rows, "ts long, value double, seq long"))
    write_export(catalog.reader("t"), f"file://{tmp_path}/out")
    restore(catalog, "again", f"file://{tmp_path}/out")
    a, b = (catalog.reader(n).ordered().collect() for n in ("t", "again"))
    assert a == b and len(a) == 500


def test_json_bodies(spark):
    ok = spark.createDataFrame([('{"entries":[{"ts":1000,"value":7},{"ts":1600,"value":9.25}]}',)], "body string")
    assert [tuple(r) for r in entries_of_json(ok).collect()] == [(0, 1000, 7.0), (1, 1600, 9.25)]
    for body in ('{"entries":[{"ts":5,', "{}", '{"entries":[{"ts":1}]}', '{"entries":[{"ts":1.5,"value":2}]}'):
        with pytest.raises(Exception):
            entries_of_json(spark.createDataFrame([(body,)], "body string")).collect()
