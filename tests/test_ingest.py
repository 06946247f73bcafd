import random

from tidewell.operators import block_index, chunked, first_block_at, ingest, late_filter, late_filter_batches, numbered


def simulate(batches):
    mark, kept = None, []
    for batch in batches:
        good = [e for e in batch if mark is None or e[0] >= mark]
        kept += sorted(good, key=lambda e: e[0])
        mark = max([e[0] for e in good] + ([mark] if mark is not None else []), default=None)
    return kept


def test_late_filter(spark):
    df = spark.createDataFrame([(1, 1.0), (5, 2.0), (7, 3.0)], "ts long, value double")
    assert sorted(r["ts"] for r in late_filter(df, 5).collect()) == [5, 7]
    assert late_filter(df, None).count() == 3


def test_many_batches_equal_a_simulation(spark, monkeypatch):
    monkeypatch.setattr(ingest, "GROUP", 7)
    rnd = random.Random(3)
    batches = [[(rnd.randrange(i * 3, i * 3 + 40), float(rnd.random())) for _ in range(rnd.randrange(0, 6))] for i in range(60)]
    rows = [(ts, v, i) for i, batch in enumerate(batches) for ts, v in batch]
    got = late_filter_batches(spark.createDataFrame(rows, "ts long, value double, batch long"))
    assert sorted((r["ts"], r["value"]) for r in got.collect()) == sorted(simulate(batches))


def test_numbers_and_chunks(spark):
    df = spark.range(100).selectExpr("id * 37 % 101 as k")
    got = sorted(map(tuple, chunked(numbered(df, ["k"]), 3).select("k", "seq", "chunk").collect()))
    assert got == [(k, i, i // 3) for i, k in enumerate(sorted(i * 37 % 101 for i in range(100)))]


def test_chunks_of_eight_rows(spark):
    df = chunked(spark.range(8).selectExpr("id as seq", "id + 1 as ts"), 3)
    assert [tuple(r) for r in block_index(df).orderBy("chunk").collect()] == [(0, 3, 1, 3), (1, 3, 4, 6), (2, 2, 7, 8)]


def test_first_block(spark):
    index = spark.createDataFrame([(0, -10), (1, -2), (4, -1), (5, 4), (7, 6)], "chunk long, highest_ts long")
    for ts, chunk in ((-1000, 0), (-10, 0), (-5, 1), (-1, 4), (0, 5), (4, 5), (7, None)):
        assert first_block_at(index, ts).first()["chunk"] == chunk
