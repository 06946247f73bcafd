import random

import pytest

from tidewell.errors import BadRequest, Conflict, CorruptCommit, SeriesNotFound
from tidewell.operators import run
from tidewell.plans import Statement
from tidewell.sources import SeriesCatalog
from tidewell.sources import catalog as catalog_module
from tidewell.sources.catalog import Transaction, limit_bound


@pytest.fixture
def catalog(spark, tmp_path):
    return SeriesCatalog(spark, f"file://{tmp_path}/root")


def batch(spark, *rows):
    return spark.createDataFrame([(t, float(v), i) for i, (t, v) in enumerate(rows)], "ts long, value double, seq long")


def read(reader, from_ts=None):
    return [tuple(r) for r in reader.ordered(from_ts).collect()]


def test_catalog(catalog):
    catalog.create("b")
    catalog.create("a.1")
    catalog.create("b")
    assert catalog.list() == ["a.1", "b"]
    assert [r["series"] for r in catalog.listed().collect()] == ["a.1", "b"]
    assert catalog.rename("b", "c") and not catalog.rename("b", "d") and not catalog.rename("a.1", "c")
    assert catalog.list() == ["a.1", "c"]
    for name in ("", ".", "..", "_x", "a/b", "a b", "ä"):
        with pytest.raises(BadRequest):
            catalog.create(name)
    with pytest.raises(SeriesNotFound):
        catalog.reader("nothing")
    with pytest.raises(SeriesNotFound):
        catalog.writer("nothing")


def test_scans_and_snapshots(spark, catalog):
    catalog.create("t")
    reader, writer = catalog.reader("t"), catalog.writer("t")
    assert read(reader) == []
    for part in ([1, 2, 3, 5, 8], [10, 20, 21], [40, 100, 110]):
        writer.append(batch(spark, *[(t, t) for t in part]))
    assert [t for t, _ in read(reader, 4)] == [5, 8, 10, 20, 21, 40, 100, 110]
    assert [t for t, _ in read(reader, 15)][0] == 20 and [t for t, _ in read(reader, 2)][0] == 2
    assert read(reader, 111) == []
    before = reader.scan()
    writer.append(batch(spark, (120, 1), (140, 2)))
    assert before.count() == 11 and reader.scan().count() == 13
    assert reader.snapshot().rows == 13


def test_late_and_equal_entries_and_ties(spark, catalog):
    catalog.create("t")
    writer, reader = catalog.writer("t"), catalog.reader("t")
    writer.append(batch(spark, (5, 1), (3, 2), (5, 3)))
    writer.append(batch(spark, (5, 4), (4, 9), (6, 5), (5, 6)))
    writer.append(batch(spark, (1, 9)))
    assert read(reader) == [(3, 2.0), (5, 1.0), (5, 3.0), (5, 4.0), (5, 6.0), (6, 5.0)]
    assert reader.snapshot().highest_ts == 6 and reader.snapshot().version == 3


def test_failed_appends_are_never_seen(spark, catalog, monkeypatch):
    catalog.create("t")
    writer, reader = catalog.writer("t"), catalog.reader("t")
    writer.append(batch(spark, (1, 1)))

    def failing(*args):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(catalog_module.CommitLog, "publish", failing)
        with pytest.raises(OSError):
            writer.append(batch(spark, (2, 2.1)))
    with monkeypatch.context() as m:
        m.setattr(Transaction, "append", failing)
        with pytest.raises(OSError):
            writer.append(batch(spark, (9, 9)))
    writer.append(batch(spark, (2, 2.2)))
    writer.append(batch(spark, (3, 3)))
    assert read(reader) == [(1, 1.0), (2, 2.2), (3, 3.0)]


def test_null_entries_fail_the_batch(spark, catalog):
    catalog.create("t")
    with pytest.raises(Exception, match="value is null"):
        catalog.writer("t").append(spark.createDataFrame([(1, None)], "ts long, value double"))
    assert read(catalog.reader("t")) == []


def test_transactions(spark, catalog):
    catalog.create("t")
    writer, reader = catalog.writer("t"), catalog.reader("t")
    with writer.transaction() as tx:
        tx.append(batch(spark, (5, 1)))
        tx.append(batch(spark, (4, 2), (6, 3)))
        assert read(reader) == []
    assert read(reader) == [(5, 1.0), (6, 3.0)] and reader.snapshot().version == 1
    with pytest.raises(RuntimeError), writer.transaction() as tx:
        tx.append(batch(spark, (7, 1)))
        raise RuntimeError
    assert reader.snapshot().version == 1


def test_chunks_in_one_commit(spark, catalog):
    catalog.create("t")
    writer, reader = catalog.writer("t"), catalog.reader("t")
    writer.append(batch(spark, (2, 0)))
    writer.append_in_chunks(batch(spark, (1, 1), (4, 2), (3, 3), (4, 4), (9, 5), (8, 6)), 2)
    # Chunks (1, 4), (3, 4), (9, 8): 1 is below the commit's mark, 3 below the first chunk's.
    assert read(reader) == [(2, 0.0), (4, 2.0), (4, 4.0), (8, 6.0), (9, 5.0)]
    assert reader.snapshot().version == 2


def test_two_writers_conflict(spark, catalog):
    catalog.create("t")
    writer = catalog.writer("t")
    last = writer.log.current()
    writer.append(batch(spark, (1, 1)))
    with pytest.raises(Conflict):
        writer.log.publish(last, [])


def test_damaged_commits(spark, catalog, monkeypatch):
    monkeypatch.setattr(catalog_module, "FULL_EVERY", 4)
    catalog.create("t")
    writer, reader = catalog.writer("t"), catalog.reader("t")
    for i in range(6):
        writer.append(batch(spark, (i, i)))
    folder = writer.folder
    newest = writer.log.file(6)
    folder.delete(newest)
    folder.create(newest, b'{"crc32": 1, "bo')
    assert reader.snapshot().version == 5 and [t for t, _ in read(reader)] == [0, 1, 2, 3, 4]
    writer.append(batch(spark, (7, 7)))
    assert [t for t, _ in read(reader)] == [0, 1, 2, 3, 4, 7] and reader.snapshot().version == 7
    for name in folder.names("commits"):
        folder.delete(f"commits/{name}")
    folder.create(writer.log.file(1), b"{}")
    with pytest.raises(CorruptCommit):
        reader.snapshot()


def test_old_commits_go(spark, catalog, monkeypatch):
    monkeypatch.setattr(catalog_module, "FULL_EVERY", 2)
    catalog.create("t")
    log = catalog.writer("t").log
    last = log.current()
    for i in range(9):
        last = log.publish(last, [catalog_module.Batch(f"b{i}", 1, i, i)])
    assert log.versions()[0] >= 4 and len(log.current().batches) == 9


def test_tokens_are_applied_once(spark, catalog):
    catalog.create("t")
    for _ in range(2):
        catalog.writer("t").append(batch(spark, (1, 1)), token="q:7")
    assert read(catalog.reader("t")) == [(1, 1.0)]


def test_limits_cut_the_scan(spark, catalog):
    catalog.create("t")
    writer, rnd = catalog.writer("t"), random.Random(5)
    for i in range(4):
        writer.append(batch(spark, *[(rnd.randrange(i * 1_000_000, (i + 1) * 1_000_000), i) for _ in range(20)]))
    reader = catalog.reader("t")
    for limit in (0, 1, 2, 3, 50):
        statement = Statement.of(from_ts=100_000, group_by_ms=60_000, aggregators=("mean", "max"), limit=limit)
        assert reader.query(statement).collect() == run(reader.scan(), statement).collect()
    assert limit_bound(reader.snapshot(), Statement.of(from_ts=0, group_by_ms=60_000, limit=2)) <= 1_060_000
    assert limit_bound(reader.snapshot(), Statement.of(from_ts=0, group_by_ms=60_000, limit=500)) is None


def test_batch_numbers_of_long_transactions():
    """Equal times keep the order of their arrival, however many appends a transaction has."""
    numbers = [(version << catalog_module.APPEND_BITS) + place for version in range(3) for place in (0, 999, 1000, 1500, 2**31 - 1)]
    assert numbers == sorted(set(numbers)) and numbers[-1] < 2**63
