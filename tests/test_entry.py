import duckdb
import pytest

import __spark_entry__ as entry
from tidewell import queries

SF = "/root/testdata/sf0.001"


def comparable(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in ("events", "orders"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_agrees_with_sql(spark, database, name):
    got = queries.queries()[name](spark, SF).toPandas()
    want = database.execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["ts", "mean"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
