import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import ODD_TEXTS, prose
from tidewell.llm import knn_join, mixing


def brute_top(rows, every, k):
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for at, (q, x) in enumerate(good):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i, n) for n, (i, v) in enumerate(good) if n != at)
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i, _) in enumerate(scored[:k])]
    return sorted(out)


def top(spark, rows, every=10, k=5, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as score", "'x' as v", "2 as row")
    return sorted(map(tuple, knn_join.top_k(df, every, k).collect()))


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_top_k(spark, spread, monkeypatch):
    monkeypatch.setattr(knn_join, "QUERIES_A_CELL", 4)
    monkeypatch.setattr(knn_join, "QUERIES_A_BLOCK", 3)
    monkeypatch.setattr(knn_join, "ROWS_A_BLOCK", 50)
    g = np.random.default_rng(3)
    centres = g.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + spread * g.normal(size=8)).astype("float32").tolist()) for i in range(400)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, None), (403, [math.nan] * 8), (404, [math.inf] + [0.0] * 7), (405, [None] + [0.0] * 7), (None, rows[1][1]), (450, [0.0] * 8)]
    rows += [(400, rows[3][1]), (7, rows[7][1]), (7, rows[7][1]), (30, rows[30][1])] + [(500 + i, rows[0][1]) for i in range(9)]  # repeated ids, repeated rows, ties
    assert top(spark, rows) == brute_top(rows, 10, 5)


def test_large_components(spark):
    g = np.random.default_rng(4)
    rows = [(i, (g.normal(size=4) * 10.0 ** g.integers(0, 13)).tolist()) for i in range(120)] + [(200, [1e12, 1.0, 0.0, 0.0]), (201, [1e12, 1.0 + 1 / 256, 0.0, 0.0]), (210, [-1e12, 0.5, 0.0, 0.0])]
    assert top(spark, rows, kind="double") == brute_top(rows, 10, 5)
    rows = [(i, (g.normal(size=4) * 1e6).astype("float32").tolist()) for i in range(80)] + [(90, [3e38, 1.0, 2.0, 3.0])]
    assert top(spark, rows) == brute_top(rows, 10, 5)


def test_order_key():
    numbers = [0, 1, -1, 9, -9, 10, -10, 2**63, -(2**70), 10**40, -(10**40), 123, -124, -123]
    assert sorted(numbers) == sorted(numbers, key=knn_join.order_key)


def test_cells_that_need_the_same_rows_share_a_copy():
    """Rows dealt over rows stored: one copy where nothing is pruned; where clusters are apart, each row goes to its own."""
    n = np.full(8, 1000.0)
    copies = lambda reach, most: sum((np.isfinite(reach[cells].min(0)) * n).sum() for cells in knn_join.grouped(reach, np.full(8, 10.0), n, most)) / n.sum()
    assert copies(np.zeros((8, 8)), 1000) == 1 and copies(np.zeros((8, 8)), 40) == 2
    assert copies(np.where(np.eye(8) > 0, 0.0, np.inf), 1000) == 1
    assert len(knn_join.grouped(np.where(np.eye(8) > 0, 0.0, np.inf), np.full(8, 10.0), n, 1000)) == 8


def test_clusters_are_pruned(spark, monkeypatch):
    g = np.random.default_rng(5)
    centres = 30 * np.linalg.qr(g.normal(size=(8, 8)))[0]
    rows = [(i, (centres[i % 8] + 0.01 * g.normal(size=8)).tolist()) for i in range(800)]
    dealt, real = [], knn_join.grouped

    def spy(reach, asked, held, most):
        groups = real(reach, asked, held, most)
        dealt.append(sum((np.isfinite(reach[cells].min(0)) * held).sum() for cells in groups) / held.sum())
        return groups

    monkeypatch.setattr(knn_join, "grouped", spy)
    monkeypatch.setattr(knn_join, "QUERIES_A_CELL", 2)
    monkeypatch.setattr(knn_join, "QUERIES_A_BLOCK", 12)
    assert top(spark, rows, kind="double") == brute_top(rows, 10, 5)
    assert dealt[0] <= 3


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, knn_join.top_k(df).collect())) == [(0, 1, 1, 131072), (0, 2, 2, -65536)]
    assert knn_join.top_k(df.limit(0)).collect() == [] and knn_join.top_k(df.where("vec_id > 0")).collect() == []


@pytest.mark.parametrize(("query", "sql", "table"), [(knn_join.op6_knn_join, knn_join.OP6_SQL, "embeddings"), (mixing.op7_mixing, mixing.OP7_SQL, "documents")])
def test_sql(spark, query, sql, table):
    sf = "/root/testdata/sf0.001"
    database = duckdb.connect()
    database.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    want = database.execute(sql).fetchdf()
    got = query(spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    bound, left, open_, target = {s: 3 * sizes[s] for s in names}, float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > bound[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = bound[s]
            left -= bound[s]
        open_ -= full
    return target


def test_mixing(spark, rnd):
    rows = [(i, rnd.choice(["a", "b", "b", "b", "b", "c", "d", None]), prose(rnd, rnd.randrange(1, 60))) for i in range(600)]
    rows += [(1000 + i, "e", t) for i, t in enumerate(ODD_TEXTS)] + [(None, "a", "x y z"), (3, "b", "twice two"), (3, "b", "twice two"), (2000, "f", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as target", "2 as size", "'k' as other")
    got = mixing.mix_sources(df).collect()
    assert sorted(map(tuple, mixing.mix_sources(df).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert len(got) == len(rows)
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    want = brute_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        target[r["source"]] = r["target"]
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3 * largest[s] + 0.05 * target[s]
    assert mixing.mix_sources(df.limit(0)).collect() == []
