"""Exact top-k search by inner product as a Voronoi kNN join.

A coordinate more makes it a search for nearest neighbours: with M the largest
norm, x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0); the squared
distance is then |q|^2 + M^2 - 2 q.x. Pivots divide data and queries into cells.
Of each cell a summary is kept: how many rows, and the least distances of data to
its pivot, and the largest of queries. Triangle inequalities turn the summaries
into a bound for each cell of queries, within which its neighbours must lie. Cells of
queries that need much the same data are put together, so a row of data is copied
once for each block of queries that it may be a neighbour of: where bounds prune
nothing, once for all queries that a block holds. Blocks are solved apart, and their
results merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import discard, materialize, table

#: Queries to a cell on average, and bounds of the number of pivots.
QUERIES_A_CELL, LEAST_PIVOTS, MOST_PIVOTS = 4096, 8, 512
#: A row of data goes to every block of queries that may need it, so blocks of queries are as large as memory easily holds.
QUERIES_A_BLOCK, ROWS_A_BLOCK = 16_384, 32_768
SLACK = 1e-9


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row, vec_id, v array<double>): floor(scale * x) of every component, whole numbers; row tells rows of one vec_id apart.

    Rows without id, and vectors that are null or hold null or non-finite
    components, are left out, and no others.
    """
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if not np.isfinite(flat).all():
                raise ValueError("a component is too large to be scaled")
            sizes = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["vec_id", "v"])

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(floored, "vec_id long, v array<double>")
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def order_key(n: int) -> str:
    """Text that sorts as the number does, of any size."""
    digits = str(abs(n))
    if n >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def best_of(q: np.ndarray, x: np.ndarray, own: int | None, ids: np.ndarray, k: int, exact: bool) -> list[tuple[int, int]]:
    """(place, score) of the k rows of x with the highest inner products with q, row own left out; ties to the smaller id.

    exact: products and sums are whole numbers below 2**53. If not, rows that may be among
    the best by the bound of rounding errors are scored again by whole numbers of any size.
    """
    line = x @ q
    if own is not None:
        line[own] = -np.inf
    if not exact:
        error = (len(q) + 2) * 2.0**-52 * np.abs(x) @ np.abs(q)
        low, high = line - error, line + error
        edge = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
        maybe = np.flatnonzero((high >= edge) & (line > -np.inf))
        whole = [int(c) for c in q]
        scored = [(sum(a * int(b) for a, b in zip(whole, x[i], strict=True)), int(i)) for i in maybe]
        scored.sort(key=lambda s: (-s[0], ids[s[1]], s[1]))
        return [(i, score) for score, i in scored[:k]]
    if len(line) > k:
        edge = np.partition(line, len(line) - k)[len(line) - k]
        over, ties = np.flatnonzero(line > edge), np.flatnonzero(line == edge)
        best = np.r_[over, ties[np.argsort(ids[ties], kind="stable")][: k - len(over)]]
    else:
        best = np.arange(len(line))
    return [(int(b), int(line[b])) for b in best if line[b] > -np.inf]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of float64; shorter vectors are padded with zeros."""
    lists = column.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From rows (x, extra) to pivots, which have that coordinate as well."""
    full = np.c_[x, extra]
    squares = (full**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


DEALT = "asks boolean, cell int, block int, salt int, row long, vec_id long, raw binary"


def _dealt(asks: bool, group: int, block: np.ndarray, salt: np.ndarray, rows: np.ndarray, ids: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    """Rows for the blocks of one group of cells; raw holds a vector's bytes a row."""
    n, data = len(ids), np.ascontiguousarray(raw)
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(data.strides[0])
    packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    columns = [pa.array(np.full(n, asks)), pa.array(np.full(n, group, np.int32)), pa.array(block), pa.array(salt), pa.array(rows), pa.array(ids), packed]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in DEALT.split(", ")])


def grouped(reach: np.ndarray, asked: np.ndarray, held: np.ndarray, most: int) -> list[list[int]]:
    """Cells of queries put together where that copies fewer rows: reach[i, j] is finite if queries of cell i need rows of data cell j.

    asked and held are the queries and rows of a cell. A cell joins the group with which
    most rows are saved, while the group has at most so many queries.
    """
    need = np.isfinite(reach)
    groups: list[list[int]] = []
    union, queries = np.zeros((0, len(held)), bool), np.zeros(0)
    for i in sorted(np.flatnonzero(asked), key=lambda i: -float((need[i] * held).sum())):
        saved = np.where(queries + asked[i] <= most, ((union & need[i]) * held).sum(1), 0.0)
        # Queries of the group would meet rows that they don't need: worth it only if most are shared.
        saved = np.where(2 * saved > ((union | need[i]) * held).sum(1), saved, 0.0)
        if len(groups) and saved.max() > 0:
            g = int(saved.argmax())
            groups[g].append(int(i))
            union[g] |= need[i]
            queries[g] += asked[i]
        else:
            groups.append([int(i)])
            union, queries = np.vstack([union, need[i]]), np.r_[queries, asked[i]]
    return groups


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the k highest inner products, ties to the smaller vec_id.

    vectors has vec_id and embedding. Queries are the rows whose id is divisible by
    every; candidates are all rows but the query's own, those of its id included; rows that
    share an id each ask and each answer. Fewer than k candidates are all returned; an empty
    table, or one without queries, gives no row. Vectors of unequal length are compared as
    if padded with zeros. Ranks are exact at any size of components; a score beyond 64 bits
    is given as the nearest 64-bit number. Only pivots and the summaries of cells, of
    bounded number, come to the driver. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = materialize(quantised(vectors, scale), "knn-vectors")
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(norm2).alias("m2"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("nq")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts["n"] or not facts["nq"]:
        discard(rows)
        return spark.createDataFrame([], schema)
    width, m2 = max(1, facts["width"]), facts["m2"]
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(facts["nq"] / QUERIES_A_CELL)))
    drawn = rows.select("v", F.xxhash64("vec_id").alias("h"), "row").orderBy("h", "row").limit(wanted).select("v").toArrow()
    x = _matrix(drawn.column("v").combine_chunks(), width)
    pivots = np.unique(np.c_[x, np.sqrt(np.maximum(m2 - (x**2).sum(1), 0))], axis=0)
    n_cells = len(pivots)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = _matrix(batch.column(1), width)
            d = _distances(x, np.sqrt(np.maximum(m2 - (x**2).sum(1), 0)), pivots)
            q = ids % every == 0
            dq = _distances(x[q], np.zeros(q.sum()), pivots)
            out = []
            for kind, dist in ((0, d), (1, dq)):
                if len(dist):
                    cell = dist.argmin(1)
                    near = dist[np.arange(len(dist)), cell]
                    for c in np.unique(cell):
                        own = np.sort(near[cell == c])
                        out.append({"kind": kind, "cell": int(c), "n": len(own), "far": float(own[-1]), "near": own[: k + 1].tolist()})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("kind", pa.int32()), ("cell", pa.int32()), ("n", pa.int64()), ("far", pa.float64()), ("near", pa.list_(pa.float64()))]))

    parts = rows.select("vec_id", "v").mapInArrow(summarise, "kind int, cell int, n long, far double, near array<double>")
    least = Window.partitionBy("kind", "cell").orderBy("d")
    totals = parts.groupBy("kind", "cell").agg(F.sum("n").alias("n"), F.max("far").alias("far"))
    nearest = parts.select("kind", "cell", F.explode("near").alias("d")).withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1).groupBy("kind", "cell").agg(F.collect_list("d").alias("near"))
    summary = totals.join(nearest, ["kind", "cell"]).collect()  # two rows a cell at most
    data = {r["cell"]: r for r in summary if r["kind"] == 0}
    asked = {r["cell"]: r for r in summary if r["kind"] == 1}
    apart = np.stack([np.sqrt(((pivots - p) ** 2).sum(1)) for p in pivots])
    # bound: all of the k nearest of a query in cell i, itself left out, are at most so far away.
    reach = np.full((n_cells, n_cells), np.inf)  # reach[i, j]: rows of data cell j this near their pivot, or farther, may be needed in query cell i
    for i, r in asked.items():
        bounds = np.sort(np.concatenate([r["far"] + apart[i, j] + np.array(s["near"]) for j, s in data.items()]))
        bound = bounds[k] if len(bounds) > k else np.inf
        bound = bound * (1 + SLACK) + SLACK * math.sqrt(m2)
        for j, s in data.items():
            needed = max(0.0, apart[i, j] - r["far"] - bound)
            if s["far"] * (1 + SLACK) + SLACK * math.sqrt(m2) >= needed:
                reach[i, j] = needed
    count = lambda of: np.array([of[c]["n"] if c in of else 0 for c in range(n_cells)], float)
    groups = grouped(reach, count(asked), count(data), QUERIES_A_BLOCK)
    group_of = np.zeros(n_cells, np.int32)
    for g, cells in enumerate(groups):
        group_of[cells] = g
    reach = np.stack([reach[cells].min(0) for cells in groups])
    blocks = [max(1, math.ceil(sum(asked[i]["n"] for i in cells) / QUERIES_A_BLOCK)) for cells in groups]
    salts = [max(1, math.ceil(float((np.isfinite(reach[g]) * count(data)).sum()) / ROWS_A_BLOCK)) for g in range(len(groups))]
    small, exact = math.sqrt(m2) < 2**15, m2 < 2.0**53

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of data to the query blocks that may need them; queries to all parts of their block."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                number, ids, x = part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), width)
                raw = np.ascontiguousarray(x.astype("<i2" if small else "<f8"))
                mixed = (number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                d = _distances(x, np.sqrt(np.maximum(m2 - (x**2).sum(1), 0)), pivots)
                cell = d.argmin(1)
                near = d[np.arange(len(d)), cell] * (1 + SLACK) + SLACK * math.sqrt(m2)
                for g in range(len(groups)):
                    hit = np.flatnonzero(near >= reach[g, cell])
                    if len(hit):
                        salt = (mixed[hit] % np.uint64(salts[g])).astype(np.int32)
                        for b in range(blocks[g]):
                            yield _dealt(False, g, np.full(len(hit), b, np.int32), salt, number[hit], ids[hit], raw[hit])
                q = np.flatnonzero(ids % every == 0)
                if len(q):
                    own = group_of[_distances(x[q], np.zeros(len(q)), pivots).argmin(1)]
                    for g in np.unique(own):
                        h = q[own == g]
                        block = (mixed[h] % np.uint64(blocks[g])).astype(np.int32)
                        for s in range(salts[g]):
                            yield _dealt(True, int(g), block, np.full(len(h), s, np.int32), number[h], ids[h], raw[h])

    dealt = rows.select("row", "vec_id", "v").mapInArrow(deal, DEALT)

    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        def side(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            kind = np.dtype("<i2" if small else "<f8")
            return part["row"].to_numpy(), part["vec_id"].to_numpy(), np.frombuffer(b"".join(part["raw"]), kind).reshape(-1, width).astype(np.float64)

        (q_rows, q_ids, q), (x_rows, ids, x) = side(group[group["asks"]]), side(group[~group["asks"]])
        place, out = {int(r): i for i, r in enumerate(x_rows)}, []
        for number, query, vector in zip(q_rows, q_ids, q, strict=True):
            for b, score in best_of(vector, x, place.get(int(number)), ids, k, exact):
                out.append((int(number), int(query), int(ids[b]), int(x_rows[b]), max(-(2**63), min(2**63 - 1, score)), order_key(score)))
        frame = pd.DataFrame(out, columns=["asker", "query_id", "vec_id", "row", "score", "key"])
        return frame.astype({c: "int64" for c in frame.columns if c != "key"})

    local = dealt.groupBy("cell", "block", "salt").applyInPandas(solve, "asker long, query_id long, vec_id long, row long, score long, key string")
    order = Window.partitionBy("asker").orderBy(F.col("key").desc(), "vec_id", "row")
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector with all others."""
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


#: The same rows in DuckDB.
OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
