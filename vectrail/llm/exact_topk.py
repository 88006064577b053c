"""Exact top-k by inner product through a vector-approximation file.

The file holds a cell number for each component of each distinct vector, and beside it the exact
integers and the smallest ids that carry the vector. A dimension's cells end at the quantiles of a sample
(GRID_ROWS rows) and at the least and greatest value of all rows, so an outlier widens one cell alone.
A search reads the cells once for the (k+1)-th best lower bound of each query, and once more for the
vectors whose upper bound reaches it. Of those, exact vectors are read in the order of their upper
bounds, a few for each query at a time, until no bound left reaches the (k+1)-th exact score so far.
Bounds are computed in floating point and widened by the greatest rounding error, scores in integers.
Queries come in blocks of bounded size, each broadcast by itself.

Defined results: a vector that is null or holds a null or non-finite component takes no part; a shorter
vector counts as padded with zeros; repeated rows (same id, same vector) are one row; a query never
finds rows of its own id; equal scores go to the smaller id; no queries or no vectors give no rows;
components beyond 2**62 are clamped there, and scores beyond the range of a long to its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.llm import common

#: Cells for each component, rows that place them, and the most query vectors that are broadcast at once.
CELLS, GRID_ROWS, QUERY_BLOCK = 256, 4096, 2048
#: Vectors that are held against a block at once, and exact vectors that a query reads at once.
ROWS, READ = 1024, 8
LIMIT, LONG = 2**62, 2**63 - 1


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the same rows of b, exact, clamped to the range of a long."""
    most = np.abs(a).max(axis=1, initial=0).astype(np.float64) * np.abs(b).max(axis=1, initial=0) * max(1, a.shape[1])
    out = np.einsum("ij,ij->i", a, b)
    for i in np.nonzero(most >= 2.0**62)[0].tolist():
        out[i] = min(max(sum(x * y for x, y in zip(a[i].tolist(), b[i].tolist())), -LONG), LONG)
    return out


def usable(vec: Column) -> Column:
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v: floor(256 * x) of each component as little-endian 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat = np.floor(256.0 * np.asarray(lists.flatten(), dtype=np.float64))
            raw = np.clip(flat, -LIMIT, LIMIT).astype("<i8").tobytes()
            ends = np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64)) * 8
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())], pa.binary())], names=["id", "v"])

    held = vectors.where(usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    return held.where("id is not null").mapInArrow(run, "id bigint, v binary")


def matrix(raws: list[bytes], dim: int, kind: str = "<i8") -> np.ndarray:
    """Rows from packed vectors, shorter ones padded with zeros."""
    width = dim * np.dtype(kind).itemsize
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raws), dtype=kind).reshape(len(raws), dim)


class Grid:
    """Cells of each dimension: cell c of dimension d holds the integers from edges[d, c] to edges[d, c + 1] - 1."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray):
        """sample: some rows; low and high: the least and greatest value of every dimension over all rows."""
        self.dim = len(low)
        inner = np.sort(sample, axis=0)[(np.arange(1, CELLS) * len(sample)) // CELLS].T
        ends = np.concatenate([low[:, None], np.clip(inner, low[:, None], high[:, None] + 1), high[:, None] + 1], axis=1)
        self.edges = np.sort(ends, axis=1)

    def cells(self, ints: np.ndarray) -> np.ndarray:
        found = [np.searchsorted(self.edges[d, 1:-1], ints[:, d], side="right") for d in range(self.dim)]
        return np.stack(found, axis=1).astype(np.uint8) if found else np.zeros((len(ints), 0), np.uint8)

    def box(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest components of the vectors in the cells."""
        d = np.arange(self.dim)
        return self.edges[d, cells].astype(np.float64), (self.edges[d, cells.astype(np.int64) + 1] - 1).astype(np.float64)

    def bound(self, queries: np.ndarray, cells: np.ndarray, upper: bool) -> np.ndarray:
        """For each query and each vector in the cells: no inner product is above (below, unless upper)."""
        low, high = self.box(cells)
        q = queries.astype(np.float64)
        more, less = np.maximum(q, 0.0), np.minimum(q, 0.0)
        found = more @ high.T + less @ low.T if upper else more @ low.T + less @ high.T
        sizes = np.maximum(np.abs(low), np.abs(high)).max(axis=1, initial=0.0)
        weights = np.abs(q).sum(axis=1)
        if float(weights.max(initial=0.0)) * float(sizes.max(initial=0.0)) < 2.0**53:
            return found  # every sum was exact
        error = (8 * (self.dim + 8) * 2.0**-53) * np.outer(weights, sizes)
        return found + error if upper else found - error


def grid_of(ints: DataFrame, dim: int) -> Grid:
    """A grid for rows (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                m = matrix(b.column(0)[at : at + ROWS].to_pylist(), dim)
                low = m.min(axis=0) if low is None else np.minimum(low, m.min(axis=0))
                high = m.max(axis=0) if high is None else np.maximum(high, m.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    ends = ints.select("v").mapInArrow(run, "d int, low bigint, high bigint").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").toArrow()  # dim rows
    some = ints.orderBy(F.xxhash64("id", "v")).limit(GRID_ROWS).select("v").collect()  # GRID_ROWS rows
    return Grid(matrix([bytes(r.v) for r in some], dim), np.asarray(ends["low"]).astype(np.int64), np.asarray(ends["high"]).astype(np.int64))


def va_file(ints: DataFrame, grid: Grid, k: int) -> DataFrame:
    """vid, ids, cells, v for each distinct vector; ids are its k + 1 smallest, no more can be returned."""
    first = ints.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    groups = first.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("vid"), "ids", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = grid.cells(matrix(b.column("v").to_pylist(), grid.dim))
            yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("ids"), pa.array([r.tobytes() for r in cells], pa.binary()), b.column("v")], names=["vid", "ids", "cells", "v"])

    return groups.mapInArrow(run, "vid bigint, ids array<bigint>, cells binary, v binary")


def thresholds(index: DataFrame, block, grid: Grid, k: int) -> DataFrame:
    """Of each query (its place in the block) the k + 1 best lower bounds of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                low = grid.bound(block.value, matrix(b.column(0)[at : at + ROWS].to_pylist(), grid.dim, "u1"), False)
                best = low if best is None else np.hstack([best, low])
                if best.shape[1] > k + 1:
                    best = -np.partition(-best, k, axis=1)[:, : k + 1]
        if best is not None:
            q = np.repeat(np.arange(best.shape[0]), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(best.ravel(), pa.float64())], names=["q", "low"])

    return index.select("cells").mapInArrow(run, "q bigint, low double")


class Nearest:
    """The k + 1 best vectors of each query so far, by score and then by the smaller id."""

    def __init__(self, queries: np.ndarray, reach: np.ndarray, k: int):
        self.queries, self.reach, self.read = queries, reach, 0
        self.score = np.full((len(queries), k + 1), -LONG, dtype=np.int64)
        self.vid = np.full((len(queries), k + 1), LONG, dtype=np.int64)

    def offer(self, upper: np.ndarray, vids: np.ndarray, exact: list[bytes], dim: int) -> None:
        """Read exact vectors in the order of their upper bounds while those reach the last of the best."""
        n = min(READ, upper.shape[1])
        while True:
            last = self.score[:, -1]
            need = np.maximum(self.reach, np.where(last > -LONG, np.nextafter(last.astype(np.float64), -np.inf), -np.inf))
            most = upper.max(axis=1, initial=-np.inf)
            open_ = np.nonzero((most >= need) & (most > -np.inf))[0]
            if not len(open_):
                return
            rows = np.argpartition(-upper[open_], n - 1, axis=1)[:, :n]
            bounds = np.take_along_axis(upper[open_], rows, axis=1)
            i, j = np.nonzero((bounds >= need[open_][:, None]) & (bounds > -np.inf))
            q, row = open_[i], rows[i, j]
            used, place = np.unique(row, return_inverse=True)
            got = products(self.queries[q], matrix([exact[x] for x in used.tolist()], dim)[place])
            self.read += len(q)
            upper[q, row] = -np.inf
            score, vid = np.full(bounds.shape, -LONG, dtype=np.int64), np.full(bounds.shape, LONG, dtype=np.int64)
            score[i, j], vid[i, j] = got, vids[row]
            score, vid = np.hstack([self.score[open_], score]), np.hstack([self.vid[open_], vid])
            order = np.lexsort((vid, -score), axis=1)[:, : self.score.shape[1]]
            self.score[open_], self.vid[open_] = np.take_along_axis(score, order, axis=1), np.take_along_axis(vid, order, axis=1)


def nearest(index: DataFrame, block, reach, grid: Grid, k: int, reads=None) -> DataFrame:
    """q, vid, ids, score: of each partition and query the k + 1 best vectors that reach the query's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids = Nearest(block.value, reach.value, k), {}
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                vids = np.asarray(part.column("vid"))
                upper = grid.bound(block.value, matrix(part.column("cells").to_pylist(), grid.dim, "u1"), True)
                best.offer(upper, vids, part.column("v").to_pylist(), grid.dim)
                new = np.nonzero(np.isin(vids, best.vid))[0]
                ids.update(zip(vids[new].tolist(), part.column("ids").take(pa.array(new)).to_pylist()))
            ids = {v: ids[v] for v in np.unique(best.vid).tolist() if v in ids}
        q, place = np.nonzero(best.vid != LONG)
        vid = best.vid[q, place]
        if reads is not None:
            reads.add(best.read)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array([ids[v] for v in vid.tolist()], pa.list_(pa.int64())), pa.array(best.score[q, place], pa.int64())], names=["q", "ids", "score"])

    return index.select("vid", "ids", "cells", "v").mapInArrow(run, "q bigint, ids array<bigint>, score bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK, reads=None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that is_query (a condition on the id) takes.

    reads: an accumulator that is told how many exact vectors were read."""
    spark = vectors.sparkSession
    size = vectors.where(usable(F.col(vec_col))).agg(F.max(F.size(vec_col))).first()[0]
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    ints = common.stored(integers(common.spread(vectors), id_col, vec_col), "va-integers") if size is not None else None
    if ints is None or ints.isEmpty():
        return nothing
    grid = grid_of(ints, max(1, size))
    index = common.stored(va_file(ints, grid, k), "va-file")

    asked = integers(vectors.where(is_query), id_col, vec_col).distinct()
    asked = common.stored(asked.join(asked.groupBy("v").agg(F.min("id").alias("qid")), "v"), "va-queries")
    distinct = asked.where("id = qid").select("qid", "v")
    blocks = max(1, -(-distinct.count() // query_block))
    while (distinct.groupBy(F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("b")).count().agg(F.max("count")).first()[0] or 0) > 2 * query_block:
        blocks *= 2

    results = []
    for b in range(blocks):
        held = distinct.where(F.pmod(F.xxhash64("v"), F.lit(blocks)) == b).orderBy("qid").collect()  # at most 2 * query_block rows
        if not held:
            continue
        block = spark.sparkContext.broadcast(matrix([bytes(r.v) for r in held], grid.dim))
        best = thresholds(index, block, grid, k).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))).where(F.col("r") == k + 1)
        reach = np.full(len(held), -np.inf)
        for r in best.collect():  # a row for each query of the block at most
            reach[r.q] = min(r.low, 2.0**62) if r.low > -(2.0**62) else -np.inf  # scores beyond a long are equal
        exact = nearest(index, block, spark.sparkContext.broadcast(reach), grid, k, reads)
        names = spark.createDataFrame([(i, r.qid) for i, r in enumerate(held)], "q bigint, qid bigint")
        one = exact.select("q", "score", F.explode("ids").alias("vec_id"))
        one = one.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
        one = one.join(F.broadcast(names), "q").select("qid", "vec_id", "score")
        results.append(common.stored(one, "va-found") if blocks > 1 else one)
    if not results:
        return nothing
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    kept = asked.select(F.col("id").alias("query_id"), "qid").join(found, "qid").where("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
