"""Nearest-neighbour search: one query against a corpus, and many queries in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import vectors

#: What rows without a score of their own hold in the compatibility form of a restricted search.
SENTINEL = 1e11
#: Vectors in a block of the all-pairs forms.
BLOCK = 2048


def vector_of(corpus: DataFrame, key, id_col: str = "image_id", features: str = "features") -> DataFrame:
    """The one row of a key (the condition reaches the scan), as column `query`."""
    return corpus.where(F.col(id_col) == key).select(F.col(features).alias("query")).limit(1)


def scored(corpus: DataFrame, query: DataFrame, measure: str = "euclidean", features: str = "features") -> DataFrame:
    """corpus with `score` against a one-row query."""
    distance, _ = vectors.measure(measure)
    return corpus.crossJoin(F.broadcast(query)).withColumn("score", distance(F.col(features), F.col("query"))).drop("query")


def nearest(corpus: DataFrame, key, k: int, measure: str = "euclidean", where: Column | None = None, id_col: str = "image_id", features: str = "features") -> DataFrame:
    """The k rows most like the row of `key`, which is left out: a top-k without a full sort."""
    _, ascending = vectors.measure(measure)
    held = corpus if where is None else corpus.where(where)
    rows = scored(held.where(F.col(features).isNotNull()), vector_of(corpus, key, id_col, features), measure, features)
    return rows.where(F.col(id_col) != key).orderBy(F.col("score").asc() if ascending else F.col("score").desc(), id_col).limit(k).select(id_col, "score")


def nearest_with_sentinel(corpus: DataFrame, key, k: int, where: Column, measure: str = "euclidean", id_col: str = "image_id", features: str = "features") -> DataFrame:
    """As nearest(where=...), but rows outside take part with SENTINEL and fill up the end (compatibility form)."""
    rows = scored(corpus, vector_of(corpus, key, id_col, features), measure, features)
    rows = rows.withColumn("score", F.when(where, F.col("score")).otherwise(F.lit(SENTINEL)))
    return rows.where(F.col(id_col) != key).orderBy("score", id_col).limit(k).select(id_col, "score")


def pairwise(a: np.ndarray, b: np.ndarray, measure: str) -> np.ndarray:
    """Matrix of distances (cosine: similarities), each from its own differences, so that equal rows tie exactly."""
    out = np.empty((len(a), len(b)))
    size = np.sqrt((b * b).sum(axis=1))
    for i, row in enumerate(a):
        if measure == "cosine":
            with np.errstate(invalid="ignore", divide="ignore"):
                out[i] = (b * row).sum(axis=1) / (np.sqrt((row * row).sum()) * size)
            continue
        d = b - row
        out[i] = np.sqrt((d * d).sum(axis=1)) if measure == "euclidean" else np.abs(d).sum(axis=1) if measure == "manhattan" else np.cbrt((np.abs(d) ** 3).sum(axis=1))
    return out


def _blocks(rows: DataFrame, id_col: str, features: str, name: str, blocks: int) -> DataFrame:
    """block, ids and vectors packed together: BLOCK vectors or so in a row."""

    kind, arrow = ("string", pa.string()) if rows.schema[id_col].dataType.simpleString() == "string" else ("bigint", pa.int64())

    def pack(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        rows = 0
        for g in groups:
            for block, i, v in zip(g.column(0).to_pylist(), g.column(1).to_pylist(), g.column(2).to_pylist()):
                ids, vs = held.setdefault(block, ([], []))
                ids.append(i)
                vs.append(np.asarray(v, dtype=np.float64))
                rows += 1
                if rows >= 2 * BLOCK:  # of all the blocks of a task; one that is open then goes on in another row
                    for each, (ids, vs) in held.items():
                        yield packed(each, ids, vs)
                    held, rows = {}, 0
        for block, (ids, vs) in held.items():
            yield packed(block, ids, vs)

    def packed(block: int, ids: list, vs: list) -> pa.RecordBatch:
        raw = np.asarray(vs, dtype=np.float64)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ids], pa.list_(arrow)), pa.array([raw.tobytes()], pa.binary())], names=["block", f"{name}_ids", f"{name}_raw"])

    part = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    held = rows.where(F.col(features).isNotNull()).select(part.alias("block"), F.col(id_col).cast(kind), features)
    return held.repartition("block").mapInArrow(pack, f"block int, {name}_ids array<{kind}>, {name}_raw binary")


def _block_pairs(queries: DataFrame, corpus: DataFrame, id_col: str, features: str) -> DataFrame:
    """q_ids, q_raw, c_ids, c_raw: every block of queries beside every block of the corpus."""
    corpus_blocks = max(1, -(-corpus.count() // BLOCK))
    query_blocks = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-queries.count() // BLOCK))
    left = _blocks(queries, id_col, features, "q", query_blocks).select("q_ids", "q_raw", F.explode(F.sequence(F.lit(0), F.lit(corpus_blocks - 1))).alias("block"))
    right = _blocks(corpus, id_col, features, "c", corpus_blocks)
    return left.join(right, "block").select("q_ids", "q_raw", "c_ids", "c_raw")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and vectors of both sides of each pair of blocks, the corpus by id."""
    for b in batches:
        for q_ids, q_raw, c_ids, c_raw in zip(*(b.column(n).to_pylist() for n in ("q_ids", "q_raw", "c_ids", "c_raw"))):
            q, c = (np.frombuffer(raw, dtype=np.float64).reshape(len(ids), -1) for raw, ids in ((q_raw, q_ids), (c_raw, c_ids)))
            order = np.argsort(c_ids, kind="stable")
            yield q_ids, q, np.asarray(c_ids)[order], c[order]


def distance_sums(queries: DataFrame, corpus: DataFrame, measure: str = "euclidean", id_col: str = "image_id", features: str = "features") -> DataFrame:
    """src, total: the sum of the distances of each query to all rows of corpus. Each pair of blocks gives a row for a query, not one for a pair of rows."""
    kind = "string" if corpus.schema[id_col].dataType.simpleString() == "string" else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q, _, c in _matrices(batches):
            for at in range(0, len(q), 256):
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at : at + 256]), pa.array(pairwise(q[at : at + 256], c, measure).sum(axis=1))], names=["src", "total"])

    return _block_pairs(queries, corpus, id_col, features).mapInArrow(run, f"src {kind}, total double").groupBy("src").agg(F.sum("total").alias("total"))


def knn(queries: DataFrame, corpus: DataFrame, k: int, measure: str = "euclidean", id_col: str = "image_id", features: str = "features") -> DataFrame:
    """src, dst, distance, rank (from 1) for the k rows of corpus nearest to each query; a row finds itself too.

    Both sides are packed into blocks; each pair of blocks is one matrix computation whose k best per
    query go on, and a window with a group limit merges them. Ties go to the smaller id.
    """
    _, ascending = vectors.measure(measure)
    kind = "string" if corpus.schema[id_col].dataType.simpleString() == "string" else "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q_ids, q, names, c in _matrices(batches):
            for at in range(0, len(q), 256):
                d = pairwise(q[at : at + 256], c, measure)
                best = np.argsort(d if ascending else -d, axis=1, kind="stable")[:, :k]
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[at : at + 256], n)), pa.array(names[best].ravel()), pa.array(np.take_along_axis(d, best, axis=1).ravel())], names=["src", "dst", "distance"])

    pairs = _block_pairs(queries, corpus, id_col, features).mapInArrow(run, f"src {kind}, dst {kind}, distance double")
    order = F.col("distance").asc() if ascending else F.col("distance").desc()
    rank = F.row_number().over(Window.partitionBy("src").orderBy(order, "dst"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
