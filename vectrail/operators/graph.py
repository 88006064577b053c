"""Nearest-neighbour graphs and personalised PageRank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions import labels
from vectrail.operators import search
from vectrail.sources import store

ITERATIONS, BETA = 60, 0.85
#: Graphs of at most so many edges are ranked in one task; larger ones by joins.
ONE_TASK_EDGES = 2_000_000


def knn_graph(rows: DataFrame, k: int, measure: str = "euclidean", id_col: str = "image_id", features: str = "features") -> DataFrame:
    """Edges src, dst, distance, rank to each row's k nearest, itself among them."""
    return search.knn(rows, rows, k, measure, id_col, features)


def transitions(edges: DataFrame, k: int) -> DataFrame:
    """Edges with weight 1 / k each, also where a row has fewer than k."""
    return edges.select("src", "dst", (F.lit(1.0) / k).alias("weight"))


def seeds(nodes: DataFrame, chosen: Column) -> DataFrame:
    """node, mass: equal shares of one over the chosen nodes, 0 elsewhere."""
    marked = nodes.select(F.col("image_id").alias("node"), F.coalesce(chosen, F.lit(False)).cast("double").alias("hit"))
    share = marked.agg(F.sum("hit").alias("all"))
    return marked.crossJoin(F.broadcast(share)).select("node", F.coalesce(F.try_divide("hit", "all"), F.lit(0.0)).alias("mass"))


def label_seeds(nodes: DataFrame, label: str) -> DataFrame:
    return seeds(nodes, labels.mentions(F.col("aspect_of_hand"), label))


def pagerank(weights: DataFrame, jump: DataFrame, iterations: int = ITERATIONS, beta: float = BETA, one_task: bool | None = None) -> DataFrame:
    """node, pagerank for every node of jump after a fixed number of steps from the uniform start.

    Mass that reaches a node without edges is lost, as mass always was. one_task: which way; by default
    by the number of edges.
    """
    if one_task is None:
        one_task = weights.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES
    return _in_one_task(weights, jump, iterations, beta) if one_task else _by_joins(weights, jump, iterations, beta)


def _in_one_task(weights: DataFrame, jump: DataFrame, iterations: int, beta: float) -> DataFrame:
    rows = jump.select(F.col("node").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.col("mass").alias("x")).unionByName(weights.select("src", "dst", F.col("weight").alias("x")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        src, x = np.asarray(table["src"]), np.asarray(table["x"])
        edge = np.asarray(table["dst"].is_valid())
        order = np.argsort(src[~edge], kind="stable")
        nodes, jumps = src[~edge][order], x[~edge][order]
        if not len(nodes):
            return
        inside = np.isin(src[edge], nodes) & np.isin(np.asarray(table["dst"].fill_null(-1))[edge], nodes)
        a = np.searchsorted(nodes, src[edge][inside])
        b = np.searchsorted(nodes, np.asarray(table["dst"].fill_null(-1))[edge][inside])
        w = x[edge][inside]
        rank = np.full(len(nodes), 1.0 / len(nodes))
        for _ in range(iterations):
            rank = beta * np.bincount(b, w * rank[a], len(nodes)) + (1 - beta) * jumps
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(rank, pa.float64())], names=["node", "pagerank"])

    return rows.coalesce(1).mapInArrow(run, "node bigint, pagerank double")


def _by_joins(weights: DataFrame, jump: DataFrame, iterations: int, beta: float) -> DataFrame:
    """A join and a sum for each step; the edges keep their partitioning by src, ranks are written every few steps."""
    weights = store.materialised(weights.repartition("src"), "weights")
    jump = store.materialised(jump, "jump")
    count = jump.count()
    rank = jump.select("node", F.lit(1.0 / max(1, count)).alias("pagerank"))
    for i in range(iterations):
        moved = weights.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("weight") * F.col("pagerank")).alias("moved"))
        rank = jump.join(moved, F.col("node") == F.col("dst"), "left").select("node", (beta * F.coalesce("moved", F.lit(0.0)) + (1 - beta) * F.col("mass")).alias("pagerank"))
        if i % 5 == 4:
            rank = store.materialised(rank, "pagerank")
    return rank


def dominant(rows: DataFrame, seed_ids: list, k: int, top: int, measure: str = "euclidean") -> DataFrame:
    """The `top` nodes by personalised PageRank from seed nodes, seeds not excluded."""
    weights = transitions(knn_graph(rows, k, measure), k)
    return pagerank(weights, seeds(rows, F.col("image_id").isin(seed_ids))).orderBy(F.desc("pagerank"), "node").limit(top)


def classify(rows: DataFrame, train: Column, k: int = 15, measure: str = "manhattan") -> DataFrame:
    """image_id, predicted for rows outside the training condition: the side whose seeds give the greater rank."""
    weights = store.materialised(transitions(knn_graph(rows, k, measure), k), "knn-weights")
    sides = [pagerank(weights, seeds(rows, train & labels.mentions(F.col("aspect_of_hand"), side))).withColumnRenamed("pagerank", side) for side in ("dorsal", "palmar")]
    both = sides[0].join(sides[1], "node").join(rows.where(~train).select(F.col("image_id").alias("node")), "node", "left_semi")
    return both.select(F.col("node").alias("image_id"), F.when(F.col("dorsal") > F.col("palmar"), "dorsal").when(F.col("dorsal") < F.col("palmar"), "palmar").otherwise("unknown").alias("predicted"))
