"""Layered random-projection index with prefix back-off."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions import vectors


@dataclasses.dataclass(frozen=True)
class Hashes:
    """layers x hashes projection vectors and the bucket width. Bounded by layers * hashes * dimensions."""

    planes: tuple[tuple[tuple[float, ...], ...], ...]
    width: float

    @property
    def layers(self) -> int:
        return len(self.planes)

    @property
    def depth(self) -> int:
        return len(self.planes[0])


def sample_hashes(rows: DataFrame, layers: int, depth: int, seed: int = 0, features: str = "features") -> Hashes:
    """Vectors with each coordinate uniform between the column's least and greatest value; width is a hundredth of the least norm."""
    spans = rows.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("i").collect()
    low, high = np.array([r.low for r in spans]), np.array([r.high for r in spans])
    planes = np.random.default_rng(seed).uniform(low, high, (layers, depth, len(low)))
    return of_planes(planes)


def fixed_hashes(layers: int, depth: int, dim: int, low: float = -0.5, high: float = 0.5, seed: int = 0) -> Hashes:
    """Hashes that do not look at data, for indexes that must agree between runs and engines. Rounded, so that text holds them exactly."""
    return of_planes(np.round(np.random.default_rng(seed).uniform(low, high, (layers, depth, dim)), 3))


def of_planes(planes: np.ndarray) -> Hashes:
    norms = np.sqrt((planes * planes).sum(axis=2))
    return Hashes(tuple(tuple(tuple(map(float, h)) for h in layer) for layer in planes), float(norms.min()) / 100)


def bucket(features: Column, plane: tuple[float, ...], width: float) -> Column:
    """Number of the bucket that the magnitude of the projection falls into; zero stays zero."""
    v = F.array(*[F.lit(x) for x in plane])
    size = float(np.sqrt(sum(x * x for x in plane)))
    return F.ceil(F.abs(vectors.dot(features, v)) / F.lit(size) / F.lit(width)).cast("bigint")


def buckets(rows: DataFrame, hashes: Hashes, features: str = "features", keep: str = "image_id") -> DataFrame:
    """keep, layer, numbers: the bucket numbers of each row in each layer. No shuffle."""
    per_layer = F.array(*[F.struct(F.lit(n).alias("layer"), F.array(*[bucket(F.col(features), p, hashes.width) for p in layer]).alias("numbers")) for n, layer in enumerate(hashes.planes)])
    return rows.where(F.col(features).isNotNull()).select(keep, F.explode(per_layer).alias("b")).select(keep, "b.layer", "b.numbers")


def _prefix(length: Column) -> Column:
    return F.array_join(F.slice("numbers", F.lit(1), length).cast("array<string>"), "-")


def build(rows: DataFrame, hashes: Hashes, features: str = "features") -> DataFrame:
    """key, image_id for every prefix of every layer's numbers. Layers share keys."""
    lengths = F.sequence(F.lit(1), F.lit(hashes.depth))
    return buckets(rows, hashes, features).select("image_id", F.explode(F.transform(lengths, _prefix)).alias("key")).distinct().select("key", "image_id")


def query_keys(rows: DataFrame, hashes: Hashes, features: str = "features") -> DataFrame:
    """key, dropped for a query: its full keys, each once, and those with trailing numbers dropped."""
    full = buckets(rows, hashes, features).select("numbers").distinct()
    drops = F.sequence(F.lit(0), F.lit(hashes.depth - 1))
    return full.select(F.explode(F.transform(drops, lambda j: F.struct(_prefix(F.lit(hashes.depth) - j).alias("key"), j.alias("dropped")))).alias("x")).select("x.key", "x.dropped")


def candidates(index: DataFrame, query: DataFrame, hashes: Hashes) -> DataFrame:
    """image_id of every row that shares a probed key."""
    return index.join(F.broadcast(query_keys(query, hashes).select("key").distinct()), "key", "left_semi").select("image_id").distinct()


def search(index: DataFrame, rows: DataFrame, key, hashes: Hashes, top: int) -> DataFrame:
    """image_id, score: the nearest candidates, exact copies of the query left out."""
    query = rows.where(F.col("image_id") == key).limit(1)
    found = rows.join(candidates(index, query, hashes), "image_id")
    near = found.crossJoin(F.broadcast(query.select(F.col("features").alias("query")))).withColumn("score", vectors.l2(F.col("features"), F.col("query")))
    return near.where("score <> 0").orderBy("score", "image_id").limit(top).select("image_id", "score")


def statistics(index: DataFrame, rows: DataFrame, key, hashes: Hashes) -> DataFrame:
    """unique_candidates and overall_candidates (with repeats over keys and levels) of a query."""
    query = rows.where(F.col("image_id") == key).limit(1)
    hits = index.join(F.broadcast(query_keys(query, hashes)), "key")
    near = hits.join(rows, "image_id").crossJoin(F.broadcast(query.select(F.col("features").alias("query"))))
    near = near.withColumn("far", vectors.l2(F.col("features"), F.col("query")) != 0)
    return near.agg(F.countDistinct(F.when(F.col("far"), F.col("image_id"))).alias("unique_candidates"), F.count("*").alias("overall_candidates"))


def save(index: DataFrame, hashes: Hashes, path: str) -> None:
    spark = index.sparkSession
    index.write.mode("overwrite").parquet(f"{path}/buckets")
    spark.createDataFrame([(n, h, list(p)) for n, layer in enumerate(hashes.planes) for h, p in enumerate(layer)], "layer int, h int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/functions")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Hashes]:
    rows = spark.read.parquet(f"{path}/functions").orderBy("layer", "h").collect()
    layers: dict[int, list] = {}
    for r in rows:
        layers.setdefault(r.layer, []).append(r.vector)
    return spark.read.parquet(f"{path}/buckets"), of_planes(np.array([layers[n] for n in sorted(layers)]))
