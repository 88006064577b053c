"""Latent semantics: SVD, PCA, NMF and LDA of feature rows, listings of them, and fold-in.

SVD and PCA sum products of rows into a matrix of features by features, one partial sum for each
partition and then one for each of a few merge tasks; its eigenvectors give the basis. That holds for
any number of rows; the number of features is bounded by FEATURES. Signs are fixed: the entry of
largest magnitude of each component is positive (the first of equals).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions import vectors
from vectrail.sources import store

FEATURES = 12_000
#: Tasks that merge partial sums before the driver adds up what they give.
MERGERS = 4


@dataclasses.dataclass(frozen=True)
class Model:
    """basis: features x k. strength: singular values, explained variances, or nothing. centre: what projection subtracts."""

    method: str
    basis: np.ndarray
    strength: np.ndarray
    centre: np.ndarray


def _sums(rows: DataFrame, of, width: int, features: str) -> np.ndarray:
    """Sum over all rows of of(matrix of a batch), which is an array of `width` columns."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = np.asarray(b.column(0).flatten(), dtype=np.float64).reshape(b.num_rows, -1) if b.num_rows else None
            if x is not None:
                total = of(x) if total is None else total + of(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["m"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for raw in b.column(0):
                m = np.frombuffer(raw.as_py(), dtype="<f8")
                total = m.copy() if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    got = rows.select(features).where(F.col(features).isNotNull()).mapInArrow(partial, "m binary").repartition(MERGERS).mapInArrow(merge, "m binary").collect()
    if not got:
        raise ValueError("no rows to reduce")
    return np.sum([np.frombuffer(bytes(r.m), dtype="<f8") for r in got], axis=0).reshape(-1, width)


def _width(rows: DataFrame, features: str) -> int:
    sizes = [r[0] for r in rows.where(F.col(features).isNotNull()).select(F.size(features)).distinct().limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError("feature vectors must be of one size, and there must be some")
    if sizes[0] > FEATURES:
        raise ValueError(f"{sizes[0]} features; {FEATURES} at most")
    return sizes[0]


def _fixed_signs(basis: np.ndarray) -> np.ndarray:
    return basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)


def svd(rows: DataFrame, k: int, features: str = "features") -> Model:
    """Uncentred; scores() of it are U * S."""
    d = _width(rows, features)
    values, axes = np.linalg.eigh(_sums(rows, lambda x: x.T @ x, d, features))
    order = np.argsort(-values)[:k]
    return Model("svd", _fixed_signs(axes[:, order]), np.sqrt(np.maximum(values[order], 0)), np.zeros(d))


def pca(rows: DataFrame, k: int, features: str = "features") -> Model:
    """Centred; strength holds the variances (n - 1 in the denominator)."""
    d = _width(rows, features)
    sums = _sums(rows, lambda x: np.vstack([x.sum(axis=0), np.full(d, float(len(x)))]), d, features)
    n, mean = sums[1, 0], sums[0] / sums[1, 0]
    values, axes = np.linalg.eigh(_sums(rows, lambda x: (x - mean).T @ (x - mean), d, features) / max(1.0, n - 1))
    order = np.argsort(-values)[:k]
    return Model("pca", _fixed_signs(axes[:, order]), np.maximum(values[order], 0), mean)


def _nmf_rows(x: np.ndarray, h: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative weights of rows for a fixed basis h (k x features), by multiplicative updates."""
    w = np.full((len(x), len(h)), max(1e-12, np.sqrt(x.mean() / len(h)) if x.size else 1e-12))
    top, gram = x @ h.T, h @ h.T
    for _ in range(steps):
        w *= top / np.maximum(w @ gram, 1e-12)
    return w


def nmf(rows: DataFrame, k: int, seed: int = 0, iterations: int = 20, steps: int = 30, features: str = "features") -> Model:
    """Non-negative factors by multiplicative updates: weights of rows where the rows are, the basis from their sums."""
    d = _width(rows, features)
    rows = store.materialised(rows.select(features).where(F.col(features).isNotNull()), "nmf")
    low = rows.agg(F.min(F.array_min(features))).first()[0]
    if low < 0:
        raise ValueError("non-negative factors need non-negative features")
    h = np.random.default_rng(seed).uniform(0.1, 1.0, (k, d))

    for _ in range(iterations):
        held = h

        def parts(x: np.ndarray, held=held) -> np.ndarray:
            w = _nmf_rows(x, held, steps)
            return np.vstack([w.T @ x, (w.T @ w) @ held])

        sums = _sums(rows, parts, d, features)
        h = h * sums[:k] / np.maximum(sums[k:], 1e-12)
    return Model("nmf", h.T, np.zeros(0), np.zeros(d))


def projected(features: Column, basis: np.ndarray, centre: np.ndarray | None = None) -> Column:
    """Products of a feature vector with each column of the basis, as an expression."""
    v = features if centre is None or not centre.any() else F.zip_with(features, F.array(*[F.lit(float(c)) for c in centre]), lambda x, c: x - c)
    return F.array(*[vectors.dot(v, F.array(*[F.lit(float(b)) for b in column])) for column in basis.T])


def scores(rows: DataFrame, model: Model, id_col: str = "image_id", features: str = "features") -> DataFrame:
    """id, features: each row in the latent space (SVD and PCA: fold-in works the same way for new rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
                y = _nmf_rows(x, model.basis.T, 200) if model.method == "nmf" else (x - model.centre) @ model.basis
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.float64()))], names=[id_col, features])

    held = rows.where(F.col(features).isNotNull()).select(id_col, F.col(features).cast("array<double>"))
    return held.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {features} array<double>")


def lda(rows: DataFrame, k: int, seed: int = 0, iterations: int = 20, id_col: str = "image_id", features: str = "features") -> tuple[DataFrame, Model]:
    """Topic shares of each row (they sum to one) and the topics, by the library's variational inference."""
    held = rows.select(id_col, array_to_vector(F.col(features).cast("array<double>")).alias("v"))
    model = LDA(k=k, seed=seed, maxIter=iterations, featuresCol="v", optimizer="online").fit(held)
    share = model.transform(held).select(id_col, vector_to_array("topicDistribution").alias(features))
    topics = model.topicsMatrix().toArray()
    return share, Model("lda", topics, np.zeros(0), np.zeros(topics.shape[0]))


def reduce(rows: DataFrame, method: str, k: int, seed: int = 0) -> tuple[DataFrame, Model]:
    """Reduced rows and the model, by "svd", "pca", "nmf" or "lda"."""
    if method == "lda":
        return lda(rows, k, seed)
    found = {"svd": svd, "pca": pca, "nmf": nmf}.get(method)
    if found is None:
        raise ValueError(f"unknown method {method!r}; known: svd, pca, nmf, lda")
    model = found(rows, k)
    return scores(rows, model), model


def as_rows(spark, model: Model) -> DataFrame:
    """component, feature_idx, weight: the basis as a table."""
    rows = [(j, i, float(model.basis[i, j])) for j in range(model.basis.shape[1]) for i in range(model.basis.shape[0])]
    return spark.createDataFrame(rows, "component int, feature_idx int, weight double")


def term_weights(reduced: DataFrame, model: Model | None = None, id_col: str = "image_id", features: str = "features") -> DataFrame:
    """component, id, weight, rank: rows by falling weight in each latent semantic (SVD: of U, not U * S)."""
    each = reduced.select(id_col, F.posexplode(features).alias("component", "weight"))
    if model is not None and model.method == "svd":
        strength = F.array(*[F.lit(float(s)) for s in model.strength])
        each = each.withColumn("weight", F.try_divide("weight", F.get(strength, F.col("component"))))
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("weight"), id_col))
    return each.select("component", id_col, "weight", rank.alias("rank"))


def feature_weights(basis: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("weight"), "feature_idx"))
    return basis.select("component", "feature_idx", "weight", rank.alias("rank"))


def top_images(reduced: DataFrame, components: int, images: int, id_col: str = "image_id", features: str = "features") -> DataFrame:
    """The first images of the first latent semantics, weights rounded to 3 places half to even; ties in falling id."""
    each = reduced.select(id_col, F.posexplode(F.slice(features, 1, components)).alias("component", "weight")).withColumn("weight", F.bround("weight", 3))
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("weight"), F.desc(id_col)))
    return each.withColumn("rank", rank).where(F.col("rank") <= images).select("component", id_col, "weight", "rank")


def best_image(rows: DataFrame, model: Model, id_col: str = "image_id", features: str = "features") -> DataFrame:
    """component, id, weight of the row with the greatest product with each column of the basis; ties go to the last id."""
    each = rows.select(id_col, F.posexplode(projected(F.col(features), model.basis)).alias("component", "weight"))
    return each.groupBy("component").agg(F.max(F.struct("weight", id_col)).alias("b")).select("component", f"b.{id_col}", "b.weight")
