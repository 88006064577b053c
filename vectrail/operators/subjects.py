"""Subjects: groups of images compared by their mean vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.functions import vectors
from vectrail.operators import reduce


def means(rows: DataFrame, group: str = "subject", features: str = "features") -> DataFrame:
    """group, features: the mean vector, by partial sums for each place."""
    each = rows.select(group, F.posexplode(features).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(features))


def most_similar(rows: DataFrame, subject, top: int = 3, group: str = "subject") -> DataFrame:
    """The subjects most like one, by 100 / distance."""
    m = means(rows, group)
    query = m.where(F.col(group) == subject).select(F.col("features").alias("query"))
    scored = m.where(F.col(group) != subject).crossJoin(F.broadcast(query))
    return scored.select(group, vectors.inverse_similarity(vectors.l2(F.col("features"), F.col("query"))).alias("similarity")).orderBy(F.desc("similarity"), group).limit(top)


def reduced_means(rows: DataFrame, method: str, k: int, group: str = "subject") -> DataFrame:
    """Mean vectors of all subjects, reduced together."""
    m = means(rows, group)
    reduced, _ = reduce.reduce(m.withColumnRenamed(group, "image_id"), method, k)
    return reduced.withColumnRenamed("image_id", group)


def grid(rows: DataFrame, subject, methods: tuple[str, ...], sizes: tuple[int, ...], group: str = "subject") -> DataFrame:
    """method, k and the most similar subjects for every combination."""
    parts = [most_similar(reduced_means(rows, m, k, group), subject, group=group).select(F.lit(m).alias("method"), F.lit(k).alias("k"), "*") for m in methods for k in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matrix(rows: DataFrame, compat: bool = False, group: str = "subject") -> DataFrame:
    """subject_a, subject_b, similarity: one half by a join on a < b, the other mirrored, 100 on the diagonal.
    compat: similarity of the last components alone."""
    m = means(rows, group)
    a, b = m.alias("a"), m.alias("b")
    x, y = F.col("a.features"), F.col("b.features")
    score = vectors.last_component_similarity(x, y) if compat else vectors.inverse_similarity(vectors.l2(x, y))
    half = a.join(b, F.col(f"a.{group}") < F.col(f"b.{group}")).select(F.col(f"a.{group}").alias("subject_a"), F.col(f"b.{group}").alias("subject_b"), score.alias("similarity"))
    mirrored = half.select(F.col("subject_b").alias("subject_a"), F.col("subject_a").alias("subject_b"), "similarity")
    diagonal = m.select(F.col(group).alias("subject_a"), F.col(group).alias("subject_b"), F.lit(100.0).alias("similarity"))
    return half.unionByName(mirrored).unionByName(diagonal)
