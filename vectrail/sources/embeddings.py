"""Feature vectors of the standard tables as image rows with metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, features, subject, aspect_of_hand, accessories, gender."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    side = F.when(F.col("label") % 2 == 0, "dorsal").otherwise("palmar")
    hand = F.when(F.col("vec_id") % 2 == 0, "left").otherwise("right")
    return raw.select(
        F.col("vec_id").alias("image_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label").alias("subject"),
        F.concat_ws(" ", side, hand).alias("aspect_of_hand"),
        (F.col("vec_id") % 3 == 0).cast("int").alias("accessories"),
        F.when(F.col("vec_id") % 5 < 2, "male").otherwise("female").alias("gender"),
    )


#: The same rows in SQL, for the queries' counterparts.
IMAGES_SQL = """images AS (
  SELECT vec_id AS image_id, CAST(embedding AS DOUBLE[]) AS features, label AS subject,
         CASE WHEN label % 2 = 0 THEN 'dorsal' ELSE 'palmar' END || ' ' || CASE WHEN vec_id % 2 = 0 THEN 'left' ELSE 'right' END AS aspect_of_hand,
         CAST(vec_id % 3 = 0 AS INTEGER) AS accessories,
         CASE WHEN vec_id % 5 < 2 THEN 'male' ELSE 'female' END AS gender
  FROM embeddings)"""
