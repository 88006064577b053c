"""Incremental ingestion: a stream of image files whose features are added to a table, each image once.

An extension: feature tables used to be filled by scripts that looked for what was missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectrail.sources import images, store

IMAGE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """image_path and image_name of files as they arrive."""
    raw = spark.readStream.format("binaryFile").schema(IMAGE_SCHEMA).option("pathGlobFilter", pattern).load(folder)
    return raw.select(F.col("path").alias("image_path"), F.element_at(F.split("path", "/"), -1).alias("image_name"))


def add_features(batch: DataFrame, table_path: str, models: tuple[str, ...]) -> None:
    """Append features of a batch's images that the table does not hold; a batch that comes again adds nothing."""
    spark = batch.sparkSession
    try:
        present = spark.read.parquet(table_path).select("image_name")
    except Exception as error:  # the table starts with the first batch
        if "PATH_NOT_FOUND" not in str(error):
            raise
        present = batch.select("image_name").limit(0)
    new = store.missing(batch.dropDuplicates(["image_name"]), present, "image_name")
    paths = [r.image_path for r in new.select("image_path").collect()]  # file names of one trigger
    if paths:
        raw = spark.read.format("image").load(paths).select("image.*")
        decoded = raw.select(F.col("origin").alias("image_path"), F.element_at(F.split("origin", "/"), -1).alias("image_name"), "height", "width", F.col("nChannels").alias("channels"), F.col("data").alias("pixels"))
        images.features(decoded, models).write.mode("append").parquet(table_path)


def ingest(spark: SparkSession, folder: str, table_path: str, checkpoint: str, models: tuple[str, ...] = images.MODELS, pattern: str = "*.jpg") -> StreamingQuery:
    """Take in what is there and what arrived since the last call, then stop (availableNow)."""
    stream = file_stream(spark, folder, pattern)
    return stream.writeStream.foreachBatch(lambda batch, _: add_features(batch, table_path, models)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
