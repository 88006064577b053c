"""Image folders, metadata files, and feature tables made from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrail.functions import images as kernels
from vectrail.sources import store

#: Columns that metadata files may hold, by name; any order.
METADATA = {
    "id": T.IntegerType(), "age": T.IntegerType(), "gender": T.StringType(), "skinColor": T.StringType(), "accessories": T.IntegerType(),
    "nailPolish": T.IntegerType(), "aspectOfHand": T.StringType(), "imageName": T.StringType(), "irregularities": T.IntegerType(),
}
MODELS = ("CM", "LBP", "HOG")


def listing(spark: SparkSession, folder: str, pattern: str | None = "*.jpg") -> DataFrame:
    """image_path, image_name of a folder's files; pattern None: all files. Contents are not read."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select(F.col("path").alias("image_path"), F.element_at(F.split("path", "/"), -1).alias("image_name"))


def decoded(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """image_path, image_name, height, width, channels and pixels (row by row, blue first)."""
    raw = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder).select("image.*")
    return raw.select(F.col("origin").alias("image_path"), F.element_at(F.split("origin", "/"), -1).alias("image_name"), "height", "width", F.col("nChannels").alias("channels"), F.col("data").alias("pixels"))


def features(images: DataFrame, models: tuple[str, ...] = MODELS, whole_image_lbp: bool = False) -> DataFrame:
    """image_name, image_path and a vector for each model. Images are worked on where they lie, a batch at a time."""
    unknown = set(models) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}; known: {', '.join(MODELS)}")
    of = {"CM": kernels.color_moments, "LBP": lambda x: kernels.lbp(x, whole_image=whole_image_lbp), "HOG": kernels.hog}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h, w, c = (b.column(n)[i].as_py() for n in ("height", "width", "channels"))
                x = np.frombuffer(b.column("pixels")[i].as_py(), dtype=np.uint8).reshape(h, w, c)
                x = np.repeat(x, 3, axis=2) if c == 1 else x[..., :3]
                yield pa.RecordBatch.from_arrays([b.column("image_name").slice(i, 1), b.column("image_path").slice(i, 1), *(pa.array([of[m](x)], pa.list_(pa.float64())) for m in models)], names=["image_name", "image_path", *models])

    return images.mapInArrow(run, "image_name string, image_path string, " + ", ".join(f"{m} array<double>" for m in models))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A metadata file with header; known columns have fixed types, whatever their order."""
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(n, METADATA.get(n, T.StringType())) for n in names])
    return spark.read.option("header", True).schema(schema).csv(path).withColumnRenamed("imageName", "image_name").withColumnRenamed("aspectOfHand", "aspect_of_hand")


def in_folder(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Metadata of the images that are there."""
    return rows.join(files.select("image_name"), "image_name", "left_semi")


def split_metadata(spark: SparkSession, folder: str, csv_path: str, out: str, pattern: str | None = None) -> None:
    """Write the metadata of a folder's images as a file with header."""
    in_folder(metadata(spark, csv_path), listing(spark, folder, pattern)).write.mode("overwrite").option("header", True).csv(out)


def extend(table: DataFrame, images: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """table with features of those images that have none yet."""
    ready = table
    for m in models:
        ready = ready.where(F.col(m).isNotNull()) if m in table.columns else ready.limit(0)
    return store.upsert(table, features(store.missing(images, ready, "image_name"), models), "image_name")


def log_append(rows: DataFrame, path: str) -> None:
    """Append result rows to a log of experiments."""
    rows.write.mode("append").option("header", True).csv(path)
