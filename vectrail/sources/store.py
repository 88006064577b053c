"""Tables that outlive a plan: the shared folder, and the upserts of feature tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, or one of our own where it names none and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vectrail-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder, so that iterations do not grow its plan."""
    return df.sparkSession.read.parquet(appended(df, name))


def appended(df: DataFrame, name: str, path: str | None = None) -> str:
    """Path of a table in the shared folder to which the rows of df are added; without a path it is new."""
    path = path or f"{shared_dir(df.sparkSession)}/vectrail/{name}-{uuid.uuid4().hex}"
    df.write.mode("append").parquet(path)
    return path


def upsert(table: DataFrame, new: DataFrame, key: str, insert: bool = True) -> DataFrame:
    """table with the columns of new set where keys match; other rows of new are added if insert."""
    old, fresh = table.alias("o"), new.alias("n")
    joined = old.join(fresh, F.col(f"o.{key}") == F.col(f"n.{key}"), "full" if insert else "left")
    names = [*table.columns, *(c for c in new.columns if c not in table.columns)]

    def column(c: str):
        sides = [F.col(f"{s}.{c}") for s, d in (("n", new), ("o", table)) if c in d.columns]
        return F.coalesce(*sides).alias(c)

    return joined.select(*map(column, names))


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among keys."""
    return table.join(keys.select(key), key, "left_anti")


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows of wanted that still have to be computed; empty if nothing is new."""
    return wanted.join(present.select(key), key, "left_anti")
