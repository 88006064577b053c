"""What the operators of this subpackage share: table access, shared storage and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def giving_back(batches):
    """The batches of a Python worker's task; when they end, what the task used goes back to the system, as idle workers live on."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. A folder of our own only where the session names none and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="vectrail-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, so that lost executors cost
    one stage only, and a plan that uses the rows twice computes them once."""
    return reread(df.sparkSession, written(df, what))


def written(df: DataFrame, what: str = "table") -> str:
    path = f"{shared_dir(df.sparkSession)}/vectrail/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def reread(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table that written() made."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(column: pa.Array, most: int = 8_000_000):
    """The strings of an Arrow column, in runs of a bounded number of characters (a text is never cut)."""
    run, size = [], 0
    for x in column:
        s = x.as_py() or ""
        if run and size + len(s) > most:
            yield run
            run, size = [], 0
        run.append(s)
        size += len(s)
    if run:
        yield run


def parts(batch: pa.RecordBatch, column: int, most: int = 2_000_000):
    """Slices of a batch with the strings of one of its columns, each of a bounded number of characters (a text is never cut)."""
    at = 0
    for run in texts(batch.column(column), most):
        yield batch.slice(at, len(run)), run
        at += len(run)


def spread(df: DataFrame) -> DataFrame:
    """df as it is, or dealt out evenly if it is so small and in so few files that most cores would idle in Python work."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if size // part >= cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
