"""Intermediate tables in a folder that the driver and every executor reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode, where it is unset, one below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if warehouse.startswith(("/", "file:")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        named = warehouse.rstrip("/") + "/_shared"
    return named.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop's objects."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    folder = f"{shared_dir(spark)}/libretto/{name}-{uuid.uuid4().hex}"
    at, fs = hadoop(spark, folder)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{folder}/data"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what follows re-reads it, and does not compute it again."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Bytes of texts that a Python worker gets at a time.
BATCH = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH) -> Iterator[None]:
    """What is computed meanwhile hands texts to Python by their bytes, so that a worker's memory does not grow with the number of rows a task has."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if had is None else spark.conf.set(key, had)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` stored, and its number of rows."""
    out = stored(df, name)
    return out, out.count()


def forget(*dfs: DataFrame) -> None:
    """Delete stored steps that nothing reads any more."""
    for df in dfs:
        at, fs = hadoop(df.sparkSession, df.stored_at)
        fs.delete(at, True)
