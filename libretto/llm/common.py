"""Helpers shared by the pipeline operators: shared storage, sizing, Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java / RE2 / Python character class body.
ASCII_SPACE = r"\x20\x09-\x0D"


#: Shuffle files go when the write that needed them ends, so a chain of steps keeps one step's files.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a folder
    under the warehouse is taken, if the executors reach it: in local mode, or if the
    warehouse is no machine's own disk. Otherwise it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        own_disk = warehouse.startswith(("/", "file:"))
        if own_disk and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        named = warehouse.rstrip("/") + "/_shared"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/libretto/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _written(spark: SparkSession, path: str, write: Callable[[], None]) -> None:
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        write()
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    at, fs = _hadoop(spark, path)
    fs.deleteOnExit(at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage without localCheckpoint: a lost executor costs a re-read, not a
    recomputation. The folder goes with ``forget``, or when the application ends.
    """
    spark = df.sparkSession
    path = _fresh(spark, name)
    _written(spark, path, lambda: df.write.parquet(path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a stored step's files."""
    at, fs = _hadoop(df.sparkSession, df.stored_at)
    return fs.getContentSummary(at).getLength()


#: Most buckets that Spark lets a table have.
MOST_PARTS = 100_000


def dealt_out(df: DataFrame, by: str, parts: int, name: str) -> DataFrame:
    """``df`` as a bucketed Parquet table in the shared folder: groupings by ``by`` read it without a shuffle."""
    spark = df.sparkSession
    path, parts = _fresh(spark, name), min(parts, MOST_PARTS)
    table = f"libretto_{uuid.uuid4().hex}"
    writer = df.repartition(parts, by).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, by).sortBy(by)
    _written(spark, path, lambda: writer.saveAsTable(table))
    out = spark.table(table)
    # the files stay where they are; only the name goes out of the catalogue
    spark.sql(f"drop table {table}")
    out.stored_at = path
    return out


def forget(*dfs: DataFrame) -> None:
    """Delete stored steps that nothing reads any more."""
    for df in dfs:
        at, fs = _hadoop(df.sparkSession, df.stored_at)
        fs.delete(at, True)


def map_arrow(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]]) -> DataFrame:
    """Run ``make()(batch)`` per Arrow batch; it returns the output columns by name.

    ``make`` is called once per task, so per-task caches live in its closure.
    Long batches are cut so that texts in flight stay near ``SLICE_BYTES``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for piece in slices(batch):
                if (got := work(piece)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


#: Input bytes that one call of a batch function sees at most (one longer row still goes whole).
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * limit / max(1, batch.nbytes))) if batch.nbytes > limit else batch.num_rows
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
