"""Incremental ingestion with Structured Streaming: each file once, each claim once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from libretto.operators.ingest import unseen
from libretto.plans.snapshots import Snapshots
from libretto.plans.store import forget, stored


#: Parts of a target, by hash of the key: a batch meets only the parts its keys are in.
PARTS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def append_unseen(target: str, keys: tuple[str, ...], parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A batch writer that skips keys the target holds: a batch that is tried again adds nothing twice.

    The target is partitioned by a hash of the key, and only the partitions that the
    batch's keys fall in are read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).persist()
        try:
            if _exists(spark, target):
                mine = [r["part"] for r in new.select("part").distinct().collect()]  # as many as there are parts at most
                old = spark.read.schema(new.schema).parquet(target).where(F.col("part").isin(mine))
            else:
                old = spark.createDataFrame([], new.schema)
            unseen(new, old, keys).write.mode("append").partitionBy("part").parquet(target)
        finally:
            new.unpersist()

    return write


def stream_claims(spark: SparkSession, source: str, schema, target: str, checkpoint: str, claims: Callable[[DataFrame], DataFrame], keys: tuple[str, ...], trigger: dict | None = None) -> StreamingQuery:
    """Read new Parquet files below ``source``, derive claims, append the unseen ones.

    The default trigger handles what is there and stops; ``{"processingTime": "1
    hour"}`` keeps the periodic refresh of the batch jobs.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    out = claims(rows).writeStream.foreachBatch(append_unseen(target, keys)).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and mean value by type and tumbling window, with late rows accepted for ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


# -- once each, however often the stream says it ----------------------------------------

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def commit_unseen(store: Snapshots, table: str, name: str, keys: tuple[str, ...], parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A batch writer that commits each batch of the stream ``name`` once, with the keys that the table lacks.

    Rows and the batch's number go into one version of the snapshot, so that a batch
    that was committed, but not noted by the stream, is recognised when it comes again.
    The table is cut into parts by key, of which only the batch's are read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        tx = store.begin()
        if not tx.once(name, batch_id):
            return
        new = stored(batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")), "batch")
        if table in tx.base.tables:
            mine = [str(r["part"]) for r in new.select("part").distinct().collect()]  # as many as there are parts at most
            fresh_rows = unseen(new, tx.base.read(table, mine), keys)
        else:
            fresh_rows = unseen(new, batch.sparkSession.createDataFrame([], new.schema), keys)
        tx.append(table, fresh_rows.select(*new.columns), "part")
        tx.commit()
        forget(new)

    return write


def stream_claims_once(spark: SparkSession, source: str, schema, store: Snapshots, table: str, checkpoint: str, claims: Callable[[DataFrame], DataFrame], keys: tuple[str, ...], name: str, within: str = "1 day", files: int = 1000, trigger: dict | None = None) -> StreamingQuery:
    """Claims of new Parquet files below ``source``, each key once.

    Keys seen within the last ``within`` are held in state, in RocksDB, and repeats go
    before they are written; what comes again later is found in the table. Time is that
    of arrival, which never runs back: no row is late. ``files`` are read at once.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    arrived = claims(rows).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", within)
    once = arrived.dropDuplicatesWithinWatermark(list(keys)).drop("arrived")
    out = once.writeStream.queryName(name).foreachBatch(commit_unseen(store, table, name, keys)).option("checkpointLocation", checkpoint)
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        return out.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(STATE_STORE, before)


# -- windows ------------------------------------------------------------------------------


def sliding_counts(events: DataFrame, size: str = "1 hour", slide: str = "20 minutes", late: str = "2 hours") -> DataFrame:
    """Events and mean value by type and window of ``size`` that starts every ``slide``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events by user and session: a session ends once nothing has come for ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def run_windows(spark: SparkSession, source: str, schema, windows: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files: int = 1, trigger: dict | None = None) -> StreamingQuery:
    """Append the windows that the watermark closes to Parquet files below ``target``; rows behind it are dropped."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows(rows).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()
