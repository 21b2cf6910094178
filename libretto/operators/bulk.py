"""Serving for many requests at once: deep pages, nearest chapters, similar works of every work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from libretto.functions import text as T
from libretto.plans.store import counted, fresh, stored

from .search_index import SMALL, containing
from .serve import Tables, claim_value, claims_of_works

#: Rows in a block of ranked rows.
BLOCK_ROWS = 50_000
BLOCK = (StructField("block", IntegerType()),)


@dataclass(frozen=True)
class RankedPages:
    """Rows in one order, stored in blocks by range of it, with the number of rows before each block.

    A page, however deep, reads the one or two blocks it lies in. ``order`` has to be
    total, as all orders of the catalogue are.
    """

    spark: SparkSession
    path: str
    order: tuple[Column, ...]
    schema: StructType

    @classmethod
    def build(cls, df: DataFrame, order: list[Column], path: str | None = None, block_rows: int = BLOCK_ROWS) -> RankedPages:
        path = path or fresh(df.sparkSession, "ranked")
        blocks = max(1, -(-df.count() // block_rows))
        laid = df.repartitionByRange(blocks, *order).sortWithinPartitions(*order)
        laid.withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{path}/rows")
        sizes = df.sparkSession.read.schema(StructType([*df.schema, *BLOCK])).parquet(f"{path}/rows").groupBy("block").agg(F.count("*").alias("rows"))
        # a row for each block: one small window
        before = F.coalesce(F.sum("rows").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sizes.withColumn("before", before).coalesce(1).write.parquet(f"{path}/directory")
        return cls(df.sparkSession, path, tuple(order), df.schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str, order: list[Column], schema: StructType) -> RankedPages:
        return cls(spark, path, tuple(order), schema)

    def directory(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/directory")

    def total(self) -> int:
        return self.directory().agg(F.sum("rows")).first()[0] or 0

    def page(self, number: int, size: int = 20) -> DataFrame:
        """Rows (number - 1) * size and on, ``size`` at most, in order."""
        first = (number - 1) * size
        # as many blocks as the page lies in
        met = self.directory().where((F.col("before") < first + size) & (F.col("before") + F.col("rows") > first)).orderBy("block").collect()
        if not met:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(StructType([*self.schema, *BLOCK])).parquet(f"{self.path}/rows").where(F.col("block").isin([r["block"] for r in met])).drop("block")
        return rows.orderBy(*self.order).offset(first - met[0]["before"]).limit(size)


def placed(df: DataFrame, order: list[Column] | None = None, name: str = "place") -> DataFrame:
    """Rows with their place, from 1, in a total order, or as they come from a sort: sorted in ranges, numbered in each, the ranges' sizes added before them. No task sees all rows."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows = stored(laid.withColumns({"__range": F.spark_partition_id(), "__n": F.monotonically_increasing_id()}), "ranges")
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__rows"))
    # a row for each range
    before = sizes.select("__range", F.coalesce(F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.col("__n").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + own + 1).drop("__range", "__n", "__before")


def nearest_many(chapters: DataFrame, requests: DataFrame, group: str = "work_id", number: str = "chapter_number", tie: str = "id") -> DataFrame:
    """(request, group, target, number, id): the chapter nearest to each request (request, group, target).

    Ties to the smaller number, then the smaller id; a request for a group without
    numbered chapters, or without a target, gets none. One sort of chapters and
    requests together: each request sees the last number up to its own, and the next.
    """
    known = chapters.where(F.col(number).isNotNull()).groupBy(F.col(group).alias("g"), F.col(number).cast("double").alias("at")).agg(F.min(tie).alias("id"))
    asked = requests.where(F.col("target").isNotNull()).select(F.col(group).alias("g"), F.col("target").cast("double").alias("at"), F.lit(None).cast(dict(known.dtypes)["id"]).alias("id"), "request", F.lit(1).alias("kind"))
    both = known.select("g", "at", "id", F.lit(None).cast(dict(asked.dtypes)["request"]).alias("request"), F.lit(0).alias("kind")).unionByName(asked)
    here = F.when(F.col("kind") == 0, F.struct("at", "id"))
    line = Window.partitionBy("g").orderBy("at", "kind")
    around = both.withColumns({
        "low": F.last(here, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)),
        "high": F.first(here, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing)),
    }).where("kind = 1")
    down, up = F.col("at") - F.col("low.at"), F.col("high.at") - F.col("at")
    best = F.when(F.col("high").isNull() | (down <= up), F.col("low")).otherwise(F.coalesce("high", "low"))
    found = around.withColumn("best", best).where(F.col("best").isNotNull())
    return found.select("request", F.col("g").alias(group), F.col("at").alias("target"), F.col("best.at").alias(number), F.col("best.id").alias(tie))


def similar_all(t: Tables, size: int = 12) -> DataFrame:
    """(work_id, place, similar_id): what ``serve.similar`` finds, for every work at once.

    A claim's value is similar to all works of which it holds a term. The latest works
    of a value, then of a term, are taken before they meet: a list of size + 1 is
    enough for each, as a work leaves out itself alone. So no pairs of works that
    share a common term are formed.
    """
    latest = [F.desc_nulls_last("updated_at"), F.asc("work_id")]
    # claims meet their works once: a row for each different value of a work
    claims = t["metadata_claims"].where(F.col("field_name").isin("tags", "genres"))
    told = claims_of_works(t | {"metadata_claims": claims}).select("work_id", claim_value().alias("value"), "is_resolved")
    told = stored(told.groupBy("work_id", "value").agg(F.max("is_resolved").alias("is_resolved")), "told-values")
    dates = t["works"].select(F.col("id").alias("work_id"), "updated_at")
    top = lambda df, key: df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*latest))).where(F.col("place") <= size + 1).drop("place")
    # dealt by work, rows are told apart and meet their work's date where they are
    said = told.select("work_id", F.lower("value").alias("value")).repartition("work_id").distinct()
    top_said = stored(top(said.join(dates, "work_id"), "value"), "latest-of-values")
    tags = F.explode(T.parse_tags(F.col("value"))).alias("term")
    held = containing(top_said.select("value"), told.where("is_resolved").select("value").distinct().select(tags))
    of_term, n = counted(top(held.join(top_said, "value").select("term", "work_id", "updated_at").distinct(), "term"), "latest-of-terms")
    terms = told.where("is_resolved").select(F.col("work_id").alias("own"), tags).repartition("own").distinct()
    # where the lists of terms are broadcast, a work's rows stay together from here on
    met = terms.join(F.broadcast(of_term) if n <= SMALL else of_term, "term").where(F.col("own") != F.col("work_id")).select("own", "work_id", "updated_at").distinct()
    ranked = met.withColumn("place", F.row_number().over(Window.partitionBy("own").orderBy(*latest))).where(F.col("place") <= size)
    return ranked.select(F.col("own").alias("work_id"), "place", F.col("work_id").alias("similar_id"))
