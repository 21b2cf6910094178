"""Exact dedup against a persistent index of digests, bucketed and sorted by digest.

The index holds one row per distinct text ever seen: the digest of the normalised
text and the row that stays. New rows are digested, combined by digest where they
are read, and met with the index by a sort-merge anti-join: the index is in place,
in buckets, and is neither shuffled nor rewritten. What no earlier row had is
appended to the same buckets. Built-in functions throughout.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, MOST_PARTS, _fresh, _hadoop, stored

#: Digests that a bucket of a new index is made for.
BUCKET_ROWS = 1_000_000
#: A group of copies counts as large from this share of all rows on: there are at most MOST_LARGE such groups, whatever the rows.
LEAST_LARGE, MOST_LARGE = 64, 10_000


def digest(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{ASCII_SPACE}]++", " "), 256))


class DigestIndex:
    """Digests of all texts seen, each with the id and the row number of the row that stays.

    Lives below ``path``: Parquet files in buckets by digest, sorted within each, and
    the number of buckets. ``open`` finds it again in a later session. ``add`` may be
    repeated after a failure: digests that are there already are not added again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str):
        self.spark, self.path, self.buckets, self.id_type = spark, path, buckets, id_type
        self.table = f"libretto_digests_{uuid.uuid4().hex}"
        spark.sql(f"create table {self.table} (digest binary, keep_id {id_type}, keep_row bigint) using parquet clustered by (digest) sorted by (digest) into {buckets} buckets location '{path}/digests'")

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint") -> DigestIndex:
        spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(id_type).alias("id_type")).write.parquet(f"{path}/layout")
        return cls(spark, path, buckets, id_type)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        layout = spark.read.parquet(f"{path}/layout").first()
        return cls(spark, path, layout["buckets"], layout["id_type"])

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, rows: DataFrame) -> None:
        """Append the digests of ``rows`` (digest, id, row) that the index lacks, each with its first row: the smallest id, null last, then the smallest row number."""
        first = rows.groupBy("digest").agg(_first().alias("f"))
        new = first.hint("merge").join(self.rows(), "digest", "left_anti")
        new.select("digest", F.col("f.id").alias("keep_id"), F.col("f.row").alias("keep_row")).write.insertInto(self.table)

    def rebuilt(self, path: str, buckets: int) -> DigestIndex:
        """The same digests below another path, one file a bucket: after many appends, or with more buckets for a grown index."""
        new = DigestIndex.create(self.spark, path, buckets, self.id_type)
        self.rows().repartition(buckets, "digest").write.insertInto(new.table)
        return new

    def close(self) -> None:
        """The table's name leaves the session; the files stay."""
        self.spark.sql(f"drop table if exists {self.table}")


def _first() -> Column:
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))


def digested(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(digest, id, row) of every row, stored: the texts are read once, here."""
    rows = docs.select(digest(F.col(text_col)).alias("digest"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"))
    return stored(rows, "digests")


def decide(rows: DataFrame, index: DigestIndex, n: int) -> DataFrame:
    """What becomes of each of ``n`` rows (digest, id, row), all of them in the index: (id, row, digest, keep_id, group_size, kept).

    Rows without a copy come from the count of their digest, with no further join. A
    large group's keeper is broadcast: a group of at least n / MOST_LARGE rows is one
    of at most MOST_LARGE. The others are joined by digest.
    """
    counted = rows.groupBy("digest").agg(F.count("*").alias("group_size"), _first().alias("f"))
    groups = stored(counted.hint("merge").join(index.rows(), "digest"), "groups")
    large = F.col("group_size") >= max(LEAST_LARGE, -(-n // MOST_LARGE))
    keeper = ["digest", "keep_id", "keep_row", "group_size"]
    alone = groups.where("group_size = 1").select(F.col("f.id").alias("id"), F.col("f.row").alias("row"), *keeper)
    hot = groups.where(large).select(*keeper)
    crowd = rows.join(F.broadcast(hot), "digest").select("id", "row", *keeper)
    few = groups.where(~large & (F.col("group_size") > 1)).select(*keeper)
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(few, "digest").select("id", "row", *keeper)
    every = alone.unionAll(crowd).unionAll(rest)
    return every.select("id", "row", "digest", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))).alias("kept"))


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", batches: int = 4) -> DataFrame:
    """Each row of ``docs`` with the row that stays of its text: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal if they are once each run of ASCII white space is one space; null
    counts as empty. The index starts empty and takes the rows in ``batches`` ranges of
    ascending id, as they would come in over time: a text's first range holds its
    smallest id, so that one stays. Null ids come last and stay only where no row with
    an id has the text (``keep_id`` is null then). Of rows that repeat id and text
    one is kept. Other columns are ignored, whatever their names; an empty table gives
    an empty result. A group of copies may hold any share of the rows.
    """
    spark = docs.sparkSession
    rows = digested(docs, text_col, id_col)
    n = rows.count()
    cuts = rows.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if n else []
    place = F.lit(0)
    for cut in sorted(set(cuts)):
        place = place + F.when(F.col("id").cast("double") <= cut, 0).otherwise(1)
    rows = rows.withColumn("batch", place)
    path = _fresh(spark, "digest-index")
    # with fewer buckets than shuffle partitions Spark would rather shuffle the index
    buckets = min(MOST_PARTS, max(-(-n // BUCKET_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    index = DigestIndex.create(spark, path, buckets, dict(rows.dtypes)["id"])
    at, fs = _hadoop(spark, path)
    fs.deleteOnExit(at)
    for k in range(len(set(cuts)) + 1):
        index.add(rows.where(F.col("batch") == k))
    found = decide(rows, index, n)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_new(docs: DataFrame, index: DigestIndex, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text neither the index nor an earlier row has, all columns as they are; their digests join the index.

    Repeated and null texts and ids count as in ``exact_duplicates``. A batch that is
    given again after it was added loses all its rows, as all are known then.
    """
    numbered = stored(docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), digest(F.col(text_col)).alias("digest")), "numbered")
    first = numbered.groupBy("digest").agg(_first().alias("f"))
    new = stored(first.hint("merge").join(index.rows(), "digest", "left_anti").select("digest", F.col("f.id").alias("id"), F.col("f.row").alias("row")), "new-digests")
    index.add(new)
    return numbered.join(new.select("row"), "row", "left_semi").select("doc.*")
