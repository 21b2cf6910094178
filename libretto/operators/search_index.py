"""Substring search through a stored inverted index of letter groups.

Every title and synopsis is a unit, numbered; the index holds for each group of one,
two or three letters the units that have it, in chunks of bounded size, and the
number of them. A pattern's letters between wildcards give its groups; the lists of
the rarest are intersected chunk by chunk, and only the works left are looked up and
tested with the pattern itself. What holds for ``ilike`` holds here: case, wildcards,
escapes and nulls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from libretto.plans.store import counted, fresh

#: Works in a chunk (as a power of two), letter groups of a pattern that are intersected, and works for which a bucket of the lists is made.
CHUNK_BITS, RAREST, BUCKET_WORKS = 16, 4, 100_000
#: Rows of a table that may be broadcast, and of one whose keys are written into the scan of what it meets.
SMALL, FEW = 200_000, 1000

TEXTS, LISTS, SIZES = "id string, title string, synopsis string, n long, chunk long", "letters string, chunk long, units array<long>, bucket int", "letters string, held long"


def pieces(text: Column, n: int) -> Column:
    """All runs of ``n`` letters."""
    many = F.length(text) - n + 1
    return F.when(many > 0, F.transform(F.sequence(F.lit(1), many), lambda k: F.substring(text, k, n))).otherwise(F.array().cast("array<string>"))


def groups_of_text(text: Column) -> Column:
    """Distinct groups of up to three letters; the empty one stands in every text."""
    return F.array_distinct(F.concat(F.array(F.lit("")), pieces(text, 1), pieces(text, 2), pieces(text, 3)))


def groups_of_pattern(pattern: Column) -> Column:
    """Groups that a text needs to match: of each run of letters between wildcards, or of the empty pattern the empty one. An escaped letter counts as a wildcard: one test less, no match lost."""
    runs = F.filter(F.split(F.lower(pattern), r"\\.?|[%_]"), lambda r: r != "")
    each = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 3, F.array(r)).otherwise(pieces(r, 3))))
    return F.when(F.size(each) > 0, F.array_distinct(each)).otherwise(F.array(F.lit("")))


@dataclass(frozen=True)
class TextIndex:
    """The index below ``path``: ``texts`` by chunk, ``lists`` by bucket of the letter group, ``sizes``."""

    spark: SparkSession
    path: str
    buckets: int

    @classmethod
    def build(cls, works: DataFrame, path: str | None = None) -> TextIndex:
        """Index the title and synopsis of works (id, title, synopsis)."""
        spark = works.sparkSession
        path = path or fresh(spark, "text-index")
        texts = works.select("id", "title", "synopsis").withColumn("n", F.monotonically_increasing_id()).withColumn("chunk", F.shiftright("n", CHUNK_BITS))
        texts.write.partitionBy("chunk").parquet(f"{path}/texts")
        texts = spark.read.schema(TEXTS).parquet(f"{path}/texts")
        buckets = max(1, -(-texts.count() // BUCKET_WORKS))
        unit = F.explode(F.array(F.struct((F.col("n") * 2).alias("unit"), F.lower("title").alias("said")), F.struct((F.col("n") * 2 + 1).alias("unit"), F.lower("synopsis").alias("said"))))
        units = texts.select("chunk", unit.alias("u")).where("u.said is not null")
        held = units.select("chunk", F.col("u.unit").alias("unit"), F.explode(groups_of_text(F.col("u.said"))).alias("letters"))
        # the empty group's list, too, is cut at every chunk
        lists = held.groupBy("letters", "chunk").agg(F.array_sort(F.collect_list("unit")).alias("units")).withColumn("bucket", _bucket(F.col("letters"), buckets))
        lists.repartition("bucket").sortWithinPartitions("bucket", "letters", "chunk").write.partitionBy("bucket").parquet(f"{path}/lists")
        sizes = spark.read.schema(LISTS).parquet(f"{path}/lists").groupBy("letters").agg(F.sum(F.size("units")).alias("held"))
        sizes.write.parquet(f"{path}/sizes")
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")
        return cls(spark, path, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        return cls(spark, path, spark.read.parquet(f"{path}/layout").first()["buckets"])

    def rarest(self, patterns: DataFrame) -> DataFrame:
        """(request, letters, bucket, need): the RAREST letter groups of each request (request, pattern); none for a request with a group that no text has."""
        sizes = self.spark.read.schema(SIZES).parquet(f"{self.path}/sizes")
        wanted = patterns.where("pattern is not null").select("request", F.explode(groups_of_pattern(F.col("pattern"))).alias("letters"))
        of_request = Window.partitionBy("request")
        ranked = wanted.join(sizes, "letters", "left").withColumns({"place": F.row_number().over(of_request.orderBy(F.coalesce("held", F.lit(0)), "letters")), "lacks": F.max(F.col("held").isNull()).over(of_request), "groups": F.count("*").over(of_request)})
        kept = ranked.where(~F.col("lacks") & (F.col("place") <= RAREST))
        return kept.select("request", "letters", _bucket(F.col("letters"), self.buckets).alias("bucket"), F.least(F.col("groups"), F.lit(RAREST)).alias("need"))

    def candidates(self, patterns: DataFrame) -> DataFrame:
        """(request, chunk, n): works of which the title or the synopsis has all the rarest groups of the pattern."""
        wanted, n = counted(self.rarest(patterns), "wanted")
        met = _met(self.spark.read.schema(LISTS).parquet(f"{self.path}/lists"), wanted, n, ["bucket", "letters"])
        lists = met.groupBy("request", "chunk").agg(F.collect_list("units").alias("lists"), F.max("need").alias("need")).where(F.size("lists") == F.col("need"))
        common = F.aggregate("lists", F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        works = F.array_distinct(F.transform(common, lambda u: F.shiftright(u, 1)))
        return lists.select("request", "chunk", F.explode(works).alias("n"))

    def search(self, patterns: DataFrame) -> DataFrame:
        """(request, id): works whose title or synopsis is like ``%pattern%``, whatever the case, for each (request, pattern)."""
        found, n = counted(self.candidates(patterns), "candidates")
        texts = _met(self.spark.read.schema(TEXTS).parquet(f"{self.path}/texts"), found, n, ["chunk", "n"])
        like = F.concat(F.lit("%"), F.col("pattern"), F.lit("%"))
        tested = texts.join(patterns.select("request", "pattern"), "request").withColumn("like", like)
        return tested.where(F.expr("title ilike like or synopsis ilike like")).select("request", "id")

    def ids(self, pattern: str) -> DataFrame:
        """(id) of one pattern."""
        one = self.spark.range(1).select(F.lit(0).alias("request"), F.lit(pattern).alias("pattern"))
        return self.search(one).select("id")


def _met(df: DataFrame, asked: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """``df`` joined with the ``n`` rows of ``asked``. Where those are few their keys go into the scan: of the folders and row groups of ``df`` only the ones they lie in are read."""
    if n > FEW:
        return df.join(F.broadcast(asked) if n <= SMALL else asked, keys)
    rows = asked.select(*keys).distinct().collect()
    for key in keys:
        df = df.where(F.col(key).isin(sorted({r[key] for r in rows})))
    return df.join(F.broadcast(asked), keys)


def _bucket(letters: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(letters), F.lit(buckets)).cast("int")


def containing(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, value): every value (value) that contains a term (term), both compared as they are, through an index of the values."""
    index = TextIndex.build(values.select("value").distinct().select(F.col("value").alias("id"), F.col("value").alias("title"), F.lit(None).cast("string").alias("synopsis")))
    # wildcards in a term are letters here
    pattern = F.regexp_replace("term", r"([%_\\])", r"\\$1")
    asked = terms.select("term").distinct().select(F.col("term").alias("request"), pattern.alias("pattern"))
    return index.search(asked).select(F.col("request").alias("term"), F.col("id").alias("value")).where(F.col("value").contains(F.col("term")))
