"""Boilerplate lines by site-relative frequency.

For every site the number of its pages that hold a line is divided by the number
of its pages; lines above the ratio are boilerplate of that site and are dropped
from its pages. Pages with the same text count once, so copies of a page do not
turn its own lines into boilerplate. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Share of a site's pages above which a line is boilerplate, and the fewest pages that must hold it.
RATIO, FEWEST = 0.02, 3
#: Boilerplate tables of at most so many lines are broadcast; larger ones are joined by shuffle.
BROADCAST_LINES = 200_000
#: White space around a line that does not tell lines apart.
EDGES = " \t\r\x0b\x0c"


def lines_of(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def hashed_lines(text: str) -> Column:
    """Hashes of the lines without the white space around them, in order; the hash of a blank line is null."""
    return F.transform(lines_of(text), lambda s: F.when(F.btrim(s, F.lit(EDGES)) != "", F.xxhash64(F.btrim(s, F.lit(EDGES)))))


def frequent_lines(docs: DataFrame, host: str, text: str, ratio: float = RATIO, fewest: int = FEWEST) -> DataFrame:
    """Stored (site, key, pages, share): hashes of the lines that more than ``ratio`` of a host's pages hold. No text is shuffled."""
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    hashed = pages.select("host", F.xxhash64("text").alias("page"), "text")
    totals = hashed.groupBy("host", "page").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("total"))
    lines = hashed.select("host", "page", F.explode(F.array_distinct(hashed_lines("text"))).alias("h")).where(F.col("h").isNotNull())
    counts = lines.distinct().groupBy("host", "h").agg(F.count("*").alias("pages")).where(F.col("pages") >= fewest)
    joined = counts.join(totals.withColumnRenamed("host", "site"), F.col("host").eqNullSafe(F.col("site")))
    share = F.col("pages") / F.col("total")
    return stored(joined.where(share > ratio).select(F.col("host").alias("site"), F.col("h").alias("key"), "pages", share.alias("share")), "frequent-lines")


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float = RATIO, fewest: int = FEWEST) -> DataFrame:
    """(host, line, pages, share): the lines that more than ``ratio`` of a host's pages hold, with their text."""
    frequent = frequent_lines(docs, host, text, ratio, fewest)
    side = F.broadcast(frequent) if frequent.count() <= BROADCAST_LINES else frequent
    single = F.explode(F.array_distinct(F.transform(lines_of(text), lambda s: F.btrim(s, F.lit(EDGES)))))
    lines = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), single.alias("line")).where(F.col("line") != "").withColumn("h", F.xxhash64("line"))
    found = lines.join(side, F.col("host").eqNullSafe(F.col("site")) & (F.col("h") == F.col("key")))
    return found.groupBy("host", "line").agg(F.first("pages").alias("pages"), F.first("share").alias("share"))


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", ratio: float = RATIO, fewest: int = FEWEST, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, host, text, n_lines, n_dropped) of every row, with its site's boilerplate lines dropped from the text.

    Lines end at \\n and are compared without the white space around them; blank
    lines stay. Null is a site of its own; a null text stays null with no lines; an
    empty text is one blank line; repeated rows are one page in the counts and
    repeated rows in the result; the columns in ``carry`` pass through, others are
    ignored.

    Lines are compared by 64-bit hashes; an empty table gives an empty result; texts
    of any length are handled whole. A site has at most (lines of a page / ratio)
    boilerplate lines. Their hashes are counted: a small table is broadcast, grouped
    by site; a larger one meets the lines of the pages in a shuffle join, and pages
    are put together again by row.
    """
    common = frequent_lines(docs, host_col, text_col, ratio, fewest)
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry)).alias("carry"))
    listed = lines_of("text")
    if common.count() <= BROADCAST_LINES:
        by_site = F.broadcast(common.groupBy("site").agg(F.collect_list("key").alias("bad")))
        met = rows.join(by_site, F.col("host").eqNullSafe(F.col("site")), "left")
        # a hash set of the site's lines meets the page's lines once; what they share is short
        mine = F.array_intersect(hashed_lines("text"), F.coalesce("bad", F.array().cast("array<bigint>")))
        met = met.withColumn("mine", mine)
        good = lambda s: ~F.coalesce(F.array_contains(F.col("mine"), F.xxhash64(F.btrim(s, F.lit(EDGES)))) & (F.btrim(s, F.lit(EDGES)) != ""), F.lit(False))
        kept = F.when(F.size("mine") == 0, listed).otherwise(F.filter(listed, good))
        out = met.select("id", "host", "text", "carry", listed.alias("all"), kept.alias("kept"))
    else:
        page = rows.withColumn("row", F.struct("id", "host", F.xxhash64("text", "carry").alias("h")))
        exploded = page.select("row", F.posexplode(listed).alias("at", "raw")).withColumn("line", F.btrim("raw", F.lit(EDGES)))
        exploded = exploded.withColumn("h", F.when(F.col("line") != "", F.xxhash64("line")))
        good = exploded.join(common, F.col("row.host").eqNullSafe(F.col("site")) & (F.col("h") == F.col("key")), "left_anti")
        # a set where the lines are: of a row that repeats each task sends its lines once
        parts = good.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("at", "raw"))).alias("parts"))
        parts = parts.select(F.col("row").alias("its"), F.col("parts.raw").alias("left"))
        met = page.join(parts, F.col("row") == F.col("its"), "left")
        out = met.select("id", "host", "text", "carry", listed.alias("all"), F.when(F.col("text").isNotNull(), F.coalesce("left", F.array().cast("array<string>"))).alias("kept"))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("all"))
    left = F.when(F.col("text").isNull(), 0).otherwise(F.size("kept"))
    text = F.when(F.col("text").isNotNull(), F.array_join("kept", "\n"))
    return out.select(F.col("id").alias(id_col), F.col("host").alias(host_col), text.alias(text_col), lines.cast("long").alias("n_lines"), (lines - left).cast("long").alias("n_dropped"), *(F.col("carry")[c].alias(c) for c in carry))
