"""Discovery over tables of fetched pages: sitemaps, breadth-first frontiers, tiers and site probes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from libretto.functions import urls as U
from libretto.plans.store import stored

#: Fetch tiers, their names and delays in seconds.
TIERS = ((1, "httpx", 1.0), (2, "cloudscraper", 2.0), (3, "curl_cffi", 3.0), (4, "scrapling", 5.0))
MAX_DEPTH = 3


def tiers_table(spark) -> DataFrame:
    return spark.createDataFrame([(t, n, n, d) for t, n, d in TIERS], "tier int, name string, fetcher string, delay double")


def page_links(pages: DataFrame) -> DataFrame:
    """(url, link, is_listing): normalised addresses that each page links to."""
    raw = pages.select("url", F.explode(U.hrefs(F.col("html"))).alias("href")).withColumn("full", U.resolve(F.col("url"), F.col("href")))
    return raw.where(F.col("full").rlike("^(?i)https?://[^/]")).select("url", U.normalise(F.col("full")).alias("link"), U.is_listing(F.col("full")).alias("is_listing"))


def sitemap_urls(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    return sitemaps.select(F.explode(U.sitemap_locs(F.col(xml))).alias("loc")).select(U.normalise(F.trim("loc")).alias("url")).where(F.col("url") != "").distinct()


def discover(seeds: DataFrame, links: DataFrame, max_depth: int = MAX_DEPTH, max_pages: int | None = None, max_novels: int | None = None) -> DataFrame:
    """(url, depth, source, slug) of title pages reached breadth-first from ``seeds`` (url, source).

    One join and one anti-join per level; links and levels are stored, so that no
    level computes those before it again. ``max_pages`` bounds the addresses seen in
    order of depth and address, ``max_novels`` the rows returned; both are features
    of the operator and off unless asked for.
    """
    seen = stored(seeds.groupBy("url").agg(F.min("source").alias("source")).select("url", F.lit(0).alias("depth"), "source"), "frontier")
    links = stored(links.select("url", "link", "is_listing"), "links")
    frontier = seen
    for depth in range(1, max_depth):
        step = frontier.join(links, "url").groupBy("link").agg(F.max("is_listing").alias("listed"), F.min("source").alias("source"))
        new = step.select(F.col("link").alias("url"), F.lit(depth).alias("depth"), F.when(F.col("listed"), "listing").otherwise(F.col("source")).alias("source"))
        frontier = stored(new.join(seen.select("url"), "url", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    if max_pages is not None:
        seen = seen.orderBy("depth", "url").limit(max_pages)
    found = seen.withColumn("slug", U.novel_slug(F.col("url"))).where(F.col("slug").isNotNull())
    return found.orderBy("depth", "url").limit(max_novels) if max_novels is not None else found


def detect_tier(probes: DataFrame) -> DataFrame:
    """(url, tier): the lowest tier that answered 200 with links to title pages, or null. ``probes``: (url, tier, status, text)."""
    works = (F.col("status") == 200) & U.has_novel_links(F.col("text"))
    return probes.groupBy("url").agg(F.min(F.when(works, F.col("tier"))).alias("tier"))


def vote_tier(detected: DataFrame, by: list[str] | None = None, order: str = "url") -> DataFrame:
    """Most frequent tier (per group), ties to the tier seen first by ``order``; with votes and candidates checked."""
    keys = by or []
    votes = detected.where(F.col("tier").isNotNull()).groupBy(*keys, "tier").agg(F.count("*").alias("votes"), F.min(order).alias("first_seen"))
    best = votes.groupBy(*keys).agg(F.min_by(F.struct("tier", "votes"), F.struct(-F.col("votes"), "first_seen", "tier")).alias("b"))
    total = detected.groupBy(*keys).agg(F.count("*").alias("candidates_checked"))
    joined = total.join(best, keys, "left") if keys else total.join(best, F.lit(True), "left")
    return joined.select(*keys, F.col("b.tier").alias("tier"), F.coalesce("b.votes", F.lit(0)).cast("long").alias("votes"), "candidates_checked")


def probe_confidence(tier: Column, novels: Column) -> Column:
    return F.when(tier.isNull(), "none").when(novels >= 3, "high").when(novels >= 1, "medium").otherwise("low")


def probe_sites(tiers: DataFrame, novels: DataFrame) -> DataFrame:
    """(site, tier, novel_count, confidence) from (site, tier) and discovered (site, url)."""
    counted = novels.groupBy("site").agg(F.count("*").alias("novel_count"))
    joined = tiers.join(counted, "site", "left").withColumn("novel_count", F.coalesce("novel_count", F.lit(0)))
    return joined.select("site", "tier", "novel_count", probe_confidence(F.col("tier"), F.col("novel_count")).alias("confidence"))


def paginate(pages: DataFrame, first: DataFrame, limit: int = 200) -> DataFrame:
    """(start, page, url, html): pages of each list in order, following next-page links at most ``limit`` pages.

    ``pages``: (url, html, next_url). Each round joins only the lists still going on,
    to stored links without the texts, and is stored itself; a list ends where it
    would come back to one of its own pages.
    """
    links = stored(pages.select("url", "next_url"), "next-links")
    begin = first.select(F.col("url").alias("start"), "url", F.lit(1).alias("page")).withColumn("trail", F.array("url"))
    rounds = [stored(begin.join(links, "url"), "lists")]
    while len(rounds) < limit:
        going = rounds[-1].where(F.col("next_url").isNotNull() & ~F.array_contains("trail", F.col("next_url")))
        if going.isEmpty():
            break
        step = going.select("start", F.col("next_url").alias("url"), F.lit(len(rounds) + 1).alias("page"), F.array_append("trail", F.col("next_url")).alias("trail"))
        rounds.append(stored(step.join(links, "url"), "lists"))
    places = reduce(DataFrame.unionByName, [r.select("start", "page", "url") for r in rounds])
    return places.join(pages.select("url", "html"), "url").select("start", "page", "url", "html")
