"""Idempotent writes: what is there already is skipped, a second run changes nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from libretto.functions import text as T
from libretto.functions.scores import claim_confidence, completeness
from libretto.schema import KEYS, conform, det_id

#: Claim fields and the metadata column each comes from.
CLAIM_SOURCES = {
    "title": "title", "original_title": "original_title", "author": "author", "artist": "artist", "translator_group": "translator_group",
    "synopsis": "synopsis", "status": "status", "language": "language", "original_language": "original_language",
    "genres": "genres", "tags": "tags", "release_year": "release_year", "total_chapters": "total_chapters", "cover_url": "cover_url",
}
LISTS, NUMBERS = ("genres", "tags"), ("release_year", "total_chapters")


def unseen(new: DataFrame, old: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``; of repeated keys the first by the remaining columns' order of id."""
    order = [F.asc(c) for c in sorted(new.columns, key=lambda c: (c != "id", c))]
    once = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
    have = old.select(*(F.col(k).alias(f"__{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return once.join(have, condition, "left_anti")


def upsert(new: DataFrame, old: DataFrame, table: str) -> DataFrame:
    """The table with the unseen rows appended."""
    return old.unionByName(conform(unseen(new, old, KEYS[table]), table))


def source_title_rows(metadata: DataFrame, as_of: Column) -> DataFrame:
    """Source titles of extracted metadata (site_key and RawMetadata columns), scored for completeness."""
    kinds = dict(metadata.dtypes)
    record = F.to_json(F.struct(*(c for c in metadata.columns if c not in ("site_key", "page_url"))))
    rows = metadata.select(
        F.col("site_key").alias("source_site"), "source_id", "source_url", record.alias("raw_metadata"), completeness(kinds).alias("quality_score"),
        as_of.alias("last_scraped_at"), as_of.alias("created_at"), as_of.alias("updated_at"),
    )
    return conform(rows.withColumn("id", det_id("source_site", "source_id")), "source_titles")


def overwrite_sources(new: DataFrame, old: DataFrame) -> DataFrame:
    """Known source titles take the new blob, score and time; unknown ones are added."""
    # of repeated sources the best record, in one order for every run
    taken = F.struct("quality_score", "raw_metadata", "last_scraped_at", "updated_at")
    fresh = new.groupBy(F.col("source_site").alias("__s"), F.col("source_id").alias("__i")).agg(F.max(taken).alias("n")).select("__s", "__i", *(F.col(f"n.{c}").alias(f"__{c}") for c in ("raw_metadata", "quality_score", "last_scraped_at", "updated_at")))
    joined = old.join(fresh, (F.col("source_site") == F.col("__s")) & (F.col("source_id") == F.col("__i")), "left")
    kept = joined.select(*(F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in joined.columns else F.col(c) for c in old.columns))
    return kept.unionByName(conform(unseen(new, old, KEYS["source_titles"]), "source_titles"))


def claim_rows(metadata: DataFrame, source_titles: DataFrame, as_of: Column) -> DataFrame:
    """One claim per field that the metadata has; the confidence is the source's quality."""
    st = source_titles.select(F.col("id").alias("source_title_id"), F.col("source_site").alias("__s"), F.col("source_id").alias("__i"), "quality_score")
    joined = metadata.join(st, (F.col("site_key") == F.col("__s")) & (F.col("source_id") == F.col("__i")))
    value = lambda f, c: T.list_claim(F.col(c)) if f in LISTS else T.int_claim(F.col(c)) if f in NUMBERS else T.truthy(F.col(c).cast("string"))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), value(f, c).alias("raw_value")) for f, c in CLAIM_SOURCES.items() if c in metadata.columns)))
    rows = joined.select("source_title_id", claim_confidence(F.col("quality_score")).alias("confidence"), pairs.alias("p")).select("source_title_id", "confidence", "p.*")
    rows = rows.where(F.col("raw_value").isNotNull() & (F.col("field_name") != "cover_url"))
    rows = rows.withColumn("normalised_value", F.when(F.col("field_name") == "status", T.status("raw_value")))
    rows = rows.withColumns({"claim_hash": F.md5("raw_value"), "created_at": as_of, "updated_at": as_of})
    return conform(rows.withColumn("id", det_id("source_title_id", "field_name", "claim_hash")), "metadata_claims")


def cover_rows(metadata: DataFrame, source_titles: DataFrame, as_of: Column) -> DataFrame:
    st = source_titles.select(F.col("id").alias("source_title_id"), F.col("source_site").alias("__s"), F.col("source_id").alias("__i"))
    joined = metadata.where(T.truthy("cover_url").isNotNull()).join(st, (F.col("site_key") == F.col("__s")) & (F.col("source_id") == F.col("__i")))
    rows = joined.select("source_title_id", F.col("cover_url").alias("source_url"), as_of.alias("created_at"), as_of.alias("updated_at"))
    return conform(rows.withColumn("id", det_id("source_title_id", "source_url")), "cover_candidates")


def stub_rows(listings: DataFrame, source_titles: DataFrame, as_of: Column) -> DataFrame:
    """Chapter stubs of listings (site_key, page_url and RawChapterListing columns); the page is the source title's."""
    st = source_titles.select(F.col("id").alias("source_title_id"), F.col("source_site").alias("__s"), F.col("source_url").alias("__u"))
    joined = listings.join(st, (F.col("site_key") == F.col("__s")) & (F.col("page_url") == F.col("__u")))
    rows = joined.select("source_title_id", "source_chapter_id", F.col("source_url"), F.col("title").alias("source_title_text"), "chapter_number", as_of.alias("created_at"), as_of.alias("updated_at"))
    return conform(rows.withColumn("id", det_id("source_title_id", "source_chapter_id")), "source_chapters")


def save_contents(contents: DataFrame, source_chapters: DataFrame, as_of: Column) -> DataFrame:
    """Stubs take their page's content. Empty content counts as missing; a number of 0 does not replace the listing's."""
    # of pages fetched twice the longer content, then the larger, in one order for every run
    page = F.struct(F.length("raw_content").alias("size"), "raw_content", "title", "chapter_number", "content_format")
    got = contents.where(T.truthy("raw_content").isNotNull()).groupBy(F.col("source_url").alias("__u")).agg(F.max(page).alias("p")).select(
        "__u", F.col("p.title").alias("__t"), F.col("p.chapter_number").alias("__n"), F.col("p.raw_content").alias("__c"), F.col("p.content_format").alias("__f")
    )
    joined = source_chapters.join(got, F.col("source_url") == F.col("__u"), "left")
    hit = F.col("__c").isNotNull()
    new = {
        "raw_content": F.coalesce("__c", "raw_content"), "content_format": F.coalesce("__f", "content_format"),
        "source_title_text": F.coalesce(T.truthy("__t"), F.col("source_title_text")), "chapter_number": F.coalesce(F.nullif("__n", F.lit(0.0)), "chapter_number"),
        "last_scraped_at": F.when(hit, as_of).otherwise(F.col("last_scraped_at")), "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")),
    }
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in source_chapters.columns))


def without_content(source_chapters: DataFrame) -> DataFrame:
    return source_chapters.where(T.truthy("raw_content").isNull())


@dataclass(frozen=True)
class Conflict(Exception):
    """A row with this natural key exists."""

    table: str
    key: str


def create_work(works: DataFrame, title: str, as_of: Column, slug: str | None = None, **columns) -> DataFrame:
    """The new work as one row, or Conflict."""
    spark = works.sparkSession
    row = spark.range(1).select(F.lit(title).alias("title"), (F.lit(slug) if slug else T.slugify(F.lit(title))).alias("slug"), *(F.lit(v).alias(k) for k, v in columns.items()))
    key = row.first()["slug"]
    if not works.where(F.col("slug") == key).isEmpty():
        raise Conflict("works", key)
    return conform(row.withColumns({"id": det_id(F.lit("work"), "slug"), "created_at": as_of, "updated_at": as_of}), "works")


def create_version(versions: DataFrame, work_id: str, language: str, as_of: Column, translator_group: str | None = None, version_type: str = "fan") -> DataFrame:
    spark = versions.sparkSession
    row = spark.range(1).select(F.lit(work_id).alias("work_id"), F.lit(language).alias("language"), F.lit(translator_group).cast("string").alias("translator_group"), F.lit(version_type).alias("version_type"))
    row = row.withColumns({"slug": T.version_slug("language", "translator_group"), "label": T.version_label("language", "translator_group", "version_type")})
    key = row.first()["slug"]
    if not versions.where((F.col("work_id") == work_id) & (F.col("slug") == key)).isEmpty():
        raise Conflict("versions", f"{work_id}/{key}")
    return conform(row.withColumns({"id": det_id("work_id", "slug"), "created_at": as_of, "updated_at": as_of}), "versions")
