"""Conflict resolution: the winning claim, cover and chapter text of every work, all works at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from libretto.functions.scores import cover_score
from libretto.functions.text import truthy
from libretto.plans.store import small_batches, stored
from libretto.schema import conform, det_id

from .clean import clean_and_score, stale

#: Claim fields that are written to a work, and the column they go to.
WORK_FIELDS = {"title": "title", "synopsis": "synopsis", "status": "status", "original_language": "original_language"}

#: Columns of a source chapter that cleaning writes.
CLEANED = ("cleaned_content", "paragraph_count", "word_count", "cleaner_version", "quality_score", "last_cleaned_at")


def ranked(df: DataFrame, keys: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def winning_claims(claims: DataFrame, keys: list[str], authoritative_first: bool = False) -> DataFrame:
    """The claim of each key and field with the highest confidence, then the latest, then the smallest id."""
    first = [F.desc("is_metadata_authoritative")] if authoritative_first else []
    out = ranked(claims, [*keys, "field_name"], *first, F.desc("confidence"), F.desc("created_at"), F.asc("id"), name="__n")
    return out.where("__n = 1").drop("__n").withColumn("value", F.coalesce(truthy("normalised_value"), F.col("raw_value")))


def owners(source_titles: DataFrame, versions: DataFrame, *columns: str) -> DataFrame:
    """(source_title_id, version_id, work_id, *columns) of source titles with a version. Met before claims are, of which there are many more, so that claims travel once."""
    st = source_titles.select(F.col("id").alias("source_title_id"), "version_id", *columns)
    return st.join(versions.select(F.col("id").alias("version_id"), "work_id"), "version_id")


def _claims_of_works(claims: DataFrame, source_titles: DataFrame, versions: DataFrame) -> DataFrame:
    return claims.join(owners(source_titles, versions, "is_metadata_authoritative"), "source_title_id")


def _claim_order(authoritative_first: bool) -> list[Column]:
    return [*([F.desc("is_metadata_authoritative")] if authoritative_first else []), F.desc("confidence"), F.desc("created_at"), F.asc("id")]


def outcomes(claims: DataFrame, source_titles: DataFrame, versions: DataFrame, authoritative_first: bool = False) -> DataFrame:
    """Claims with a work (work_id), and in ``is_resolved`` whether they won: one window, and no way back to the claims."""
    best = F.first("id").over(Window.partitionBy("work_id", "field_name").orderBy(*_claim_order(authoritative_first)))
    return _claims_of_works(claims, source_titles, versions).withColumn("is_resolved", F.col("id") == best)


def resolve_metadata(works: DataFrame, claims: DataFrame, source_titles: DataFrame, versions: DataFrame, as_of: Column, authoritative_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(works, claims) after resolution. Works without claims stay as they are."""
    # claims on other fields change no work
    told = _claims_of_works(claims.where(F.col("field_name").isin(*WORK_FIELDS)), source_titles, versions)
    best = winning_claims(told, ["work_id"], authoritative_first)
    chosen = [F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f"__{f}") for f in WORK_FIELDS]
    wide = best.groupBy(F.col("work_id").alias("__w")).agg(*chosen)
    joined = works.join(wide, works["id"] == F.col("__w"), "left")
    new = {c: F.coalesce(truthy(F.col(f"__{f}")), F.col(c)) for f, c in WORK_FIELDS.items()}
    new["updated_at"] = F.when(F.col("__w").isNotNull(), as_of).otherwise(F.col("updated_at"))
    out_works = joined.select(*(new.get(c, F.col(c)).alias(c) for c in works.columns))
    won = outcomes(claims, source_titles, versions, authoritative_first).groupBy(F.col("id").alias("__id")).agg(F.max("is_resolved").alias("__won"))
    flagged = claims.join(won, claims["id"] == F.col("__id"), "left")
    flag = F.coalesce("__won", "is_resolved")
    return out_works, flagged.select(*(flag.alias(c) if c == "is_resolved" else F.col(c) for c in claims.columns))


def resolve_covers(works: DataFrame, covers: DataFrame, source_titles: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(works, covers): unscored covers are scored, the best of each work selected; ties to the smaller id."""
    scored = covers.withColumn("quality_score", F.coalesce("quality_score", cover_score(F.col("width"), F.col("height"), F.col("file_size"))))
    st = source_titles.select(F.col("id").alias("source_title_id"), "version_id").join(versions.select(F.col("id").alias("version_id"), "work_id"), "version_id")
    owned = scored.join(st, "source_title_id")
    # one pass with map-side combine: the highest score, and of those the smallest id
    best = owned.groupBy("work_id").agg(F.min_by("id", F.struct(-F.col("quality_score"), "id")).alias("best"))
    chosen = best.select(F.col("work_id").alias("__w"), "best")
    out_works = works.join(chosen, works["id"] == F.col("__w"), "left").select(*(F.coalesce("best", c).alias(c) if c == "selected_cover_id" else F.col(c) for c in works.columns))
    owner = st.select(F.col("source_title_id").alias("__st"), F.col("work_id").alias("__ow")).join(chosen, F.col("__ow") == F.col("__w"))
    flagged = scored.join(owner, scored["source_title_id"] == F.col("__st"), "left")
    flag = F.when(F.col("__st").isNull(), F.col("is_selected")).otherwise(F.col("id") == F.col("best"))
    return out_works, flagged.select(*(flag.alias(c) if c == "is_selected" else F.col(c) for c in covers.columns))


def resolve_chapters(version_chapters: DataFrame, source_chapters: DataFrame, source_titles: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(version_chapters, source_chapters, report): map, clean, promote.

    Numbered source chapters are mapped to a chapter of their version, made where it
    is missing; raw ones are cleaned and scored; each chapter takes the cleaned text
    of the best score (null counts as 0, ties to the smaller id) and keeps a title it
    has. ``report`` counts mapped, cleaned, promoted and skipped per version. Texts are
    cleaned once, here: all three results read the stored outcome. Titles and chapter
    numbers are stored before texts meet them: where they are few, as their size on
    disk tells, they are broadcast, and no text travels.
    """
    st = stored(source_titles.where(F.col("version_id").isNotNull()).select(F.col("id").alias("source_title_id"), "version_id"), "owners")
    owned = source_chapters.join(st, "source_title_id")
    numbered = owned.where(F.col("chapter_number").isNotNull())
    titles = numbered.groupBy("version_id", "chapter_number").agg(F.min_by("source_title_text", F.struct("created_at", "id")).alias("title"))
    have = version_chapters.select(F.col("version_id").alias("__v"), F.col("chapter_number").alias("__n"))
    missing = titles.join(have, (F.col("version_id") == F.col("__v")) & (F.col("chapter_number") == F.col("__n")), "left_anti")
    stubs = stored(conform(missing.withColumns({"id": det_id("version_id", "chapter_number"), "created_at": as_of, "updated_at": as_of}), "version_chapters"), "stubs")
    chapters = version_chapters.unionByName(stubs)
    # all rows go through in one pass; those that need no cleaning without a text to clean, and keep what they have
    told = owned.withColumn("__new", stale().cast("int"))
    had = told.withColumns({"__raw": F.when(F.col("__new") == 1, F.col("raw_content")), **{f"__had_{c}": F.col(c) for c in CLEANED if c in source_chapters.columns}})
    cleaned = clean_and_score(had, raw="__raw", content_format=F.coalesce("content_format", F.lit("html")) if "content_format" in owned.columns else "html").withColumn("last_cleaned_at", as_of)
    columns = [F.when(F.col("__new") == 1, F.col(c)).otherwise(F.col(f"__had_{c}")).alias(c) if c in CLEANED else F.col(c) for c in source_chapters.columns]
    with small_batches(source_chapters.sparkSession):
        both = stored(cleaned.select(*columns, "version_id", "__new"), "cleaned")
    ids = stored(chapters.select(F.col("id").alias("__vc"), F.col("version_id").alias("__v"), F.col("chapter_number").alias("__n")), "chapter-ids")
    mapped = both.join(ids, (F.col("version_id") == F.col("__v")) & (F.col("chapter_number") == F.col("__n")), "left")
    mapped = mapped.withColumn("version_chapter_id", F.coalesce("__vc", "version_chapter_id"))
    usable = mapped.where(F.col("version_chapter_id").isNotNull() & truthy("cleaned_content").isNotNull())
    best = ranked(usable, ["version_chapter_id"], F.desc(F.coalesce("quality_score", F.lit(0.0))), F.asc("id"), name="__r").where("__r = 1")
    best = best.select(F.col("version_chapter_id").alias("__b"), F.col("id").alias("__from"), F.col("cleaned_content").alias("__text"), F.col("word_count").alias("__words"), F.col("source_title_text").alias("__title"))
    promoted = chapters.join(best, chapters["id"] == F.col("__b"), "left")
    new = {
        "content": F.coalesce("__text", "content"), "word_count": F.coalesce("__words", "word_count"), "promoted_from_id": F.coalesce("__from", "promoted_from_id"),
        "title": F.coalesce(truthy("title"), F.col("__title")), "updated_at": F.when(F.col("__b").isNotNull(), as_of).otherwise(F.col("updated_at")),
    }
    out_chapters = promoted.select(*(new.get(c, F.col(c)).alias(c) for c in version_chapters.columns))
    orphan = source_chapters.join(st.select(F.col("source_title_id").alias("__st")), F.col("source_title_id") == F.col("__st"), "left_anti")
    out_sources = mapped.select(*source_chapters.columns).unionByName(orphan)
    per_source = mapped.groupBy("version_id").agg(F.count_if(F.col("__vc").isNotNull()).alias("mapped"), F.count_if(F.col("__new") == 1).alias("cleaned"))
    per_chapter = promoted.groupBy("version_id").agg(F.count_if(F.col("__b").isNotNull()).alias("promoted"), F.count_if(F.col("__b").isNull()).alias("skipped"))
    return out_chapters, out_sources, per_chapter.join(per_source, "version_id", "left").fillna(0, ["mapped", "cleaned"])


def resolve_all(tables: dict[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """Metadata, covers and chapters of all works; and ``outcomes``, the claims that have a work and whether they won."""
    t = dict(tables)
    t["outcomes"] = outcomes(t["metadata_claims"], t["source_titles"], t["versions"])
    t["works"], t["metadata_claims"] = resolve_metadata(t["works"], t["metadata_claims"], t["source_titles"], t["versions"], as_of)
    t["works"], t["cover_candidates"] = resolve_covers(t["works"], t["cover_candidates"], t["source_titles"], t["versions"])
    t["version_chapters"], t["source_chapters"], t["report"] = resolve_chapters(t["version_chapters"], t["source_chapters"], t["source_titles"], as_of)
    return t
