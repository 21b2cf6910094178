"""Whole jobs: an ingest cycle, the refresh queue, full resolution; and their storage."""

from __future__ import annotations

import traceback
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from libretto.operators import ingest, match, resolve
from libretto.schema import DDL, conform, det_id, empty, schema
from libretto.sources.extract import extract_contents, extract_listings, extract_titles, extract_titles_listed

from .snapshots import Conflict, Snapshot, Snapshots
from .store import stored

Tables = dict[str, DataFrame]


def new_tables(spark: SparkSession) -> Tables:
    return {name: empty(spark, name) for name in DDL}


def load(spark: SparkSession, root: str) -> Tables:
    return {name: spark.read.schema(schema(name)).parquet(f"{root}/{name}") for name in DDL}


def save(tables: Tables, root: str) -> str:
    """Write every table below a fresh folder and return it; readers switch to it when all are complete."""
    target = f"{root}/{uuid.uuid4().hex}"
    for name in DDL:
        conform(tables[name], name).write.parquet(f"{target}/{name}")
    return target


def checkout(snapshot: Snapshot) -> Tables:
    """The eight tables of a version; those it lacks are empty."""
    return {name: snapshot.read(name) if name in snapshot.tables else empty(snapshot.spark, name) for name in DDL}


def commit(tables: Tables, store: Snapshots) -> Snapshot:
    """All eight tables as the next version: all of them, or none."""
    tx = store.begin()
    for name in DDL:
        tx.write(name, conform(tables[name], name))
    return tx.commit()


def transact(store: Snapshots, work: Callable[[Tables], Tables], tries: int = 3) -> Snapshot:
    """Run ``work`` over the latest version and commit the tables it changed.

    Where another writer commits meanwhile, ``work`` runs again over what that one
    left; after ``tries`` such conflicts the last is raised. A job that fails leaves
    the version as it was.
    """
    for left in reversed(range(tries)):
        tx = store.begin()
        before = checkout(tx.base)
        after = work(dict(before))
        for name in DDL:
            if after[name] is not before[name] or name not in tx.base.tables:
                tx.write(name, conform(after[name], name))
        try:
            return tx.commit()
        except Conflict:
            if not left:
                raise
    raise ValueError("no try was allowed")


def ingest_titles(tables: Tables, title_pages: DataFrame, as_of: Column) -> tuple[Tables, DataFrame]:
    """Sources, claims and covers of fetched title pages (site_key, url, html); and the metadata they were made from, parsed once."""
    metadata = stored(extract_titles(title_pages, F.col("site_key")), "metadata")
    return ingest_metadata(tables, metadata, as_of), metadata


def ingest_metadata(tables: Tables, metadata: DataFrame, as_of: Column) -> Tables:
    """Sources, claims and covers of extracted metadata, which is read several times."""
    t = dict(tables)
    t["source_titles"] = stored(ingest.overwrite_sources(ingest.source_title_rows(metadata, as_of), t["source_titles"]), "source-titles")
    t["metadata_claims"] = ingest.upsert(ingest.claim_rows(metadata, t["source_titles"], as_of), t["metadata_claims"], "metadata_claims")
    t["cover_candidates"] = ingest.upsert(ingest.cover_rows(metadata, t["source_titles"], as_of), t["cover_candidates"], "cover_candidates")
    return t


def ingest_listings(tables: Tables, listing_pages: DataFrame, as_of: Column) -> Tables:
    """Chapter stubs of fetched listings."""
    return ingest_stubs(tables, extract_listings(listing_pages, F.col("site_key")), as_of)


def ingest_stubs(tables: Tables, listings: DataFrame, as_of: Column) -> Tables:
    """Chapter stubs of extracted listings."""
    stubs = ingest.stub_rows(listings, tables["source_titles"], as_of)
    return tables | {"source_chapters": ingest.upsert(stubs, tables["source_chapters"], "source_chapters")}


def ingest_contents(tables: Tables, chapter_pages: DataFrame, as_of: Column) -> Tables:
    """Contents of fetched chapters."""
    told = ingest.save_contents(extract_contents(chapter_pages, F.col("site_key")), tables["source_chapters"], as_of)
    return tables | {"source_chapters": stored(told, "source-chapters")}


def ingest_cycle(tables: Tables, title_pages: DataFrame, listing_pages: DataFrame, chapter_pages: DataFrame, as_of: Column) -> Tables:
    """One pass over fetched pages, each (site_key, url, html): metadata, claims, covers, stubs, contents, matching.

    Where the title pages are the listing pages, too, each is parsed once for both.
    """
    if listing_pages is title_pages:
        told = stored(extract_titles_listed(title_pages, F.col("site_key")), "metadata")
        metadata = told.drop("chapters")
        listings = told.select("site_key", "page_url", F.explode("chapters").alias("c")).select("site_key", "page_url", "c.*")
        t = ingest_stubs(ingest_metadata(tables, metadata, as_of), listings, as_of)
    else:
        t, metadata = ingest_titles(tables, title_pages, as_of)
        t = ingest_listings(t, listing_pages, as_of)
    t = ingest_contents(t, chapter_pages, as_of)
    return link_sources(t, metadata, as_of)


def link_sources(tables: Tables, metadata: DataFrame, as_of: Column) -> Tables:
    """Works and versions for source titles without a version, matched against the works there are."""
    t = dict(tables)
    open_ = t["source_titles"].where(F.col("version_id").isNull()).select("id", F.col("source_site").alias("__s"), F.col("source_id").alias("__i"))
    named = open_.join(metadata, (F.col("site_key") == F.col("__s")) & (F.col("source_id") == F.col("__i"))).where(F.coalesce("title", F.lit("")) != "")
    rows = named.select("id", "title", F.coalesce("language", F.lit("en")).alias("language"), "translator_group", F.lit("fan").alias("version_type"))
    rows = rows.groupBy("id").agg(F.min(F.struct("title", "language", "translator_group", "version_type")).alias("r")).select("id", "r.*")
    works = match.match_batch(rows, t["works"])
    placed = stored(match.find_versions(works.join(rows, "id"), t["versions"]), "placed")
    stamps = {"created_at": as_of, "updated_at": as_of}
    new_works = placed.where("is_new_work").groupBy(F.col("work_id").alias("id"), "slug").agg(F.min_by("title", "id").alias("title"))
    t["works"] = t["works"].unionByName(conform(new_works.withColumns(stamps), "works"))
    new_versions = placed.where("is_new_version").groupBy(F.col("version_id").alias("id"), "work_id", F.col("version_slug").alias("slug")).agg(*(F.min(c).alias(c) for c in ("language", "translator_group", "version_type"))).join(
        placed.groupBy(F.col("version_id").alias("id")).agg(F.min("version_label").alias("label")), "id"
    )
    t["versions"] = t["versions"].unionByName(conform(new_versions.withColumns(stamps), "versions"))
    link = placed.select(F.col("id").alias("__st"), F.col("version_id").alias("__v"))
    joined = t["source_titles"].join(link, F.col("id") == F.col("__st"), "left")
    t["source_titles"] = joined.select(*(F.coalesce("version_id", "__v").alias(c) if c == "version_id" else F.col(c) for c in t["source_titles"].columns))
    return t


def audited(tables: Tables, site: str, url: str, work, as_of: str, job_type: str = "full") -> Tables:
    """Run ``work(tables)`` and append one job row: completed with counts, or failed with the error and its trace."""
    spark = tables["ingestion_jobs"].sparkSession
    job = {"source_site": site, "source_url": url, "job_type": job_type}
    try:
        out = work(tables)
        before, after = (t["source_chapters"].agg(F.count("*").alias("n"), F.count("raw_content").alias("c")).first() for t in (tables, out))
        job |= {"status": "completed", "chapters_found": after["n"], "chapters_new": after["n"] - before["n"], "chapters_updated": after["c"] - before["c"]}
    except Exception as e:
        out = dict(tables)
        job |= {"status": "failed", "error_message": str(e)[:1000], "error_detail": traceback.format_exc()}
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in job.items()))
    at = F.lit(as_of).cast("timestamp")
    row = row.withColumns({c: at for c in ("started_at", "completed_at", "created_at", "updated_at")})
    row = row.withColumn("id", det_id("source_site", "source_url", F.lit(as_of)))
    out["ingestion_jobs"] = tables["ingestion_jobs"].unionByName(conform(row, "ingestion_jobs"))
    return out


def refresh_order() -> list[Column]:
    """Those not scraped for longest first, never scraped ones last."""
    return [F.asc_nulls_last("last_scraped_at"), F.asc("id")]


def refresh_queue(source_titles: DataFrame) -> DataFrame:
    """Source titles in the order of their turn."""
    return source_titles.orderBy(*refresh_order())


def refresh_jobs(source_titles: DataFrame, as_of: Column) -> DataFrame:
    """A pending job for every source title."""
    rows = source_titles.select("source_site", "source_url", F.col("id").alias("source_title_id"), F.lit("refresh").alias("job_type"), as_of.alias("created_at"), as_of.alias("updated_at"))
    return conform(rows.withColumn("id", det_id("source_title_id", as_of)), "ingestion_jobs")


def resolve_work(tables: Tables, as_of: Column) -> Tables:
    return resolve.resolve_all(tables, as_of)
