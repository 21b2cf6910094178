"""The serving surface: which operator answers which route.

``call`` finds the route of a method and path and returns its DataFrame; a missing
row is an empty DataFrame, and a clash on create raises ``ingest.Conflict``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from libretto.operators import ingest, serve
from libretto.sources.sites import get_site, sites_table

from . import jobs

Tables = dict[str, DataFrame]


def _works(t: Tables, page: int = 1, size: int = 20, **facets) -> DataFrame:
    return serve.search(t, number=int(page), size=int(size), **facets)


def _chapter(t: Tables, version_id: str, number: str) -> DataFrame:
    return t["version_chapters"].where((F.col("version_id") == version_id) & (F.col("chapter_number") == float(number)))


def _versions(t: Tables, key: str) -> DataFrame:
    w = serve.by_id_or_slug(t["works"], key).select(F.col("id").alias("work_id"))
    return serve.versions_with_counts(t["versions"].join(w, "work_id", "left_semi"), t["version_chapters"]).orderBy("created_at", "id")


def _new_job(t: Tables, site: str, url: str, as_of: Column) -> DataFrame:
    """A pending job row; an unknown site raises KeyError."""
    get_site(site)
    spark = t["ingestion_jobs"].sparkSession
    st = spark.range(1).select(F.lit(site).alias("source_site"), F.lit(url).alias("source_url"), F.lit(f"{site}:{url}").alias("id"))
    return jobs.refresh_jobs(st, as_of).withColumn("job_type", F.lit("full")).withColumn("source_title_id", F.lit(None).cast("string"))


#: Method, path with its parameters, and the operator.
ROUTES: tuple[tuple[str, str, Callable[..., DataFrame]], ...] = (
    ("GET", "/api/v1/works", _works),
    ("GET", "/api/v1/works/{key}", serve.detail),
    ("GET", "/api/v1/works/{key}/versions", _versions),
    ("POST", "/api/v1/works", lambda t, title, as_of, **more: ingest.create_work(t["works"], title, as_of, **more)),
    ("POST", "/api/v1/works/{work_id}/versions", lambda t, work_id, language, as_of, **more: ingest.create_version(t["versions"], work_id, language, as_of, **more)),
    ("GET", "/api/v1/versions/{version_id}/chapters", lambda t, version_id, size=2000: serve.chapters_of_version(t["version_chapters"], version_id, int(size))),
    ("GET", "/api/v1/versions/{version_id}/chapters/{number}", _chapter),
    ("GET", "/api/v1/versions/{version_id}/chapters/{number}/sources", lambda t, version_id, number: serve.chapter_sources(t, version_id, float(number))),
    ("GET", "/api/v1/admin/sources/health", serve.source_health),
    ("GET", "/api/v1/admin/sources/{site}", serve.sources_of_site),
    ("GET", "/api/v1/admin/works/{key}/claims", lambda t, key, field=None: serve.claims_of_work(t, key, field)),
    ("POST", "/api/v1/admin/resolve", lambda t, as_of: jobs.resolve_work(t, as_of)["report"]),
    ("GET", "/api/v1/ingestion/adapters", lambda t: sites_table(t["works"].sparkSession)),
    ("GET", "/api/v1/ingestion/jobs", lambda t, site=None, status=None, size=50: serve.recent_jobs(t["ingestion_jobs"], site, status, min(int(size), 200))),
    ("GET", "/api/v1/ingestion/jobs/{job_id}", lambda t, job_id: t["ingestion_jobs"].where(F.col("id") == job_id)),
    ("POST", "/api/v1/ingestion/jobs", _new_job),
    ("GET", "/api/novels", lambda t, status=None, sort="popular", page=1, size=20: serve.listing(t, status, sort, int(page), min(int(size), 100))),
    ("GET", "/api/search", _works),
    ("GET", "/api/stats", serve.stats),
    ("GET", "/api/novels/{work_id}/similar", lambda t, work_id, size=12: serve.similar(t, work_id, min(int(size), 50))),
    ("GET", "/api/novel/{key}/chapters", lambda t, key, size=5000: serve.chapters_of_work(t, key, min(int(size), 5000))),
    ("GET", "/novel/{key}", serve.detail),
    ("GET", "/novel/{key}/chapter/{number}", lambda t, key, number: serve.read_chapter(t, key, float(number))),
)


def call(tables: Tables, method: str, path: str, **params) -> DataFrame:
    for verb, pattern, operator in ROUTES:
        m = re.fullmatch(re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", pattern), path)
        if m and verb == method:
            return operator(tables, **m.groupdict(), **params)
    raise LookupError(f"{method} {path}")
