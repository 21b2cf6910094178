"""Serving queries over the domain tables: listing, search, similarity, reading, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from libretto.functions import text as T

from .resolve import owners
from .search_index import TextIndex

Tables = dict[str, DataFrame]

#: Sort orders of the catalogue; an unknown name means the first. The id makes every order total.
ORDERS: dict[str, list[Column]] = {}


def orders() -> dict[str, list[Column]]:
    if not ORDERS:
        total, updated, created = F.desc(F.coalesce("total_chapters", F.lit(0))), F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at")
        ORDERS.update(
            popular=[total, updated, F.asc("id")], updated=[updated, created, F.asc("id")], new=[created, F.asc("id")],
            rating=[updated, created, F.asc("id")], chapters=[total, F.asc("id")], az=[F.asc_nulls_last("title"), F.asc("id")],
        )
    return ORDERS


def page(df: DataFrame, sort: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of a sorted result: a top-k over offset + size rows, never a full sort."""
    return df.orderBy(*sort).offset((number - 1) * size).limit(size)


def page_meta(df: DataFrame, size: int) -> DataFrame:
    """(total, pages): rows, and pages of ``size`` (one at least)."""
    return df.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages"))


def claim_value() -> Column:
    return F.coalesce(T.truthy("normalised_value"), F.col("raw_value"))


def claims_of_works(t: Tables) -> DataFrame:
    """Claims with their work: the chain claim, source title, version."""
    return t["metadata_claims"].join(owners(t["source_titles"], t["versions"], "source_site"), "source_title_id")


def cards(t: Tables) -> DataFrame:
    """A row per work with author, cover and chapter count, each aggregated once and joined."""
    chapters = t["version_chapters"].join(t["versions"].select(F.col("id").alias("version_id"), "work_id"), "version_id").groupBy("work_id").agg(F.count("*").alias("total_chapters"))
    resolved = claims_of_works(t).where((F.col("field_name") == "author") & F.col("is_resolved"))
    author = resolved.groupBy("work_id").agg(F.min_by(claim_value(), F.struct(-F.col("confidence"), "id")).alias("author"))
    covers = t["cover_candidates"].select(F.col("id").alias("selected_cover_id"), F.coalesce("local_path", "source_url").alias("cover_url"))
    w = t["works"].join(chapters, F.col("id") == chapters["work_id"], "left").drop("work_id").join(author, F.col("id") == author["work_id"], "left").drop("work_id").join(covers, "selected_cover_id", "left")
    default = lambda c, d: F.coalesce(T.truthy(c), F.lit(d)).alias(c)
    return w.select(
        "id", "slug", default("title", ""), default("status", "ongoing"), default("original_language", ""), F.left(F.coalesce("synopsis", F.lit("")), F.lit(200)).alias("synopsis"),
        default("author", "Unknown"), default("cover_url", ""), F.coalesce("total_chapters", F.lit(0)).alias("total_chapters"), "created_at", "updated_at",
    )


def by_id_or_slug(df: DataFrame, key: str) -> DataFrame:
    return df.where((F.col("id") == key) | (F.col("slug") == key))


def works_with_tag(t: Tables, tags: list[str]) -> DataFrame:
    wanted = reduce(lambda a, b: a | b, (F.lower(claim_value()).contains(x.lower()) for x in tags), F.lit(False))
    return claims_of_works(t).where(F.col("field_name").isin("tags", "genres") & wanted).select("work_id").distinct()


def search(t: Tables, q: str = "", status: str | None = None, language: str | None = None, tags: str = "", exclude_tags: str = "", chap_min: int | None = None, chap_max: int | None = None, sort: str = "popular", number: int = 1, size: int = 20, min_rating: float | None = None, index: TextIndex | None = None) -> DataFrame:
    """Faceted search: text in title or synopsis, equality filters, tags to have and not to have, chapter bounds.

    With an ``index`` of the works' texts no work is tested for ``q`` but the few that the index finds.

    ``min_rating`` is accepted and says nothing: works have no ratings. Where neither
    chapter bounds nor the order need counts, the page is taken before cards are made.
    """
    w = t["works"]
    tests = [F.lit(True)]
    if q and index is None:
        tests.append(F.col("title").ilike(f"%{q}%") | F.col("synopsis").ilike(f"%{q}%"))
    if status:
        tests.append(F.col("status") == status)
    if language:
        tests.append(F.col("original_language") == language)
    w = w.where(reduce(lambda a, b: a & b, tests))
    if q and index is not None:
        w = w.join(index.ids(q).withColumnRenamed("id", "__hit"), F.col("id") == F.col("__hit"), "left_semi")
    if have := T.parse_csv(tags):
        w = w.join(works_with_tag(t, have), F.col("id") == F.col("work_id"), "left_semi")
    if lack := T.parse_csv(exclude_tags):
        w = w.join(works_with_tag(t, lack), F.col("id") == F.col("work_id"), "left_anti")
    order = orders().get(sort, orders()["popular"])
    if chap_min is None and chap_max is None and sort in CARD_FREE:
        # the order reads the works alone: only the page's rows get cards, of claims and chapters that are theirs
        ids = page(w.select("id", F.coalesce("title", F.lit("")).alias("title"), "created_at", "updated_at"), order, number, size).select(F.col("id").alias("__id"))
        chosen = w.join(F.broadcast(ids), F.col("id") == F.col("__id"), "left_semi")
        return cards(narrowed(t | {"works": chosen})).orderBy(*order)
    found = cards(t | {"works": w})
    if chap_min is not None:
        found = found.where(F.col("total_chapters") >= chap_min)
    if chap_max is not None:
        found = found.where(F.col("total_chapters") <= chap_max)
    return page(found, order, number, size)


#: Orders that need no more than the works.
CARD_FREE = frozenset(("updated", "new", "rating", "az"))


def narrowed(t: Tables) -> Tables:
    """Tables with the versions of the works in ``works`` alone, and what hangs on those: few works are not looked up among all."""
    v = t["versions"].join(F.broadcast(t["works"].select(F.col("id").alias("work_id"))), "work_id", "left_semi")
    return t | {"versions": v}


def listing(t: Tables, status: str | None = None, sort: str = "popular", number: int = 1, size: int = 20) -> DataFrame:
    return search(t, status=status, sort=sort, number=number, size=size)


def stats(t: Tables) -> DataFrame:
    return t["works"].agg(F.count("*").alias("works")).crossJoin(t["version_chapters"].agg(F.count("*").alias("chapters")))


def terms_of(t: Tables, fields: tuple[str, ...] = ("tags", "genres"), resolved: bool = True) -> DataFrame:
    """(work_id, term): distinct tags and genres of works."""
    c = claims_of_works(t).where(F.col("field_name").isin(*fields))
    c = c.where("is_resolved") if resolved else c
    return c.select("work_id", F.explode(T.parse_tags(claim_value())).alias("term")).distinct()


def similar(t: Tables, work_id: str, size: int = 12) -> DataFrame:
    """Other works with a claim value that contains one of this work's terms, latest first."""
    mine = terms_of(narrowed(t | {"works": t["works"].where(F.col("id") == work_id).select("id")})).select("term")
    # one row: the terms of one work
    terms = mine.agg(F.array_sort(F.collect_set("term")).alias("terms")).where(F.size("terms") > 0)
    said = F.lower(claim_value())
    others = claims_of_works(t).where(F.col("field_name").isin("tags", "genres") & (F.col("work_id") != work_id)).select("work_id", said.alias("said"))
    hits = others.join(F.broadcast(terms), F.exists("terms", lambda x: F.col("said").contains(x))).select("work_id").distinct()
    chosen = page(t["works"].join(hits, F.col("id") == F.col("work_id"), "left_semi"), [F.desc_nulls_last("updated_at"), F.asc("id")], 1, size)
    return cards(narrowed(t | {"works": chosen})).orderBy(F.desc_nulls_last("updated_at"), F.asc("id"))


def detail(t: Tables, key: str) -> DataFrame:
    """Card, tags and sites of one work."""
    own = narrowed(t | {"works": by_id_or_slug(t["works"], key)})
    card = cards(own)
    tags = terms_of(own).groupBy("work_id").agg(F.slice(F.array_sort(F.collect_set("term")), 1, 12).alias("tags"))
    sites = claims_of_works(own).groupBy("work_id").agg(F.array_sort(F.collect_set("source_site")).alias("sites"))
    return card.join(tags, card["id"] == tags["work_id"], "left").drop("work_id").join(sites, card["id"] == sites["work_id"], "left").drop("work_id")


def versions_with_counts(versions: DataFrame, chapters: DataFrame) -> DataFrame:
    n = chapters.groupBy("version_id").agg(F.count("*").alias("chapter_count"))
    joined = versions.join(n, versions["id"] == n["version_id"], "left").drop("version_id")
    return joined.withColumn("chapter_count", F.coalesce("chapter_count", F.lit(0)))


def chapters_of_version(chapters: DataFrame, version_id: str | None = None, size: int | None = None) -> DataFrame:
    rows = chapters if version_id is None else chapters.where(F.col("version_id") == version_id)
    out = rows.select("id", "version_id", "chapter_number", "title", "word_count", (F.length(F.coalesce("content", F.lit(""))) > 0).alias("has_content"))
    return out.orderBy("version_id", "chapter_number", "id").limit(size) if size else out


def filter_chapters(chapters: DataFrame, q: str = "", newest_first: bool = False) -> DataFrame:
    """Chapters whose title or number holds ``q``, in reading order or reversed."""
    number = F.regexp_replace(F.col("chapter_number").cast("string"), r"\.0$", "")
    hit = F.lower(F.coalesce("title", F.lit(""))).contains(q.lower()) | number.contains(q)
    order = F.desc("chapter_number") if newest_first else F.asc("chapter_number")
    return chapters.where(hit).orderBy(order, "id")


def chapters_of_work(t: Tables, key: str, size: int = 5000) -> DataFrame:
    """Chapters of all versions of a work, by number."""
    w = by_id_or_slug(t["works"], key).select(F.col("id").alias("work_id"))
    v = t["versions"].select(F.col("id").alias("version_id"), "work_id").join(w, "work_id", "left_semi")
    return t["version_chapters"].join(v, "version_id").select("id", "version_id", "chapter_number", chapter_title(), "word_count").orderBy("chapter_number", "id").limit(size)


def chapter_title() -> Column:
    return T.chapter_label(F.col("chapter_number"), F.col("title")).alias("title")


def neighbours(chapters: DataFrame, group: str, number: str = "chapter_number") -> DataFrame:
    """(group, number, prev, next): the nearest smaller and larger distinct numbers."""
    order = Window.partitionBy(group).orderBy(number)
    return chapters.select(group, number).where(F.col(number).isNotNull()).distinct().select(group, number, F.lag(number).over(order).alias("prev_number"), F.lead(number).over(order).alias("next_number"))


def nearest(chapters: DataFrame, group: str, target: Column, number: str = "chapter_number", tie: str = "id") -> DataFrame:
    """The chapter of each group whose number is nearest to ``target``; ties to the smaller number, then id."""
    key = F.struct(F.abs(F.col(number) - target), number, tie)
    return chapters.groupBy(group).agg(F.min_by(F.struct(number, tie), key).alias("b")).select(group, F.col(f"b.{number}").alias(number), F.col(f"b.{tie}").alias(tie))


def read_chapter(t: Tables, key: str, number: float) -> DataFrame:
    """The chapter nearest to ``number`` of a work, its paragraphs and neighbours."""
    w = by_id_or_slug(t["works"], key).select(F.col("id").alias("work_id"), F.col("title").alias("work_title"))
    v = t["versions"].select(F.col("id").alias("version_id"), "work_id").join(w, "work_id")
    ch = t["version_chapters"].join(v, "version_id")
    best = nearest(ch, "work_id", F.lit(number)).select(F.col("work_id").alias("__w"), F.col("id").alias("__c"))
    around = neighbours(ch, "work_id").select(F.col("work_id").alias("__nw"), F.col("chapter_number").alias("__nn"), "prev_number", "next_number")
    one = ch.join(best, (F.col("work_id") == F.col("__w")) & (F.col("id") == F.col("__c"))).join(around, (F.col("work_id") == F.col("__nw")) & (F.col("chapter_number") == F.col("__nn")), "left")
    return one.select("id", "work_id", "work_title", "chapter_number", T.chapter_label(F.col("chapter_number"), F.col("title")).alias("label"), T.reader_paragraphs("content").alias("paragraphs"), "word_count", "prev_number", "next_number")


def chapter_sources(t: Tables, version_id: str | None = None, number: float | None = None) -> DataFrame:
    """Source chapters behind a version's chapter (or behind all), with site and whether they were promoted."""
    vc = t["version_chapters"]
    vc = vc if version_id is None else vc.where(F.col("version_id") == version_id)
    vc = vc if number is None else vc.where(F.col("chapter_number") == number)
    vc = vc.select(F.col("id").alias("version_chapter_id"), "promoted_from_id")
    st = t["source_titles"].select(F.col("id").alias("source_title_id"), "source_site")
    sc = t["source_chapters"].join(vc, "version_chapter_id").join(st, "source_title_id", "left")
    out = sc.select("version_chapter_id", "id", F.coalesce("source_site", F.lit("unknown")).alias("source_site"), "quality_score", F.col("id").eqNullSafe(F.col("promoted_from_id")).alias("is_promoted"))
    return out if number is None else out.orderBy(F.desc_nulls_last("quality_score"), "id")


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """(source_site, id, status, created_at) of each site's latest job, ties to the larger id: one pass with map-side combine."""
    best = F.max_by(F.struct("id", "status", "created_at"), F.struct("created_at", "id"))
    return jobs.groupBy("source_site").agg(best.alias("j")).select("source_site", "j.*")


def source_health(t: Tables) -> DataFrame:
    """Per site: titles, chapters, mean quality of scored chapters (0 reads as none), latest job. Three aggregates, each joined by site."""
    st = t["source_titles"]
    titles = st.groupBy("source_site").agg(F.count("*").alias("title_count"))
    sc = t["source_chapters"].join(st.select(F.col("id").alias("source_title_id"), "source_site"), "source_title_id")
    chapters = sc.groupBy("source_site").agg(F.count("*").alias("chapter_count"), F.nullif(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality"))
    jobs = latest_jobs(t["ingestion_jobs"]).select("source_site", F.col("status").alias("last_job_status"), F.col("created_at").alias("last_job_at"))
    return titles.join(chapters, "source_site", "left").join(jobs, "source_site", "left").select("source_site", "title_count", F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"), "avg_quality", "last_job_status", "last_job_at").orderBy("source_site")


def sources_of_site(t: Tables, site: str) -> DataFrame:
    return t["source_titles"].where(F.col("source_site") == site).orderBy(F.desc("created_at"), "id")


def claims_of_work(t: Tables, key: str, field: str | None = None) -> DataFrame:
    w = by_id_or_slug(t["works"], key).select(F.col("id").alias("work_id"))
    # broadcast: one work, its versions, its sources
    own = F.broadcast(t["versions"].join(F.broadcast(w), "work_id", "left_semi"))
    c = t["metadata_claims"].join(F.broadcast(owners(t["source_titles"], own, "source_site")), "source_title_id")
    return (c.where(F.col("field_name") == field) if field else c).orderBy("field_name", F.desc("confidence"), "id")


def recent_jobs(jobs: DataFrame, site: str | None = None, status: str | None = None, size: int = 50) -> DataFrame:
    for column, value in (("source_site", site), ("status", status)):
        jobs = jobs.where(F.col(column) == value) if value else jobs
    return jobs.orderBy(F.desc("created_at"), "id").limit(size)
