"""Queries over whole jobs and routes: resolution, ingestion, serving, discovery, storage.

Fixtures are SQL that Spark and DuckDB both run over the driver's tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libretto import oracles as O
from libretto import schema
from libretto import site_pages as P
from libretto.fixtures import domain, raw
from libretto.functions import scores as S
from libretto.functions import text as T
from libretto.functions.repair import misread, repaired
from libretto.operators import bulk, clean, ingest, resolve, serve
from libretto.plans import api, jobs
from libretto.plans.snapshots import Snapshots
from libretto.plans.store import fresh
from libretto.queries import CARD_TABLES, CARDS, CLAIMS, OWNED, PARAS, SCORE, SORTS, VALUE, WORDS, doc_paragraphs, part_pages, query
from libretto.sources import discover, extract
from libretto.sources.images import image_header, local_path
from libretto.sources.sites import sites_table

AS_OF = "2026-01-01"
ALL = ("works", "versions", "source_titles", "version_chapters", "source_chapters", "metadata_claims", "cover_candidates", "ingestion_jobs")


def at():
    return F.lit(AS_OF).cast("timestamp")


# -- the chapter resolver ------------------------------------------------------------

#: Chapters as three of sixty sources tell them: some without a number, some without text, some cleaned before.
SOURCE_CHAPTERS = """
    select concat('sc-', cast(doc_id as string)) id, concat('st-', cast(doc_id % 60 as string)) source_title_id, cast(doc_id as string) source_chapter_id, 'u' source_url,
           case when doc_id % 17 = 0 then cast(null as double) else cast(floor(doc_id / 60) % 12 as double) end chapter_number,
           case when doc_id % 2 = 0 then left(text, 40) when doc_id % 7 = 0 then '' else concat('Chapter ', cast(doc_id as string)) end source_title_text,
           case when doc_id % 19 = 0 then cast(null as string) else replace(text, chr(10), concat(chr(10), chr(10))) end raw_content, 'text' content_format,
           case when doc_id % 13 = 0 then 'cleaned before' end cleaned_content, case when doc_id % 13 = 0 then '1.0' end cleaner_version,
           case when doc_id % 13 = 0 then 0.8 end quality_score, case when doc_id % 13 = 0 then 2 end word_count, cast('2025-01-01' as timestamp) created_at
    from documents"""
SOURCES = "select distinct concat('st-', cast(doc_id % 60 as string)) id, case when doc_id % 60 % 10 = 9 then cast(null as string) else concat('v-', cast(doc_id % 60 % 25 as string)) end version_id, 's' source_site, cast(doc_id % 60 as string) source_id, 'u' source_url from documents"
CHAPTERS = "select distinct concat('vc-', cast(doc_id % 25 as string)) id, concat('v-', cast(doc_id % 25 as string)) version_id, cast(1 as double) chapter_number, case when doc_id % 25 % 2 = 0 then 'There before' else '' end title, 'old' content, 1 word_count from documents"


def chapter_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = raw(spark, sf_dir, "documents")
    made = [spark.sql(sql.replace("from documents", "from {documents}"), documents=docs) for sql in (CHAPTERS, SOURCE_CHAPTERS, SOURCES)]
    return tuple(schema.conform(df, name) for df, name in zip(made, ("version_chapters", "source_chapters", "source_titles"), strict=True))


RAW_PARAS = "list_filter(list_transform(string_split(raw_content, chr(10) || chr(10)), lambda x: trim(x, e' \\t\\r\\n')), lambda x: x <> '')"
RESOLVED = f"""
    sc as ({SOURCE_CHAPTERS}), st as ({SOURCES}), vc as ({CHAPTERS}),
    own as (select sc.*, version_id, coalesce(raw_content, '') <> '' and cleaner_version is distinct from '1.0' stale from sc join st on sc.source_title_id = st.id where version_id is not null),
    src as (select id, source_title_text title, {RAW_PARAS} ps from own where stale),
    {O.cleaned("src", "done")},
    counted as (select s.id, coalesce(ps, []) ps, coalesce(list_sum(list_transform(coalesce(ps, []), lambda x: {WORDS.format("x")})), 0) w from (select id from src) s left join done using (id)),
    told as (
        select o.id, version_id, chapter_number, stale, source_title_text, case when stale then array_to_string(ps, chr(10) || chr(10)) else cleaned_content end body,
               case when stale then {O.quality("coalesce(ps, [])", "coalesce(w, 0)")} else quality_score end score, case when stale then w else word_count end words
        from own o left join counted using (id)),
    best as (select * from told where chapter_number is not null and coalesce(body, '') <> '' qualify row_number() over (partition by version_id, chapter_number order by coalesce(score, 0) desc, id) = 1),
    firsts as (select version_id, chapter_number, source_title_text title from own where chapter_number is not null qualify row_number() over (partition by version_id, chapter_number order by created_at, id) = 1),
    every as (select version_id, chapter_number, title, content, word_count from vc union all select version_id, chapter_number, title, null, null from firsts f where not exists (select 1 from vc where vc.version_id = f.version_id and vc.chapter_number = f.chapter_number))"""


@query("resolve_chapters", f"""
    with recursive {RESOLVED}
    select e.version_id, e.chapter_number, coalesce(nullif(e.title, ''), b.source_title_text) title, md5(coalesce(b.body, e.content, '')) content, cast(coalesce(b.words, e.word_count) as integer) word_count, b.id promoted_from_id
    from every e left join best b on e.version_id = b.version_id and e.chapter_number = b.chapter_number""")
def resolve_chapters(spark, sf_dir):
    """Map, clean and promote the chapters that sixty sources tell."""
    out = resolve.resolve_chapters(*chapter_tables(spark, sf_dir), at())[0]
    return out.select("version_id", "chapter_number", "title", F.md5(F.coalesce("content", F.lit(""))).alias("content"), "word_count", "promoted_from_id")


@query("resolve_report", f"""
    with recursive {RESOLVED},
    c as (select e.version_id, count(b.id) promoted, count(*) - count(b.id) skipped from every e left join best b on e.version_id = b.version_id and e.chapter_number = b.chapter_number group by 1),
    s as (select version_id, count(chapter_number) mapped, count(*) filter (where stale) cleaned from told group by 1)
    select version_id, promoted, skipped, coalesce(mapped, 0) mapped, coalesce(cleaned, 0) cleaned from c left join s using (version_id)""")
def resolve_report(spark, sf_dir):
    return resolve.resolve_chapters(*chapter_tables(spark, sf_dir), at())[2].select("version_id", "promoted", "skipped", "mapped", "cleaned")


@query("chapter_contents", f"""
    with recursive {RESOLVED}
    select id, version_id, chapter_number, md5(coalesce(body, '')) body, cast(words as integer) word_count, round(score, 6) quality_score from told""")
def chapter_contents(spark, sf_dir):
    """Source chapters after the resolver: cleaned text and score of each that has a version."""
    chapters, sources, titles = chapter_tables(spark, sf_dir)
    told = resolve.resolve_chapters(chapters, sources, titles, at())[1]
    # digests meet the titles, not texts
    out = told.select("id", "source_title_id", "chapter_number", F.md5(F.coalesce("cleaned_content", F.lit(""))).alias("body"), "word_count", F.round("quality_score", 6).alias("quality_score"))
    out = out.join(titles.where("version_id is not null").select(F.col("id").alias("source_title_id"), "version_id"), "source_title_id")
    return out.select("id", "version_id", "chapter_number", "body", "word_count", "quality_score")


@query("stale_chapters", f"""
    with sc as ({SOURCE_CHAPTERS}) select id, coalesce(raw_content, '') = '' missing, coalesce(raw_content, '') <> '' and cleaner_version is distinct from '1.0' stale from sc""")
def stale_chapters(spark, sf_dir):
    """Which source chapters have no content, and which need cleaning."""
    rows = chapter_tables(spark, sf_dir)[1]
    none = ingest.without_content(rows).select(F.col("id").alias("lacks"))
    return rows.join(none, F.col("id") == F.col("lacks"), "left").select("id", F.col("lacks").isNotNull().alias("missing"), clean.stale().alias("stale"))


# -- full resolution -------------------------------------------------------------------

TOLD_FIELD = "case cast(split_part(id, '-', 2) as int) % 5 when 0 then 'title' when 1 then 'synopsis' when 2 then 'status' when 3 then 'original_language' else 'author' end"
BEST = f"""{OWNED},
    told as (select work_id, {TOLD_FIELD} field, {VALUE} v, confidence, created_at, id from owned),
    best as (select * from told qualify row_number() over (partition by work_id, field order by confidence desc, created_at desc, id) = 1)"""


def told_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The domain tables, the claims about the fields that works have, and no chapters."""
    t = domain(spark, sf_dir, "works", *CLAIMS, "cover_candidates")
    t["metadata_claims"] = t["metadata_claims"].withColumn("field_name", F.expr(TOLD_FIELD))
    return t | {n: schema.empty(spark, n) for n in ("version_chapters", "source_chapters")}


@query("resolve_all", f"""
    with {BEST},
    wide as (select work_id, max(v) filter (where field = 'title') title, max(v) filter (where field = 'synopsis') synopsis, max(v) filter (where field = 'status') status,
        max(v) filter (where field = 'original_language') original_language, count(*) filter (where field <> 'author') n from best group by work_id),
    scored as (select c.id, work_id, cast({SCORE} as double) score from cover_candidates c join source_titles s on c.source_title_id = s.id join versions v on s.version_id = v.id),
    cover as (select * from scored qualify row_number() over (partition by work_id order by score desc, id) = 1)
    select w.id, coalesce(nullif(b.title, ''), w.title) title, coalesce(nullif(b.synopsis, ''), w.synopsis) synopsis, coalesce(nullif(b.status, ''), w.status) status,
           coalesce(nullif(b.original_language, ''), w.original_language) original_language, coalesce(c.id, selected_cover_id) selected_cover_id, coalesce(n, 0) > 0 touched
    from works w left join wide b on w.id = b.work_id left join cover c on w.id = c.work_id""", ("works", *CLAIMS, "cover_candidates"))
def resolve_all(spark, sf_dir):
    """Metadata, covers and chapters of all works in one job."""
    done = jobs.resolve_work(told_tables(spark, sf_dir), at())
    return done["works"].select("id", "title", "synopsis", "status", "original_language", "selected_cover_id", F.coalesce(F.col("updated_at") == at(), F.lit(False)).alias("touched"))


@query("resolved_claims", f"with {BEST} select t.id, b.id is not null is_resolved from told t left join best b on t.id = b.id", ("works", *CLAIMS))
def resolved_claims(spark, sf_dir):
    done = jobs.resolve_work(told_tables(spark, sf_dir), at())
    return done["outcomes"].select("id", "is_resolved")


@query("selected_covers", f"""
    with scored as (select c.id, work_id, cast({SCORE} as double) score from cover_candidates c join source_titles s on c.source_title_id = s.id join versions v on s.version_id = v.id),
    best as (select * from scored qualify row_number() over (partition by work_id order by score desc, id) = 1)
    select c.id, cast({SCORE} as double) quality_score, case when s.id is null then c.is_selected else b.id is not null end is_selected
    from cover_candidates c left join scored s on c.id = s.id left join best b on c.id = b.id""", ("works", "versions", "source_titles", "cover_candidates"))
def selected_covers(spark, sf_dir):
    t = domain(spark, sf_dir, "works", "versions", "source_titles", "cover_candidates")
    return resolve.resolve_covers(t["works"], t["cover_candidates"], t["source_titles"], t["versions"])[1].select("id", "quality_score", "is_selected")


# -- the ingest cycle ---------------------------------------------------------------------


def fetched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Title pages with a list of up to three chapters, and pages of all but the last chapter."""
    base = part_pages(spark, sf_dir).withColumn("k", F.regexp_extract("url", r"(\d+)\.html", 1).cast("long"))
    numbers = F.when(F.col("k") % 4 > 0, F.sequence(F.lit(1).cast("long"), F.col("k") % 4)).otherwise(F.array().cast("array<bigint>"))
    item = lambda n: F.concat(F.lit('<li><a href="/'), F.col("k").cast("string"), F.lit("/chapter-"), n.cast("string"), F.lit('.html">Chapter '), n.cast("string"), F.lit(": Part</a></li>"))
    pages = base.select("site_key", "url", F.concat("html", F.lit('<ul class="list-chapter">'), F.array_join(F.transform(numbers, item), ""), F.lit("</ul>")).alias("html"))
    chapters = base.select("site_key", "k", F.explode(numbers).alias("n")).where(F.col("n") < F.col("k") % 4)
    url = F.concat(F.lit("https://novelfull.com/"), F.col("k").cast("string"), F.lit("/chapter-"), F.col("n").cast("string"), F.lit(".html"))
    body = F.concat(F.lit("<h2>Chapter "), F.col("n").cast("string"), F.lit(": Told</h2><div id='chapter-content'><p>Words of "), F.col("k").cast("string"), F.lit("</p></div>"))
    return pages, chapters.select("site_key", url.alias("url"), body.alias("html"))


def cycle(spark: SparkSession, sf_dir: str, tables: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    pages, chapters = fetched(spark, sf_dir)
    return jobs.ingest_cycle(tables or jobs.new_tables(spark), pages, pages, chapters, at())


STUBS = "stubs as (select p_partkey k, unnest(range(1, p_partkey % 4 + 1)) n from part)"


@query("ingest_chapters", f"""
    with {STUBS}
    select md5('novelfull|' || k) source_title_id, 'chapter-' || n || '.html' source_chapter_id, 'https://novelfull.com/' || k || '/chapter-' || n || '.html' source_url, cast(n as double) chapter_number,
           'Chapter ' || n || case when n < k % 4 then ': Told' else ': Part' end source_title_text, case when n < k % 4 then '<div id="chapter-content"><p>Words of ' || k || '</p></div>' end raw_content from stubs""")
def ingest_chapters(spark, sf_dir):
    """Stubs of the listings, and contents of the chapters fetched."""
    pages, chapters = fetched(spark, sf_dir)
    t, _ = jobs.ingest_titles(jobs.new_tables(spark), pages, at())
    t = jobs.ingest_contents(jobs.ingest_listings(t, pages, at()), chapters, at())
    return t["source_chapters"].select("source_title_id", "source_chapter_id", "source_url", "chapter_number", "source_title_text", "raw_content")


@query("ingest_covers", "select md5('novelfull|' || p_partkey) source_title_id, 'https://novelfull.com/c/' || p_partkey || '.jpg' source_url from part")
def ingest_covers(spark, sf_dir):
    t, _ = jobs.ingest_titles(jobs.new_tables(spark), fetched(spark, sf_dir)[0], at())
    return t["cover_candidates"].select("source_title_id", "source_url")


@query("ingest_sources", """
    select cast(p_partkey as varchar) source_id, round(least((case when p_size % 2 = 0 then 6 else 5 end) / 6.0 + 2 / 6.0 * 0.2, 1.0), 4) quality_score, p_name title, p_brand author, 'en' slug, 'Fan Translation (EN)' label, 'en' "language", true linked from part""")
def ingest_sources(spark, sf_dir):
    """Every source with the version and work it was linked to, and what its stored record says."""
    t = cycle(spark, sf_dir)
    said = F.from_json("raw_metadata", "title string, author string")
    v = t["versions"].select(F.col("id").alias("version_id"), "work_id", "slug", "label", "language")
    w = t["works"].select(F.col("id").alias("work_id"), F.lit(True).alias("linked"))
    return t["source_titles"].join(v, "version_id").join(w, "work_id").select("source_id", "quality_score", said["title"].alias("title"), said["author"].alias("author"), "slug", "label", "language", "linked")


@query("ingest_twice", f"""
    with {STUBS}, n as (select count(*) n, count(*) filter (where n < k % 4) c from stubs)
    select 'source_titles' "table", count(*) n_rows from part union all select 'cover_candidates', count(*) from part union all select 'source_chapters', n from n
    union all select 'metadata_claims', sum(7 + case when p_size % 2 = 0 then 1 else 0 end) from part union all select 'jobs completed', 2 union all select 'jobs failed', 1
    union all select 'chapters found', 2 * n from n union all select 'chapters new', n from n union all select 'chapters updated', c from n""")
def ingest_twice(spark, sf_dir):
    """The same pages twice through an audited cycle, a version each: the second run adds nothing. A third fails and is written down."""
    store = Snapshots(spark, fresh(spark, "saved"))
    for day in ("2026-01-01", "2026-01-02"):
        jobs.transact(store, lambda t: jobs.audited(t, "novelfull", "https://novelfull.com", lambda tables: cycle(spark, sf_dir, tables), day))  # noqa: B023
    t = jobs.checkout(jobs.transact(store, lambda t: jobs.audited(t, "novelfull", "https://novelfull.com", lambda tables: {}["no such table"], "2026-01-03")))
    out = None
    for name in ("source_titles", "cover_candidates", "source_chapters", "metadata_claims"):
        n = t[name].agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"))
        out = n if out is None else out.unionAll(n)
    log, done = t["ingestion_jobs"], F.col("status") == "completed"
    for name, count in (("jobs completed", F.count_if(done)), ("jobs failed", F.count_if(~done)), ("chapters found", F.sum("chapters_found")), ("chapters new", F.sum("chapters_new")), ("chapters updated", F.sum("chapters_updated"))):
        out = out.unionAll(log.agg(F.lit(name).alias("table"), count.cast("long").alias("n_rows")))
    return out


@query("delete_cascade", """
    select 'works' "table", count(*) n from works where id <> '7' union all select 'versions', count(*) from versions where work_id <> '7'
    union all select 'source_titles', count(*) from source_titles s join versions v on s.version_id = v.id where work_id <> '7'
    union all select 'version_chapters', count(*) from version_chapters c join versions v on c.version_id = v.id where work_id <> '7'""", ("works", "versions", "source_titles", "version_chapters"))
def delete_cascade(spark, sf_dir):
    """A work goes, and with it its versions, sources and chapters."""
    left = schema.delete_rows(domain(spark, sf_dir, "works", "versions", "source_titles", "version_chapters"), "works", F.col("id") == "7")
    out = None
    for name, df in left.items():
        n = df.agg(F.lit(name).alias("table"), F.count("*").alias("n"))
        out = n if out is None else out.unionAll(n)
    return out


# -- routes -------------------------------------------------------------------------------


@query("read_chapter", """
    with c as (select c.*, v.work_id, w.title work_title from version_chapters c join versions v on c.version_id = v.id join works w on v.work_id = w.id where w.slug = 'customer-000000011'),
    n as (select chapter_number, lag(chapter_number) over w prev_number, lead(chapter_number) over w next_number from (select distinct chapter_number from c) window w as (order by chapter_number))
    select c.id, work_id, work_title, c.chapter_number, c.title label, c.content paragraphs, word_count, prev_number, next_number from c join n using (chapter_number)
    order by abs(c.chapter_number - 3.4), c.chapter_number, c.id limit 1""", ("works", "versions", "version_chapters"))
def read_chapter(spark, sf_dir):
    one = api.call(domain(spark, sf_dir, "works", "versions", "version_chapters"), "GET", "/novel/customer-000000011/chapter/3.4")
    return one.withColumn("paragraphs", F.array_join("paragraphs", "|"))


@query("route_search_unknown_sort", f"with {CARDS} select * from cards order by {SORTS['popular']} limit 20", CARD_TABLES)
def route_search_unknown_sort(spark, sf_dir):
    """A sort order that does not exist means the first one."""
    return api.call(domain(spark, sf_dir, *CARD_TABLES), "GET", "/api/search", sort="no such order", min_rating=4.5)


@query("route_novels", f"with {CARDS} select * from cards where status = 'hiatus' order by {SORTS['az']} limit 10 offset 10", CARD_TABLES)
def route_novels(spark, sf_dir):
    return api.call(domain(spark, sf_dir, *CARD_TABLES), "GET", "/api/novels", status="hiatus", sort="az", page=2, size=10)


@query("route_job", "select * from ingestion_jobs where id = '7'", ("ingestion_jobs",))
def route_job(spark, sf_dir):
    return api.call(domain(spark, sf_dir, "ingestion_jobs"), "GET", "/api/v1/ingestion/jobs/7")


@query("route_new_job", "select 'novelfull' source_site, 'https://novelfull.com/' || max(p_partkey) || '.html' source_url, 'full' job_type, 'pending' status from part")
def route_new_job(spark, sf_dir):
    """A job for the page of the last part."""
    url = f"https://novelfull.com/{raw(spark, sf_dir, 'part').agg(F.max('p_partkey')).first()[0]}.html"
    row = api.call(jobs.new_tables(spark), "POST", "/api/v1/ingestion/jobs", site="novelfull", url=url, as_of=at())
    return row.select("source_site", "source_url", "job_type", "status")


@query("route_adapters", f"""
    with {P.ANSWERS}, n as (select site_key, count(*) pages from p group by 1)
    select t.*, coalesce(pages, 0) pages from (values
        ('boxnovel', 'BoxNovel', 'https://boxnovel.com', 1e0), ('foxaholic', 'Foxaholic', 'https://foxaholic.com', 1e0), ('novelbuddy', 'NovelBuddy', 'https://novelbuddy.com', 1e0), ('novelfire', 'NovelFire', 'https://novelfire.net', 1e0),
        ('novelfull', 'NovelFull', 'https://novelfull.com', 1e0), ('novelbin', 'NovelBin', 'https://novelbin.com', 1e0), ('readnovelfull', 'Read Novel Full', 'https://readnovelfull.com', 1e0),
        ('archiveofourown', 'Archive of Our Own', 'https://archiveofourown.org', 5e-1), ('chrysanthemumgarden', 'Chrysanthemum Garden', 'https://chrysanthemumgarden.com', 5e-1), ('creativenovels', 'Creative Novels', 'https://creativenovels.com', 5e-1),
        ('fanfiction', 'FanFiction.net', 'https://www.fanfiction.net', 5e-1), ('fimfiction', 'FimFiction', 'https://www.fimfiction.net', 1e0), ('freewebnovel', 'FreeWebNovel', 'https://freewebnovel.com', 1e0),
        ('hostednovel', 'Hosted Novel', 'https://hostednovel.com', 1e0), ('lightnovelworld', 'LightNovelWorld', 'https://www.lightnovelworld.com', 1e0), ('novelhall', 'Novel Hall', 'https://www.novelhall.com', 1e0),
        ('ranobes', 'Ranobes', 'https://ranobes.net', 5e-1), ('relibrary', 'Re:Library', 'https://re-library.com', 5e-1), ('royalroad', 'Royal Road', 'https://www.royalroad.com', 1e0), ('scribblehub', 'ScribbleHub', 'https://www.scribblehub.com', 1e0),
        ('tapas', 'Tapas', 'https://tapas.io', 5e-1), ('wanderinginn', 'The Wandering Inn', 'https://wanderinginn.com', 5e-1), ('wattpad', 'Wattpad', 'https://www.wattpad.com', 5e-1), ('webnovel', 'WebNovel', 'https://www.webnovel.com', 5e-1),
        ('wuxiacity', 'Wuxia.city', 'https://wuxia.city', 1e0), ('wuxiaworld', 'WuxiaWorld', 'https://www.wuxiaworld.com', 5e-1)) t(site_key, site_name, base_url, rps) left join n using (site_key)""")
def route_adapters(spark, sf_dir):
    """Every adapter, with the title pages there are of its site."""
    pages = P.title_pages(spark, sf_dir).groupBy("site_key").agg(F.count("*").alias("pages"))
    return sites_table(spark).join(pages, "site_key", "left").fillna(0, ["pages"])


@query("route_new_work", "select regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') slug, p_name title, 'ongoing' status, md5('work|' || regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g')) id from part where p_partkey = 5")
def route_new_work(spark, sf_dir):
    title = raw(spark, sf_dir, "part").where("p_partkey = 5").first()["p_name"]
    return api.call(domain(spark, sf_dir, "works"), "POST", "/api/v1/works", title=title, as_of=at(), status="ongoing").select("slug", "title", "status", "id")


@query("route_new_version", "select '7' work_id, 'fr-group-x' slug, 'Group X (FR)' label, 'fr' \"language\", md5('7|fr-group-x') id")
def route_new_version(spark, sf_dir):
    row = api.call(domain(spark, sf_dir, "versions"), "POST", "/api/v1/works/7/versions", language="fr", as_of=at(), translator_group="Group X")
    return row.select("work_id", "slug", "label", "language", "id")


@query("route_version_chapters", "select id, version_id, chapter_number, title, word_count, length(coalesce(content, '')) > 0 has_content from version_chapters where version_id = '5' order by chapter_number, id limit 2", ("version_chapters",))
def route_version_chapters(spark, sf_dir):
    return api.call(domain(spark, sf_dir, "version_chapters"), "GET", "/api/v1/versions/5/chapters", size=2)


@query("route_chapter", "select * from version_chapters where version_id = '5' and chapter_number = 2", ("version_chapters",))
def route_chapter(spark, sf_dir):
    return api.call(domain(spark, sf_dir, "version_chapters"), "GET", "/api/v1/versions/5/chapters/2")


@query("route_chapter_sources", """
    select s.version_chapter_id, s.id, coalesce(t.source_site, 'unknown') source_site, s.quality_score, s.id is not distinct from c.promoted_from_id is_promoted
    from source_chapters s join version_chapters c on s.version_chapter_id = c.id left join source_titles t on s.source_title_id = t.id where c.version_id = '5' and c.chapter_number = 2""", ("source_chapters", "version_chapters", "source_titles"))
def route_chapter_sources(spark, sf_dir):
    return api.call(domain(spark, sf_dir, "source_chapters", "version_chapters", "source_titles"), "GET", "/api/v1/versions/5/chapters/2/sources")


@query("route_work_chapters", """
    select c.id, version_id, chapter_number, coalesce(nullif(title, ''), 'Chapter ' || cast(floor(chapter_number) as int)) title, word_count
    from version_chapters c join versions v on c.version_id = v.id where work_id = '11' order by chapter_number, c.id limit 25""", ("works", "versions", "version_chapters"))
def route_work_chapters(spark, sf_dir):
    return api.call(domain(spark, sf_dir, "works", "versions", "version_chapters"), "GET", "/api/novel/11/chapters", size=25)


@query("route_work_versions", "select v.id, created_at, cast(count(c.id) as bigint) chapter_count, row_number() over (order by created_at, v.id) place from versions v left join version_chapters c on v.id = c.version_id where work_id = '11' group by 1, 2", ("works", "versions", "version_chapters"))
def route_work_versions(spark, sf_dir):
    return bulk.placed(api.call(domain(spark, sf_dir, "works", "versions", "version_chapters"), "GET", "/api/v1/works/11/versions").select("id", "created_at", "chapter_count"))


@query("route_work_claims", f"with {OWNED} select work_id, field_name, {VALUE} \"value\", confidence, id, row_number() over (order by field_name, confidence desc, id) place from owned where work_id = '11'", ("works", *CLAIMS))
def route_work_claims(spark, sf_dir):
    found = api.call(domain(spark, sf_dir, "works", *CLAIMS), "GET", "/api/v1/admin/works/11/claims")
    return bulk.placed(found.select("work_id", "field_name", serve.claim_value().alias("value"), "confidence", "id"))


@query("route_site_sources", "select id, created_at, row_number() over (order by created_at desc, id) place from source_titles where source_site = '5-LOW'", ("source_titles",))
def route_site_sources(spark, sf_dir):
    return bulk.placed(api.call(domain(spark, sf_dir, "source_titles"), "GET", "/api/v1/admin/sources/5-LOW").select("id", "created_at"))


@query("route_resolve", f"""
    with {BEST}, n as (select count(*) n from best) select 'resolved' what, cast(n as bigint) n from n""", ("works", *CLAIMS, "cover_candidates"))
def route_resolve(spark, sf_dir):
    done = jobs.resolve_work(told_tables(spark, sf_dir), at())
    return done["outcomes"].where("is_resolved").agg(F.lit("resolved").alias("what"), F.count("*").alias("n"))


@query("filter_chapters", "select id from version_chapters where (contains(lower(coalesce(title, '')), 'ter 2') or contains(cast(cast(chapter_number as int) as varchar), 'ter 2'))", ("version_chapters",))
def filter_chapters(spark, sf_dir):
    return serve.filter_chapters(domain(spark, sf_dir, "version_chapters")["version_chapters"], "ter 2", newest_first=True).select("id")


@query("card_display", "select id, left(coalesce(synopsis, ''), 160) preview, strftime(updated_at, '%b %d') updated from works", ("works",))
def card_display(spark, sf_dir):
    return domain(spark, sf_dir, "works")["works"].select("id", T.preview("synopsis").alias("preview"), T.short_date("updated_at").alias("updated"))


# -- cleaning details ------------------------------------------------------------------------


@query("extra_patterns", f"""
    with t as (select doc_id, {PARAS} p from documents),
    k as (select doc_id, list_filter(p, lambda x: length(trim(x)) >= 3 and not regexp_matches(x, '{O.BAD}|(?:^The )|(?:[0-9]{{4}})')) kept from t)
    select doc_id, cast(len(kept) as integer) n, md5(array_to_string(kept, '|')) digest from k""")
def extra_patterns(spark, sf_dir):
    """Patterns of a site's own beside the fixed ones."""
    p = doc_paragraphs(spark, sf_dir).select("doc_id", T.drop_boilerplate(F.col("p"), ("^The ", "[0-9]{4}")).alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


@query("quality_notes", f"""
    with p as (select doc_id, {PARAS} p from documents),
    w as (select doc_id, p, len(p) n, coalesce(list_sum(list_transform(p, lambda x: {WORDS.format("x")})), 0) w, len(regexp_extract_all(array_to_string(p, chr(10)), '{S.HINTS}')) h, {O.repeats("p")} again from p)
    select doc_id, array_to_string(list_filter([case when w = 0 then 'empty content' end, case when w > 0 and w < 500 then 'short chapter (' || cast(w as bigint) || ' words)' end, case when w > 15000 then 'suspiciously long (' || cast(w as bigint) || ' words)' end,
        case when n = 1 then 'single blob paragraph' end, case when n > 1 and w / n > 500 then 'unusually long average paragraph' end, case when h > 0 then h || ' boilerplate hit(s)' end, case when again then 'repetitive content detected' end], lambda x: x is not null), '; ') notes from w""")
def quality_notes(spark, sf_dir):
    p = doc_paragraphs(spark, sf_dir).withColumn("w", T.total_words(F.col("p")))
    return p.select("doc_id", F.array_join(S.chapter_quality(F.col("p"), F.col("w"))["notes"], "; ").alias("notes"))


#: How each seventh of the documents was misread before it is repaired: not at all, once, twice or three times over.
DAMAGE = ((), ("latin-1",), ("cp1252",), ("cp1252", "cp1252"), ("latin-1", "cp1252", "cp1252"), ("mac_roman",), ("latin-1", "cp437"))


@query("text_repair", r"select doc_id, doc_id % 7 kind, md5(text) digest, regexp_matches(text, '[^\x00-\x7F]') beyond_ascii from documents")
def text_repair(spark, sf_dir):
    """Every document damaged in one of six ways, or not, and restored: the texts of the table have no quotes or ligatures that repair would rewrite."""
    said = F.col("text")
    for k, names in enumerate(DAMAGE):
        said = F.when(F.col("doc_id") % len(DAMAGE) == k, reduce(misread, names, F.col("text"))).otherwise(said)
    rows = raw(spark, sf_dir, "documents").select("doc_id", said.alias("said"), F.col("text").rlike(r"[^\x00-\x7F]").alias("beyond_ascii"))
    return rows.select("doc_id", (F.col("doc_id") % 7).alias("kind"), F.md5(repaired(F.col("said"))).alias("digest"), "beyond_ascii")


# -- sources ----------------------------------------------------------------------------------


@query("json_source", """
    select cast(o_orderkey as varchar) url, cast(o_orderkey * 10 as varchar) source_chapter_id, 'Part "1"' title, 'https://x.com/' || o_orderkey source_url from orders
    union all select cast(o_orderkey as varchar), cast(o_orderkey * 10 + 1 as varchar), o_orderpriority, null from orders where o_orderkey % 3 <> 0""")
def json_source(spark, sf_dir):
    """Answers of two parts, of which some are locked."""
    body = "concat('{\"parts\": [{\"id\": ', o_orderkey * 10, ', \"title\": \"Part \\\\\"1\\\\\"\", \"url\": \"https://x.com/', o_orderkey, '\"}, {\"id\": ', o_orderkey * 10 + 1, ', \"title\": \"', o_orderpriority, '\", \"free\": ', case when o_orderkey % 3 = 0 then 'false' else 'true' end, '}], \"other\": 1}')"
    rows = raw(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("url"), F.expr(body).alias("body"))
    return extract.json_parts(rows)


@query("embedded_json", "select o_orderkey, case when o_orderkey % 5 = 0 then null when o_orderkey % 2 = 0 then o_orderpriority else 'sum ' || o_orderkey end found from orders")
def embedded_json(spark, sf_dir):
    html = "case when o_orderkey % 5 = 0 then '<p>no data</p>' when o_orderkey % 2 = 0 then concat('<script>window.__DATA__ = {\"description\": \"', o_orderpriority, '\", \"summary\": \"s\"};</script>') else concat('<script>window.__DATA__={\"description\":\"\",\"summary\":\"sum ', o_orderkey, '\"};</script>') end"
    return raw(spark, sf_dir, "orders").select("o_orderkey", extract.embedded_json(F.expr(html), "description", "summary").alias("found"))


@query("paginated_lists", """
    with recursive l as (select n_nationkey k, 1 page from nation union all select k, page + 1 from l where page < k % 6 + 1)
    select 'https://x.com/l/' || k || '/1' start, page, 'https://x.com/l/' || k || '/' || page url from l""")
def paginated_lists(spark, sf_dir):
    """Lists of one to six pages, followed by their links to the next page."""
    k = F.col("k").cast("string")
    step = raw(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.lit(1), (F.col("n_nationkey") % 6 + 1).cast("int"))).alias("page"))
    link = F.concat(F.lit('<a href="#">next</a><a href="/l/'), k, F.lit("/"), (F.col("page") + 1).cast("string"), F.when(F.col("page") % 2 == 0, F.lit('" rel="next">more</a>')).otherwise(F.lit('">Next</a>')))
    html = F.when(F.col("page") <= F.col("k") % 6, link).otherwise(F.lit("<p>the end</p>"))
    pages = step.select(F.concat(F.lit("https://x.com/l/"), k, F.lit("/"), F.col("page").cast("string")).alias("url"), html.alias("html"))
    first = pages.where(F.col("url").endswith("/1")).select("url")
    return discover.paginate(extract.next_pages(pages, "https://x.com"), first).select("start", "page", "url")


@query("sitemap", "select distinct 'https://x.com/book/' || (o_orderkey % 97) || '/' || (o_custkey % 11) url from orders")
def sitemap(spark, sf_dir):
    xml = "concat('<urlset><url><loc> https://x.com/book/', o_orderkey % 97, '/', o_custkey % 11, '/?a=1 </loc></url>', case when o_orderkey % 2 = 0 then '</urlset>' else '<broken' end)"
    return discover.sitemap_urls(raw(spark, sf_dir, "orders").select(F.expr(xml).alias("xml")))


@query("detect_tiers", """
    select 'https://s' || o_custkey || '.com' url, min(case when o_orderstatus <> 'F' and o_orderkey % 3 = 0 then o_orderkey % 4 + 1 end) tier from orders group by 1""")
def detect_tiers(spark, sf_dir):
    """The lowest tier that got an answer with links to title pages."""
    probes = "concat('https://s', o_custkey, '.com') url, cast(o_orderkey % 4 + 1 as int) tier, case when o_orderstatus = 'F' then 503 else 200 end status, case when o_orderkey % 3 = 0 then '<a href=\"/novel/x\">x</a>' else '<p>please wait</p>' end text"
    found = discover.detect_tier(raw(spark, sf_dir, "orders").selectExpr(*_parts(probes)))
    return found.select("url", F.col("tier").cast("long").alias("tier"))


def _parts(sql: str) -> list[str]:
    """The comma-separated expressions of a select list, commas in brackets aside."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(sql[start:k])
            start = k + 1
    return [*out, sql[start:]]


@query("probe_sites", """
    with n as (select o_custkey site, count(*) n from orders where o_orderkey % 2 = 0 group by 1)
    select c_custkey site, case when c_custkey % 4 > 0 then c_custkey % 4 end tier, coalesce(n, 0) novel_count,
           case when c_custkey % 4 = 0 then 'none' when n >= 3 then 'high' when n >= 1 then 'medium' else 'low' end confidence from customer left join n on c_custkey = site""")
def probe_sites(spark, sf_dir):
    tiers = raw(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 4).alias("tier"))
    novels = raw(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("url"))
    return discover.probe_sites(tiers, novels)


# -- pages of every site ----------------------------------------------------------------------

AT = P.filled_sql


@query("site_titles", f"""
    with {P.ANSWERS} select site_key, base || {AT("address")} source_url, {AT("source_id")} source_id, replace(p_name, ' ', ' & ') title, case when has_author then p_brand end author, status from p""")
def site_titles(spark, sf_dir):
    """A title page of each of the 26 sites in turn."""
    return extract.extract_titles(P.title_pages(spark, sf_dir), F.col("site_key")).select("site_key", "source_url", "source_id", "title", "author", "status")


@query("site_listings", f"""
    with {P.ANSWERS}, c as (select *, unnest([1, 2]) c from p)
    select site_key, base || {AT("address")} page_url, {AT("chapter_id", "cast(c as varchar)")} source_chapter_id, base || {AT("chapter", "cast(c as varchar)")} source_url, 'Chapter ' || c title, cast(c as double) chapter_number from c""")
def site_listings(spark, sf_dir):
    """A list of two chapters of each site."""
    return extract.extract_listings(P.listing_pages(spark, sf_dir), F.col("site_key")).select("site_key", "page_url", "source_chapter_id", "source_url", "title", "chapter_number")


@query("site_contents", f"""
    with {P.ANSWERS}
    select site_key, base || {AT("chapter", "'1'")} source_url, {AT("chapter_id", "'1'")} source_chapter_id, 'Chapter 1' title, 1e0 chapter_number,
           case when site_key = 'archiveofourown' then 'Chapter 1' else 'Text of ' || replace(p_name, ' ', ' &amp; ') end body from p""")
def site_contents(spark, sf_dir):
    """A chapter page of each site: its content without tags."""
    found = extract.extract_contents(P.chapter_pages(spark, sf_dir), F.col("site_key"))
    return found.select("site_key", "source_url", "source_chapter_id", "title", "chapter_number", F.regexp_replace("raw_content", "<[^>]*>", "").alias("body"))


@query("image_headers", """
    select p_partkey, case p_partkey % 4 when 0 then 'png' when 1 then 'gif' when 2 then 'jpeg' end image_format, case when p_partkey % 4 < 3 then p_size * 7 end width, case when p_partkey % 4 < 3 then p_size * 9 + 1 end height,
           'covers/' || p_partkey || '.' || case p_partkey % 4 when 0 then 'png' when 1 then 'gif' when 2 then 'jpeg' else 'jpg' end path from part""")
def image_headers(spark, sf_dir):
    """First bytes of pictures in three formats, and of one that is none."""
    w, h = "p_size * 7", "p_size * 9 + 1"
    big, little = "lpad(hex({0}), {1}, '0')", "concat(lpad(hex({0} & 255), 2, '0'), lpad(hex(shiftright(cast({0} as int), 8)), 2, '0'))"
    data = (
        f"unhex(case p_partkey % 4 when 0 then concat('89504E470D0A1A0A0000000D49484452', {big.format(w, 8)}, {big.format(h, 8)}) when 1 then concat('474946383961', {little.format('cast(' + w + ' as int)')}, {little.format('cast(' + h + ' as int)')}) "
        f"when 2 then concat('FFD8FFE000040000FFC0001108', {big.format(h, 4)}, {big.format(w, 4)}, '0300') else '00112233' end)"
    )
    found = raw(spark, sf_dir, "part").select("p_partkey", image_header(F.expr(data)).alias("i"))
    return found.select("p_partkey", F.col("i.image_format").alias("image_format"), F.col("i.width").cast("long").alias("width"), F.col("i.height").cast("long").alias("height"), local_path(F.col("p_partkey").cast("string"), F.col("i.image_format")).alias("path"))


@query("windowed_events", "select date_trunc('hour', ts) start, event_type, count(*) n, round(avg(value), 6) mean_value from events group by 1, 2")
def windowed_events(spark, sf_dir):
    from libretto.streaming.ingest import windowed_counts

    events = raw(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(events).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))
