"""Registry of the engine's queries and their SQL oracles.

Every query takes (spark, sf_dir). A limit stands only where it is the feature: a
page of a catalogue, a top list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from libretto import oracles as O
from libretto.fixtures import domain, raw, spread, with_views
from libretto.functions import scores as S
from libretto.functions import text as T
from libretto.functions import urls as U
from libretto.operators import bulk, clean, ingest, match, resolve, serve
from libretto.plans import jobs
from libretto.plans.store import fresh, stored
from libretto.sources import discover, extract
from libretto.sources.sites import get_site

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = with_views(oracle, *views) if views else oracle
        return f

    return keep


def claims_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("source_title_id"), F.col("event_type").alias("field_name"), F.col("props").alias("raw_value"),
        F.lit(None).cast("string").alias("normalised_value"), F.col("value").alias("confidence"), F.col("ts").alias("created_at"),
    )


# -- resolution ---------------------------------------------------------------


@query("resolve_metadata", """
    select user_id source_title_id, event_type field_name, props "value", value confidence, event_id id from events
    qualify row_number() over (partition by user_id, event_type order by value desc, ts desc, event_id) = 1""")
def resolve_metadata(spark, sf_dir):
    best = resolve.winning_claims(claims_of_events(spark, sf_dir), ["source_title_id"])
    return best.select("source_title_id", "field_name", "value", "confidence", "id")


@query("resolve_metadata_pivot", """
    with best as (select * from events qualify row_number() over (partition by user_id, event_type order by value desc, ts desc, event_id) = 1)
    select user_id source_title_id, max(props) filter (where event_type = 'view') "view", max(props) filter (where event_type = 'click') click,
           max(props) filter (where event_type = 'signup') signup, coalesce(max(props) filter (where event_type = 'error'), 'none') error
    from best group by user_id""")
def resolve_metadata_pivot(spark, sf_dir):
    best = resolve.winning_claims(claims_of_events(spark, sf_dir), ["source_title_id"])
    wide = best.groupBy("source_title_id").pivot("field_name", ["view", "click", "signup", "error"]).agg(F.first("value"))
    return wide.withColumn("error", F.coalesce("error", F.lit("none")))


CLAIMS = ("metadata_claims", "source_titles", "versions")
VALUE = "coalesce(nullif(normalised_value, ''), raw_value)"
OWNED = "owned as (select c.*, work_id, source_site from metadata_claims c join source_titles s on c.source_title_id = s.id join versions v on s.version_id = v.id)"


@query("resolve_works", f"""
    with {OWNED},
    best as (select * from owned qualify row_number() over (partition by work_id, field_name order by confidence desc, created_at desc, id) = 1)
    select w.id, w.title, coalesce(w.status, '') status, cast(count(b.id) as bigint) fields from works w left join best b on b.work_id = w.id group by w.id, w.title, w.status""", ("works", *CLAIMS))
def resolve_works(spark, sf_dir):
    t = domain(spark, sf_dir, "works", *CLAIMS)
    told = (t["metadata_claims"], t["source_titles"], t["versions"])
    works, _ = resolve.resolve_metadata(t["works"], *told, F.col("updated_at"))
    won = resolve.outcomes(*told).where("is_resolved").groupBy("work_id").agg(F.countDistinct("field_name").alias("fields"))
    return works.join(won, F.col("id") == F.col("work_id"), "left").select("id", "title", F.coalesce("status", F.lit("")).alias("status"), F.coalesce("fields", F.lit(0)).alias("fields"))


SCORE = """case when width is null or height is null or width = 0 or height = 0 then 0.0 when width < 100 or height < 100 then 0.05
    else cast(round(cast(cast(5e-1 * (5e-1 * least(width / 3e2, 1e0) + 5e-1 * least(height / 4.5e2, 1e0)) + 3e-1 * greatest(0e0, 1e0 - 2e0 * abs(width / height - 2e0 / 3e0))
    + 2e-1 * case when file_size is null or file_size = 0 then 1e0 when file_size < 10000 then 3e-1 when file_size > 10000000 then 5e-1 else 1e0 end as varchar) as decimal(38, 20)), 4) as double) end"""


@query("cover_score", f"select id, cast({SCORE} as double) score from cover_candidates", ("cover_candidates",))
def cover_score(spark, sf_dir):
    t = domain(spark, sf_dir, "cover_candidates")["cover_candidates"]
    return t.select("id", S.cover_score(F.col("width"), F.col("height"), F.col("file_size")).alias("score"))


@query("resolve_covers", f"""
    with scored as (select c.id, work_id, cast({SCORE} as double) score from cover_candidates c join source_titles s on c.source_title_id = s.id join versions v on s.version_id = v.id),
    best as (select * from scored qualify row_number() over (partition by work_id order by score desc, id) = 1)
    select w.id, coalesce(b.id, w.selected_cover_id) selected_cover_id from works w left join best b on w.id = b.work_id""", ("works", "versions", "source_titles", "cover_candidates"))
def resolve_covers(spark, sf_dir):
    t = domain(spark, sf_dir, "works", "versions", "source_titles", "cover_candidates")
    return resolve.resolve_covers(t["works"], t["cover_candidates"], t["source_titles"], t["versions"])[0].select("id", "selected_cover_id")


@query("best_offers", """
    select l_orderkey version_id, l_linenumber chapter_number, l_suppkey supplier, l_partkey part, cast(l_discount as double) quality from lineitem
    qualify row_number() over (partition by l_orderkey, l_linenumber order by coalesce(l_discount, 0) desc, l_partkey, l_suppkey, l_shipdate) = 1""")
def best_offers(spark, sf_dir):
    """The ranking alone, over a large table."""
    rows = raw(spark, sf_dir, "lineitem")
    best = resolve.ranked(rows, ["l_orderkey", "l_linenumber"], F.desc(F.coalesce("l_discount", F.lit(0.0))), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_shipdate"), name="n").where("n = 1")
    return best.select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("chapter_number"), F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), F.col("l_discount").alias("quality"))


# -- claims and jobs ------------------------------------------------------------


@query("claim_dedup", """
    with keyed as (select event_id, user_id source_title_id, event_type field_name, md5(props) claim_hash from events)
    select source_title_id, field_name, claim_hash, min(event_id) id from keyed k where not exists (
        select 1 from keyed o where o.event_id % 3 = 0 and o.source_title_id = k.source_title_id and o.field_name = k.field_name and o.claim_hash = k.claim_hash)
    group by source_title_id, field_name, claim_hash""")
def claim_dedup(spark, sf_dir):
    rows = claims_of_events(spark, sf_dir).withColumn("claim_hash", F.md5("raw_value")).select("source_title_id", "field_name", "claim_hash", "id")
    return ingest.unseen(rows, rows.where(F.col("id") % 3 == 0), ("source_title_id", "field_name", "claim_hash"))


@query("claims_by_field", f"with {OWNED} select work_id, field_name, {VALUE} \"value\", confidence, id, source_site from owned", CLAIMS)
def claims_by_field(spark, sf_dir):
    c = serve.claims_of_works(domain(spark, sf_dir, *CLAIMS))
    return c.select("work_id", "field_name", serve.claim_value().alias("value"), "confidence", "id", "source_site")


@query("latest_job_per_site", "select event_type source_site, event_id id, ts created_at from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) = 1")
def latest_job_per_site(spark, sf_dir):
    rows = raw(spark, sf_dir, "events").select(F.col("event_type").alias("source_site"), F.col("event_id").alias("id"), F.lit("done").alias("status"), F.col("ts").alias("created_at"))
    return serve.latest_jobs(rows).drop("status")


@query("recent_jobs", "select * from ingestion_jobs where status = 'failed' order by created_at desc, id limit 200", ("ingestion_jobs",))
def recent_jobs(spark, sf_dir):
    return serve.recent_jobs(domain(spark, sf_dir, "ingestion_jobs")["ingestion_jobs"], status="failed", size=200)


@query("refresh_queue", "select id, source_site, last_scraped_at, row_number() over (order by last_scraped_at asc nulls last, id) turn from source_titles", ("source_titles",))
def refresh_queue(spark, sf_dir):
    """The whole queue, every source with its turn."""
    rows = domain(spark, sf_dir, "source_titles")["source_titles"].select("id", "source_site", "last_scraped_at")
    return bulk.placed(rows, jobs.refresh_order(), "turn")


@query("refresh_jobs", """
    select md5(id || '|2026-01-01 00:00:00') id, source_site, source_url, id source_title_id, 'refresh' job_type, 'pending' status from source_titles""", ("source_titles",))
def refresh_jobs(spark, sf_dir):
    """A pending job for every source."""
    done = jobs.refresh_jobs(domain(spark, sf_dir, "source_titles")["source_titles"], F.lit("2026-01-01").cast("timestamp"))
    return done.select("id", "source_site", "source_url", "source_title_id", "job_type", "status")


@query("unseen_anti_join", "select doc_id, source, n_chars from documents where doc_id not in (select doc_id from labels)")
def unseen_anti_join(spark, sf_dir):
    return ingest.unseen(raw(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), raw(spark, sf_dir, "labels"), ("doc_id",))


# -- catalogue --------------------------------------------------------------------

CARD_TABLES = ("works", "versions", "source_titles", "version_chapters", "metadata_claims", "cover_candidates")
CARDS = f"""{OWNED},
    n as (select work_id, count(*) n from version_chapters c join versions v on c.version_id = v.id group by work_id),
    a as (select work_id, {VALUE} author from owned where field_name = 'author' and is_resolved qualify row_number() over (partition by work_id order by confidence desc, id) = 1),
    cards as (
        select w.id, w.slug, coalesce(w.title, '') title, coalesce(nullif(w.status, ''), 'ongoing') status, coalesce(w.original_language, '') original_language,
               left(coalesce(w.synopsis, ''), 200) synopsis, coalesce(nullif(a.author, ''), 'Unknown') author, coalesce(c.local_path, c.source_url, '') cover_url,
               cast(coalesce(n.n, 0) as bigint) total_chapters, w.created_at, w.updated_at
        from works w left join n on w.id = n.work_id left join a on w.id = a.work_id left join cover_candidates c on w.selected_cover_id = c.id)"""
SORTS = {
    "popular": "total_chapters desc, updated_at desc nulls last, id", "updated": "updated_at desc nulls last, created_at desc nulls last, id", "new": "created_at desc nulls last, id",
    "rating": "updated_at desc nulls last, created_at desc nulls last, id", "chapters": "total_chapters desc, id", "az": "title asc nulls last, id",
}

for _sort, _order in SORTS.items():

    @query(f"catalog_{_sort}", f"with {CARDS} select * from cards order by {_order} limit 20 offset 20", CARD_TABLES)
    def _catalog(spark, sf_dir, sort=_sort):
        return serve.listing(domain(spark, sf_dir, *CARD_TABLES), sort=sort, number=2, size=20)


@query("catalog_page_meta", "select count(*) total, greatest(1, cast(ceil(count(*) / 20.0) as bigint)) pages from works where status = 'ongoing'", ("works",))
def catalog_page_meta(spark, sf_dir):
    return serve.page_meta(domain(spark, sf_dir, "works")["works"].where("status = 'ongoing'"), 20)


@query("search_text", f"with {CARDS} select * from cards where (title ilike '%7%' or synopsis ilike '%7%') order by {SORTS['popular']} limit 100", CARD_TABLES)
def search_text(spark, sf_dir):
    return serve.search(domain(spark, sf_dir, *CARD_TABLES), q="7", size=100)


TAGGED = f"select work_id from owned where field_name in ('tags', 'genres') and lower({VALUE}) like "


@query("search_facets", f"""
    with {CARDS} select * from cards where status = 'completed' and id in ({TAGGED}'%ring%') and id not in ({TAGGED}'%promo%') and total_chapters between 5 and 60
    order by {SORTS['chapters']} limit 50""", CARD_TABLES)
def search_facets(spark, sf_dir):
    return serve.search(domain(spark, sf_dir, *CARD_TABLES), status="completed", tags=" ring ,", exclude_tags="promo", chap_min=5, chap_max=60, sort="chapters", size=50)


TERMS = f"""terms as (
        select distinct work_id, term from (
            select work_id, lower(regexp_replace(trim(unnest(regexp_split_to_array({VALUE}, '[,;|]+'))), '^[\\[\\]"]+|[\\[\\]"]+$', '', 'g')) term
            from owned where field_name in ('tags', 'genres') and is_resolved) where length(term) between 1 and 39)"""


@query("similar_items", f"""
    with {CARDS}, {TERMS}
    select * from cards where id <> '7' and id in (
        select o.work_id from owned o join terms t on t.work_id = '7' and contains(lower(coalesce(nullif(o.normalised_value, ''), o.raw_value)), t.term) where o.field_name in ('tags', 'genres'))
    order by updated_at desc nulls last, id limit 12""", CARD_TABLES)
def similar_items(spark, sf_dir):
    return serve.similar(domain(spark, sf_dir, *CARD_TABLES), "7")


@query("work_terms", f"with {OWNED}, {TERMS} select work_id, cast(count(*) as bigint) n, string_agg(term, ',' order by term) terms from terms group by work_id", CLAIMS)
def work_terms(spark, sf_dir):
    terms = serve.terms_of(domain(spark, sf_dir, *CLAIMS))
    return terms.groupBy("work_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))


@query("work_detail", f"""
    with {CARDS}, {TERMS}
    select cards.*, (select string_agg(term, ',' order by term) from (select term from terms where work_id = '11' order by term limit 12)) tags,
           (select string_agg(distinct source_site, ',' order by source_site) from owned where work_id = '11') sites
    from cards where slug = 'customer-000000011'""", CARD_TABLES)
def work_detail(spark, sf_dir):
    d = serve.detail(domain(spark, sf_dir, *CARD_TABLES), "customer-000000011")
    return d.withColumn("tags", F.array_join("tags", ",")).withColumn("sites", F.array_join("sites", ","))


@query("site_stats", "select (select count(*) from works) works, (select count(*) from version_chapters) chapters", ("works", "version_chapters"))
def site_stats(spark, sf_dir):
    return serve.stats(domain(spark, sf_dir, "works", "version_chapters"))


@query("source_health", """
    with t as (select source_site, count(*) title_count from source_titles group by 1),
    c as (select source_site, count(*) chapter_count, nullif(avg(s.quality_score), 0) avg_quality from source_chapters s join source_titles t on s.source_title_id = t.id group by 1),
    j as (select * from ingestion_jobs qualify row_number() over (partition by source_site order by created_at desc, id desc) = 1)
    select t.source_site, title_count, coalesce(chapter_count, 0) chapter_count, round(avg_quality, 6) avg_quality, j.status last_job_status, j.created_at last_job_at
    from t left join c using (source_site) left join j using (source_site)""", ("source_titles", "source_chapters", "ingestion_jobs"))
def source_health(spark, sf_dir):
    return serve.source_health(domain(spark, sf_dir, "source_titles", "source_chapters", "ingestion_jobs")).withColumn("avg_quality", F.round("avg_quality", 6))


# -- reading ----------------------------------------------------------------------


@query("versions_with_counts", "select v.id, v.work_id, v.label, cast(count(c.id) as bigint) chapter_count from versions v left join version_chapters c on v.id = c.version_id group by v.id, v.work_id, v.label", ("versions", "version_chapters"))
def versions_with_counts(spark, sf_dir):
    t = domain(spark, sf_dir, "versions", "version_chapters")
    return serve.versions_with_counts(t["versions"], t["version_chapters"]).select("id", "work_id", "label", "chapter_count")


@query("chapters_of_version", "select id, version_id, chapter_number, title, word_count, length(coalesce(content, '')) > 0 has_content from version_chapters", ("version_chapters",))
def chapters_of_version(spark, sf_dir):
    return serve.chapters_of_version(domain(spark, sf_dir, "version_chapters")["version_chapters"])


@query("chapter_prev_next", """
    with d as (select distinct work_id, chapter_number from version_chapters c join versions v on c.version_id = v.id)
    select work_id, chapter_number, lag(chapter_number) over w prev_number, lead(chapter_number) over w next_number from d window w as (partition by work_id order by chapter_number)""", ("versions", "version_chapters"))
def chapter_prev_next(spark, sf_dir):
    t = domain(spark, sf_dir, "versions", "version_chapters")
    return serve.neighbours(t["version_chapters"].join(t["versions"].select(F.col("id").alias("version_id"), "work_id"), "version_id"), "work_id")


@query("chapter_nearest", "select version_id, chapter_number, id from version_chapters qualify row_number() over (partition by version_id order by abs(chapter_number - 3.4), chapter_number, id) = 1", ("version_chapters",))
def chapter_nearest(spark, sf_dir):
    return serve.nearest(domain(spark, sf_dir, "version_chapters")["version_chapters"], "version_id", F.lit(3.4))


@query("chapter_sources_audit", """
    select s.version_chapter_id, s.id, coalesce(t.source_site, 'unknown') source_site, s.quality_score, s.id is not distinct from c.promoted_from_id is_promoted
    from source_chapters s join version_chapters c on s.version_chapter_id = c.id left join source_titles t on s.source_title_id = t.id""", ("source_chapters", "version_chapters", "source_titles"))
def chapter_sources_audit(spark, sf_dir):
    return serve.chapter_sources(domain(spark, sf_dir, "source_chapters", "version_chapters", "source_titles"))


# -- cleaning ---------------------------------------------------------------------

DOUBLED = "replace(text, chr(10), chr(10) || chr(10))"
PARAS = f"list_filter(list_transform(string_split({DOUBLED}, chr(10) || chr(10)), lambda x: trim(x, e' \\t\\r\\n')), lambda x: x <> '')"
WORDS = O.WORDS


def doubled(text: str = "text") -> Column:
    """The driver's texts with a blank line where they have one line end."""
    return F.replace(F.col(text), F.lit("\n"), F.lit("\n\n"))


def doc_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").select("doc_id", T.plain_paragraphs(doubled()).alias("p"))


@query("text_paragraphs", f"select doc_id, cast(len({PARAS}) as integer) n, md5(array_to_string({PARAS}, '|')) digest from documents")
def text_paragraphs(spark, sf_dir):
    return doc_paragraphs(spark, sf_dir).select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


def _duck_html(x: str) -> str:
    for pattern, new in T.HTML_STEPS:
        x = f"regexp_replace({x}, '{pattern}', {'chr(1)' if new == chr(1) else repr(new)}, 'g')"
    for a, b in T.ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


HTML_PARAS = f"list_filter(list_transform(string_split({_duck_html('html')}, chr(1)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"


@query("html_paragraphs", f"select page_id, cast(len({HTML_PARAS}) as integer) n, md5(array_to_string({HTML_PARAS}, '|')) digest from pages")
def html_paragraphs(spark, sf_dir):
    p = raw(spark, sf_dir, "pages").select("page_id", T.html_paragraphs("html").alias("p"))
    return p.select("page_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


INJECTED = ("Translator's note: thanks", "End of chapter ---", "read more novel updates here", "Support the author!", "Next Chapter", "please donate to us", "Chapter 12", "Volume 3.5", "advertisement", "The donated cloak.")
INJECT_SQL = "case doc_id % 11 " + " ".join(f"when {k} then '{s.replace(chr(39), chr(39) * 2)}'" for k, s in enumerate(INJECTED)) + " else 'ok' end"
BAD = T.BOILERPLATE_ANY.replace("'", "''")


@query("boilerplate_filter", f"""
    with t as (select doc_id, list_append({PARAS}, {INJECT_SQL}) p from documents),
    k as (select doc_id, len(p) before, list_filter(p, lambda x: length(trim(x)) >= 3 and not regexp_matches(x, '{BAD}')) kept from t)
    select doc_id, cast(before as integer) n_before, cast(len(kept) as integer) n_after, md5(array_to_string(kept, '|')) digest from k""")
def boilerplate_filter(spark, sf_dir):
    line = F.coalesce(F.get(F.array(*map(F.lit, INJECTED)), (F.col("doc_id") % 11).cast("int")), F.lit("ok"))
    p = doc_paragraphs(spark, sf_dir).select("doc_id", F.array_append("p", line).alias("p")).withColumn("kept", T.drop_boilerplate(F.col("p")))
    return p.select("doc_id", F.size("p").alias("n_before"), F.size("kept").alias("n_after"), F.md5(F.array_join("kept", "|")).alias("digest"))


@query("paragraph_fix", f"""
    with recursive src as (select doc_id id, unnest({PARAS}) p, unnest(range(1, len({PARAS}) + 1)) pos from documents),
    {O.split_blobs("src", "cut")},
    t as (select id, count(*) n, string_agg(p, '|' order by pos, grp) ps from cut where {WORDS.format("p")} >= 3 group by id)
    select doc_id, cast(coalesce(n, 0) as integer) n, md5(coalesce(ps, '')) digest from documents left join t on doc_id = id""")
def paragraph_fix(spark, sf_dir):
    p = doc_paragraphs(spark, sf_dir).select("doc_id", T.fix_paragraphs(F.col("p")).alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


@query("orphan_merge", f"""
    with src as (select doc_id, unnest({PARAS}) p, unnest(range(1, len({PARAS}) + 1)) pos from documents),
    g as (select *, sum(case when pos = 1 or {WORDS.format("p")} >= 8 then 1 else 0 end) over (partition by doc_id order by pos) grp from src),
    m as (select doc_id, grp, string_agg(p, ' ' order by pos) p from g group by doc_id, grp),
    t as (select doc_id, count(*) n, string_agg(p, '|' order by grp) ps from m group by doc_id)
    select doc_id, cast(coalesce(n, 0) as integer) n, md5(coalesce(ps, '')) digest from documents left join t using (doc_id)""")
def orphan_merge(spark, sf_dir):
    """Paragraphs of fewer than eight words join the one before."""
    p = doc_paragraphs(spark, sf_dir).select("doc_id", T.merge_orphans(F.col("p"), 8).alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


@query("blob_split", f"""
    with recursive src as (select doc_id id, 1 pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) p from documents), {O.split_blobs("src", "cut")}
    select id doc_id, cast(grp - 1 as integer) pos, p paragraph, cast({WORDS.format("p")} as integer) words from cut where grp > 0""")
def blob_split(spark, sf_dir):
    one = raw(spark, sf_dir, "documents").select("doc_id", T.collapse("text").alias("p")).where(T.word_count("p") >= T.BLOB_WORDS)
    return one.select("doc_id", F.posexplode(T.split_blob(F.col("p"))).alias("pos", "paragraph")).withColumn("words", T.word_count("paragraph"))


@query("bare_headings", "select page_id, regexp_matches(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '" + T.BARE_HEADING + "') bare, regexp_matches(cast(page_id as varchar) || ' - Title', '" + T.BARE_HEADING + "') numbered from pages")
def bare_headings(spark, sf_dir):
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return raw(spark, sf_dir, "pages").select("page_id", T.is_bare_heading(title).alias("bare"), T.is_bare_heading(F.concat(F.col("page_id").cast("string"), F.lit(" - Title"))).alias("numbered"))


PAGE_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
NEAR_TITLE = O.ratio(O.heading_key("title"), O.heading_key("p"), T.HEADING_RATIO)


@query("heading_dedup", f"""
    with t as (select page_id, {PAGE_TITLE} title, {HTML_PARAS} ps from pages),
    e as (select page_id, title, unnest(ps) p, unnest(range(1, len(ps) + 1)) pos from t),
    gone as (select page_id, count(*) n from e where title <> '' and pos <= {T.HEADING_WINDOW} and (regexp_matches(trim(p), '{T.BARE_HEADING}') or {NEAR_TITLE} >= {T.HEADING_RATIO}) group by page_id)
    select page_id, cast(len(ps) as integer) n_before, cast(len(ps) - coalesce(n, 0) as integer) n_after from t left join gone using (page_id)""")
def heading_dedup(spark, sf_dir):
    p = raw(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), T.html_paragraphs("html").alias("p"))
    p = p.withColumn("alike", clean.heading_likeness(F.col("p"), F.col("title")))
    return p.select("page_id", F.size("p").alias("n_before"), F.size(clean.dedup_heading(F.col("p"), F.col("title"), F.col("alike"))).alias("n_after"))


PLAIN_QUOTES = "translate({0}, '‘’‚‛“”„‟', '" + "\'\'" * 4 + '"' * 4 + "')"


@query("clean_pipeline", f"""
    with recursive src as (select page_id id, {PAGE_TITLE} title, {HTML_PARAS} ps from (select page_id, {PLAIN_QUOTES.format("html")} html from pages)),
    {O.cleaned("src", "done")},
    every as (select s.id, coalesce(ps, []) ps, coalesce(list_sum(list_transform(coalesce(ps, []), lambda x: {WORDS.format("x")})), 0) w from (select id from src) s left join done using (id))
    select id page_id, array_to_string(ps, chr(10) || chr(10)) cleaned_content, cast(len(ps) as integer) paragraph_count, cast(w as integer) word_count, {O.quality("ps", "w")} quality_score, '1.0' cleaner_version from every""")
def clean_pipeline(spark, sf_dir):
    p = raw(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.col("html").alias("raw"))
    return clean.clean_and_score(p, raw="raw", title="title").select("page_id", "cleaned_content", "paragraph_count", "word_count", "quality_score", "cleaner_version")


QUALITY = f"""
    with p as (select doc_id, {PARAS} p from documents),
    w as (select doc_id, {O.repeats("p")} again, len(p) n, coalesce(list_sum(list_transform(p, lambda x: {WORDS.format("x")})), 0) w, len(regexp_extract_all(array_to_string(p, chr(10)), '{S.HINTS}')) h from p),
    s as (select doc_id, n, w, h,
        case when w = 0 then 0e0 when w < 500 then w / 500 * 5e-1 when w > 15000 then 5e-1 else 5e-1 + least(w, 2000) / 2000 * 5e-1 end l,
        case when n = 0 then 0e0 when n = 1 then 1e-1 when w / n > 500 then 3e-1 else 4e-1 + least(n, 30) / 30 * 6e-1 end t,
        greatest(0e0, 1e0 - case when h > 0 then least(h * 1e-1, 4e-1) else 0e0 end - case when again then 2e-1 else 0e0 end) c from w)
    select doc_id, cast(w as integer) words, cast(n as integer) paragraphs, cast(h as integer) hits, round(cast(l as double), 6) length_score, round(cast(t as double), 6) structure_score,
           round(cast(c as double), 6) cleanliness_score, cast(round(cast(cast(35e-2 * l + 35e-2 * t + 3e-1 * c as varchar) as decimal(38, 20)), 4) as double) final_score from s"""


@query("chapter_quality", QUALITY)
def chapter_quality(spark, sf_dir):
    p = doc_paragraphs(spark, sf_dir).withColumn("w", T.total_words(F.col("p")))
    q = p.select("doc_id", S.chapter_quality(F.col("p"), F.col("w")).alias("q"))
    six = lambda c: F.round(F.col(f"q.{c}"), 6).alias(c)
    return q.select("doc_id", F.col("q.word_count").alias("words"), F.col("q.paragraph_count").alias("paragraphs"), F.col("q.boilerplate_hits").alias("hits"), six("length_score"), six("structure_score"), six("cleanliness_score"), F.col("q.final_score").alias("final_score"))


@query("repetition_check", f"""
    with t as (select doc_id, {PARAS} p from documents),
    pairs as (select doc_id, unnest(p[1 : len(p) - 1]) a, unnest(p[2 : len(p)]) b from t),
    hits as (select doc_id, bool_or(len(list_filter(range(20, least(length(a), length(b)) + 1), lambda k: right(a, k) = left(b, k))) > 0) h from pairs group by doc_id)
    select doc_id, coalesce(h, false) has_repetition from documents left join hits using (doc_id)""")
def repetition_check(spark, sf_dir):
    return doc_paragraphs(spark, sf_dir).select("doc_id", S.repeats(F.col("p")).alias("has_repetition"))


@query("reader_paragraphs", r"""
    with t as (
        select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, e' \t\r\n')), lambda x: x <> '') ls,
               string_split(regexp_replace(text, '([.!?])\s+([A-Z"“])', e'\\1\x01\\2', 'g'), e'\x01') ss from documents),
    p as (select doc_id, case when len(ls) > 1 then ls when len(ss) > 2 then list_transform(range(0, len(ss), 3), lambda k: trim(array_to_string(ss[k + 1 : k + 3], ' ')))
        when trim(text) = '' then [] else [trim(text)] end p from t)
    select doc_id, cast(unnest(range(len(p))) as integer) pos, unnest(p) paragraph from p""")
def reader_paragraphs(spark, sf_dir):
    return raw(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.reader_paragraphs("text")).alias("pos", "paragraph"))


# -- text functions -------------------------------------------------------------------

TITLE = "case when p_partkey % 3 = 0 then 'The ' || p_name when p_partkey % 3 = 1 then upper(p_name) else p_name || '''s Novel!' end"
STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def variant_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("The "), name)).when(F.col("p_partkey") % 3 == 1, F.upper(name)).otherwise(F.concat(name, F.lit("'s Novel!")))
    return raw(spark, sf_dir, "part").select("p_partkey", title.alias("title"), "p_brand")


@query("title_normalise", f"""
    select p_partkey, array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(lower({TITLE}), '[^a-z0-9\\s]', '', 'g')), '\\s+'), lambda w: w <> '' and w not in ({STOPS})), ' ') match_key,
           trim(regexp_replace(regexp_replace(lower({TITLE}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) heading_key,
           array_to_string(list_sort(regexp_split_to_array(trim({TITLE}), '\\s+')), ' ') token_sort from part""")
def title_normalise(spark, sf_dir):
    return variant_titles(spark, sf_dir).select("p_partkey", T.match_key("title").alias("match_key"), T.heading_key("title").alias("heading_key"), T.token_sort("title").alias("token_sort"))


FOLDED = f"translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}')"
for _from, _to in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
    FOLDED = f"replace({FOLDED}, '{_from}', '{_to}')"
#: Twice, as a digit between two commas belongs to both.
GROUPED = f"regexp_replace(regexp_replace({FOLDED}, '([0-9]),([0-9])', '\\1\\2', 'g'), '([0-9]),([0-9])', '\\1\\2', 'g')"


@query("slugify", f"select doc_id, trim(regexp_replace({GROUPED}, '[^a-z0-9]+', '-', 'g'), '-') slug from documents")
def slugify(spark, sf_dir):
    return raw(spark, sf_dir, "documents").select("doc_id", T.slugify("text").alias("slug"))


@query("version_slug_label", """
    select o_orderkey, trim(regexp_replace(lower('en' || case when o_orderkey % 4 = 0 then '' else '-' || o_orderpriority end), '[^a-z0-9]+', '-', 'g'), '-') slug,
           case when o_orderkey % 4 <> 0 then o_orderpriority when o_orderstatus = 'F' then 'Official' else 'Fan Translation' end || ' (EN)' label from orders""")
def version_slug_label(spark, sf_dir):
    v = domain(spark, sf_dir, "versions")["versions"]
    return v.select(F.col("id").cast("long").alias("o_orderkey"), T.version_slug("language", "translator_group").alias("slug"), T.version_label("language", "translator_group", "version_type").alias("label"))


NUMBER_TEXT = "case page_id % 6 when 0 then 'Chapter ' || page_id || '.5: The Battle' when 1 then 'ch. ' || page_id when 2 then 'Interlude #' || page_id when 3 then page_id || ' - Title' when 4 then 'Part ' || page_id else 'Prologue' end"
NUMBERS = [f"try_cast(nullif(regexp_extract({x}, '{p}', 1), '') as double)" for x in (NUMBER_TEXT, "url") for p in T.CHAPTER_NUMBERS]


@query("chapter_number_parse", f"select page_id, coalesce({', '.join(NUMBERS)}) number from pages")
def chapter_number_parse(spark, sf_dir):
    return raw(spark, sf_dir, "pages").select("page_id", T.chapter_number(F.expr(NUMBER_TEXT), F.col("url")).alias("number"))


RAW_STATUS = "case o_orderkey % 7 when 0 then ' Completed ' when 1 then 'ON-GOING' when 2 then 'on hold' when 3 then 'Cancelled' when 4 then 'stub' when 5 then '' else lower(o_orderstatus) end"


def _duck_map(table: dict[str, str], key: str, other: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else {other} end"


@query("status_normalise", f"select o_orderkey, {_duck_map(T.STATUS, f'trim(lower({RAW_STATUS}))', 'null')} strict, {_duck_map(T.STATUS_LOOSE, f'trim(lower({RAW_STATUS}))', f'trim(lower({RAW_STATUS}))')} loose from orders")
def status_normalise(spark, sf_dir):
    o = raw(spark, sf_dir, "orders").select("o_orderkey", F.expr(RAW_STATUS).alias("s"))
    return o.select("o_orderkey", T.status("s").alias("strict"), T.status_loose("s").alias("loose"))


@query("url_normalise", r"""
    select page_id, lower(regexp_extract(url, '^(\w+)://', 1)) || '://' || regexp_extract(url, '^\w+://([^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^\w+://[^/?#]*([^?#]*)', 1), '/+$', '') url,
           regexp_extract(url, '^\w+://([^/?#]*)', 1) authority, false is_listing from pages""")
def url_normalise(spark, sf_dir):
    return raw(spark, sf_dir, "pages").select("page_id", U.normalise(F.col("url")).alias("url"), U.authority(F.col("url")).alias("authority"), U.is_listing(F.col("url")).alias("is_listing"))


@query("source_id", r"select page_id, coalesce(nullif(regexp_extract(url, '/([^/?#]+?)(?:\.html)?/?$', 1), ''), url) novelfull, coalesce(nullif(regexp_extract(url, '/(?:novel|manga)/([^/?#]+)', 1), ''), regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1)) madara from pages")
def source_id(spark, sf_dir):
    u = F.col("url")
    return raw(spark, sf_dir, "pages").select("page_id", extract.source_id_column(get_site("novelfull"), u).alias("novelfull"), extract.source_id_column(get_site("boxnovel"), u).alias("madara"))


# -- matching ---------------------------------------------------------------------


def works_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work per distinct part name."""
    p = raw(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return p.select(F.concat(F.lit("w"), F.col("k").cast("string")).alias("id"), T.slugify("p_name").alias("slug"), F.col("p_name").alias("title"), F.col("k").alias("created_at"))


@query("work_match_exact", r"""
    with w as (select 'w' || min(p_partkey) id, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') slug from part group by p_name),
    c as (select p_partkey, case when p_partkey % 2 = 0 then upper(p_name) else p_name || ' zzzzzzzzzzzzzzzz' end title from part)
    select p_partkey id, w.id work_id, w.id is not null matched from c left join w on w.slug = trim(regexp_replace(lower(c.title), '[^a-z0-9]+', '-', 'g'), '-')""")
def work_match_exact(spark, sf_dir):
    title = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" zzzzzzzzzzzzzzzz")))
    c = raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), title.alias("title"))
    m = match.match_works(c, works_of_parts(spark, sf_dir))
    hit = F.col("reason") == "exact_slug"
    return m.select("id", F.when(hit, F.col("work_id")).alias("work_id"), hit.alias("matched"))


def _duck_key(title: str) -> str:
    """Sorted words of a title without stop words, in DuckDB SQL."""
    kept = f"list_filter(regexp_split_to_array(trim(regexp_replace(lower({title}), '[^a-z0-9\\s]', '', 'g')), '\\s+'), lambda w: w <> '' and w not in ({STOPS}))"
    return f"array_to_string(list_sort({kept}), ' ')"


def _duck_slug(title: str) -> str:
    return f"trim(regexp_replace(lower({title}), '[^a-z0-9]+', '-', 'g'), '-')"


def _duck_sorted(x: str) -> str:
    return f"array_to_string(list_sort(regexp_split_to_array(lower({x}), '\\s+')), ' ')"


FUZZY = f"""
    w as (select 'w' || min(p_partkey) id, min(p_partkey) created_at, {_duck_slug("p_name")} slug, {_duck_key("p_name")} k from part group by p_name),
    c as (select p_partkey id, {_duck_slug(TITLE)} slug, {_duck_key(TITLE)} k from part),
    named as (select slug, id from w qualify row_number() over (partition by slug order by created_at, id) = 1)"""


@query("work_match_fuzzy", f"""
    with {FUZZY},
    scored as (select c.k, w.id, created_at, {O.ratio("c.k", "w.k", 90)} score from (select distinct k from c where k <> '') c, w where w.k <> ''),
    best as (select * from scored where score >= 90 qualify row_number() over (partition by k order by score desc, created_at, id) = 1)
    select c.id, c.slug, coalesce(n.id, b.id, md5('work|' || c.slug)) work_id, case when n.id is not null or b.id is null then 1e0 else score / 100 end confidence,
           case when n.id is not null then 'exact_slug' when b.id is not null then 'fuzzy_title' else 'new' end reason, n.id is null and b.id is null is_new_work
    from c left join named n on c.slug = n.slug left join best b on c.k = b.k""")
def work_match_fuzzy(spark, sf_dir):
    c = variant_titles(spark, sf_dir).select(F.col("p_partkey").alias("id"), "title")
    return match.match_works(c, works_of_parts(spark, sf_dir))


@query("work_match_batch", f"""
    with recursive {FUZZY},
    nodes as (select slug, k, min(id) seen, row_number() over (order by min(id)) n from c group by slug, k),
    near as (select a.n earlier, b.n later, a.slug = b.slug named, {O.ratio("a.k", "b.k", 90)} score from nodes a join nodes b on a.n < b.n),
    before as (select later, list(earlier) e from near where score >= 90 or named group by later),
    f as (
        select 0::bigint n, []::bigint[] founders
        union all
        select f.n + 1, case when len(list_intersect(founders, coalesce(e, []))) = 0 then list_append(founders, f.n + 1) else founders end
        from f left join before on later = f.n + 1 where f.n < (select max(n) from nodes)),
    made as (select * from nodes where n in (select unnest(founders) from f where f.n = (select max(n) from nodes))),
    every as (select c.id, c.slug, n from c join nodes using (slug, k)),
    sides as (select earlier a, later b, score from near union all select later, earlier, score from near),
    best as (
        select e.id, m.slug, score from every e join sides on a = e.n join made m on m.n = b where m.seen < e.id and score >= 90
        qualify row_number() over (partition by e.id order by score desc, m.seen) = 1)
    select e.id, e.slug, md5('work|' || coalesce(s.slug, b.slug)) work_id, case when s.slug is not null then 1e0 else b.score / 100 end confidence,
           case when s.seen = e.id then 'new' when s.slug is not null then 'exact_slug' else 'fuzzy_title' end reason, coalesce(s.seen = e.id, false) is_new_work
    from every e left join (select slug, min(seen) seen from made group by slug) s on s.slug = e.slug and s.seen <= e.id left join best b on b.id = e.id""")
def work_match_batch(spark, sf_dir):
    """All titles come in one batch and no work is there yet: each joins what an earlier one made."""
    c = variant_titles(spark, sf_dir).select(F.col("p_partkey").alias("id"), "title")
    return match.match_batch(c, works_of_parts(spark, sf_dir).where("false"))


@query("version_match", f"""
    with c as (select id, work_id, language, {_duck_sorted("translator_group || 's'")} a, version_type from versions),
    v as (select id version_id, work_id, language, {_duck_sorted("translator_group")} b from versions where translator_group is not null),
    names as (select a, b, {O.ratio("a", "b", 85)} score from (select distinct a from c where a is not null), (select distinct b from v)),
    scored as (select c.id, version_id, score from c join v using (work_id, language) join names using (a, b) where score >= 85),
    best as (select * from scored qualify row_number() over (partition by id order by score desc, version_id) = 1),
    lone as (select work_id, language, version_type, min(id) version_id from versions group by 1, 2, 3 having count(*) = 1)
    select id, version_id, score / 100 confidence, case when score >= 98 then 'translator_exact' else 'translator_fuzzy' end reason from best
    union all
    select c.id, o.version_id, 6e-1, 'language_only' from c join lone o using (work_id, language, version_type) where a is null""", ("versions",))
def version_match(spark, sf_dir):
    v = domain(spark, sf_dir, "versions")["versions"]
    c = v.select("id", "work_id", "language", F.when(F.col("translator_group").isNotNull(), F.concat(F.col("translator_group"), F.lit("s"))).alias("translator_group"), "version_type")
    return match.match_versions(c, v)


# -- extraction and discovery -----------------------------------------------------------


@query("page_metadata_extract", """
    select page_id, regexp_extract(html, '<title>(.*?)</title>', 1) title, trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) h1, regexp_extract(html, '<html lang="([^"]*)"', 1) lang from pages""")
def page_metadata_extract(spark, sf_dir):
    p = raw(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.trim(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("h1"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("lang"))


@query("page_links", r"""
    with l as (select url, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) href from pages)
    select url, regexp_extract(url, '^(\w+://[^/?#]*)', 1) || regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+$', '') link, false is_listing from l where href like '/%'""")
def page_links(spark, sf_dir):
    return discover.page_links(raw(spark, sf_dir, "pages"))


PART_PAGE = ('<div class="book"><img src="/c/{0}.jpg"></div><h3 class="title">', '</h3><div class="info"><a href="/author/x">', '</a><a href="/status/y">', '</a><a href="/genre/z">', '</a></div><span>', ' Chapters</span><div class="desc-text"><p>', "</p></div>")


@query("site_title_extract", """
    select concat('https://novelfull.com/', p_partkey, '.html') source_url, cast(p_partkey as varchar) source_id, p_name title, p_brand author, case when p_size % 2 = 0 then 'completed' end status,
           p_type genres, p_size total_chapters, 'https://novelfull.com/c/' || p_partkey || '.jpg' cover_url, p_name || ' by ' || p_brand synopsis from part""")
def site_title_extract(spark, sf_dir):
    rows = extract.extract_titles(part_pages(spark, sf_dir), F.col("site_key"))
    return rows.select("source_url", "source_id", "title", "author", "status", F.array_join("genres", ",").alias("genres"), "total_chapters", "cover_url", "synopsis")


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title page of one template for every part."""
    a = PART_PAGE
    key = F.col("p_partkey").cast("string")
    html = F.concat(
        F.replace(F.lit(a[0]), F.lit("{0}"), key), "p_name", F.lit(a[1]), "p_brand", F.lit(a[2]), F.when(F.col("p_size") % 2 == 0, "Completed").otherwise("Sometime"), F.lit(a[3]), "p_type",
        F.lit(a[4]), F.col("p_size").cast("string"), F.lit(a[5]), "p_name", F.lit(" by "), "p_brand", F.lit(a[6]),
    )
    # dealt as parts, which are smaller than their pages
    return spread(raw(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select(F.lit("novelfull").alias("site_key"), F.concat(F.lit("https://novelfull.com/"), key, F.lit(".html")).alias("url"), html.alias("html"))


@query("metadata_completeness", "select cast(p_partkey as varchar) source_id, round(least((case when p_size % 2 = 0 then 6 else 5 end) / 6.0 + 2 / 6.0 * 0.2, 1.0), 4) score from part")
def metadata_completeness(spark, sf_dir):
    rows = extract.extract_titles(part_pages(spark, sf_dir), F.col("site_key"))
    return rows.select("source_id", S.completeness(dict(rows.dtypes)).alias("score"))


@query("ingest_claims", """
    with c as (
        select p_partkey k, unnest([{'f': 'title', 'v': p_name}, {'f': 'author', 'v': p_brand}, {'f': 'synopsis', 'v': p_name || ' by ' || p_brand}, {'f': 'language', 'v': 'en'},
            {'f': 'original_language', 'v': 'zh'}, {'f': 'genres', 'v': p_type}, {'f': 'total_chapters', 'v': cast(p_size as varchar)}, {'f': 'status', 'v': case when p_size % 2 = 0 then 'completed' end}]) x,
            round(least((case when p_size % 2 = 0 then 6 else 5 end) / 6.0 + 2 / 6.0 * 0.2, 1.0), 4) confidence from part)
    select md5('novelfull|' || k) source_title_id, x.f field_name, x.v raw_value, md5(x.v) claim_hash, cast(confidence as double) confidence from c where x.v <> ''""")
def ingest_claims(spark, sf_dir):
    at = F.lit("2026-01-01").cast("timestamp")
    # parsed once: the sources and their claims are both made from it
    meta = stored(extract.extract_titles(part_pages(spark, sf_dir), F.col("site_key")), "metadata")
    st = ingest.source_title_rows(meta, at)
    return ingest.claim_rows(meta, st, at).select("source_title_id", "field_name", "raw_value", "claim_hash", "confidence")


@query("tier_vote", """
    with d as (select user_id site, event_id url, case when event_type in ('view', 'click', 'purchase') then cast(floor(value) as int) % 4 + 1 end tier from events),
    v as (select site, tier, count(*) votes, min(url) first_seen from d where tier is not null group by site, tier)
    select s.site, v.tier, coalesce(v.votes, 0) votes, s.n candidates_checked from (select site, count(*) n from d group by site) s
    left join (select * from v qualify row_number() over (partition by site order by votes desc, first_seen, tier) = 1) v using (site)""")
def tier_vote(spark, sf_dir):
    tier = F.when(F.col("event_type").isin("view", "click", "purchase"), F.floor("value").cast("int") % 4 + 1)
    d = raw(spark, sf_dir, "events").select(F.col("user_id").alias("site"), F.col("event_id").alias("url"), tier.alias("tier"))
    return discover.vote_tier(d, ["site"])


EDGES = "select 'https://s.example.com/novel/' || l_orderkey url, 'https://s.example.com/novel/' || (l_partkey % 5000) link, false is_listing from lineitem"


@query("bfs_discover", f"""
    with recursive e as ({EDGES}), b as (
        select 'https://s.example.com/novel/1' url, 0 depth
        union select e.link, b.depth + 1 from b join e on b.url = e.url where b.depth < 2)
    select url, cast(min(depth) as integer) depth, regexp_extract(url, '([^/]*)$', 1) slug from b group by url""")
def bfs_discover(spark, sf_dir):
    base = F.lit("https://s.example.com/novel/")
    links = raw(spark, sf_dir, "lineitem").select(F.concat(base, F.col("l_orderkey").cast("string")).alias("url"), F.concat(base, (F.col("l_partkey") % 5000).cast("string")).alias("link"), F.lit(False).alias("is_listing"))
    seeds = spark.range(1).select(F.concat(base, F.lit("1")).alias("url"), F.lit("homepage").alias("source"))
    return discover.discover(seeds, links).select("url", "depth", "slug")


@query("probe_confidence", """
    select o_custkey site, count(*) novels, case when o_custkey % 5 = 0 then 'none' when count(*) >= 3 then 'high' else 'medium' end confidence from orders group by o_custkey""")
def probe_confidence(spark, sf_dir):
    o = raw(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("site")).agg(F.count("*").alias("novels"))
    tier = F.when(F.col("site") % 5 != 0, 1)
    return o.select("site", "novels", discover.probe_confidence(tier, F.col("novels")).alias("confidence"))


# -- streaming --------------------------------------------------------------------


@query("streaming_ingest", "select user_id source_title_id, event_type field_name, md5(props) claim_hash, min(event_id) id from events group by 1, 2, 3")
def streaming_ingest(spark, sf_dir):
    """The events table through the streaming writer, which handles what is there and stops."""
    from libretto.streaming.ingest import stream_claims

    root = _shared(spark)
    schema = raw(spark, sf_dir, "events").schema
    keys = ("source_title_id", "field_name", "claim_hash")
    claims = lambda e: e.select(F.col("user_id").alias("source_title_id"), F.col("event_type").alias("field_name"), F.md5("props").alias("claim_hash"), F.col("event_id").alias("id"))
    stream_claims(spark, f"{sf_dir}/events*.parquet", schema, f"{root}/claims", f"{root}/checkpoint", claims, keys).awaitTermination()
    return spark.read.parquet(f"{root}/claims").drop("part")


def _shared(spark: SparkSession) -> str:
    """A fresh folder that all executors reach."""
    return fresh(spark, "stream")


from libretto import composites, requests, stateful  # noqa: E402, F401  (they register their queries)
