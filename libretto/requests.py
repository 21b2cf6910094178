"""Queries that answer many requests at once: indexed search, deep pages, nearest chapters, similar works."""

from __future__ import annotations

from pyspark.sql import functions as F

from libretto.fixtures import domain, raw
from libretto.operators import bulk, serve
from libretto.operators.search_index import TextIndex
from libretto.queries import CARD_TABLES, CARDS, SORTS, TERMS, query

#: Patterns of nine kinds from the names of nations: whole, few letters, with wildcards, of digits, empty, null, and ones that nothing is like.
EACH = "explode(array(0, 1, 2, 3, 4, 5, 6, 7, 8))"
PATTERNS = f"""
    select n_nationkey * 9 + k request, case k when 0 then n_name when 1 then lower(left(n_name, 2)) when 2 then substring(n_name, 3, 1)
        when 3 then concat(left(n_name, 3), '%', right(n_name, 2)) when 4 then concat(left(n_name, 1), '_', lower(substring(n_name, 3, 3)))
        when 5 then cast(100 + n_nationkey * 7 as string) when 6 then case when n_nationkey = 0 then '' else concat('%', n_name) end
        when 7 then cast(null as string) else concat(n_name, ' nowhere') end pattern
    from (select *, {EACH} k from nation)"""


@query("search_indexed", f"""
    with asked as ({PATTERNS.replace(EACH, "unnest([0, 1, 2, 3, 4, 5, 6, 7, 8])")})
    select request, id from asked join works on title ilike '%' || pattern || '%' or synopsis ilike '%' || pattern || '%'""", ("works",))
def search_indexed(spark, sf_dir):
    """Substring search for 225 patterns through the index of titles and synopses."""
    index = TextIndex.build(domain(spark, sf_dir, "works")["works"])
    return index.search(spark.sql(PATTERNS.replace("from nation", "from {nation}"), nation=raw(spark, sf_dir, "nation")))


@query("search_indexed_page", f"with {CARDS} select * from cards where (title ilike '%09%' or synopsis ilike '%09%') and status = 'completed' order by {SORTS['az']} limit 24", CARD_TABLES)
def search_indexed_page(spark, sf_dir):
    t = domain(spark, sf_dir, *CARD_TABLES)
    return serve.search(t, q="09", status="completed", sort="az", size=24, index=TextIndex.build(t["works"]))


@query("catalog_deep_pages", f"""
    with {CARDS}, c as (select greatest(1, cast(ceil(count(*) / 7.0) as bigint)) pages from cards),
    placed as (select id, title, row_number() over (order by {SORTS['popular']}) r from cards)
    select p page, r place, id, title from placed, (select unnest([1, (pages + 1) // 2, pages, pages + 1]) p from c) where r > (p - 1) * 7 and r <= p * 7""", CARD_TABLES)
def catalog_deep_pages(spark, sf_dir):
    """The first, the middle, the last page and the one behind it, through the rank directory."""
    ranked = bulk.RankedPages.build(serve.cards(domain(spark, sf_dir, *CARD_TABLES)), serve.orders()["popular"], block_rows=500)
    pages = max(1, -(-ranked.total() // 7))
    out = None
    for p in (1, (pages + 1) // 2, pages, pages + 1):
        # a page is seven rows: numbering them takes one small window
        rows = ranked.page(p, 7).select(F.lit(p).cast("long").alias("page"), (F.row_number().over(bulk.Window.orderBy(*serve.orders()["popular"])) + (p - 1) * 7).cast("long").alias("place"), "id", "title")
        out = rows if out is None else out.unionAll(rows)
    return out


ASKED = "select o_orderkey request, cast(o_custkey as string) work_id, case when o_orderkey % 11 = 0 then cast(null as double) else o_orderkey % 9 - 0.5 * (o_orderkey % 2) end target from orders"


@query("nearest_chapters", f"""
    with asked as ({ASKED}), c as (select c.id, chapter_number, work_id from version_chapters c join versions v on c.version_id = v.id)
    select request, a.work_id, cast(target as double) target, chapter_number, id from asked a join c on a.work_id = c.work_id where target is not null
    qualify row_number() over (partition by request order by abs(chapter_number - target), chapter_number, id) = 1""", ("versions", "version_chapters"))
def nearest_chapters(spark, sf_dir):
    """The chapter nearest to a number, for a request of every order."""
    t = domain(spark, sf_dir, "versions", "version_chapters")
    chapters = t["version_chapters"].join(t["versions"].select(F.col("id").alias("version_id"), "work_id"), "version_id")
    return bulk.nearest_many(chapters, spark.sql(ASKED.replace("from orders", "from {orders}"), orders=raw(spark, sf_dir, "orders")))


@query("similar_all", f"""
    with {CARDS}, {TERMS},
    said as (select distinct work_id, lower(coalesce(nullif(normalised_value, ''), raw_value)) said from owned where field_name in ('tags', 'genres')),
    held as (select term, said from (select distinct term from terms) t join (select distinct said from said) s on contains(said, term)),
    met as (select distinct t.work_id, s.work_id similar_id from terms t join held using (term) join said s using (said) where t.work_id <> s.work_id)
    select m.work_id, cast(row_number() over (partition by m.work_id order by updated_at desc nulls last, similar_id) as integer) place, similar_id
    from met m join works w on w.id = similar_id qualify place <= 12""", CARD_TABLES)
def similar_all(spark, sf_dir):
    """The twelve similar works of every work."""
    return bulk.similar_all(domain(spark, sf_dir, *CARD_TABLES))
