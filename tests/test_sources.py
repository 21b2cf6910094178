"""Extraction by site spec, the registry, discovery and image headers."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from libretto import site_pages
from libretto.plans import jobs
from libretto.sources import discover, extract, images, sites
from libretto.sources.dom import parse

TITLE_PAGE = """<html><h1 class="font-white">My Fiction</h1><span property="name">An Author</span><div class="description"><div class="description-content"><p>Line one.</p><p>Line two.</p></div></div>
<span class="label">ORIGINAL</span><span class="label">STUB</span><a class="label" href="/tag/x?genre=1">Drama</a><a class="label" href="/x?tag=m">Magic</a><img class="thumbnail" src="/c.jpg">
<table id="chapters"><tbody><tr><td><a href="/fiction/12/my/chapter/100/one">Chapter 1: One</a></td><td><time datetime="2024-01-01">x</time></td></tr>
<tr><td><a href="/fiction/12/my/chapter/101/two">Two</a></td></tr></tbody></table></html>"""
CHAPTER_PAGE = "<h1>Chapter 7: Seven</h1><div class='chapter-content'><p>A &amp; B</p><p>C</p></div>"
URL = "https://www.royalroad.com/fiction/12/my"


def test_selectors():
    page = parse("<div class='a b'><ul id=x><li><a href='/c/1'>One<li><a href=/c/2 title=t>Two</a></ul></div><p>z<p>y")
    assert [n.text() for n in page.select("div.a li > a:not([title])")] == ["One"]
    assert [n.text() for n in page.select("#x li:nth-of-type(2), p")] == ["Two", "z", "y"]
    assert page.first("a[href$='2']").attr("title") == "t" and page.first("q") is None
    assert parse(None).select("p") == []


def test_title_record():
    r = extract.title_record(sites.get_site("royalroad"), URL, TITLE_PAGE)
    assert (r["source_id"], r["title"], r["author"], r["status"], r["genres"], r["tags"], r["total_chapters"]) == ("12", "My Fiction", "An Author", "dropped", ["Drama"], ["Magic"], 2)
    assert r["synopsis"] == "Line one.\nLine two." and r["cover_url"] == "https://www.royalroad.com/c.jpg"


def test_listing_and_content():
    rows = extract.listing_records(sites.get_site("royalroad"), URL, TITLE_PAGE)
    assert [(r["source_chapter_id"], r["chapter_number"], r["release_date"]) for r in rows] == [("100", 1.0, "2024-01-01"), ("101", 2.0, None)]
    c = extract.content_record(sites.get_site("royalroad"), URL + "/chapter/100/x", CHAPTER_PAGE)
    assert c["chapter_number"] == 7.0 and c["source_chapter_id"] == "100" and "<p>C</p>" in c["raw_content"]
    assert extract.content_record(sites.get_site("royalroad"), URL, "<p>none</p>")["raw_content"] == ""


def test_site_deltas():
    madara = "<ul><li class='wp-manga-chapter'><a href='/novel/x/chapter-2/'>Chapter 2</a><li class='wp-manga-chapter'><a href='/novel/x/chapter-1/'>Chapter 1</a></ul><div class='post-content_item'><div class='summary-heading'>Status</div><div class='summary-content'>OnGoing</div></div>"
    assert [r["chapter_number"] for r in extract.listing_records(sites.get_site("boxnovel"), "u", madara)] == [1.0, 2.0]
    ao3 = "<dl class='stats'><dt>Status</dt><dd>Completed: 2020</dd></dl><dd class='chapters'>3/12</dd>"
    r = extract.title_record(sites.get_site("archiveofourown"), "https://archiveofourown.org/works/5", ao3)
    assert (r["status"], r["total_chapters"], r["source_id"]) == ("completed", 12, "5")
    ff = "<select id=chap_select><option value=1>1. A<option value=2 selected>2. B</select>"
    assert [c["source_url"] for c in extract.listing_records(sites.get_site("fanfiction"), "https://www.fanfiction.net/s/9/1/x", ff)] == ["https://www.fanfiction.net/s/9/1/", "https://www.fanfiction.net/s/9/2/"]
    ww = "<a href='/novel/a/chapter-1'>Chapter 1</a><a href='/x/chapter-1'>again</a><ul class='novel-info'><li>Translated by: Me</li></ul>"
    assert len(extract.listing_records(sites.get_site("wuxiaworld"), "u", ww)) == 1
    assert extract.title_record(sites.get_site("wuxiaworld"), "u", ww)["translator_group"] == "Me"
    ranobes = "<h1>T</h1><script>window.__DATA__ = " + json.dumps({"description": "", "summary": "S"}) + ";</script>"
    assert extract.title_record(sites.get_site("ranobes"), "u", ranobes)["synopsis"] == "S"
    assert extract.title_record(sites.get_site("creativenovels"), "u", "<head><title>My Book – Site | X</title></head>")["title"] == "My Book"
    assert extract.title_record(sites.get_site("relibrary"), "u", f"<div class='entry-content'>{'x' * 1200}</div>")["synopsis"] == "x" * 1000 + "…"


def test_extract_tables(spark):
    pages = spark.createDataFrame([("royalroad", URL, TITLE_PAGE), ("nowhere", "u", "<p>"), ("royalroad", "v", None), (None, "w", "x")], "site string, url string, html string")
    assert extract.extract_titles(pages, F.col("site")).count() == 1
    assert extract.extract_listings(pages, F.col("site")).count() == 2
    assert extract.extract_contents(pages.limit(0), "royalroad").count() == 0
    row = spark.createDataFrame([("x", '{"parts":[{"id":1,"title":"a","url":"u","free":true},{"id":2,"title":"b","url":"v","free":false}]}')], "url string, body string")
    assert [r["source_chapter_id"] for r in extract.json_parts(row).collect()] == ["1"]
    doc = spark.createDataFrame([('window.__DATA__ = {"summary":"S"};',), ("none",)], "h string")
    assert [r[0] for r in doc.select(extract.embedded_json(F.col("h"), "description", "summary")).collect()] == ["S", None]


def test_registry(spark):
    with pytest.raises(ValueError):
        sites.register(sites.get_site("tapas"))
    with pytest.raises(KeyError):
        sites.get_site("nowhere")
    copy = sites.list_sites()
    copy.clear()
    assert len(sites.list_sites()) == 26 and sites.sites_table(spark).count() == 26
    failed = []
    sites.autodiscover("libretto.sources", lambda name, e: failed.append(name))
    assert failed == []


def test_next_page():
    assert extract.next_page("<a rel='next' href='/2'>x</a>", "https://a.com") == "https://a.com/2"
    assert extract.next_page("<a href='#'>Next</a><a href='/3'>»</a>", "https://a.com") == "https://a.com/3"
    assert extract.next_page("<a href='/4'>other</a>", "https://a.com") is None


def test_discovery(spark):
    html = lambda *links: "".join(f'<a href="{x}">x</a>' for x in links)
    pages = spark.createDataFrame([("https://s.com", html("/browse", "/novel/a?x=1")), ("https://s.com/browse", html("/novel/b", "/novel/a")), ("https://s.com/novel/b", html("/novel/c")), ("https://s.com/novel/c", html("/novel/d"))], "url string, html string")
    links = discover.page_links(pages)
    seeds = spark.createDataFrame([("https://s.com", "homepage")], "url string, source string")
    found = {r["url"]: (r["depth"], r["source"], r["slug"]) for r in discover.discover(seeds, links).collect()}
    assert found == {"https://s.com/novel/a": (1, "homepage", "a"), "https://s.com/novel/b": (2, "listing", "b")}
    assert discover.discover(seeds, links, max_novels=1).count() == 1
    probes = spark.createDataFrame([("u", 1, 403, None), ("u", 2, 200, "/novel/x"), ("u", 3, 200, "/novel/x"), ("v", 1, 200, "nothing")], "url string, tier int, status int, text string")
    assert {r["url"]: r["tier"] for r in discover.detect_tier(probes).collect()} == {"u": 2, "v": None}
    voted = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1), ("d", 2), ("e", None)], "url string, tier int")
    assert discover.vote_tier(voted).first().asDict() == {"tier": 2, "votes": 2, "candidates_checked": 5}
    chain = spark.createDataFrame([("p1", "h", "p2"), ("p2", "h", "p3"), ("p3", "h", "p1")], "url string, html string, next_url string")
    got = discover.paginate(chain, spark.createDataFrame([("p1",)], "url string"))
    assert [r["url"] for r in got.orderBy("page").collect()] == ["p1", "p2", "p3"]


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 300, 450)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 450, 300) + b"\0" * 12
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (299).to_bytes(3, "little") + (449).to_bytes(3, "little")
    assert [images.inspect(x) for x in (png, jpeg, webp, b"", None, b"x")] == [("png", 300, 450), ("jpeg", 300, 450), ("webp", 300, 450), (None,) * 3, (None,) * 3, (None,) * 3]
    (tmp_path / "a.png").write_bytes(png)
    r = images.read_covers(spark, str(tmp_path)).first()
    assert (r["image_format"], r["width"], r["quality_score"]) == ("png", 300, 0.86)


def test_markup_of_text_stays_text():
    page = parse("<div class='chapter-content' title='a &quot;b&quot;'><p>1 &lt; 2 &amp;amp; &lt;b&gt;no tag&lt;/b&gt;</p><style>p > a {}</style></div>")
    assert page.first("div").html() == '<div class="chapter-content" title="a &quot;b&quot;"><p>1 &lt; 2 &amp;amp; &lt;b&gt;no tag&lt;/b&gt;</p><style>p > a {}</style></div>'


def test_long_lists_end(spark):
    """Lists of thirty pages, one that bites its tail, and the limit."""
    rows = [(f"a{k}", "h", f"a{k + 1}" if k < 29 else None) for k in range(30)] + [("b0", "h", "b1"), ("b1", "h", "b0")]
    pages = spark.createDataFrame(rows, "url string, html string, next_url string")
    first = spark.createDataFrame([("a0",), ("b0",), ("gone",)], "url string")
    got = [(r["start"], r["page"], r["url"]) for r in discover.paginate(pages, first).collect()]
    assert sorted(got) == sorted([("a0", k + 1, f"a{k}") for k in range(30)] + [("b0", 1, "b0"), ("b0", 2, "b1")])
    assert discover.paginate(pages, first, limit=3).count() == 5
    assert discover.paginate(pages, first.limit(0)).count() == 0


def test_pages_are_dealt_over_all_tasks(spark, sf):
    """A table of parts is one small file; its pages, which take long to read, are not left to one task."""
    from libretto import queries
    from libretto import composites, site_pages  # isort: skip

    many = spark.sparkContext.defaultParallelism
    made = [f(spark, sf) for f in (queries.part_pages, site_pages.title_pages, site_pages.listing_pages, site_pages.chapter_pages)]
    for pages in (*made, *composites.fetched(spark, sf)):
        total, sizes = pages.count(), [r["count"] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= many and max(sizes) <= total / many


def test_pages_of_both_kinds_are_parsed_once(spark, sf, monkeypatch):
    # title, list and what the title's rules take out in one page of each site
    titles, lists = site_pages.title_pages(spark, sf), site_pages.listing_pages(spark, sf)
    pages = titles.join(lists.select("url", F.col("html").alias("more")), "url").select("site_key", "url", F.concat("html", "more").alias("html")).limit(60).localCheckpoint()
    both = extract.extract_titles_listed(pages, F.col("site_key"))
    assert sorted(both.drop("chapters").collect(), key=str) == sorted(extract.extract_titles(pages, F.col("site_key")).collect(), key=str)
    listed = both.select("site_key", "page_url", F.explode("chapters").alias("c")).select("site_key", "page_url", "c.*").collect()
    assert sorted(listed, key=str) == sorted(extract.extract_listings(pages, F.col("site_key")).collect(), key=str) and len(listed) > 60
    # the cycle reads such pages by no other way
    for name in ("extract_titles", "extract_listings"):
        monkeypatch.setattr(jobs, name, lambda *a: 1 / 0)
    same = pages.limit(3).localCheckpoint()
    t = jobs.ingest_cycle(jobs.new_tables(spark), same, same, same.limit(0), F.lit("2026-01-01").cast("timestamp"))
    assert t["source_titles"].count() == 3
