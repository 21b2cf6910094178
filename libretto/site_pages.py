"""A small page of each kind for every site, and what a reader of the page would write down.

Slots: {k} the key, {n} the title, {b} the author, {c} the number of a chapter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from libretto.fixtures import raw, spread

MADARA_TITLE = '<div class="post-title"><h1>{n}</h1></div><div class="author-content"><a href="/a">{b}</a></div><div class="post-content_item"><div class="summary-heading">Status</div><div class="summary-content">Completed</div></div>'
MADARA_ROW = '<li class="wp-manga-chapter"><a href="{base}/novel/b{k}/chapter-{c}/">Chapter {c}</a></li>'
MADARA_BODY = '<h1>Chapter {c}</h1><div class="reading-content"><div class="text-left"><p>Text of {n}</p></div></div>'
FULL_TITLE = '<h3 class="title">{n}</h3><div class="info"><a href="/author/x">{b}</a><a href="/status/y">Completed</a></div>'
FULL_BODY = '<h2>Chapter {c}</h2><div id="chr-content"><p>Text of {n}</p></div>'

#: key, base, title address, source id, title page, has an author, status, list around {rows}, row, chapter address, chapter id, chapter page.
PAGES = (
    ("boxnovel", "https://boxnovel.com", "/novel/b{k}/", "b{k}", MADARA_TITLE, True, "completed", "<ul>{rows}</ul>", MADARA_ROW, "/novel/b{k}/chapter-{c}/", "chapter-{c}", MADARA_BODY),
    ("foxaholic", "https://foxaholic.com", "/manga/b{k}/", "b{k}", MADARA_TITLE, True, "completed", "<ul>{rows}</ul>", MADARA_ROW, "/novel/b{k}/chapter-{c}/", "chapter-{c}", MADARA_BODY),
    ("novelbuddy", "https://novelbuddy.com", "/novel/b{k}", "b{k}", MADARA_TITLE, True, "completed", "<ul>{rows}</ul>", MADARA_ROW, "/novel/b{k}/chapter-{c}/", "chapter-{c}", MADARA_BODY),
    ("novelfire", "https://novelfire.net", "/novel/b{k}", "b{k}", MADARA_TITLE, True, "completed", "<ul>{rows}</ul>", MADARA_ROW, "/novel/b{k}/chapter-{c}/", "chapter-{c}", MADARA_BODY),
    ("novelfull", "https://novelfull.com", "/b{k}.html", "b{k}", FULL_TITLE, True, "completed", '<ul class="list-chapter">{rows}</ul>', '<li><a href="/b{k}/chapter-{c}.html">Chapter {c}</a></li>', "/b{k}/chapter-{c}.html", "chapter-{c}.html", '<h2>Chapter {c}</h2><div id="chapter-content"><p>Text of {n}</p></div>'),
    ("novelbin", "https://novelbin.com", "/b/b{k}", "b{k}", FULL_TITLE, True, "completed", '<ul id="list-chapter">{rows}</ul>', '<li><a href="/b/b{k}/chapter-{c}">Chapter {c}</a></li>', "/b/b{k}/chapter-{c}", "chapter-{c}", FULL_BODY),
    ("readnovelfull", "https://readnovelfull.com", "/b{k}.html", "b{k}", '<h3 class="title">{n}</h3><ul class="info"><li>x</li><li><a href="/u">{b}</a></li></ul><div class="info"><a href="/status/y">Completed</a></div>', True, "completed", '<ul class="list-chapter">{rows}</ul>', '<li><a href="/b{k}/chapter-{c}.html">Chapter {c}</a></li>', "/b{k}/chapter-{c}.html", "chapter-{c}.html", FULL_BODY),
    ("archiveofourown", "https://archiveofourown.org", "/works/{k}", "{k}", '<h2 class="heading">{n}</h2><a rel="author" href="/u">{b}</a><dl class="stats"><dt>Status</dt><dd>Completed: 2020-01-01</dd></dl>', True, "completed", '<ol class="chapter">{rows}</ol>', '<li><a href="/works/{k}/chapters/{k}{c}">Chapter {c}</a></li>', "/works/{k}/chapters/{k}{c}", "{k}{c}", '<div id="chapters"><h3 class="title">Chapter {c}</h3></div><div id="chapters"><p>never</p></div>'),
    ("chrysanthemumgarden", "https://chrysanthemumgarden.com", "/novel/b{k}/", "b{k}", '<h1 class="novel-title">{n}</h1><ul class="novel-info"><li>Author: {b}</li></ul><p class="status">Completed</p>', True, "completed", "<div>{rows}</div>", '<div class="chapter-item"><a href="/novel/b{k}/c-{c}/">Chapter {c}</a></div>', "/novel/b{k}/c-{c}/", "c-{c}", '<h1>Chapter {c}</h1><div id="novel-content"><p>Text of {n}<span class="jum">junk</span></p></div>'),
    ("creativenovels", "https://creativenovels.com", "/novel/b{k}/", "b{k}", '<head><title>{n} – Site | Shop</title></head><div class="author"><a href="/u">{b}</a></div><p class="status">Completed</p>', True, "completed", '<div class="chapter-listing">{rows}</div>', '<a href="/novel/b{k}/c-{c}/">Chapter {c}</a>', "/novel/b{k}/c-{c}/", "c-{c}", '<h1>Chapter {c}</h1><article><div class="entry-content"><p>Text of {n}</p></div></article>'),
    ("fanfiction", "https://www.fanfiction.net", "/s/{k}/1/x", "{k}", '<div id="profile_top"><b>{n}</b><a href="/u/1/x">{b}</a></div>', True, None, '<select id="chap_select">{rows}</select>', '<option value="{c}">Chapter {c}</option>', "/s/{k}/{c}/", "{c}", '<select id="chap_select"><option value="9">Chapter 9</option><option value="{c}" selected>Chapter {c}</option></select><div class="storytext"><p>Text of {n}</p></div>'),
    ("fimfiction", "https://www.fimfiction.net", "/story/{k}/x", "{k}", '<a class="story_name" href="/">{n}</a><div class="info-container"><a href="/user/1">{b}</a></div><span class="story_status">Incomplete</span>', True, "ongoing", '<ul class="chapters">{rows}</ul>', '<li><a class="chapter-title" href="/chapter/{k}{c}/x">Chapter {c}</a></li>', "/chapter/{k}{c}/x", "{k}{c}", '<h1 class="chapter-title">Chapter {c}<div style="float:right">tools</div></h1><div id="chapter"><p>Text of {n}</p></div>'),
    ("freewebnovel", "https://freewebnovel.com", "/b{k}.html", "b{k}", '<div class="m-desc"><h1 class="tit">{n}</h1><div class="txt"><span>Completed</span></div></div><div class="m-imgtxt"><a href="/authors/x">{b}</a></div>', True, "completed", '<ul id="idData">{rows}</ul>', '<li><a href="/b{k}/chapter-{c}.html">Chapter {c}</a></li>', "/b{k}/chapter-{c}.html", "chapter-{c}.html", '<h1>Chapter {c}</h1><div class="m-read"><div class="txt"><p>Text of {n}</p></div></div>'),
    ("hostednovel", "https://hostednovel.com", "/novels/b{k}", "b{k}", '<h1>{n}</h1><section aria-labelledby="novel-details-heading"><dl><dt>Author</dt><dd>{b}</dd><dt>Status</dt><dd>Completed</dd></dl></section>', True, "completed", '<div id="chapters"><ul role="list">{rows}</ul></div>', '<li><a href="/novel/b{k}/chapter-{c}">Chapter {c}</a></li>', "/novel/b{k}/chapter-{c}", "chapter-{c}", '<h1>Chapter {c}</h1><div class="chapter"><p>Text of {n}</p></div>'),
    ("lightnovelworld", "https://www.lightnovelworld.com", "/novel/b{k}", "b{k}", '<ul><li class="text1">{n}<span>NEW</span></li></ul><span class="textC999">{b}</span><p class="status">Completed</p>', True, "completed", '<div id="chapter_content"><ul>{rows}</ul></div>', '<li><a href="/novel/b{k}/chapter-{c}">Chapter {c}</a></li>', "/novel/b{k}/chapter-{c}", "chapter-{c}", '<h1>Chapter {c}</h1><div id="content_detail"><p>Text of {n}</p><div class="chapter-nav">next</div></div>'),
    ("novelhall", "https://www.novelhall.com", "/novel/{k}.html", "{k}", '<div class="book-info"><h1>{n}</h1></div><div class="booktag"><b>Author</b><span class="blue">{b}</span><b>Status</b><span class="blue">Completed</span></div>', True, "completed", '<div id="morelist" class="book-catalog"><ul>{rows}</ul></div>', '<li><a href="/b{k}/{c}.html">Chapter {c}</a></li>', "/b{k}/{c}.html", "{c}.html", '<h1>Chapter {c}</h1><div id="htmlContent" class="entry-content"><p>Text of {n}</p></div>'),
    ("ranobes", "https://ranobes.net", "/novels/{k}-x.html", "{k}", '<h1 class="title">{n}</h1><div class="tag_list"><a href="/authors/x">{b}</a></div><div class="r-fullstory-pageinfo"><span>Completed</span></div>', True, "completed", "<div>{rows}</div>", '<div class="cat_line"><a href="/read/{k}{c}.html">Chapter {c}</a></div>', "/read/{k}{c}.html", "{k}{c}.html", '<h1>Chapter {c}</h1><div id="arrticle"><p>Text of {n}</p></div>'),
    ("relibrary", "https://re-library.com", "/translations/b{k}/", "b{k}", '<h1 class="entry-title">{n}</h1><a href="/nauthor/x/">{b}</a>', True, None, '<ul>{rows}<li class="page_item"><a href="https://elsewhere.org/x">Chapter 9</a></li></ul>', '<li class="page_item"><a href="https://re-library.com/translations/b{k}/c-{c}/">Chapter {c}</a></li>', "/translations/b{k}/c-{c}/", "c-{c}", '<h1 class="entry-title">Chapter {c}</h1><div class="entry-content"><p>Text of {n}</p><div class="sharedaddy">share</div></div>'),
    ("royalroad", "https://www.royalroad.com", "/fiction/{k}/x", "{k}", '<h1 class="font-white">{n}</h1><span property="name">{b}</span><span class="label">ORIGINAL</span><span class="label">COMPLETE</span>', True, "completed", '<table id="chapters"><tbody>{rows}</tbody></table>', '<tr><td><a href="/fiction/{k}/x/chapter/{k}{c}/y">Chapter {c}</a></td></tr>', "/fiction/{k}/x/chapter/{k}{c}/y", "{k}{c}", '<h1>Chapter {c}</h1><div class="chapter-content"><p>Text of {n}</p></div>'),
    ("scribblehub", "https://www.scribblehub.com", "/series/{k}/x/", "{k}", '<div class="fic_title">{n}</div><span class="auth_name_fic">{b}</span><span class="fic_state">Completed</span>', True, "completed", '<ol class="toc_ol">{rows}</ol>', '<li><a class="toc_a" href="https://www.scribblehub.com/read/{k}/chapter/{k}{c}/">Chapter {c}</a></li>', "/read/{k}/chapter/{k}{c}/", "{k}{c}", '<div class="chapter-title">Chapter {c}</div><div id="chp_raw"><p>Text of {n}</p></div>'),
    ("tapas", "https://tapas.io", "/series/b{k}", "b{k}", '<meta property="og:title" content="{n}"><div class="creator"><a href="/u">{b}</a></div>', True, None, "<ul>{rows}</ul>", '<li class="episode__item"><a href="/episode/{k}{c}">Chapter {c}</a></li>', "/episode/{k}{c}", "{k}{c}", '<h1>Chapter {c}</h1><div class="viewer-content"><p>Text of {n}</p></div>'),
    ("wanderinginn", "https://wanderinginn.com", "/table-of-contents/{k}", "wanderinginn", '<meta property="og:site_name" content="{n}">', False, None, '<div id="table-of-contents">{rows}</div>', '<a href="https://wanderinginn.com/2020/{k}/c-{c}/">Chapter {c}</a>', "/2020/{k}/c-{c}/", "c-{c}", '<h1 class="entry-title">Chapter {c}</h1><div class="entry-content"><p>Text of {n}</p><nav>next</nav></div>'),
    ("wattpad", "https://www.wattpad.com", "/story/{k}-x", "{k}", '<h1>{n}</h1><a href="/user/x">{b}</a>', True, None, '<ul class="table-of-contents">{rows}</ul>', '<li><a href="/{k}{c}-x">Chapter {c}</a></li>', "/{k}{c}-x", "{k}{c}", '<h1 class="h2">Chapter {c}</h1><p data-p-id="1">Text of {n}</p><p>never</p>'),
    ("webnovel", "https://www.webnovel.com", "/book/x_{k}", "{k}", '<meta property="og:title" content="{n}"><address><a href="/p">{b}</a></address><span class="tag-status">Completed</span>', True, "completed", '<ol class="j_catalog_list">{rows}</ol>', '<li><a href="/book/x_{k}/{k}{c}">Chapter {c}</a></li>', "/book/x_{k}/{k}{c}", "{k}{c}", '<h1>Chapter {c}</h1><div class="chapter-content"><p>Text of {n}</p></div>'),
    ("wuxiacity", "https://wuxia.city", "/book/b{k}", "b{k}", '<h1 class="book-name">{n}</h1><dl class="author"><dt>By</dt><dd>{b}</dd></dl><p class="status">Completed</p>', True, "completed", '<ul class="chapters">{rows}</ul>', '<li class="oneline"><a href="/book/b{k}/c-{c}">Chapter {c}</a></li>', "/book/b{k}/c-{c}", "c-{c}", '<h1>Chapter {c}</h1><div class="chapter-text"><p>Text of {n}</p></div>'),
    ("wuxiaworld", "https://www.wuxiaworld.com", "/novel/b{k}", "b{k}", '<h1 class="novel-name">{n}</h1><p class="author"><span>{b}</span></p><ul class="novel-info"><li>Status <b>:</b><span>Completed</span></li></ul>', True, "completed", "<div>{rows}{rows}</div>", '<a href="/novel/b{k}/chapter-{c}">Chapter {c}</a>', "/novel/b{k}/chapter-{c}", "chapter-{c}", '<h4 class="chapter-title">Chapter {c}</h4><div class="fr-view"><p>Text of {n}</p></div>'),
)
COLUMNS = ("site_key", "base", "address", "source_id", "title_page", "has_author", "status", "around", "row", "chapter", "chapter_id", "chapter_page")
#: Sites whose lists come with the last chapter first.
NEWEST_FIRST = ("boxnovel", "foxaholic", "novelbuddy", "novelfire", "scribblehub")


def _filled(template: str, c: int | None = None) -> Column:
    name = F.regexp_replace("p_name", " ", " &amp; ") if template.endswith("_page") else F.col("p_name")
    x = F.replace(F.replace(F.replace(F.col(template), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{n}"), name), F.lit("{b}"), F.col("p_brand"))
    return F.replace(F.replace(x, F.lit("{c}"), F.lit(str(c))) if c else x, F.lit("{base}"), F.col("base"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with the templates of one site, in turn; the sites are 26 rows."""
    rows = [(k, *r) for k, r in enumerate(PAGES)]
    kinds = ", ".join(f"{c} {'boolean' if c == 'has_author' else 'string'}" for c in COLUMNS)
    sites = F.broadcast(spark.createDataFrame(rows, f"site int, {kinds}"))
    # dealt as parts, which are smaller than their pages
    return spread(raw(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")).join(sites, F.col("p_partkey") % len(PAGES) == F.col("site"))


def title_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("site_key", F.concat("base", _filled("address")).alias("url"), _filled("title_page").alias("html"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _filled("row", 1), _filled("row", 2)
    rows = F.when(F.col("site_key").isin(*NEWEST_FIRST), F.concat(two, one)).otherwise(F.concat(one, two))
    return _parts(spark, sf_dir).select("site_key", F.concat("base", _filled("address")).alias("url"), F.replace("around", F.lit("{rows}"), rows).alias("html"))


def chapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("site_key", F.concat("base", _filled("chapter", 1)).alias("url"), _filled("chapter_page", 1).alias("html"))


def _sql(x: str | bool | None) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"


#: What is to be found, as SQL: the templates' answers, never the pages.
ANSWERS = "sites(site, site_key, base, address, source_id, has_author, status, chapter, chapter_id) as (values " + ", ".join(
    "(" + ", ".join(map(_sql, (r[0], r[1], r[2], r[3], r[5], r[6], r[9], r[10]))).join((f"{k}, ", ")")) for k, r in enumerate(PAGES)
) + f"), p as (select * from part join sites on p_partkey % {len(PAGES)} = site)"


def filled_sql(x: str, c: str = "''") -> str:
    return f"replace(replace({x}, '{{k}}', cast(p_partkey as varchar)), '{{c}}', {c})"
