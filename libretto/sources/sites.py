"""What is known of each site, declared: where its pages keep which field."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Rule:
    """How one value is found. ``kind``:

    text, inner (pieces on lines), attr: of the first match of ``select``;
    label: of the first match whose text holds ``word``, what follows the colon;
    after: the next sibling of the first match whose text holds ``word``;
    beside: the first match whose previous sibling's text holds ``word``;
    within: below the first match whose text holds ``word``, the first ``inner_select``;
    listed: the first match whose lower-case text is one of, or with ``partly`` holds one of, ``words``;
    json: the first of ``names`` in the object assigned to window.__DATA__.
    """

    kind: str
    select: str = ""
    names: tuple[str, ...] = ()
    word: str = ""
    inner_select: str = ""
    words: tuple[str, ...] = ()
    partly: bool = False


def text(select: str) -> Rule:
    return Rule("text", select)


def inner(select: str) -> Rule:
    return Rule("inner", select)


def attr(select: str, *names: str) -> Rule:
    return Rule("attr", select, names)


def og(name: str) -> Rule:
    return attr(f"meta[property='og:{name}']", "content")


def cover(select: str) -> tuple[Rule, ...]:
    return tuple(attr(s.strip(), "src", "data-src", "data-lazy-src", "data-original") for s in select.split("|"))


@dataclass(frozen=True)
class SiteSpec:
    key: str
    name: str
    base_url: str
    rate: float = 1.0
    #: Pattern of the source id in an address, and what stands in if it does not match: the address or its last segment.
    id_pattern: str | None = None
    id_constant: str | None = None
    id_fallback: str = "url"
    fields: dict[str, tuple[Rule, ...]] = field(default_factory=dict)
    genres: str = ""
    tags: str = ""
    split_tags: tuple[str, str] | None = None
    total: Rule | None = None
    total_pattern: str = r"(\d[\d,]*)"
    total_rows: str = ""
    language: str = "en"
    original_language: str | None = None
    #: "map" (unknown is null), "loose" (unknown passes through), or the words of each status.
    status: str = "map"
    status_overrides: dict[str, str] = field(default_factory=dict)
    status_words: tuple[tuple[str, tuple[str, ...]], ...] = ()
    chapters: str = ""
    chapter_rows: str = ""
    chapter_date: str = ""
    chapter_id: str | None = None
    option_list: str = ""
    chapter_order: str = ""
    unique_chapters: bool = False
    own_host: bool = False
    number_patterns: tuple[str, ...] | None = None
    number_from_url: bool = True
    chapter_title: tuple[str, ...] = ("h1, .chapter-title",)
    content: tuple[str, ...] = (".chapter-content",)
    content_drop: str = ""
    title_drop: str = ""
    synopsis_drop: str = ""
    synopsis_limit: int = 0
    title_cut: tuple[str, ...] = ()
    lazy_images: bool = False
    content_parts: str = ""


#: Templates that several sites follow.
MADARA = SiteSpec(
    "", "", "",
    id_pattern=r"/(?:novel|manga)/([^/?#]+)", id_fallback="segment", original_language="zh",
    fields={
        "title": (text("div.post-title h1, h1.post-title"),),
        "cover_url": cover("div.summary_image img, .summary_image img"),
        "author": (text("div.author-content a, .author-content a"),),
        "artist": (text("div.artist-content a, .artist-content a"),),
        "synopsis": (inner(".summary__content, .description-summary, .summary__content p"),),
        "status": (Rule("within", "div.post-status .post-content_item, div.post-content_item", word="status", inner_select=".summary-content, .post-content_item-value"),),
    },
    genres="div .genres-content [rel='tag'], .genres-content a",
    chapters="li.wp-manga-chapter > a:not([title]), ul.main.version-chap li a", chapter_order="ascending",
    chapter_title=("ol.breadcrumb li.active, h1",),
    content=("div.reading-content .text-left, div.reading-content, div.chapter-content",), lazy_images=True,
)
NOVELFULL = SiteSpec(
    "", "", "",
    id_pattern=r"/([^/?#]+?)(?:\.html)?/?$", original_language="zh",
    fields={
        "title": (text("h3.title"),),
        "cover_url": cover(".book img"),
        "author": (text("div.info a[href*='author']"),),
        "status": (text("div.info a[href*='status']"),),
        "synopsis": (inner("div.desc-text"),),
    },
    genres="div.info a[href*='genre']",
    total=Rule("listed", "li, span", words=("chapters",), partly=True), total_pattern=r"(?i)([\d,]+)\s*chapters?",
    chapters="ul.list-chapter li a", chapter_title=("h2, .chapter-title, h1",), content=("div#chapter-content",),
)

#: Fixed values, here and in the specs below: addresses, selectors, id patterns, labels and rates as the sites have them.
SITES: dict[str, SiteSpec] = {}


def register(spec: SiteSpec) -> SiteSpec:
    if spec.key in SITES:
        raise ValueError(f"site {spec.key!r} is registered already")
    SITES[spec.key] = spec
    return spec


def get_site(key: str) -> SiteSpec:
    if key not in SITES:
        raise KeyError(f"no site {key!r}; there are {', '.join(sorted(SITES))}")
    return SITES[key]


def list_sites() -> dict[str, SiteSpec]:
    return dict(SITES)


def autodiscover(package: str, failed: Callable[[str, Exception], None] | None = None) -> list[str]:
    """Import every module of a package of site specs; a module that fails is reported, not raised."""
    root, done = importlib.import_module(package), []
    for m in pkgutil.iter_modules(root.__path__, package + "."):
        try:
            importlib.import_module(m.name)
            done.append(m.name)
        except Exception as e:
            if failed:
                failed(m.name, e)
    return done


def sites_table(spark):
    """The registry as a small table."""
    rows = [(s.key, s.name, s.base_url, float(s.rate)) for s in SITES.values()]
    return spark.createDataFrame(rows, "site_key string, site_name string, base_url string, rps double")


register(replace(MADARA, key="boxnovel", name="BoxNovel", base_url="https://boxnovel.com"))
register(replace(MADARA, key="foxaholic", name="Foxaholic", base_url="https://foxaholic.com"))
register(replace(MADARA, key="novelbuddy", name="NovelBuddy", base_url="https://novelbuddy.com", id_pattern=r"novelbuddy\.(?:com|io)/novel/([^/?#]+)"))
register(replace(MADARA, key="novelfire", name="NovelFire", base_url="https://novelfire.net", id_pattern=r"novelfire\.net/novel/([^/?#]+)"))
register(replace(NOVELFULL, key="novelfull", name="NovelFull", base_url="https://novelfull.com"))
register(replace(NOVELFULL, key="novelbin", name="NovelBin", base_url="https://novelbin.com", chapters="#list-chapter li a", content=("div#chr-content, div#chapter-content",)))
register(
    replace(
        NOVELFULL, key="readnovelfull", name="Read Novel Full", base_url="https://readnovelfull.com",
        fields=NOVELFULL.fields | {"author": (text("ul.info li:nth-of-type(2) a"),)},
        chapters="ul.list-chapter li a, #list-chapter li a", content=("div#chr-content, div#chapter-content",),
    )
)
register(
    SiteSpec(
        "archiveofourown", "Archive of Our Own", "https://archiveofourown.org", 0.5, id_pattern=r"/works/(\d+)",
        fields={
            "title": (text("h2.heading"),), "author": (text("a[rel='author']"),), "language": (attr("meta[name='language']", "content"),),
            "synopsis": (inner("div.summary blockquote"),), "status": (Rule("after", "dl.stats dt", word="status"),),
        },
        genres=".fandoms a", tags=".meta .tags a", total=text("dd.chapters"), total_pattern=r"^\d+/(\d+)",
        status_words=(("completed", ("complete",)), ("ongoing", ("progress", "update"))),
        chapters="ol.chapter a[href*='/chapters/']", chapter_id=r"/chapters/(\d+)", chapter_title=("h3.title, h2.heading",),
        content=("div#chapters",), content_drop="div#feedback, div.end.notes, .chapter.preface.group nav",
    )
)
register(
    SiteSpec(
        "chrysanthemumgarden", "Chrysanthemum Garden", "https://chrysanthemumgarden.com", 0.5, id_pattern=r"chrysanthemumgarden\.com/novel/([^/?#]+)", original_language="zh",
        fields={
            "title": (text("h1.novel-title"),), "cover_url": (*cover(".novel-cover img"), attr(".novel-cover img", "data-breeze", "data-src", "src")),
            "author": (Rule("label", ".novel-info li, .novel-details li", word="author"),), "translator_group": (Rule("label", ".novel-info li, .novel-details li", word="translat"),),
            "synopsis": (inner(".summary, .description, .entry-content"),), "status": (text(".status, [class*='status']"),),
        },
        genres=".genres a, .tags a", chapters=".chapter-item a", content=("#novel-content, .entry-content, .chapter-content",), content_drop="span[style*='width:0'], span.jum",
    )
)
register(
    SiteSpec(
        "creativenovels", "Creative Novels", "https://creativenovels.com", 0.5, id_pattern=r"creativenovels\.com/novel/([^/?#]+)",
        fields={
            "title": (text("head title"),), "cover_url": cover("img.book_cover | .book-cover img"), "author": (text(".x-bar-content .x-text.bK_C, .author a"),),
            "synopsis": (inner(".description, .summary, .novel-description"),), "status": (text(".status, [class*='status']"),),
        },
        title_cut=("–", "|"), genres="a[href*='/genre/']", chapters=".chapter-listing a, .chapter-list a", content=("article .entry-content, .chapter-content",),
    )
)
register(
    SiteSpec(
        "fanfiction", "FanFiction.net", "https://www.fanfiction.net", 0.5, id_pattern=r"/s/(\d+)",
        fields={
            "title": (text("div#profile_top b"),), "author": (text("div#profile_top a[href*='/u/']"),), "cover_url": (attr("div#img_large img", "data-original", "src"),),
            "synopsis": (inner("div#profile_top div.xcontrast_txt"),),
        },
        split_tags=("div#profile_top span.xgray", "-"), option_list="select#chap_select option", chapter_title=("select#chap_select option[selected]", "div#profile_top b"), content=("div.storytext",),
    )
)
register(
    SiteSpec(
        "fimfiction", "FimFiction", "https://www.fimfiction.net", id_pattern=r"/story/(\d+)",
        fields={
            "title": (text("a.story_name"),), "author": (text("div.info-container a"),), "cover_url": cover("div.story_container__story_image img"),
            "synopsis": (inner("span.description-text"),), "status": (text(".story_status, .completion-status"),),
        },
        status_words=(("ongoing", ("incomplete", "in progress")), ("completed", ("complete",)), ("hiatus", ("hiatus", "on hold"))),
        genres="a[href*='/stories?genre=']", tags=".story-tag, .tag", total=text("span.chapter-count, .chapters span"),
        chapters="ul.chapters a.chapter-title", chapter_id=r"/(\d+)/", chapter_title=("h1.chapter-title", "a.story_name"), title_drop="div[style*='float:right']", content=("div#chapter",),
    )
)
register(
    SiteSpec(
        "freewebnovel", "FreeWebNovel", "https://freewebnovel.com", id_pattern=r"freewebnovel\.com/([^/?#]+?)(?:\.html)?/?$", original_language="zh",
        fields={
            "title": (text(".m-desc h1.tit, h1"),), "cover_url": cover(".m-imgtxt img | .book-cover img"), "author": (text(".m-imgtxt a[href*='/authors/'], .author a"),),
            "status": (text(".m-desc .txt span, .status"),), "synopsis": (inner(".m-desc .txt, .description"),),
        },
        genres="a[href*='/genre/']", chapters="#idData li > a, .chapter-list li a", content=(".m-read .txt, .chapter-content",),
    )
)
register(
    SiteSpec(
        "hostednovel", "Hosted Novel", "https://hostednovel.com", id_pattern=r"hostednovel\.com/novels/([^/?#]+)",
        fields={
            "title": (text(".text-center h1.font-extrabold, h1"),), "cover_url": (attr("section[aria-labelledby='novel-details-heading'] img[src]", "src", "data-src"),),
            "author": (Rule("after", "section[aria-labelledby='novel-details-heading'] dt", word="author"),), "status": (Rule("after", "section[aria-labelledby='novel-details-heading'] dt", word="status"),),
            "synopsis": (inner(".synopsis, .description, .summary"),),
        },
        genres="a[href*='/genres/']", chapters="#chapters ul[role='list'] li a[href]", content=(".chapter, .chapter-content, article",),
    )
)
register(
    SiteSpec(
        "lightnovelworld", "LightNovelWorld", "https://www.lightnovelworld.com", id_pattern=r"lightnovelworld\.com/novel/([^/?#]+)",
        fields={
            "title": (text("li.text1"),), "cover_url": cover(".book_info_l img | .cover img"), "author": (text("span.textC999, .author a"),),
            "status": (text(".status, span[class*='status']"),), "synopsis": (inner(".summary, .description, .content"),),
        },
        title_drop="span", genres=".genre a, .tag a", chapters="div#chapter_content ul li a, .chapter-list li a",
        content=("div#content_detail, div.chapter-content",), content_drop="div[class*='nav'], .nav-buttons, .chapter-nav",
    )
)
register(
    SiteSpec(
        "novelhall", "Novel Hall", "https://www.novelhall.com", id_pattern=r"/novel/(\d+)\.html", original_language="zh",
        fields={
            "title": (text("div.book-info h1, h1"),), "cover_url": cover("div.book-img img[src] | .cover img"), "author": (Rule("beside", ".booktag span.blue", word="author"),),
            "status": (Rule("beside", ".booktag span.blue", word="status"),), "synopsis": (inner(".js-close-wrap, .description"),),
        },
        synopsis_drop=".blue", genres="a[href*='/genre/'], a[href*='/category/']", chapters="#morelist.book-catalog ul li a[href], .chapter-list li a",
        content=("div#htmlContent.entry-content, div.chapter-content",),
    )
)
register(
    SiteSpec(
        "ranobes", "Ranobes", "https://ranobes.net", 0.5, id_pattern=r"/(\d+)-[^/]+\.html",
        fields={
            "title": (text("h1.title, h1"),), "cover_url": cover(".r-fullstory-poster .poster a img | .cover img"), "author": (text(".tag_list a[href*='/authors/'], a[href*='/author/']"),),
            "synopsis": (Rule("json", names=("description", "summary")), inner(".r-fullstory-description, .description")),
            "status": (Rule("listed", ".r-fullstory-pageinfo span, .r-fullstory-pageinfo li, .status span, .status li", words=("ongoing", "completed", "hiatus", "active"), partly=True),),
        },
        genres=".tag_list a[href*='/genre/']", chapters=".cat_line a, .chapter-row a", content=("div#arrticle, div.chapter-content",),
    )
)
register(
    SiteSpec(
        "relibrary", "Re:Library", "https://re-library.com", 0.5, id_pattern=r"re-library\.com/(?:translations|novels)/([^/?#]+)", original_language="ja",
        fields={
            "title": (text(".entry-title, h1"),), "cover_url": cover(".entry-content table img | .featured-image img"), "author": (text("a[href*='/nauthor/']"),),
            "translator_group": (text("a[href*='/ntranslator/']"),), "synopsis": (inner(".entry-content"),),
        },
        synopsis_limit=1000, genres="a[href*='/genre/'], a[href*='/ngenre/']", chapters=".page_item > a, .entry-content a[href]", own_host=True,
        chapter_title=(".entry-title, h1",), content=(".entry-content",), content_drop=".sharedaddy, .navigation, nav, .wpcnt",
    )
)
register(
    SiteSpec(
        "royalroad", "Royal Road", "https://www.royalroad.com", id_pattern=r"/fiction/(\d+)",
        fields={
            "title": (text("h1.font-white"),), "author": (text("span[property='name']"),), "synopsis": (inner(".description .description-content"), inner(".description")),
            "status": (Rule("listed", ".label", words=("ongoing", "complete", "hiatus", "dropped", "stub")),), "cover_url": (attr(".thumbnail img", "src", "data-src"), attr("img.thumbnail", "src", "data-src")),
        },
        status="loose", status_overrides={"stub": "dropped"}, genres="a.label[href*='genre']", tags="a.label[href*='tag']:not([href*='genre'])", total_rows="table#chapters tbody tr",
        chapter_rows="table#chapters tbody tr", chapters="a[href*='/chapter/']", chapter_id=r"/chapter/(\d+)/", chapter_date="time", number_patterns=(r"(?i)chapter\s+(\d+(?:\.\d+)?)",), number_from_url=False,
        chapter_title=("h1", ".chapter-title"), content=("div.chapter-content",),
    )
)
register(
    SiteSpec(
        "scribblehub", "ScribbleHub", "https://www.scribblehub.com", id_pattern=r"scribblehub\.com/series/(\d+)/",
        fields={
            "title": (text(".fic_title"),), "synopsis": (inner(".wi_fic_desc"),), "cover_url": cover(".fic_image img"), "author": (Rule("all", ".auth_name_fic"),), "status": (text(".fic_state"),),
        },
        genres=".fic_genre a", tags=".wi_fic_showtags a", total=text(".cnt_toc .cnt"), chapters=".toc_ol a.toc_a, .main .toc li a", chapter_order="oldest first",
        chapter_title=(".chapter-title, .bi_t, h1",), content=("#chp_raw",),
    )
)
register(
    SiteSpec(
        "tapas", "Tapas", "https://tapas.io", 0.5, id_pattern=r"tapas\.io/series/([^/?#]+)",
        fields={
            "title": (text("h2.series-info__title, .series-title"), og("title")), "author": (text(".creator-info a, .creator a, a[href*='/profile/']"),),
            "cover_url": (attr(".series-header__cover img, .cover-image img", "src", "data-src"), og("image")),
            "synopsis": (inner(".series-info__description, .description p"), og("description"), attr("meta[name='description']", "content")),
        },
        genres="a.genre-label, a[href*='/genre/']", tags="a.tag-label, .tags a", chapters="li.episode__item a[href*='/episode/'], .episode-list a",
        chapter_title=("h2.episode-viewer__title, h1",), content=("div.episode-viewer-wrap, div.content-viewer, div.viewer-content",),
    )
)
register(
    SiteSpec(
        "wanderinginn", "The Wandering Inn", "https://wanderinginn.com", 0.5, id_constant="wanderinginn", original_language="en",
        fields={"title": (og("site_name"),), "cover_url": (og("image"), *cover(".entry-content img"))},
        chapters="div#table-of-contents a[href*='wanderinginn.com'], .entry-content a[href*='wanderinginn.com']", chapter_title=("h1.entry-title, h1",),
        content=("div.entry-content",), content_drop="nav, .navigation, .sharedaddy, .wpcnt",
    )
)
register(
    SiteSpec(
        "wattpad", "Wattpad", "https://www.wattpad.com", 0.5, id_pattern=r"/story/(\d+)",
        fields={
            "title": (text("div.story-info span.sr-only"), text("h1"), og("title")), "author": (text("a[href*='/user/']"),),
            "cover_url": (attr("div[data-testid='cover'] img", "src", "data-src"), og("image")), "synopsis": (inner("pre.description, .description-text, .synopsis"), og("description")),
        },
        tags="ul.tag-items a, a[href*='/stories/']", chapters="ul.table-of-contents a[href], .table-of-contents a", chapter_id=r"/(\d+)-", chapter_title=("h1.h2, h1",), content_parts="p[data-p-id]",
    )
)
register(
    SiteSpec(
        "webnovel", "WebNovel", "https://www.webnovel.com", 0.5, id_pattern=r"webnovel\.com/book/[^/]+_(\d+)", original_language="zh",
        fields={
            "title": (og("title"), text("h1")), "cover_url": (og("image"), *cover(".g_thumb img | .book-cover img")), "synopsis": (og("description"), inner("p.detail, .description, div[class*='Desc']")),
            "author": (text("address a, .author-name a, span.name"),), "status": (text("span[class*='Status'], .tag-status"),),
        },
        genres="a[href*='/genre/']", tags="a[href*='/tags/']", total=text("span[class*='chapter'] strong, [class*='chapterTotal']"),
        chapters=".j_catalog_list li a, .catalog-list li a, .chapter-list li a", chapter_id=r"/(\d+)$", chapter_title=("h1, .chapter-title, [class*='chapterTitle']",),
        content=("div[class*='chapter-content'], div.content, div[class*='Content']",),
    )
)
register(
    SiteSpec(
        "wuxiacity", "Wuxia.city", "https://wuxia.city", id_pattern=r"wuxia\.city/book/([^/?#]+)", original_language="zh",
        fields={
            "title": (text("h1.book-name, h1"),), "cover_url": cover("div.book-img img | .cover img"), "author": (text("dl.author dd, .author a"),), "status": (text("dl.status dd, .status"),),
            "synopsis": (inner(".description, .summary, .book-desc"),),
        },
        genres="a[href*='/genre/'], .genres a", chapter_rows="ul.chapters li.oneline", chapters="a[href]", content=("div.chapter-content, .chapter-text",),
    )
)
register(
    SiteSpec(
        "wuxiaworld", "WuxiaWorld", "https://www.wuxiaworld.com", 0.5, id_pattern=r"wuxiaworld\.com/novel/([^/?#]+)", original_language="zh",
        fields={
            "title": (text("h1.novel-name"), text("h1")), "author": (text(".author span"), text(".author")), "translator_group": (Rule("label", ".novel-info li", word="translated"),),
            "synopsis": (inner(".novel-desc .fr-view"), inner(".description")), "status": (Rule("within", ".novel-info li", word="status", inner_select="span:last-child"),),
            "cover_url": (attr(".novel-cover img", "src", "data-src"), attr(".cover img", "src", "data-src")),
        },
        status="loose", genres="a.tag", chapters="a[href*='/chapter-']", unique_chapters=True, number_patterns=(r"(?i)chapter[- _](\d+(?:\.\d+)?)",),
        chapter_title=("h4.chapter-title", ".chapter-title", "h1"), content=("div.fr-view", "div.chapter-content"),
    )
)
