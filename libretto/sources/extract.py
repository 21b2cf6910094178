"""Pages in, records out: title metadata, chapter listings and chapter contents by site spec.

The input is a table of fetched pages, (url, html) and, for mixed input, the site
key. Extraction is map-only: one Arrow batch of pages at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from libretto.functions.text import CHAPTER_NUMBERS, STATUS, STATUS_LOOSE
from libretto.schema import RAW_CONTENT, RAW_LISTING, RAW_METADATA

from .dom import Node, parse
from .sites import SITES, Rule, SiteSpec, get_site

WINDOW_DATA = re.compile(r"window\.__DATA__\s*=\s*(\{.+?\});", re.S)
#: Texts of a link to the next page, in the order they are tried.
NEXT_HINTS = ("next", "›", "»", "next page", "next »")


def absolute(base: str, href: str | None) -> str:
    if not href:
        return ""
    return href if href.startswith(("http://", "https://")) else urljoin(base, href)


def last_segment(url: str) -> str:
    return url.rstrip("/").split("/")[-1]


def source_id(spec: SiteSpec, url: str) -> str:
    if spec.id_constant:
        return spec.id_constant
    m = re.search(spec.id_pattern, url) if spec.id_pattern else None
    return m[1] if m else last_segment(url) if spec.id_fallback == "segment" else url


def source_id_column(spec: SiteSpec, url: Column) -> Column:
    """The source id as a Column expression."""
    if spec.id_constant:
        return F.lit(spec.id_constant)
    other = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1) if spec.id_fallback == "segment" else url
    return F.coalesce(F.nullif(F.regexp_extract(url, spec.id_pattern, 1), F.lit("")), other) if spec.id_pattern else other


def number_of(title: str | None, url: str | None, patterns: tuple[str, ...] = CHAPTER_NUMBERS) -> float | None:
    for source in (title, url):
        for p in patterns if source else ():
            if m := re.search(p, source):
                return float(m[1])
    return None


def apply(rule: Rule, page: Node, html: str) -> str | None:
    if rule.kind == "json":
        if m := WINDOW_DATA.search(html):
            try:
                data = json.loads(m[1])
            except ValueError:
                return None
            return next((str(data[n]) for n in rule.names if data.get(n)), None)
        return None
    if rule.kind in ("text", "inner", "attr"):
        node = page.first(rule.select)
        if node is None:
            return None
        return node.text() if rule.kind == "text" else node.text("\n") if rule.kind == "inner" else node.attr(*rule.names)
    if rule.kind == "all":
        return ", ".join(t for n in page.select(rule.select) if (t := n.text())) or None
    for node in page.select(rule.select):
        said = (node.text(" ") or "").lower()
        around = node.siblings()
        at = around.index(node)
        if rule.kind == "listed":
            whole = node.text() or ""
            if any(w in whole.lower() if rule.partly else w == whole.lower() for w in rule.words):
                return whole
        elif rule.kind == "label" and rule.word in said:
            t = node.text(" ") or ""
            return t.split(":", 1)[1].strip() if ":" in t else None
        elif rule.kind == "after" and rule.word in said:
            if at + 1 < len(around):
                return around[at + 1].text()
        elif rule.kind == "beside" and at and rule.word in (around[at - 1].text() or "").lower():
            return node.text()
        elif rule.kind == "within" and rule.word in said:
            found = node.first(rule.inner_select)
            return found.text() if found else None
    return None


def status_of(spec: SiteSpec, raw: str | None) -> str | None:
    if not raw:
        return None
    key = raw.lower().strip()
    if spec.status_words:
        return next((name for name, words in spec.status_words if any(w in key for w in words)), None)
    return STATUS.get(key) if spec.status == "map" else (STATUS_LOOSE | spec.status_overrides).get(key, key)


def title_record(spec: SiteSpec, url: str, html: str, page: Node | None = None) -> dict:
    """RawMetadata of a title page; from its tree, if that is there, which loses what the spec drops."""
    page = page or parse(html)
    out: dict = {"source_id": source_id(spec, url), "source_url": url, "language": spec.language, "original_language": spec.original_language}
    for select, key in ((spec.title_drop, "title"), (spec.synopsis_drop, "synopsis")):
        if select:
            for rule in spec.fields.get(key, ()):
                if (node := page.first(rule.select)) is not None:
                    for n in node.select(select):
                        n.drop()
    for name, rules in spec.fields.items():
        value = next((v for r in rules if (v := apply(r, page, html))), None)
        if name == "cover_url" and value and value.startswith("data:"):
            value = None
        out[name] = value or out.get(name)
    out["status"] = status_of(spec, out.get("status"))
    if out.get("cover_url"):
        out["cover_url"] = absolute(spec.base_url, out["cover_url"])
    for cut in spec.title_cut:
        out["title"] = (out.get("title") or "").split(cut)[0].strip() or None
    if spec.synopsis_limit and len(out.get("synopsis") or "") > spec.synopsis_limit:
        out["synopsis"] = out["synopsis"][: spec.synopsis_limit] + "…"
    out["genres"] = [t for n in page.select(spec.genres) if (t := n.text())] if spec.genres else []
    out["tags"] = [t for n in page.select(spec.tags) if (t := n.text())] if spec.tags else []
    if spec.split_tags and (node := page.first(spec.split_tags[0])) is not None:
        out["tags"] = [p for s in (node.text(" ") or "").split(spec.split_tags[1]) if (p := s.strip())]
    if spec.total_rows:
        out["total_chapters"] = len(page.select(spec.total_rows)) or None
    elif spec.total and (m := re.search(spec.total_pattern, apply(spec.total, page, html) or "")):
        out["total_chapters"] = int(m[1].replace(",", ""))
    return out


def listing_records(spec: SiteSpec, url: str, html: str, page: Node | None = None) -> list[dict]:
    """RawChapterListings of a listing page, or of its tree, which stays as it is; a number that cannot be read is the position."""
    page, found, seen = page or parse(html), [], set()
    if spec.option_list and (options := page.select(spec.option_list)):
        story = source_id(spec, url)
        return [
            {"source_chapter_id": v, "source_url": f"{spec.base_url}/s/{story}/{v}/", "title": n.text(), "chapter_number": float(v), "release_date": None}
            for n in options if (v := n.attrs.get("value", "")).isdigit()
        ]
    if spec.chapter_rows:
        rows = [(k, row.first(spec.chapters), row) for k, row in enumerate(page.select(spec.chapter_rows), 1)]
    else:
        rows = [(k, link, link) for k, link in enumerate(page.select(spec.chapters), 1)] if spec.chapters else []
    for k, link, row in rows:
        href = link.attr("href") if link is not None else None
        if not href or spec.own_host and urlparse(spec.base_url).netloc not in href:
            continue
        m = re.search(spec.chapter_id, href) if spec.chapter_id else None
        name = m[1] if m else last_segment(href)
        if spec.unique_chapters and name in seen:
            continue
        seen.add(name)
        title = link.text()
        number = number_of(title, href if spec.number_from_url else None, spec.number_patterns or CHAPTER_NUMBERS)
        when = row.first(spec.chapter_date) if spec.chapter_date else None
        found.append({"source_chapter_id": name, "source_url": absolute(spec.base_url, href), "title": title, "chapter_number": number or float(k), "release_date": when.attr("datetime") if when is not None else None})
    if spec.chapter_order == "ascending":
        found.sort(key=lambda r: r["chapter_number"])
    elif spec.chapter_order == "oldest first" and len(found) > 1 and found[0]["chapter_number"] > found[-1]["chapter_number"]:
        found.reverse()
    return found


def content_record(spec: SiteSpec, url: str, html: str) -> dict:
    """RawChapterContent of a chapter page; without a content node the content is empty."""
    page = parse(html)
    m = re.search(spec.chapter_id, url) if spec.chapter_id else None
    title_node = next((n for s in spec.chapter_title if (n := page.first(s)) is not None), None)
    if title_node is not None and spec.title_drop:
        for n in title_node.select(spec.title_drop):
            n.drop()
    title = title_node.text() if title_node is not None else None
    if spec.content_parts:
        raw = "\n".join(n.html() for n in page.select(spec.content_parts))
    else:
        node = next((n for s in spec.content if (n := page.first(s)) is not None), None)
        if node is not None and spec.content_drop:
            for n in node.select(spec.content_drop):
                n.drop()
        if node is not None and spec.lazy_images:
            for n in node.select("img[data-src]"):
                n.attrs["src"] = n.attrs["data-src"]
        raw = node.html() if node is not None else ""
    number = number_of(title, url, spec.number_patterns or CHAPTER_NUMBERS) or 0.0
    return {"source_chapter_id": m[1] if m else last_segment(url), "source_url": url, "title": title, "chapter_number": number, "raw_content": raw, "content_format": "html"}


def next_page(html: str, base_url: str) -> str | None:
    """Address of the next page of a paginated list."""
    page = parse(html)
    links = page.select("a[href]")
    for a in links:
        if "next" in a.attrs.get("rel", "") and a.attr("href"):
            return absolute(base_url, a.attr("href"))
    for hint in NEXT_HINTS:
        for a in links:
            if (a.text() or "").lower() == hint and (href := a.attr("href")) and href != "#":
                return absolute(base_url, href)
    return None


def next_pages(pages: DataFrame, base_url: str) -> DataFrame:
    """``pages`` (url, html) with the address of each one's next page, or null."""
    schema = "url string, html string, next_url string"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [next_page(h, base_url) if h else None for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, type=pa.string())], schema=out)

    return pages.select("url", "html").mapInArrow(run, schema)


def _extract(pages: DataFrame, site: str | Column, schema: str, each: Callable[[SiteSpec, str, str], list[dict]]) -> DataFrame:
    """Rows that ``each`` makes of every page; pages of unknown sites and null pages make none."""
    ddl = "site_key string, page_url string, " + schema
    out = to_arrow_schema(StructType.fromDDL(ddl))
    specs = {get_site(site).key: get_site(site)} if isinstance(site, str) else dict(SITES)
    key = F.lit(site) if isinstance(site, str) else site

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k in specs and url is not None and html is not None:
                    rows += [{"site_key": k, "page_url": url, **r} for r in each(specs[k], url, html)]
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return pages.select(key.alias("k"), F.col("url"), F.col("html")).mapInArrow(run, ddl)


def extract_titles(pages: DataFrame, site: str | Column) -> DataFrame:
    return _extract(pages, site, RAW_METADATA, lambda s, u, h: [title_record(s, u, h)])


def extract_listings(pages: DataFrame, site: str | Column) -> DataFrame:
    return _extract(pages, site, RAW_LISTING, listing_records)


def extract_titles_listed(pages: DataFrame, site: str | Column) -> DataFrame:
    """What ``extract_titles`` finds, and in ``chapters`` what ``extract_listings`` finds in the same pages: each is parsed once."""

    def both(spec: SiteSpec, url: str, html: str) -> list[dict]:
        page = parse(html)
        # the list first: the title's rules take nodes out of the tree
        chapters = listing_records(spec, url, html, page)
        return [title_record(spec, url, html, page) | {"chapters": chapters}]

    return _extract(pages, site, f"{RAW_METADATA}, chapters array<struct<{RAW_LISTING.replace(' ', ':').replace(',:', ',')}>>", both)


def extract_contents(pages: DataFrame, site: str | Column) -> DataFrame:
    return _extract(pages, site, RAW_CONTENT, lambda s, u, h: [content_record(s, u, h)])


def json_parts(rows: DataFrame, body: str = "body") -> DataFrame:
    """Chapters of a JSON answer ``{"parts": [...]}``; parts that are not free are left out."""
    kind = "struct<parts:array<struct<id:long,title:string,url:string,free:boolean>>>"
    part = F.explode(F.from_json(body, kind)["parts"]).alias("p")
    return rows.select("url", part).where(F.coalesce("p.free", F.lit(True))).select("url", F.col("p.id").cast("string").alias("source_chapter_id"), F.col("p.title").alias("title"), F.col("p.url").alias("source_url"))


def embedded_json(html: Column, *names: str) -> Column:
    """First non-empty of the named members of the object assigned to window.__DATA__, as a Column."""
    data = F.try_parse_json(F.nullif(F.regexp_extract(html, r"(?s)window\.__DATA__\s*=\s*(\{.+?\});", 1), F.lit("")))
    return F.coalesce(*(F.nullif(F.try_variant_get(data, f"$.{n}", "string"), F.lit("")) for n in names))
