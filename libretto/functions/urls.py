"""Addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths of a title page, and fragments of a listing page's path.
NOVEL_PATHS = (r"^/novel/([^/]+)", r"^/series/([^/]+)", r"^/book/([^/]+)", r"^/books/([^/]+)", r"^/story/([^/]+)", r"^/read/([^/]+)", r"/novel/([^/]+)", r"/series/([^/]+)", r"/book/([^/]+)", r"/story/([^/]+)")
LISTING_PATHS = ("/novels", "/series", "/books", "/stories", "/all", "/browse", "/category", "/genres", "/library")
HREF = r"""href=["']([^"']+)["']"""


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))


def normalise(url: Column) -> Column:
    """Scheme, authority and path without trailing slashes; query and fragment go."""
    return F.concat(scheme(url), F.lit("://"), authority(url), F.regexp_replace(path(url), "/+$", ""))


def resolve(base: Column, href: Column) -> Column:
    """Absolute address of a link: absolute, host-relative, root-relative and relative ones."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(F.coalesce(href, F.lit("")) == "", "")
        .when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), href))
    )


def novel_slug(url: Column) -> Column:
    """Slug of a title page's address; null for other pages."""
    return F.coalesce(*(F.nullif(F.regexp_extract(path(url), "(?i)" + p, 1), F.lit("")) for p in NOVEL_PATHS))


def has_novel_links(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?i)" + "|".join(p.replace("(", "(?:") for p in NOVEL_PATHS))


def is_listing(url: Column) -> Column:
    return F.lower(path(url)).rlike("|".join(LISTING_PATHS))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), 1)


def sitemap_locs(xml: Column) -> Column:
    """Addresses of a sitemap, well formed or not."""
    return F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"<(?:\w+:)?loc>\s*([^<]*?)\s*</(?:\w+:)?loc>"), 1)
