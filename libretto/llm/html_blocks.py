"""Main-text extraction from flat text blocks.

A page is cut into flat text blocks (runs of text between block-level tags). Every
block is described by its word count and link density, those of its two neighbours,
whether it is inside an article element, and how the markup around it is named: like
another section outright (nav, footer, a container called ``ad``), in part of a
compound name, or not. A CART decision tree, trained when the operator is built on the
blocks of the small labelled pages below, keeps or drops it. Markup alone decides only
where text cannot tell: scripts and styles go, and forms and readers' comments, which
read like paragraphs. No DOM is built: one linear tokenizer pass.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Elements whose content is never text of the page.
SKIPPED = ("script", "style", "noscript", "template", "title", "svg", "math", "iframe", "object", "select", "textarea", "button")
#: Elements that do not end a text block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split()
)
#: White space rather than a block edge.
SPACING = frozenset(("br", "img", "input"))
ITEMS = frozenset("li dt dd tr td th option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Sections that are no part of an article by their element alone; a header inside an article is its headline.
OTHER_SECTIONS = frozenset("nav header footer aside form dialog menu head".split())
ARTICLES = frozenset(("article", "main"))
#: Names (class, id or role) of sections that are no part of an article: menus, headers, footers, sidebars, notices, adverts, forms and comments.
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead comment comments disqus reply replies cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended widget toolbar pagination pager copyright legal disclaimer search form complementary contentinfo".split()
)
#: Sections whose text reads like an article's: by element, and by the last word of a name.
RULED_SECTIONS, RULED_NAMES = frozenset(("form", "dialog")), frozenset("comment comments disqus reply replies form".split())
#: Parts of compound names that say where something stands, not what it is.
PLACES = frozenset(
    "container wrapper wrap slot box block unit area section inner outer list item items link links left right top bottom main primary secondary bar group row col column module panel zone region "
    "content body text js is the site page global post entry article blog".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<skip>" + "|".join(SKIPPED) + r""")\b(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=skip)\s*+>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|</?[a-z!?][^<>]*+(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.I | re.S,
)
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
ANCHOR = re.compile(r"\b(?:name|id)\s*=", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: The labelled pages: a line for each text block, + where people keep it as article text, {n} for n words.
LABELLED = (
    # an article element with a menu of its own, plain and linked items, and boilerplate that no name gives away
    """
- <html><body><div><a href="/">{2}</a></div>
- <ul><li><a href="/a">{1}</a></li>
- <li><a href="/b">{1}</a></li>
- <li><a href="/c">{2}</a></li></ul>
- <div>{8}</div>
+ <article><h1>{9}</h1>
+ <p>{85}</p>
+ <p>{2}</p>
+ <h2>{3}</h2>
+ <ul><li>{4}</li>
+ <li>{1}</li>
+ <li>{6}</li></ul>
+ <p>{40} <a href="/x">{4}</a> {20}</p>
+ <p><a href="/long">{7}</a></p>
+ <p>{120}</p>
- <ul><li><a href="/t">{1}</a></li>
- <li><a href="/f">{1}</a></li>
- <li><a href="/m">{1}</a></li></ul></article>
- <p>{11}</p></body></html>""",
    # an article that starts with a list of its sections
    """
- <nav><a href="/">{1}</a>
- </nav><div class="breadcrumbs"><a href="/d">{1}</a> <a href="/e">{2}</a>
+ </div><main><h1>{5}</h1>
- <ul><li><a href="#a">{1}</a>
- <li><a href="#b">{2}</a>
- <li><a href="#c">{1}</a>
- <li><a href="#d">{2}</a></ul>
+ <h2>{1}</h2>
+ <p>{55}</p>
+ <pre>{14}</pre>
+ <p>{9}</p>
+ <h2>{2}</h2>
+ <p>{33} <a href="/y">{2}</a> {3}</p>
+ <p><a href="/z">{1}</a></p>
+ <p>{70}</p>
+ <p>{1}</p>
+ <p>{64}</p></main>
- <footer>{10}</footer>""",
    # many links in the text, as in an encyclopaedia, and sources as linked lines
    """
- <div>{3}</div>
+ <article><h1>{3}</h1>
+ <p>{30} <a href="/1">{12}</a> {25} <a href="/2">{15}</a></p>
+ <p><a href="/3">{10}</a> {18} <a href="/4">{9}</a></p>
+ <h2>{2}</h2>
+ <ul><li><a href="/5">{6}</a></li>
+ <li><a href="/6">{9}</a></li>
+ <li><a href="/7">{5}</a></li></ul>
+ <p>{44} <a href="/8">{22}</a></p>
+ <p>{4}</p></article>
- <div>{12}</div>""",
    # divisions only, without a name
    """
- <div><a href="/">{2}</a></div>
- <div><a href="/a">{1}</a></div>
- <div><a href="/b">{1}</a></div>
- <div><a href="/c">{1}</a></div>
+ <div><h1>{7}</h1>
+ <div>{62}</div>
+ <div>{15}</div>
+ <div>{140}</div>
+ <div>{4}</div>
+ <div>{88} <a href="/d">{3}</a></div></div>
- <div>{3}</div>
- <div><a href="/e">{6}</a></div>
- <div><a href="/f">{8}</a></div>
- <div><a href="/g">{7}</a></div>
- <div>{9} <a href="/h">{2}</a></div>""",
    # a table layout with a menu beside the text
    """
- <table><tr><td><a href="/a">{2}</a>
- <tr><td><a href="/b">{1}</a>
- <tr><td><a href="/c">{3}</a>
- <tr><td>{2}
+ </table><h2>{6}</h2>
+ <p>{95}
+ <p>{28} <a href="/d">{5}</a> {31}
+ <p>{210}
+ <p>{12}
+ <p>{47}
- <hr><a href="/e">{1}</a> {1} <a href="/f">{1}</a> {1} <a href="/g">{2}</a>
- <div>{7}</div>""",
    # a short notice before and a line after the text, no article element
    """
- <ul><li><a href="/a">{1}</a>
- <li><a href="/b">{1}</a>
- </ul><div>{9}</div>
+ <h1>{8}</h1>
+ <p>{52}</p>
+ <p>{38}</p>
+ <p>{61}</p>
- <div>{11}</div>""",
    # crumbs and teasers around one long paragraph
    """
- <div><a href="/a">{1}</a> {1} <a href="/b">{2}</a> {1} <a href="/c">{3}</a></div>
+ <div>{180}</div>
- <div><a href="/d">{9}</a> {6}</div>
- <div><a href="/e">{11}</a> {4}</div>
- <div><a href="/f">{8}</a> {7}</div>
- <div>{2}</div>""",
    # names that only sound like other sections: the text decides
    """
- <div class="ad-teaser">{7}</div>
+ <div class="social-history"><h2>{3}</h2>
+ <p>{58}</p>
+ <p>{36}</p></div>
+ <div class="search-theory"><p>{75}</p>
+ <p>{41} <a href="/x">{4}</a></p></div>
- <div class="related-stories"><a href="/y">{6}</a></div>
- <div class="share-this-page">{3}</div>
- <div class="login-help">{6} <a href="/z">{2}</a></div>
- <div>{4}</div>""",
    # an article with such names inside
    """
- <header>{4}</header>
+ <article><h1>{11}</h1>
+ <div class="menu-planning"><p>{66}</p>
+ <p>{29}</p></div>
- <div class="promo-teaser">{6}</div>
+ <p>{90}</p>
+ <div class="banner-history"><p>{48}</p></div>
- <div class="newsletter-offer">{9} <a href="/n">{2}</a></div>
+ <p>{3}</p>
+ <p>{31}</p></article>
- <footer>{13}</footer>""",
    # paragraphs of every length, one of which ends the page
    """
- <nav><ul><li><a href="/a">{1}</a></li>
- <li><a href="/b">{1}</a></li></ul></nav>
- <div class="ad">{7}</div>
+ <article><h1>{10}</h1>
+ <p>{101}</p>
+ <p>{1}</p>
+ <p>{92}</p>
+ <p>{2}</p>
+ <p>{1}</p>
+ <p>{143}</p>
+ <p>{6}</p>
+ <p>{12}</p>
+ <p>{250}</p>
+ <p>{3}</p>
+ <p>{24}</p>
+ <p>{1}</p></article></body></html>""",
    """
- <div>{6}</div>
+ <article><h1>{2}</h1>
+ <p>{1}</p></article>
- <footer>{9}</footer>""",
    """
- <ul><li><a href="/a">{1}</a></li></ul>
+ <article><p>{3}</p>
+ <p>{160}</p>
+ <p>{5} <a href="/b">{1}</a></p>
+ <p>{90} <a href="/c">{9}</a> {80}</p>
+ <p>{2} <a href="/d">{3}</a></p>
+ <p>{31}</p>
+ <p>{9}</p></article>""",
    # divisions only, the text ends the page
    """
- <div><a href="/a">{1}</a> <a href="/b">{1}</a></div>
+ <div>{6}</div>
+ <div>{77}</div>
+ <div>{3}</div>
+ <div>{54}</div>
+ <div>{130}</div>""",
    """
- <div><a href="/a">{1}</a></div>
- <div>{5}</div>
+ <h1>{9}</h1>
+ <p>{48}</p>
+ <p>{7}</p>
+ <p>{66}</p>
+ <p>{5}</p>
+ <p>{102}</p>
+ <p>{39}</p>
- <p>{8} <a href="/c">{2}</a></p>""",
    # an encyclopaedia without an article element
    """
- <div><a href="/a">{1}</a> {1} <a href="/b">{1}</a></div>
+ <h1>{2}</h1>
+ <p>{40} <a href="/c">{14}</a> {12}</p>
+ <p>{25} <a href="/d">{20}</a> {30}</p>
+ <p>{30} <a href="/e">{18}</a> {9}</p>
+ <p>{50} <a href="/f">{8}</a></p>
- <p><a href="/g">{3}</a></p>
- <p><a href="/h">{4}</a></p>
- <p>{2} <a href="/i">{2}</a></p>""",
    # the text follows a menu, or teasers, without a headline
    """
- <div><a href="/a">{1}</a></div>
- <div><a href="/b">{2}</a></div>
- <div><a href="/c">{1}</a></div>
+ <p>{70}</p>
+ <p>{33}</p>
+ <p><a href="/d">{5}</a></p>
+ <p>{90}</p>
- <div><a href="/e">{3}</a></div>
- <div><a href="/f">{2}</a></div>""",
    """
- <p><a href="/a">{8}</a></p>
- <p><a href="/b">{9}</a></p>
- <p><a href="/c">{7}</a></p>
+ <p>{84}</p>
+ <p>{3} <a href="/d">{4}</a></p>
+ <p>{61}</p>
+ <p>{5}</p>
+ <p>{47}</p>""",
    """
- <div><a href="/a">{2}</a></div>
- <div><a href="/b">{1}</a></div>
+ <div>{95}</div>
+ <div>{58}</div>
- <div>{3} <a href="/c">{2}</a></div>
- <div><a href="/d">{2}</a></div>""",
    """
- <ul><li><a href="/a">{1}</a></li>
- <li><a href="/b">{3}</a></li></ul>
+ <p>{66} <a href="/c">{2}</a> {9}</p>
+ <p>{120}</p>""",
    # nothing but the text
    """
+ <article><p>{3}</p></article>""",
    """
+ <article>{1}</article>""",
    """
+ <main><h1>{4}</h1>
+ <p>{7}</p></main>""",
    """
+ <article><h1>{6}</h1>
+ <p>{5}</p>
+ <p>{2}</p></article>""",
    """
+ <div>{60}</div>
+ <div>{24}</div>""",
    """
+ <p>{35}</p>""",
    """
+ <p>{28}</p>
+ <p>{52}</p>
+ <p>{30}</p>""",
    # more names that only sound like other sections, around promises and around prose
    """
- <nav><a href="/a">{1}</a></nav>
+ <article><h1>{7}</h1>
+ <p>{44}</p>
- <div class="sponsored-offer">{9}</div>
+ <p>{63}</p>
- <div class="subscribe-now">{12}</div>
+ <p>{18}</p>
+ <div class="legal-history"><p>{37}</p>
+ <p>{80}</p></div>
- <div class="share-options">{4}</div>
+ <p>{6}</p>
+ <p>{57}</p></article>
- <footer>{8}</footer>""",
    """
- <div class="cookie-manager">{14}</div>
- <div class="login-status">{3}</div>
+ <div class="banner-making"><h1>{6}</h1>
+ <p>{49}</p>
+ <p>{73}</p>
+ <p>{35}</p></div>
- <div class="related-reading">{5}</div>
- <div class="newsletter-teaser">{11}</div>""",
    # pages of the table, word for word counted: page_id 1, 2, 4, 6, 9 and 13 of the smallest one
    """
- <nav><ul><li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li></ul></nav>
- <div class="ad">{8}</div>
+ <article><h1>{9}</h1>
+ <p>{12}
+ <p>{9}</p>
+ <p>{39}</p>
+ <p>{8}</p>
+ <p>{20}</p>
+ <p>{8}</p></article>
- <footer>{8}</footer>""",
    """
- <nav><ul><li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li></ul></nav>
- <div class="ad">{5}</div>
+ <article><h1>{2}</h1>
+ <p>{2}</article>
- <footer>{11}</footer>""",
    """
- <nav><ul><li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li></ul></nav>
- <div class="ad">{8}</div>
+ <article><h1>{8}</h1>
+ <p>{8}
+ <p>{45}</p>
+ <p>{1}</p>
+ <p>{30}</p>
+ <p>{37}</p>
+ <p>{47}</p>
+ <p>{2}</p>
+ <p>{1}
+ <p>{15}</p>
+ <p>{3}</p>
+ <p>{8}</p></article>
- <footer>{14}</footer>""",
    """
- <nav><ul><li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li></ul></nav>
- <div class="ad">{9}</div>
+ <article><h1>{7}</h1>
+ <p>{968}
+ <p>{9}</p></article>
- <footer>{7}</footer>""",
    """
- <nav><ul><li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li></ul></nav>
- <div class="ad">{6}</div>
+ <article><h1>{8}</h1>
+ <p>{12}
+ <p>{8}</p>
+ <p>{3}</p>
+ <p>{38}</p>
+ <p>{36}</p>
+ <p>{28}</p>
+ <p>{6}</p>
+ <p>{25}
+ <p>{32}</p></article>
- <footer>{13}</footer>""",
    """
- <nav><ul><li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li>
- <li><a href="/x">{1}</a></li></ul></nav>
- <div class="ad">{7}</div>
+ <article><h1>{11}</h1>
+ <p>{37}
+ <p>{17}</p>
+ <p>{13}</p>
+ <p>{24}</p>
+ <p>{61}</p>
+ <p>{22}</p>
+ <p>{74}</p>
+ <p>{61}
+ <p>{72}</p>
+ <p>{120}</p>
+ <p>{88}</p>
+ <p>{19}</p>
+ <p>{9}</p>
+ <p>{20}</p></article>
- <footer>{13}</footer>""",
    # sections that are named for what they are, however long their text
    """
- <header>{3}</header>
- <div class="cookie-notice">{42}</div>
- <nav><p>{24} <a href="/a">{2}</a></p></nav>
+ <div><h1>{8}</h1>
+ <p>{64}</p>
+ <p>{31}</p></div>
- <aside><h3>{3}</h3>
- <p>{55}</p>
- <p>{28} <a href="/b">{3}</a></p></aside>
- <div class="newsletter">{36}</div>
- <footer><p>{22}</p>
- <p>{47}</p></footer>""",
    """
- <div class="banner">{18}</div>
+ <article><h1>{5}</h1>
+ <p>{70}</p>
- <aside><p>{33}</p>
- <p>{90}</p></aside>
+ <p>{12}</p>
- <div class="related"><p>{26}</p>
- <p>{41}</p></div>
+ <p>{58}</p></article>
- <div class="sidebar"><p>{35}</p>
- <p>{110}</p>
- <p>{4}</p></div>
- <footer>{64}</footer>""",
    """
+ <main><h1>{6}</h1>
- <div class="share"><p>{8}</p></div>
+ <p>{45}</p>
+ <p>{2}</p>
- <div class="ad"><p>{75}</p></div>
+ <p>{88}</p></main>
- <section class="promo"><h2>{4}</h2>
- <p>{52}</p></section>""",
    # the text comes first, links or other sections follow; short articles with others between
    """
+ <div>{45}</div>
- <ul><li><a href="/a">{1}</a>
- <li><a href="/b">{1}</a></ul>""",
    """
+ <div>{60}</div>
+ <div>{33}</div>
- <ul><li><a href="/a">{2}</a>
- <li><a href="/b">{1}</a>
- <li><a href="/c">{1}</a></ul>""",
    """
+ <p>{52}</p>
- <p><a href="/a">{3}</a></p>""",
    """
+ <article><h1>{2}</h1>
- <p class="advert">{4}</p>
+ <p>{3}</p>
- <div class="share">{2}</div>
+ <p>{2}</p>
- <ul><li class="related">{4}</li>
+ <li>{3}</li></ul></article>""",
    """
+ <article><header><h1>{1}</h1></header>
- <div class="ad">{6}</div>
+ <p>{4}</p>
- <div class="newsletter">{5}</div>
+ <p>{1}</p></article>
- <footer>{5}</footer>""",
    """
+ <article><h1>{1}</h1>
+ <p>{3}</p></article>""",
    """
+ <main><h2>{2}</h2>
+ <p>{1}</p></main>
- <footer>{3}</footer>""",
    # a page of short lines, as a poem or a recipe
    """
- <nav><a href="/a">{1}</a></nav>
+ <main><h1>{4}</h1>
+ <p>{6}</p>
+ <p>{5}</p>
+ <p>{7}</p>
+ <p>{1}</p>
+ <ul><li>{2}</li>
+ <li>{3}</li>
+ <li>{2}</li></ul>
+ <p>{8}</p></main>
- <div>{6}</div>""",
)


def labelled_blocks(pages: tuple[str, ...] = LABELLED) -> list[tuple[Block, bool]]:
    """Blocks of labelled pages, in order, each with its label."""
    out = []
    for page in pages:
        lines = page.strip().split("\n")
        whole = "".join(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), line[2:]) for line in lines)
        found = blocks(whole)
        if len(found) != len(lines):
            raise ValueError(f"{len(lines)} labels for {len(found)} blocks")
        out += [(b, line[0] == "+") for b, line in zip(found, lines, strict=True)]
    return out


def training_table(pages: tuple[str, ...] = LABELLED) -> np.ndarray:
    """Features and label of every block that is not in a form or among comments."""
    rows = []
    for page in pages:
        part = labelled_blocks((page,))
        shape = features([b for b, _ in part])
        rows += [(*f, keep) for (b, keep), f in zip(part, shape, strict=True) if not b.ruled]
    return np.array(rows, dtype=float)


#: Deepest tree, and fewest labelled blocks of a leaf.
DEPTH, FEWEST = 10, 2


def grow(table: np.ndarray, depth: int = DEPTH):
    """A CART tree by Gini impurity: a leaf is 0 or 1, a node (feature, threshold, at most, above)."""
    y = table[:, -1]
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(table.shape[1] - 1):
        edges = np.unique(table[:, f])
        for cut in (edges[1:] + edges[:-1]) / 2:
            left = table[:, f] <= cut
            a, b = y[left], y[~left]
            if min(len(a), len(b)) < FEWEST:
                continue
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), left)
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, cut, left = best
    return (f, cut, grow(table[left], depth - 1), grow(table[~left], depth - 1))


def decide(tree, features) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


class Block(NamedTuple):
    """A text block; ``linked`` of its words are in links; ``inside`` an article element; ``hint``: 2 if it is in a section named as another, 1 if a compound name around it sounds so; ``ruled``: in a form or among comments."""

    text: str
    words: int
    linked: int
    inside: bool
    hint: int
    ruled: bool


def names_say(attrs: str, inside: bool) -> tuple[int, bool]:
    """2 if a name in the attributes is that of another section, 1 if part of a compound name is, else 0; and whether it names comments or a form."""
    said, ruled = 0, False
    for m in ATTR.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = [p.lower() for p in PARTS.findall(name)]
            if not parts or parts[0] in ("has", "with", "no", "without"):
                continue
            told = [p for p in parts if p not in PLACES]
            kinds = [p in OTHER_NAMES and not (inside and p == "header") for p in told]
            if any(kinds):
                whole = kinds[-1] or all(kinds) or any(p.startswith("comment") for p in told)
                said = max(said, 2 if whole else 1)
                ruled = ruled or whole and (told[-1] in RULED_NAMES or any(p.startswith("comment") for p in told))
    return said, ruled


def opened(tag: str, attrs: str, state: tuple[bool, int, str]) -> tuple[bool, int, str]:
    """(inside, hint, tag of the ruled section) within a container."""
    inside, hint, ruled = state
    if tag in ARTICLES:
        # a form may be wrapped around a whole page
        return (True, 2 if hint == 2 and ruled != "form" else 0, "" if ruled == "form" else ruled)
    if tag in ("body", "html") or hint == 2 and ruled and ruled != "form":
        return state
    if tag in RULED_SECTIONS:
        return (inside, 2, tag)
    if tag in OTHER_SECTIONS and not (tag == "header" and inside):
        return (inside, 2, ruled)
    said, names_rule = names_say(attrs, inside) if attrs else (0, False)
    return (inside, max(hint, said), tag if names_rule and not ruled else ruled)


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in order."""
    found: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, tuple[bool, int, str]]] = []
    # how many containers of each tag are open: a close tag without a partner costs nothing
    open_: dict[str, int] = {}
    state, link, at = (False, 0, ""), -1, 0

    def flush() -> None:
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                inside, hint, ruled = state
                found.append(Block(text, text.count(" ") + 1, len(html.unescape(" ".join(linked)).split()), inside, hint, bool(ruled)))
            parts.clear()
            linked.clear()

    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if link >= 0:
                linked.append(parts[-1])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            # a link reaches over block edges, up to the end of the container it was opened in
            named = ANCHOR.search(m["attrs"]) and "href" not in m["attrs"].lower()
            link = -1 if m["close"] or named else len(stack)
        elif tag in SPACING:
            parts.append(" ")
        elif tag not in INLINE:
            flush()
            # an open paragraph ends at any block, an open item at the next one
            while not m["close"] and stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ITEMS):
                gone, state = stack.pop()
                open_[gone] -= 1
            if m["close"]:
                while open_.get(tag):
                    gone, state = stack.pop()
                    open_[gone] -= 1
                    if gone == tag:
                        break
            elif tag not in VOID and not m["attrs"].endswith("/"):
                stack.append((tag, state))
                open_[tag] = open_.get(tag, 0) + 1
                state = opened(tag, m["attrs"], state)
            if link > len(stack):
                link = -1
    if at < len(page):
        parts.append(page[at:])
        if link >= 0:
            linked.append(parts[-1])
    flush()
    return found


def features(found: list[Block]) -> list[tuple]:
    """Words and link density of each block, of the one before and of the one after; whether it is inside an article, and its hint."""
    shape = [(0, 0.0), *((b.words, min(1.0, b.linked / b.words)) for b in found), (0, 0.0)]
    return [(*shape[k + 1], *shape[k], *shape[k + 2], b.inside, b.hint) for k, b in enumerate(found)]


def main_text(page: str | None, tree) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, f in zip(found, features(found), strict=True) if not b.ruled and decide(tree, f))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: tuple[str, ...] = LABELLED) -> DataFrame:
    """Main text of every page: (id, url, text, n_chars), one row per input row.

    Map-only, no shuffle. Null or empty html gives the empty text; null ids and
    urls pass through; repeated rows give repeated rows; other columns are
    ignored whatever their names; an empty table gives an empty result. Pages are
    read whole, of any length, well formed or not; the tokenizer is linear.
    """
    tree = grow(training_table(labelled))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = [main_text(p, tree) for p in batch.column(2).to_pylist()]
            return {"id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_arrow(rows, "id long, url string, text string, n_chars long", make).withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
