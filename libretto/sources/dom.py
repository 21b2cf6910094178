"""A small element tree and the CSS selectors that site specs use (standard library only)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the key closes an open one of the values.
CLOSES = {"li": ("li",), "p": ("p",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}

#: Elements past which an omitted end tag does not reach.
BOUNDS = frozenset("ul ol dl table tbody thead select div section article body td th blockquote".split())
#: Elements whose text is no markup.
RAW = ("script", "style")


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        # a stack, as nested generators hand each node up through every level
        left = self.children[::-1]
        while left:
            c = left.pop()
            if c.__class__ is Node:
                yield c
                left += c.children[::-1]

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            else:
                yield from c.strings()

    def text(self, sep: str = "") -> str | None:
        """Stripped pieces joined by ``sep``; null for none."""
        return sep.join(t for s in self.strings() if (t := s.strip())) or None

    def attr(self, *names: str) -> str | None:
        return next((v.strip() for n in names if (v := self.attrs.get(n)) and v.strip()), None)

    def siblings(self) -> list[Node]:
        return [c for c in self.parent.children if isinstance(c, Node)] if self.parent else [self]

    def drop(self) -> None:
        if self.parent:
            self.parent.children.remove(self)
            self.parent = None

    def html(self) -> str:
        said = (lambda c: c) if self.tag in RAW else escaped
        inner = "".join(said(c) if isinstance(c, str) else c.html() for c in self.children)
        if self.tag == "#root":
            return inner
        attrs = "".join(f' {k}="{escaped(v).replace(chr(34), "&quot;")}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{inner}</{self.tag}>")

    def select(self, selector: str) -> list[Node]:
        """Descendants that match, in document order."""
        fits = compiled(selector)
        return [n for n in self.walk() if fits(n)]

    def first(self, selector: str) -> Node | None:
        fits = compiled(selector)
        for n in self.walk():
            if fits(n):
                return n
        return None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def updatepos(self, i, j):
        # line numbers are not read
        return j

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            up = self.at
            while up.parent and up.tag not in CLOSES[tag] and up.tag not in BOUNDS:
                up = up.parent
            if up.tag in CLOSES[tag]:
                self.at = up.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(page: str | None) -> Node:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


PART = re.compile(
    r"(?P<tag>[a-z][a-z0-9]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"""|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$~]?=)["']?(?P<val>[^"'\]]*)["']?)?\]"""
    r"""|:not\(\[(?P<lacks>[\w-]+)(?:\*=["']?(?P<held>[^"'\]]*)["']?)?\]\)"""
    r"|:nth-of-type\((?P<nth>\d+)\)|:(?P<last>last-child)"
)


@lru_cache(maxsize=4096)
def compiled(selector: str) -> Callable[[Node], bool]:
    """Whether a node matches one of the selector's alternatives; each is a chain of (relation to the one before, tests)."""
    out = []
    for alternative in selector.split(","):
        chain, relation = [], " "
        for piece in re.findall(r"""(?:\[[^\]]*\]|\([^)]*\)|[^\s>])+|>""", alternative.strip()):
            if piece == ">":
                relation = ">"
                continue
            tests, at = [], 0
            while at < len(piece):
                m = PART.match(piece, at)
                if not m:
                    raise ValueError(f"selector {selector!r}")
                kind = {"op": "attr", "val": "attr", "held": "lacks"}.get(m.lastgroup, m.lastgroup)
                g = m.groupdict()
                tests.append(_test(kind, g["attr"], g["op"], g["held"] if kind == "lacks" else g["val"], g[kind]))
                at = m.end()
            chain.append((relation, tuple(tests)))
            relation = " "
        out.append(tuple(chain))

    def fits(n: Node) -> bool:
        for chain in out:
            if matches(n, chain, len(chain) - 1):
                return True
        return False

    return fits


def _test(kind: str, name: str | None, op: str | None, value: str | None, arg: str) -> Callable[[Node], bool]:
    """One test of a selector as a function of the node."""
    if kind == "tag":
        return (lambda n: True) if arg == "*" else lambda n: n.tag == arg
    if kind == "id":
        return lambda n: n.attrs.get("id") == arg
    if kind == "cls":
        return lambda n: arg in n.attrs.get("class", "") and arg in n.attrs["class"].split()
    if kind == "lacks":
        return lambda n: arg not in n.attrs or value is not None and value not in n.attrs[arg]
    if kind == "nth":
        return lambda n: n in (same := [s for s in n.siblings() if s.tag == n.tag]) and same.index(n) + 1 == int(arg)
    if kind == "last":
        return lambda n: n.siblings()[-1] is n
    holds = {None: lambda have: True, "=": lambda have: have == value, "*=": lambda have: value in have, "^=": lambda have: have.startswith(value), "$=": lambda have: have.endswith(value), "~=": lambda have: value in have.split()}[op]
    return lambda n: (have := n.attrs.get(name)) is not None and holds(have)


def matches(n: Node, chain: tuple, k: int) -> bool:
    relation, tests = chain[k]
    for passes in tests:
        if not passes(n):
            return False
    if k == 0:
        return True
    up = n.parent
    while up is not None and up.tag != "#root":
        if matches(up, chain, k - 1):
            return True
        if relation == ">":
            return False
        up = up.parent
    return False
