"""Personal data in whole texts, also where it is disguised.

Plain detectors run over the source. A chain of transducers then rewrites the
text (homoglyphs and invisible characters; spelled digits; at/dot disguises),
keeping the alignment of every rewritten piece; the same detectors run over the
rewritten text and what they find where something was rewritten is mapped back
to source code points and added to the plain spans.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

KINDS = ("email", "ip", "card", "phone")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """Each match holds one @, so the @ signs are walked: linear in any text."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (g.lstrip("0") or "0" for g in m.groups())):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def detect(text: str) -> dict[str, list[Span]]:
    """Spans of each kind, leftmost and non-overlapping within the kind."""
    digits = DIGIT.search(text) is not None
    return {
        "email": list(emails(text)) if "@" in text else [],
        "ip": list(ips(text)) if digits else [],
        "card": list(cards(text)) if digits else [],
        "phone": list(phones(text)) if digits and "+" in text else [],
    }


#: Letters of other scripts that are read as ASCII ones: source characters, then what they are read as.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXaesijopcyxhdqw")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυ", "ABEZHIKMNOPTYXavopu")
OTHER = ("ıɡℓ‐‑‒–—−․。｡﹫", "igl------...@")
#: Characters that show nothing: soft hyphen, zero-width ones, joiners, directional marks, variation selectors.
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤︀︎️﻿"
#: Ranges with compatibility forms of ASCII: sub/superscripts, enclosed, mathematical and fullwidth characters; other scripts' digits.
FORMS = r"²³¹⁰-ₜ①-⓪！-～\U0001d400-\U0001d7ff\U0001fbf0-\U0001fbf9  -  　" + "٠-٩۰-۹०-९"
CONFUSABLE = {ord(s): d for pair in (CYRILLIC, GREEK, OTHER) for s, d in zip(*pair, strict=True)}
ODD = re.compile("[" + FORMS + re.escape("".join(map(chr, CONFUSABLE))) + INVISIBLE + "]")


def plain_char(c: str) -> str:
    """What a homoglyph, compatibility form or invisible character is read as."""
    if c in INVISIBLE:
        return ""
    if ord(c) in CONFUSABLE:
        return CONFUSABLE[ord(c)]
    n = unicodedata.decimal(c, None)
    form = str(n) if n is not None else unicodedata.normalize("NFKC", c)
    return form if form.isascii() else c


#: Names of the digits, and of the plus sign, in four languages.
DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
NAMED = "|".join(sorted(DIGITS, key=len, reverse=True))
DOT_NAMES = "dot|punkt|point|punto"
OPEN, SHUT = r"[\[({<]", r"[\])}>]"
#: White space before a disguise is read from its first character on, and never given back: a long run of it costs its length, once.
GAP, LEAD = r"\s*+", r"(?<!\s)\s++"
DOT = rf"(?:(?:{LEAD})?{OPEN}{GAP}(?:{DOT_NAMES}|\.){GAP}{SHUT}{GAP}|{LEAD}(?:{DOT_NAMES})\s++|_(?:{DOT_NAMES})_|\s\.\s|&#46;|&period;)"
AT_NAMES = "at|arobase|arroba|ät"
AT_SURE = rf"(?:(?:{LEAD})?{OPEN}{GAP}(?:{AT_NAMES}|@){GAP}{SHUT}{GAP}|{LEAD}@{GAP}|(?<=\S)@\s++|&#64;|&commat;)"
AT_BARE = rf"(?:{LEAD}(?:{AT_NAMES})\s++|_(?:{AT_NAMES})_)"
LABEL = r"[A-Za-z0-9][A-Za-z0-9-]*+"

#: A run of spelled or written digits, with the separators between them.
ONE = rf"(?:\b(?:{NAMED})\b|[0-9]++)"
RUN = re.compile(rf"(?:\b(?:plus)\b{GAP}|\+{GAP})?{ONE}(?:(?:[ \t,-]{{1,3}}|{DOT}|\.)?{ONE})+", re.I)
PIECE = re.compile(rf"(?P<plus>\bplus\b\s*)|\b(?P<name>{NAMED})\b|(?P<dot>{DOT})|(?P<rest>[0-9]+|[ \t,-]+|.)", re.I | re.S)
DIGIT_NEAR = frozenset(DOT_NAMES.split("|"))
BRACKETED_DOT = re.compile(rf"[0-9]{DOT}[0-9]", re.I)


def spells(text: str) -> bool:
    """Whether a digit's name stands beside another, a number, a dot or after a plus: a cheap test before RUN."""
    lower = text.lower()
    if ("[" in text or "(" in text or "{" in text or "<" in text or "dot" in lower or "pun" in lower or "point" in lower) and BRACKETED_DOT.search(text):
        return True
    words = lower.replace("-", " ").replace(",", " ").split()
    if DIGITS.keys().isdisjoint(words):
        return False
    last = len(words) - 1
    for k, w in enumerate(words):
        if w in DIGITS:
            if k and (words[k - 1] in DIGITS or words[k - 1] == "plus" or words[k - 1][-1:].isdigit()):
                return True
            if k < last and (words[k + 1] in DIGIT_NEAR or words[k + 1][:1].isdigit() or words[k + 1][:1] in "[({<"):
                return True
    return False


#: A disguised address: a sure at sign, or a bare "at" whose domain has a disguised dot.
LABELS = rf"{LABEL}(?:(?:{DOT}|\.){LABEL})+"
ADDRESS = re.compile(
    rf"(?P<sure>{AT_SURE})(?P<d1>{LABELS})|(?P<bare>{AT_BARE})(?P<d2>{LABEL}(?:\.{LABEL})*{DOT}{LABEL}(?:(?:{DOT}|\.){LABEL})*)|(?P<plain>@)(?P<d3>{LABEL}(?:\.{LABEL})*{DOT}{LABEL}(?:(?:{DOT}|\.){LABEL})*)",
    re.I,
)
DOTS = re.compile(DOT, re.I)
HINTED = re.compile(rf"\b(?:{DOT_NAMES})\b|[\[({{<]{GAP}(?:{AT_NAMES}|@|\.){GAP}[\])}}>]|\s@|@\s|_(?:{DOT_NAMES})_|&#64;|&#46;|&commat;|&period;|@[^\s@]*+\s\.\s", re.I)

#: One of these is in every text that HINTED matches.
CHEAP_HINTS = (*DOT_NAMES.split("|"), "&#", "&c", "&p", " . ", "[", "(", "{", "<", " @", "@ ", "@\n", "\n@", "\t@", "@\t")
#: Words that are no host name after a bare "at".
NO_HOST = frozenset("the a an this that these those our your his her its my their le la les der die das el los las un une uno".split())

Edit = tuple[int, int, str]


class Aligned:
    """A rewritten text and, for its pieces, where they stand in the source."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.sources, self.edited = [0], [(0, len(text))], [False]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a rewritten span, and whether a rewritten piece lies in it."""
        a, b = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        left = self.sources[a][0] + (0 if self.edited[a] else start - self.starts[a])
        right = self.sources[b][1] if self.edited[b] else self.sources[b][0] + end - self.starts[b]
        moved = right - left != end - start  # something invisible was dropped in between
        return left, right, moved or any(self.edited[a : b + 1])

    def rewrite(self, edits: list[Edit]) -> Aligned:
        """Apply ordered edits of this text; alignment to the source composes."""
        out = Aligned.__new__(Aligned)
        out.starts, out.sources, out.edited = [], [], []
        parts: list[str] = []
        size = 0

        def copy(lo: int, hi: int) -> None:
            nonlocal size
            k = bisect_right(self.starts, lo) - 1
            while lo < hi:
                stop = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
                piece = min(hi, stop)
                out.starts.append(size)
                if self.edited[k]:
                    out.sources.append(self.sources[k])
                else:
                    s = self.sources[k][0] + lo - self.starts[k]
                    out.sources.append((s, s + piece - lo))
                out.edited.append(self.edited[k])
                parts.append(self.text[lo:piece])
                size += piece - lo
                lo, k = piece, k + 1

        at = 0
        for start, end, new in edits:
            copy(at, start)
            left, right, _ = self.source(start, max(end, start + 1))
            if new:
                out.starts.append(size)
                out.sources.append((left, right))
                out.edited.append(True)
                parts.append(new)
                size += len(new)
            at = end
        copy(at, len(self.text))
        out.text = "".join(parts)
        if not out.starts:
            out.starts, out.sources, out.edited = [0], [(0, 0)], [False]
        return out


def homoglyphs(text: str) -> list[Edit]:
    if text.isascii():
        return []
    return [(m.start(), m.end(), p) for m in ODD.finditer(text) if (p := plain_char(m[0])) != m[0]]


def spelled_digits(text: str) -> list[Edit]:
    """Runs of four or more digits of which at least one is spelled or a dot is disguised."""
    if not spells(text):
        return []
    edits: list[Edit] = []
    for m in RUN.finditer(text):
        pieces = list(PIECE.finditer(text, m.start(), m.end()))
        if sum(len(p["rest"]) if p["rest"] and p["rest"].isdigit() else 1 for p in pieces if p["name"] or p["rest"] and p["rest"].isdigit()) < 4:
            continue
        for k, p in enumerate(pieces):
            if p["plus"]:
                edits.append((*p.span(), "+"))
            elif p["name"]:
                edits.append((*p.span(), str(DIGITS[p["name"].lower()])))
            elif p["dot"]:
                edits.append((*p.span(), "."))
            elif p["rest"][0] in " \t,-":
                spelled = k and pieces[k - 1]["name"] and k + 1 < len(pieces) and pieces[k + 1]["name"]
                new = "" if spelled else " " if len(p["rest"]) > 1 or p["rest"] in "\t," else p["rest"]
                if new != p["rest"]:
                    edits.append((*p.span(), new))
    return edits


def local_start(text: str, end: int, floor: int) -> int:
    """Where the run of local-part characters that ends at ``end`` begins, not before ``floor``."""
    while end > floor and text[end - 1] in LOCAL_CHARS:
        end -= 1
    return end


def at_dots(text: str) -> list[Edit]:
    """Disguised at signs and dots of addresses, left to right: what one match has read, none after it reads again."""
    lower = text.lower()
    if not any(x in lower for x in CHEAP_HINTS) or not HINTED.search(text):
        return []
    edits: list[Edit] = []
    dots: dict[int, int] | None = None
    floor = 0
    for m in ADDRESS.finditer(text):
        group, dom = ("sure", "d1") if m["sure"] else ("bare", "d2") if m["bare"] else ("plain", "d3")
        start, low = local_start(text, m.start(), floor), floor
        floor = m.start(dom)
        if start == m.start() or m["bare"] and re.match(r"[a-z0-9-]*", m["d2"].lower())[0] in NO_HOST:
            continue
        if dots is None:
            dots = {d.end(): d.start() for d in DOTS.finditer(text)}
        left: list[Edit] = []
        while (dot := dots.get(start, -1)) > low and (before := local_start(text, dot, low)) < dot:
            left.append((dot, start, "."))
            start = before
        edits += reversed(left)
        if group != "plain":
            edits.append((*m.span(group), "@"))
        edits += [(*d.span(), ".") for d in DOTS.finditer(text, m.start(dom), m.end(dom))]
        floor = m.end()
    return edits


#: Letters read as digits inside a number, and runs of digits in which they may stand.
LETTER_DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1"}
NUMBER = r"(?<![A-Za-z0-9|])(?=[OolI|]*+[0-9])[0-9OolI|]++(?![A-Za-z0-9])"
NUMBERS = re.compile(rf"\+?[(]?{NUMBER}(?:[ ().-]{{1,2}}{NUMBER}|\.[OolI|]{{1,3}}(?=\.))*")
MIXED = re.compile(r"[0-9](?:(?=[OolI|])|(?<=[OolI|][0-9]))")


def letter_digits(text: str) -> list[Edit]:
    """Letters that stand for digits in runs of six digits or more, in tokens without other letters."""
    if not MIXED.search(text):
        return []
    edits: list[Edit] = []
    for m in NUMBERS.finditer(text):
        if sum(map(str.isdigit, m[0])) >= 6:
            edits += [(k, k + 1, LETTER_DIGITS[text[k]]) for k in range(*m.span()) if text[k] in LETTER_DIGITS]
    return edits


TRANSDUCERS: tuple[Callable[[str], list[Edit]], ...] = (homoglyphs, letter_digits, spelled_digits, at_dots)


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans of a text, and all spans: plain ones and those the method adds, in order."""
    base = detect(text or "")
    aligned = Aligned(text or "")
    for transducer in TRANSDUCERS:
        if edits := transducer(aligned.text):
            aligned = aligned.rewrite(edits)
    if len(aligned.starts) == 1:
        return base, base
    full = {}
    for kind, spans in detect(aligned.text).items():
        known = base[kind]
        mapped = (aligned.source(*s) for s in spans)
        new = {(a, b) for a, b, edited in mapped if edited and not any(x <= a and b <= y for x, y in known)}
        full[kind] = sorted({*known, *new})
    return base, full


def digest(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, plain spans, all spans and their matched source texts.

    Spans are ``kind:start:end`` in code points of the source, end exclusive, by
    kind and start. Map-only. A null or empty text has no spans; null ids pass
    through; repeated rows give repeated rows; other columns are ignored; an empty
    table gives an empty result. Every pattern is linear in the text, so very long
    texts are taken whole.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {"id": batch.column(0), "base": [], "spans": [], "values": [], **{f"n_{k}": [] for k in KINDS}}
            for text in batch.column(1).to_pylist():
                base, full = find(text)
                out["base"].append(digest(base))
                out["spans"].append(digest(full))
                out["values"].append([text[a:b] for k in KINDS for a, b in full[k]])
                for k in KINDS:
                    out[f"n_{k}"].append(len(base[k]))
            return out

        return work

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, values array<string>"
    return map_arrow(rows, schema, make).withColumnRenamed("id", id_col)
