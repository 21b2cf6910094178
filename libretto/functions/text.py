"""Text functions as Column expressions (no Python at run time)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: White space of any script.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Text) -> Column:
    """Without white space at both ends: only the ends are read, however long a run inside is."""
    return F.btrim(_c(x), F.lit(SPACES))


def collapse(x: Text) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def words(x: Text) -> Column:
    """Words between white space; none for null and blank text."""
    t = strip(F.coalesce(_c(x), F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?U)\s+"))


def word_count(x: Text) -> Column:
    t = strip(F.coalesce(_c(x), F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def total_words(paragraphs: Column) -> Column:
    return F.aggregate(paragraphs, F.lit(0), lambda n, p: n + word_count(p))


def truthy(x: Text) -> Column:
    """Null for null and for the empty string."""
    return F.nullif(_c(x), F.lit(""))


def plain_paragraphs(x: Text) -> Column:
    """Paragraphs between blank lines, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), "\n\n"), strip), lambda p: p != "")


#: Tags that the sanitiser keeps: those that end a paragraph and those that stand within one.
KEPT_BREAKS, KEPT_INLINE = "p|div|blockquote|br|hr", "em|strong|i|b|u|span"
#: Block-level tags that the sanitiser takes away, leaving white space.
LOST_BLOCKS = "h[1-6]|ul|ol|li|dl|dt|dd|table|tbody|thead|tr|td|th|section|article|main|aside|header|footer|nav|pre|form|figure|figcaption|address|body|html|head|title"
#: Character references decoded natively; the ampersand comes last.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"),
    ("&ldquo;", "“"), ("&rdquo;", "”"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"),
)
#: Rewrites of an HTML string, in order, in the syntax that Java's and RE2's regular expressions share.
HTML_STEPS = (
    (r"(?s)<!--.*?-->|<![^>]*>", ""),
    (rf"(?i)</?(?:{KEPT_BREAKS})(?:\s[^>]*)?/?>", "\x01"),
    (rf"(?i)</?(?:{KEPT_INLINE})(?:\s[^>]*)?/?>", " "),
    (rf"(?i)</?(?:{LOST_BLOCKS})(?:\s[^>]*)?/?>", " "),
    (r"</?[A-Za-z][^>]*>", ""),
)


def decode_entities(x: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, x)


def html_paragraphs(x: Text) -> Column:
    """Paragraphs of sanitised HTML: the tag sequence decides where text is cut, so no tree is built."""
    t = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), HTML_STEPS, F.coalesce(_c(x), F.lit("")))
    return F.filter(F.transform(F.split(decode_entities(t), "\x01"), collapse), lambda p: p != "")


#: Patterns of paragraphs that are boilerplate, by name.
BOILERPLATE: dict[str, str] = {
    "translator_note": r"^\s*(translator'?s?\s+note|tl\s*note|tln?|t/n)[:\s]",
    "editor_note": r"^\s*(editor'?s?\s+note|ed\s*note|e/n)[:\s]",
    "chapter_end": r"^\s*[-—~*=\s]*(end\s+of\s+chapter|chapter\s+end|fin)[-—~*=\s]*$",
    "read_on_site": r"read\s+(this|the\s+latest|more|on|at|from)\s+(novel|chapter|update)",
    "support_author": r"(support\s+the\s+(author|translator)|buy\s+the\s+(book|raw|raws))",
    "piracy_warning": r"(if\s+you\s+are\s+reading\s+this\s+(novel|chapter)\s+on\s+any\s+other\s+site|stolen\s+(novel|content)|this\s+chapter\s+is\s+stolen)",
    "chapter_nav": r"^\s*(previous|next)\s+chapter\s*$",
    "donation": r"(patreon|ko-fi|donate|paypal)\b",
    "advertisement": r"^\s*advertisement\s*$",
    "bare_chapter_heading": r"^\s*chapter\s+\d+(\.\d+)?\s*$",
    "bare_volume_heading": r"^\s*(volume|book|arc|part)\s+\d+(\.\d+)?\s*$",
}
#: One alternation of all patterns, and one of those that stand at the start of a paragraph.
BOILERPLATE_ANY = "(?i)" + "|".join(f"(?:{p})" for p in BOILERPLATE.values())
BOILERPLATE_START = "(?i)^(?:" + "|".join(f"(?:{p[1:]})" for p in BOILERPLATE.values() if p.startswith("^")) + ")"
#: What any match of the other patterns holds. Few paragraphs do, and only these are searched at every place.
BOILERPLATE_WORDS = ("read", "support", "buy", "stolen", "patreon", "ko-fi", "donate", "paypal")


def holds_any(x: Text, parts: Iterable[str]) -> Column:
    """Whether a text holds one of some strings, which are ASCII in lower case, in whatever case."""
    # a list of one, so that the lower case is made once
    return F.exists(F.array(F.lower(_c(x))), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(s)) for s in parts)))


def is_boilerplate(p: Column, extra: Iterable[str] = ()) -> Column:
    """Too short to be text, or a pattern is found anywhere in it."""
    t, own = strip(p), "|".join(f"(?:{x})" for x in extra)
    found = (F.length(t) < 3) | t.rlike(BOILERPLATE_START) | (holds_any(t, BOILERPLATE_WORDS) & t.rlike(BOILERPLATE_ANY))
    return found | t.rlike("(?i)" + own) if own else found


def drop_boilerplate(paragraphs: Column, extra: Iterable[str] = ()) -> Column:
    extra = tuple(extra)
    return F.filter(paragraphs, lambda p: ~is_boilerplate(p, extra))


#: Words from which a paragraph is a blob, words of a group it is cut into, fewest words of a paragraph.
BLOB_WORDS, GROUP_WORDS, MIN_WORDS = 500, 200, 3
#: Fixed value: where a sentence ends.
SENTENCE_GAP = r"""(?U)(?<=[.!?…])\s+|(?<=[.!?…]["'])\s+"""


def sized(paragraphs: Column) -> Column:
    """Paragraphs as structs of the text ``p`` and its number of words ``n``, which is counted once."""
    return F.transform(paragraphs, lambda p: F.struct(p.alias("p"), word_count(p).alias("n")))


def split_sized(p: Column) -> Column:
    """Sentences of a blob, gathered in order into groups of up to GROUP_WORDS words; each group's words are its sentences' words."""
    sentences = sized(F.filter(F.transform(F.split(p, SENTENCE_GAP), strip), lambda s: s != ""))
    start = F.struct(F.array().cast("array<struct<p:string,n:int>>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))
    group = lambda acc: F.array(F.struct(acc["open"].alias("p"), acc["n"].alias("n")))

    def add(acc: Column, s: Column) -> Column:
        full = acc["open"].isNotNull() & (acc["n"] + s["n"] > GROUP_WORDS)
        return F.struct(
            F.when(full, F.concat(acc["done"], group(acc))).otherwise(acc["done"]).alias("done"),
            F.when(full | acc["open"].isNull(), s["p"]).otherwise(F.concat(acc["open"], F.lit(" "), s["p"])).alias("open"),
            F.when(full, s["n"]).otherwise(acc["n"] + s["n"]).alias("n"),
        )

    return F.aggregate(sentences, start, add, lambda acc: F.when(acc["open"].isNull(), sized(F.array(p))).otherwise(F.concat(acc["done"], group(acc))))


def split_blob(p: Column) -> Column:
    """Sentences of a blob, gathered in order into groups of up to GROUP_WORDS words."""
    return split_sized(p)["p"]


def merge_orphans(paragraphs: Column, min_words: int = MIN_WORDS) -> Column:
    """Paragraphs below ``min_words`` words are appended to the one before."""

    def add(acc: Column, p: Column) -> Column:
        last = F.size(acc)
        short = (word_count(p) < min_words) & (last > 0)
        merged = F.concat(F.slice(acc, F.lit(1), last - 1), F.array(F.concat(F.rtrim(F.element_at(acc, -1), F.lit(SPACES)), F.lit(" "), F.ltrim(p, F.lit(SPACES)))))
        return F.when(short, merged).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(paragraphs, F.array().cast("array<string>"), add)


def fix_sized(paragraphs: Column, blob_words: int = BLOB_WORDS, min_words: int = MIN_WORDS, split_blobs: bool = True, merge: bool = False) -> Column:
    """``fix_paragraphs``, and each one's number of words, as ``sized``."""
    out = sized(paragraphs)
    if split_blobs:
        out = F.flatten(F.transform(out, lambda x: F.when(x["n"] >= blob_words, split_sized(x["p"])).otherwise(F.array(x))))
    if merge:
        out = sized(merge_orphans(out["p"], min_words))
    return F.filter(out, lambda x: x["n"] >= min_words)


def fix_paragraphs(paragraphs: Column, blob_words: int = BLOB_WORDS, min_words: int = MIN_WORDS, split_blobs: bool = True, merge: bool = False) -> Column:
    """Blobs are split, orphans merged if asked for, and what is still too short goes."""
    return fix_sized(paragraphs, blob_words, min_words, split_blobs, merge)["p"]


#: Paragraphs from the top that may repeat the chapter's title, and the least similarity.
HEADING_WINDOW, HEADING_RATIO = 4, 85.0
#: Fixed value: a heading that says no more than its number.
BARE_HEADING = r"(?i)^\s*(chapter|ch\.?|vol\.?|volume|book|arc|part)?\s*\d+(\.\d+)?(\s*[-–—:]\s*.{0,80})?\s*$"


def is_bare_heading(p: Text) -> Column:
    return strip(p).rlike(BARE_HEADING)


def heading_key(x: Text) -> Column:
    """Lower case; all but ASCII letters, digits and white space become spaces; collapsed."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]+", " "))


def reader_paragraphs(x: Text) -> Column:
    """Text cut for display: at blank lines, else at lines, else three sentences at a time."""
    t = F.coalesce(_c(x), F.lit(""))
    by = lambda sep: F.filter(F.transform(F.split(t, sep), strip), lambda p: p != "")
    sentences = F.split(t, r"""(?U)(?<=[.!?])\s+(?=[A-Z"“])""")
    starts = F.sequence(F.lit(1), F.greatest(F.size(sentences), F.lit(1)), F.lit(3))
    grouped = F.filter(F.transform(starts, lambda k: strip(F.array_join(F.slice(sentences, k, 3), " "))), lambda p: p != "")
    whole = F.when(strip(t) == "", F.array().cast("array<string>")).otherwise(F.array(strip(t)))
    return F.when(F.size(by("\n\n")) > 1, by("\n\n")).when(F.size(by("\n")) > 1, by("\n")).when(F.size(sentences) > 2, grouped).otherwise(whole)


#: Words that do not count when titles are compared.
STOP_WORDS = (
    "the", "a", "an", "of", "in", "to", "is", "it", "as", "and", "or", "for", "on", "with", "at", "by", "from", "i", "ii", "iii", "iv",
    "novel", "light", "manga", "manhwa", "manhua", "webtoon", "omniscient", "reader", "viewpoint", "view", "point",
)


def match_key(title: Text) -> Column:
    """Title for fuzzy comparison: lower case, punctuation gone, stop words dropped."""
    kept = F.regexp_replace(F.lower(_c(title)), r"[^a-z0-9\s]", "")
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_join(F.filter(F.split(F.trim(F.regexp_replace(kept, r"\s+", " ")), " "), lambda w: (w != "") & ~F.array_contains(stop, w)), " ")


#: Accented letters and what they are written as in a slug.
ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěğìíîïīįıłñńňòóôõöøōőŕřśşšťţùúûüūůűųýÿźżž"
PLAIN = (
    "a" * 9 + "c" * 3 + "d" * 2 + "e" * 8 + "g" + "i" * 7 + "l" + "n" * 3 + "o" * 8 + "r" * 2 + "s" * 3 + "t" * 2 + "u" * 8 + "y" * 2 + "z" * 3
)


def slugify(x: Text) -> Column:
    """ASCII kebab case: accents folded, commas inside numbers removed, other runs become one hyphen."""
    t = F.translate(F.lower(_c(x)), ACCENTED, PLAIN)
    t = F.replace(F.replace(F.replace(t, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))
    t = F.regexp_replace(t, r"(?<=\d),(?=\d)", "")
    return F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def version_slug(language: Text, group: Text) -> Column:
    return slugify(F.concat_ws("-", _c(language), truthy(group)))


#: Labels of version types without a translator group.
VERSION_LABELS = {"official": "Official", "mtl": "MTL", "original": "Original", "fan": "Fan Translation", "revised": "Revised"}


def version_label(language: Text, group: Text, kind: Text) -> Column:
    name = F.coalesce(truthy(group), lookup(VERSION_LABELS, _c(kind)), F.initcap(_c(kind)))
    return F.concat(name, F.lit(" ("), F.upper(_c(language)), F.lit(")"))


def token_sort(x: Text) -> Column:
    return F.array_join(F.array_sort(words(x)), " ")


#: Patterns of chapter numbers, in the order they are tried.
CHAPTER_NUMBERS = (
    r"(?i)chapter\s+(\d+(?:\.\d+)?)",
    r"(?i)\bch\.?\s*(\d+(?:\.\d+)?)\b",
    r"#\s*(\d+(?:\.\d+)?)",
    r"^\s*(\d+(?:\.\d+)?)\s*[:\-–—]",
    r"(\d+(?:\.\d+)?)\s*$",
)


def chapter_number(title: Text, url: Text | None = None) -> Column:
    """First number that a pattern finds, in the title and then in the address; null if none."""
    found = [F.nullif(F.regexp_extract(_c(x), p, 1), F.lit("")).try_cast("double") for x in (title, url) if x is not None for p in CHAPTER_NUMBERS]
    return F.coalesce(*found)


#: Spellings of a status; anything else is unknown.
STATUS = {
    "ongoing": "ongoing", "on-going": "ongoing", "active": "ongoing", "updating": "ongoing", "new": "ongoing", "hot": "ongoing",
    "completed": "completed", "complete": "completed", "finished": "completed", "end": "completed", "ended": "completed", "full": "completed",
    "hiatus": "hiatus", "on hiatus": "hiatus", "on hold": "hiatus", "pause": "hiatus", "paused": "hiatus",
    "dropped": "dropped", "cancelled": "dropped", "canceled": "dropped", "discontinued": "dropped", "abandoned": "dropped",
}
#: The shorter list, whose unknown spellings pass through.
STATUS_LOOSE = {
    "ongoing": "ongoing", "active": "ongoing", "updating": "ongoing", "completed": "completed", "complete": "completed", "finished": "completed",
    "hiatus": "hiatus", "on hold": "hiatus", "dropped": "dropped", "cancelled": "dropped",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def status(x: Text) -> Column:
    """Canonical status or null."""
    return lookup(STATUS, strip(F.lower(_c(x))))


def status_loose(x: Text, overrides: dict[str, str] | None = None) -> Column:
    """Canonical status, or the stripped lower-case input."""
    key = strip(F.lower(_c(x)))
    return F.coalesce(lookup(STATUS_LOOSE | (overrides or {}), key), key)


def parse_tags(x: Text) -> Column:
    """Tags of a delimited list: stripped of quotes and brackets, lower case, 1 to 39 characters."""
    tag = lambda t: F.lower(F.regexp_replace(strip(t), r'^[\[\]"]+|[\[\]"]+$', ""))
    return F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), r"[,;|]+"), tag), lambda t: (F.length(t) > 0) & (F.length(t) < 40))


def parse_csv(x: str | None) -> list[str]:
    return [p for p in (s.strip() for s in (x or "").split(",")) if p]


def list_claim(x: Column) -> Column:
    """A list as one claim value; null for none."""
    return truthy(F.array_join(x, ", "))


def int_claim(x: Column) -> Column:
    return F.nullif(x.cast("string"), F.lit("0"))


def chapter_label(number: Column, title: Column) -> Column:
    return F.coalesce(truthy(title), F.concat(F.lit("Chapter "), F.floor(number).cast("string")))


#: Characters of a description shown.
PREVIEW = 160


def preview(x: Text, size: int = PREVIEW) -> Column:
    """The start of a text for display."""
    return F.left(F.coalesce(_c(x), F.lit("")), F.lit(size))


def short_date(x: Text) -> Column:
    """Abbreviated month and day."""
    return F.date_format(_c(x), "MMM dd")
