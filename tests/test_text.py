"""Column functions against tables of cases."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from libretto.functions import scores as S
from libretto.functions import text as T
from libretto.functions import urls as U
from libretto.functions.fuzzy import indel_ratio, lcs
from libretto.functions.repair import fix_text, misread, reading, repaired
from libretto.operators.clean import clean


def one(spark, make, *values):
    """Result of a Column function on literal values."""
    return spark.range(1).select(make(*(F.lit(v) for v in values)).alias("x")).first()["x"]


def each(spark, make, cases):
    """Results on many single string values, in one job."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(cases)], "k int, v string")
    return [r["x"] for r in rows.select("k", make(F.col("v")).alias("x")).orderBy("k").collect()]


def test_plain_paragraphs(spark):
    assert each(spark, T.plain_paragraphs, ["a\n\n b \n\n\n\nc", "", None, "one\ntwo"]) == [["a", "b", "c"], [], [], ["one\ntwo"]]


@pytest.mark.parametrize("page,want", [
    ("<p>Hello</p><p>World</p>", ["Hello", "World"]),
    ("One<br>Two<br/>Three", ["One", "Two", "Three"]),
    ("<div><p>A</p><div>B <p>C</p></div></div>", ["A", "B", "C"]),
    ("<p>  lots   of \n space </p>", ["lots of space"]),
    ("<p>wor<b>d</b> <i>x</i></p>", ["wor d x"]),
    ("<p><a href='u'>link</a> and <img src=x></p>", ["link and"]),
    ("<p>a &amp;amp; b &quot;c&quot;</p>", ['a &amp; b "c"']),
    ("<!-- gone --><section>x</section><li>y</li>", ["x y"]),
    ("", []), (None, []),
])
def test_html_paragraphs(spark, page, want):
    assert each(spark, T.html_paragraphs, [page]) == [want]


def test_boilerplate(spark):
    bad = ["Translator's note: hi", "TL: x", "ed note: x", "--- End of Chapter ---", "please read the latest chapter here", "Support the author!", "Stolen novel", "next chapter", "I will donate", "Advertisement", "Chapter 12", "Volume 3.5", "ab"]
    good = ["The hero woke.", "He was a translator by trade.", "Chapter 12 began slowly", "endless fin al", "donated clothes"]
    got = each(spark, T.is_boilerplate, bad + good)
    assert got == [True] * len(bad) + [False] * len(good)
    assert one(spark, lambda p: T.is_boilerplate(p, ["secret"]), "a secret word") is True


def test_blobs_and_orphans(spark):
    blob = " ".join(f"Word {k} is here." for k in range(200))
    groups = each(spark, lambda c: T.split_blob(c), [blob])[0]
    assert " ".join(groups) == blob and all(len(g.split()) <= 200 for g in groups) and len(groups) == 4
    assert each(spark, T.split_blob, ['He said "no." Then left… "Yes!" ok'])[0] == ['He said "no." Then left… "Yes!" ok']
    paras = F.array(F.lit("one two three four"), F.lit("five"), F.lit("six seven eight"))
    row = spark.range(1).select(T.fix_paragraphs(paras).alias("a"), T.fix_paragraphs(paras, merge=True).alias("b")).first()
    assert row["a"] == ["one two three four", "six seven eight"] and row["b"] == ["one two three four five", "six seven eight"]


def test_headings(spark):
    assert each(spark, T.is_bare_heading, ["42", "Chapter 42 – Title", "The hero woke.", "vol. 2", "12.5: x", "Chapter"]) == [True, True, False, True, True, False]
    rows = spark.createDataFrame([("<p>Chapter 1: The Start</p><p>The Start</p><p>It was a dark night.</p>", "The Start"), ("<p>The Start of it</p>", None), (None, "x")], "raw_content string, source_title_text string")
    got = [r["paragraphs"] for r in clean(rows).collect()]
    assert got == [["It was a dark night."], ["The Start of it"], []]


def test_reader(spark):
    assert each(spark, T.reader_paragraphs, ["a\n\nb", "a\nb", "One. Two. Three. Four.", "One. Two.", "", None]) == [["a", "b"], ["a", "b"], ["One. Two. Three.", "Four."], ["One. Two."], [], []]


def test_titles(spark):
    assert each(spark, T.match_key, ["The Legendary Moonlight Sculptor", "of the", "Don't Stop!"]) == ["legendary moonlight sculptor", "", "dont stop"]
    assert each(spark, T.slugify, ["The Legendary Mechanic", "Élan & Vital!", "10,000 Years", "Don't", "--"]) == ["the-legendary-mechanic", "elan-vital", "10000-years", "don-t", ""]
    assert one(spark, T.version_slug, "en", "Wuxia World") == "en-wuxia-world" and one(spark, T.version_slug, "en", "") == "en"
    assert one(spark, T.version_label, "en", "", "mtl") == "MTL (EN)" and one(spark, T.version_label, "en", "Group", "fan") == "Group (EN)" and one(spark, T.version_label, "fr", "", "odd") == "Odd (FR)"


def test_numbers_and_status(spark):
    cases = ["Chapter 42: The Battle", "Chapter 5.5 — Interlude", "Prologue", "ch.7 x", "Interlude #3", "42: Title", "Part 9", None]
    assert each(spark, T.chapter_number, cases) == [42.0, 5.5, None, 7.0, 3.0, 42.0, 9.0, None]
    assert one(spark, T.chapter_number, "Prologue", "https://x/chapter-12") == 12.0
    assert each(spark, T.status, [" On-Going ", "paused", "odd", "", None]) == ["ongoing", "hiatus", None, None, None]
    assert each(spark, T.status_loose, [" Odd ", "on hold"]) == ["odd", "hiatus"]
    assert each(spark, T.parse_tags, ['A, "b";c|[D]', "", "x" * 40]) == [["a", "b", "c", "d"], [], []]
    assert T.parse_csv(" a, ,b ") == ["a", "b"] and T.parse_csv(None) == []


def test_urls(spark):
    assert one(spark, U.normalise, "HTTPS://a.com/x/y/?q=1#f") == "https://a.com/x/y"
    assert [one(spark, U.resolve, "https://a.com/d/e", h) for h in ("/x", "y", "https://b.com/", "//c.com/z", "")] == ["https://a.com/x", "https://a.com/d/y", "https://b.com/", "https://c.com/z", ""]
    assert each(spark, U.novel_slug, ["https://a.com/novel/abc", "https://a.com/p"]) == ["abc", None]
    assert each(spark, U.is_listing, ["https://a.com/Browse/x", "https://a.com/x"]) == [True, False]
    assert each(spark, U.sitemap_locs, ["<urlset><url><loc> https://a/1 </loc></url><sm:loc>https://a/2</sm:loc>"]) == [["https://a/1", "https://a/2"]]


def test_scores(spark):
    def quality(paras, words):
        p = F.array(*map(F.lit, paras)) if paras else F.array().cast("array<string>")
        return spark.range(1).select(S.chapter_quality(p, F.lit(words)).alias("q")).first()["q"]

    empty = quality([], 0)
    assert empty["final_score"] == 0.3 and empty["notes"] == ["empty content"]
    assert quality(["two words"], 2)["final_score"] == 0.3357
    assert quality([f"para {k}" for k in range(30)], 2000)["final_score"] == 1.0
    line = "a line that repeats itself exactly"
    again = quality([line, line + " and on"], 12)
    assert again["has_repetition"] and again["cleanliness_score"] == 0.8
    assert not quality(["short", "short"], 2)["has_repetition"]
    hits = quality(["patreon patreon donate ko-fi stolen"], 5)
    assert hits["boilerplate_hits"] == 5 and hits["cleanliness_score"] == 0.6
    cover = lambda *v: one(spark, S.cover_score, *v)
    assert [cover(300, 450, 100_000), cover(99, 450, 1), cover(0, 450, 1), cover(300, 300, 5000)] == [1.0, 0.05, 0.0, 0.5767]


def test_similarity():
    assert [round(indel_ratio(a, b), 4) for a, b in (("lord of mysteries", "lord of mystery"), ("legendary mechanic", "mechanic legendary"), ("wuxiaworld", "wuxia world"), ("", ""))] == [87.5, 50.0, 95.2381, 100.0]
    assert lcs("abcbdab", "bdcaba") == 4 and lcs("", "x") == 0


def test_repair():
    assert fix_text("cafÃ© “x” ﬁn\r\n") == 'café "x" fin\n' and fix_text(None) is None and fix_text("plain") == "plain"


SENTENCES = (
    "L’été “déjà” vu… – naïve coöperation", "¿Dónde está? ¡Aquí, señor!", "Straße, Größe, ÄÖÜ „gut“", "Привет, мир: как дела?", "日本語の本 です", "SCHÖN IST’S, ÜBERALL!! NICHTS GEHÖRT DÖ!!",
    "5 € – 10 £ ±3° ½", "emoji 😀 ok", "Ελληνικά γράμματα", "plain words", "",
)
#: Text that looks like damage in part, and is none.
CLEAN = ("été…» dit-il", "LIBERTÉ» et MAÇû» fin", "РІК УКРАЇНИ Її", "CAFÉ—bar, word—élan", "──┤ box ├──", "AT&T <b>", "«é» et «à»")


def damaged(text, *names):
    for name in names:
        text = text.encode().decode("latin-1").translate({128 + k: c for k, c in enumerate(reading(name))})
    return text


@pytest.mark.parametrize("names", [("latin-1",), ("cp1252",), ("cp1252", "cp1252"), ("latin-1", "cp1252", "cp1252"), ("cp1252", "latin-1")])
def test_repair_of_nested_damage(names):
    for text in (*SENTENCES, "\n".join(SENTENCES)):
        assert fix_text(damaged(text, *names)) == fix_text(text)
    assert fix_text(f"good é and {damaged('bad é', *names)}") == "good é and bad é"


@pytest.mark.parametrize("name", ["mac_roman", "cp437"])
def test_repair_of_western_text(name):
    for text in (SENTENCES[0], SENTENCES[1], SENTENCES[2], SENTENCES[5]):
        assert fix_text(damaged(text, name)) == fix_text(text)


def test_repair_of_cyrillic_and_windows_controls():
    assert fix_text(damaged("Привет, как дела", "cp1251")) == "Привет, как дела"
    assert fix_text("he said \x93yes\x94\x85") == 'he said "yes"…' and fix_text("Ｆｕｌｌ　ｗｉｄｔｈ\x1b[31m") == "Full width"


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_left_alone(text):
    assert fix_text(text) == text


def test_misread_is_what_python_reads(spark):
    rows = spark.createDataFrame([(t,) for t in SENTENCES], "t string")
    for name in ("latin-1", "cp1252", "mac_roman", "cp1251"):
        got = rows.select("t", misread(F.col("t"), name).alias("bad"), repaired(misread(F.col("t"), name)).alias("good")).collect()
        assert all(r["bad"] == damaged(r["t"], name) for r in got)
        assert all(r["good"] == fix_text(r["bad"]) for r in got)


def test_long_damaged_lines():
    text = "Größe und Maß, déjà vu. " * 8000
    assert fix_text(damaged(text, "cp1252")) == text


class Plain(HTMLParser):
    """Paragraphs as an event parser sees them, with none of the rewriting steps."""

    BREAKS, INLINE = {"p", "div", "blockquote", "br", "hr"}, {"em", "strong", "i", "b", "u", "span"}
    BLOCKS = set("h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tr td th section article main aside header footer nav pre form figure figcaption address body html head title".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = [""]

    def handle_starttag(self, tag, attrs):
        if tag in self.BREAKS:
            self.parts.append("")
        elif tag in self.INLINE or tag in self.BLOCKS:
            self.parts[-1] += " "

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.handle_starttag(tag, ())

    def handle_data(self, data):
        self.parts[-1] += data


def parsed(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    return [p for p in (" ".join(x.split()) for x in parser.parts) if p]


def test_html_paragraphs_against_a_parser(spark):
    rng = random.Random(2)
    tags = [f"<{t}>" for t in "p div blockquote em span h1 ul li table td section a sup custom-x".split()] + ["</p>", "</div>", "</em>", "</a>", "</li>", "<br>", "<br/>", "<hr />", '<p class="x y">', "<A HREF='u'>", "<!-- a <b> c -->", "<!DOCTYPE html>"]
    words = ["one", "two", " ", "\n", "  x ", "&amp;", "&lt;b&gt;", "&nbsp;", "&rdquo;", "é", "5 > 4", "AT&T", "&hellip;"]
    pages = ["".join(rng.choice(tags) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    pages += [re.sub(r"(?s)<(script|style)>.*?</\1>", "", r["html"]) for r in table]
    got = spark.createDataFrame(list(enumerate(pages)), "k long, html string").select("k", T.html_paragraphs(F.col("html")).alias("p")).collect()
    assert len(got) > 440
    for r in got:
        assert r["p"] == parsed(pages[r["k"]]), pages[r["k"]]
