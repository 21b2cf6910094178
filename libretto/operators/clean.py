"""Cleaning of chapter text, one chain of Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from libretto.functions import text as T
from libretto.functions.fuzzy import ratios
from libretto.functions.repair import repaired
from libretto.functions.scores import chapter_quality, hint_count, repeats

CLEANER_VERSION = "1.0"


def heading_likeness(paragraphs: Column, title: Column, window: int = T.HEADING_WINDOW, least: float = T.HEADING_RATIO) -> Column:
    """Similarity of each of the first ``window`` paragraphs to the title; null where a paragraph is too long to reach ``least``.

    A key grows with its text, so a long paragraph is told by the key of its start.
    """
    longest = F.floor((200 - least) / least * F.length(F.lower(title)) + 1e-9).cast("int")
    key = lambda p: F.when(F.length(T.heading_key(F.left(p, 2 * longest + 16))) <= longest, T.heading_key(p))
    return ratios(T.heading_key(title), F.transform(F.slice(paragraphs, 1, window), key))


def dedup_heading(paragraphs: Column, title: Column, alike: Column, least: float = T.HEADING_RATIO, window: int = T.HEADING_WINDOW, text: Callable[[Column], Column] = lambda p: p) -> Column:
    """Of the first ``window`` paragraphs, those go that repeat the title or are bare headings; no title, no change.

    ``alike`` is a column with their ``heading_likeness``, for the same ``least``; ``text`` gets the string of an element.
    """
    # one paragraph at a time: Python results cannot be read inside a lambda
    kept = []
    for k in range(window):
        p = F.get(paragraphs, F.lit(k))
        gone = T.is_bare_heading(text(p)) | F.coalesce(F.get(alike, F.lit(k)) >= least, F.lit(False))
        kept.append(F.slice(paragraphs, F.lit(k + 1), F.when(p.isNull() | gone, 0).otherwise(1)))
    rest = F.slice(paragraphs, F.lit(window + 1), F.greatest(F.size(paragraphs), F.lit(1)))
    return F.when(T.truthy(title).isNull() | (F.size(paragraphs) == 0), paragraphs).otherwise(F.concat(*kept, rest))


def clean(df: DataFrame, raw: str = "raw_content", title: str | None = "source_title_text", content_format: str | Column = "html", extra: Iterable[str] = (), repair: bool = True, fix: dict | None = None) -> DataFrame:
    """``df`` with paragraphs, cleaned_content, paragraph_count, word_count and cleaner_version.

    ``content_format`` is "html", "text" or a column of these. Null text gives no
    paragraphs. Each step's list is a column of its own, so that no step is written
    out again in the next one's expression.
    """
    kind = F.lit(content_format) if isinstance(content_format, str) else content_format
    source = repaired(F.col(raw)) if repair else F.col(raw)
    out = df.withColumn("__source", source)
    both = F.when(kind == "text", T.plain_paragraphs("__source")).otherwise(T.html_paragraphs("__source"))
    fixed = {"text": T.plain_paragraphs, "html": T.html_paragraphs}.get(content_format) if isinstance(content_format, str) else None
    first = fixed("__source") if fixed else both
    out = out.withColumn("__cut", first)
    out = out.withColumn("__kept", T.drop_boilerplate(F.col("__cut"), extra))
    # from here on each paragraph has its number of words beside it
    out = out.withColumn("__fixed", T.fix_sized(F.col("__kept"), **(fix or {})))
    if title:
        out = out.withColumn("__alike", heading_likeness(F.col("__fixed.p"), F.col(title)))
        out = out.withColumn("__left", dedup_heading(F.col("__fixed"), F.col(title), F.col("__alike"), text=lambda x: x["p"]))
    else:
        out = out.withColumn("__left", F.col("__fixed"))
    out = out.withColumns({"paragraphs": F.col("__left.p"), "word_count": F.aggregate("__left.n", F.lit(0), lambda n, m: n + m)})
    out = out.withColumns({
        "cleaned_content": F.array_join("paragraphs", "\n\n"), "paragraph_count": F.size("paragraphs"), "cleaner_version": F.lit(CLEANER_VERSION),
    })
    return out.drop("__source", "__cut", "__kept", "__fixed", "__alike", "__left")


def clean_and_score(df: DataFrame, **options) -> DataFrame:
    """``clean`` plus the chapter's quality score and its parts."""
    out = clean(df, **options)
    out = out.withColumns({"__hits": hint_count(F.col("paragraphs")), "__again": repeats(F.col("paragraphs"))})
    out = out.withColumn("quality", chapter_quality(F.col("paragraphs"), F.col("word_count"), F.col("__again"), F.col("__hits")))
    return out.withColumn("quality_score", F.col("quality.final_score")).drop("__hits", "__again")


def stale() -> Column:
    """Rows that need cleaning: they have raw content and were not cleaned by this version."""
    return T.truthy("raw_content").isNotNull() & ~F.col("cleaner_version").eqNullSafe(F.lit(CLEANER_VERSION))
