"""Numeric scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from libretto.functions.text import holds_any

LEAST_WORDS, TARGET_WORDS, MOST_WORDS, TARGET_PARAGRAPHS = 500, 2000, 15_000, 30
#: Wording that hints at boilerplate left in a text.
HINTS = r"(?i)(translator|tl note|patreon|stolen|read on|support the|ko-fi|donate)"
HINT_WORDS = tuple(HINTS.removeprefix("(?i)(").removesuffix(")").split("|"))
REPETITION = r"(?d)(.{20,}+)\n\1"
#: Fields that count towards completeness, fully and as a bonus.
IMPORTANT = ("title", "synopsis", "author", "status", "cover_url", "genres")
BONUS = ("original_title", "original_language", "translator_group", "total_chapters", "release_year", "tags")


def length_score(n: Column) -> Column:
    return (
        F.when(n == 0, 0.0)
        .when(n < LEAST_WORDS, n / LEAST_WORDS * 0.5)
        .when(n > MOST_WORDS, 0.5)
        .otherwise(0.5 + F.least(n, F.lit(TARGET_WORDS)) / TARGET_WORDS * 0.5)
    )


def structure_score(n_words: Column, n_paragraphs: Column) -> Column:
    return (
        F.when(n_paragraphs == 0, 0.0)
        .when(n_paragraphs == 1, 0.1)
        .when(n_words / n_paragraphs > 500, 0.3)
        .otherwise(0.4 + F.least(n_paragraphs, F.lit(TARGET_PARAGRAPHS)) / TARGET_PARAGRAPHS * 0.6)
    )


def hint_count(paragraphs: Column) -> Column:
    # none of the words holds a line's end, so few texts have to be counted
    any_ = F.exists(paragraphs, lambda p: holds_any(p, HINT_WORDS))
    return F.when(~any_, 0).otherwise(F.regexp_count(F.array_join(paragraphs, "\n"), F.lit(HINTS)))


def repeats(paragraphs: Column) -> Column:
    """Twenty or more characters that end a line and start the next one.

    The pattern is quadratic in a line, so it is tried only on pairs of lines of
    which the first holds the second's first twenty characters, as it must.
    """
    lines = F.split(F.array_join(paragraphs, "\n"), "\n")
    pairs = F.arrays_zip(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))).alias("a"), F.slice(lines, F.lit(2), F.size(lines)).alias("b"))
    head = lambda x: F.left(x["b"], F.lit(20))
    again = lambda x: (F.length(x["b"]) >= 20) & (F.instr(x["a"], head(x)) > 0) & F.concat(x["a"], F.lit("\n"), x["b"]).rlike(REPETITION)
    return F.exists(pairs, again)


def cleanliness(hits: Column, repetition: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.when(hits > 0, F.least(hits * 0.1, F.lit(0.4))).otherwise(0.0) - F.when(repetition, 0.2).otherwise(0.0))


def chapter_quality(paragraphs: Column, n_words: Column, repetition: Column | None = None, hits: Column | None = None) -> Column:
    """Struct of the sub-scores, the final score and the ordered notes. Columns that hold ``repeats`` and ``hint_count`` save computing them at each mention."""
    n, hits = F.size(paragraphs), hint_count(paragraphs) if hits is None else hits
    again = repeats(paragraphs) if repetition is None else repetition
    final = F.round(0.35 * length_score(n_words) + 0.35 * structure_score(n_words, n) + 0.30 * cleanliness(hits, again), 4)
    note = lambda test, text: F.when(test, text)
    notes = F.array(
        note(n_words == 0, F.lit("empty content")),
        note((n_words > 0) & (n_words < LEAST_WORDS), F.format_string("short chapter (%d words)", n_words)),
        note(n_words > MOST_WORDS, F.format_string("suspiciously long (%d words)", n_words)),
        note(n == 1, F.lit("single blob paragraph")),
        note((n > 1) & (n_words / n > 500), F.lit("unusually long average paragraph")),
        note(hits > 0, F.format_string("%d boilerplate hit(s)", hits)),
        note(again, F.lit("repetitive content detected")),
    )
    return F.struct(
        n_words.cast("int").alias("word_count"), n.alias("paragraph_count"), hits.alias("boilerplate_hits"), again.alias("has_repetition"),
        length_score(n_words).alias("length_score"), structure_score(n_words, n).alias("structure_score"), cleanliness(hits, again).alias("cleanliness_score"),
        final.alias("final_score"), F.array_compact(notes).alias("notes"),
    )


def present(c: Column, kind: str) -> Column:
    """Whether a value counts as there: not null, empty, zero or without elements."""
    if kind.startswith("array"):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind in ("int", "bigint", "double", "float"):
        return F.coalesce(c != 0, F.lit(False))
    return F.coalesce(c != "", F.lit(False))


def completeness(kinds: dict[str, str], prefix: str = "") -> Column:
    """Completeness of a metadata record whose columns have the given types; columns not named are absent."""
    count = lambda names: sum((present(F.col(prefix + n), kinds[n]).cast("int") for n in names if n in kinds), F.lit(0))
    return F.round(F.least(count(IMPORTANT) / len(IMPORTANT) + count(BONUS) / len(BONUS) * 0.2, F.lit(1.0)), 4)


def cover_score(width: Column, height: Column, size: Column) -> Column:
    """Resolution, aspect near 2:3, and file size of a cover."""
    w, h = width, height
    res = 0.5 * F.least(w / 300, F.lit(1.0)) + 0.5 * F.least(h / 450, F.lit(1.0))
    aspect = F.greatest(F.lit(0.0), 1 - 2 * F.abs(w / h - F.lit(2.0) / 3))
    bytes_ = F.when(size.isNull() | (size == 0), 1.0).when(size < 10_000, 0.3).when(size > 10_000_000, 0.5).otherwise(1.0)
    score = F.round(0.5 * res + 0.3 * aspect + 0.2 * bytes_, 4)
    none = w.isNull() | h.isNull() | (w == 0) | (h == 0)
    return F.when(none, 0.0).when((w < 100) | (h < 100), 0.05).otherwise(score)


def claim_confidence(quality: Column) -> Column:
    return F.coalesce(F.nullif(quality, F.lit(0.0)), F.lit(0.5))
