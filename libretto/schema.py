"""The eight tables: types, natural keys, defaults, deterministic ids, integrity helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from libretto.plans.store import stored

_STAMPS = "created_at timestamp, updated_at timestamp"

DDL: dict[str, str] = {
    "works": f"id string not null, slug string not null, title string, original_language string, status string, synopsis string, selected_cover_id string, {_STAMPS}",
    "versions": f"id string not null, work_id string not null, slug string not null, label string, translator_group string, language string not null, version_type string not null, is_active boolean not null, {_STAMPS}",
    "source_titles": f"id string not null, version_id string, source_site string not null, source_id string not null, source_url string not null, raw_metadata string, quality_score double, last_scraped_at timestamp, is_metadata_authoritative boolean not null, {_STAMPS}",
    "metadata_claims": f"id string not null, source_title_id string not null, field_name string not null, raw_value string not null, normalised_value string, claim_hash string not null, confidence double not null, is_resolved boolean not null, {_STAMPS}",
    "cover_candidates": f"id string not null, source_title_id string not null, source_url string not null, local_path string, width int, height int, file_size int, image_format string, quality_score double, is_selected boolean not null, {_STAMPS}",
    "version_chapters": f"id string not null, version_id string not null, chapter_number double not null, title string, content string, word_count int, promoted_from_id string, {_STAMPS}",
    "source_chapters": f"id string not null, source_title_id string not null, version_chapter_id string, source_url string not null, source_chapter_id string, chapter_number double, source_title_text string, raw_content string, content_format string, cleaned_content string, paragraph_count int, word_count int, quality_score double, cleaner_version string, last_scraped_at timestamp, last_cleaned_at timestamp, {_STAMPS}",
    "ingestion_jobs": f"id string not null, source_site string not null, source_url string not null, source_title_id string, job_type string not null, status string not null, error_message string, error_detail string, chapters_found int, chapters_new int, chapters_updated int, extra string, started_at timestamp, completed_at timestamp, {_STAMPS}",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


#: Natural keys: unique in each table.
KEYS: dict[str, tuple[str, ...]] = {
    "works": ("slug",),
    "versions": ("work_id", "slug"),
    "source_titles": ("source_site", "source_id"),
    "metadata_claims": ("source_title_id", "field_name", "claim_hash"),
    "cover_candidates": ("source_title_id", "source_url"),
    "version_chapters": ("version_id", "chapter_number"),
    "source_chapters": ("source_title_id", "source_chapter_id"),
    "ingestion_jobs": ("id",),
}

#: Child table, its column, parent table, and what a deleted parent does to the child.
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("versions", "work_id", "works", "cascade"),
    ("source_titles", "version_id", "versions", "cascade"),
    ("metadata_claims", "source_title_id", "source_titles", "cascade"),
    ("cover_candidates", "source_title_id", "source_titles", "cascade"),
    ("version_chapters", "version_id", "versions", "cascade"),
    ("source_chapters", "source_title_id", "source_titles", "cascade"),
    ("source_chapters", "version_chapter_id", "version_chapters", "set null"),
    ("ingestion_jobs", "source_title_id", "source_titles", "set null"),
)

DEFAULTS: dict[str, dict[str, object]] = {
    "versions": {"language": "en", "version_type": "fan", "is_active": True},
    "source_titles": {"raw_metadata": "{}", "is_metadata_authoritative": False},
    "metadata_claims": {"confidence": 0.5, "is_resolved": False},
    "cover_candidates": {"is_selected": False},
    "ingestion_jobs": {"job_type": "full", "status": "pending", "extra": "{}"},
}

#: The recognised names of claim fields.
CLAIM_FIELDS = (
    "title", "original_title", "alternative_titles", "author", "artist", "translator_group", "synopsis", "status",
    "language", "original_language", "genres", "tags", "release_year", "total_chapters", "release_frequency",
)
STATUSES = ("ongoing", "completed", "hiatus", "dropped")
VERSION_TYPES = ("official", "fan", "mtl", "original", "revised")

RAW_METADATA = (
    "source_id string, source_url string, title string, original_title string, author string, artist string, translator_group string, synopsis string, "
    "cover_url string, status string, language string, original_language string, genres array<string>, tags array<string>, release_year int, total_chapters int, extra map<string,string>"
)
RAW_LISTING = "source_chapter_id string, source_url string, title string, chapter_number double, release_date string"
RAW_CONTENT = "source_chapter_id string, source_url string, title string, chapter_number double, raw_content string, content_format string"


def det_id(*key: Column | str) -> Column:
    """Deterministic row id: md5 of the natural key, so that re-runs agree."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("\0")) for k in key]
    return F.md5(F.concat_ws("|", *parts))


def empty(spark, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order: missing ones null or default, types cast."""
    defaults = DEFAULTS.get(table, {})
    have = set(df.columns)
    out = []
    for f in schema(table):
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(c, F.lit(defaults[f.name])) if f.name in defaults else c).alias(f.name))
    return df.select(*out)


def duplicates(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*columns).count().where(F.col("count") > 1)


def assert_unique(df: DataFrame, columns: tuple[str, ...]) -> None:
    if bad := duplicates(df, columns).head(1):
        raise AssertionError(f"{columns} not unique: {bad[0]}")


def doomed(tables: dict[str, DataFrame], table: str, condition: Column) -> dict[str, DataFrame]:
    """The ids that go with a delete, by table, each stored: few ids are broadcast to the tables that hold them, by their size on disk."""
    gone = {table: stored(tables[table].where(condition).select("id"), f"gone-{table}")}
    order = ["works", "versions", "source_titles", "version_chapters", "metadata_claims", "cover_candidates", "source_chapters", "ingestion_jobs"]
    parents = {parent for _, _, parent, _ in FOREIGN_KEYS}
    for child in order[order.index(table) + 1 :]:
        # what nothing refers to needs no list of its own
        if child not in tables or child not in parents:
            continue
        lost = [tables[child].join(_ids(gone[p]), F.col(c) == F.col("__gone"), "left_semi").select("id") for c, p in _kept_keys(child, gone, "cascade")]
        if lost:
            gone[child] = stored(reduce(DataFrame.unionAll, lost).distinct(), f"gone-{child}")
    return gone


def _ids(gone: DataFrame) -> DataFrame:
    return gone.select(F.col("id").alias("__gone"))


def _kept_keys(child: str, gone: dict[str, DataFrame], action: str) -> list[tuple[str, str]]:
    """Columns of a table, and their parents, that lose ids in a delete and answer it so."""
    return [(c, p) for t, c, p, a in FOREIGN_KEYS if t == child and p in gone and a == action]


def affected(gone: dict[str, DataFrame]) -> list[str]:
    """The tables that refer to one of which ids go."""
    return [child for child in DDL if any(t == child and p in gone for t, _, p, _ in FOREIGN_KEYS)]


def touched(df: DataFrame, child: str, gone: dict[str, DataFrame]) -> list[DataFrame]:
    """The rows of a child table that go or lose a reference, once for each key."""
    keys = _kept_keys(child, gone, "cascade") + _kept_keys(child, gone, "set null")
    return [df.join(_ids(gone[p]), F.col(c) == F.col("__gone"), "left_semi") for c, p in keys]


def bereft(df: DataFrame, child: str, gone: dict[str, DataFrame]) -> DataFrame:
    """A child table after its parents' ids are gone."""
    for column, parent in _kept_keys(child, gone, "cascade"):
        df = df.join(_ids(gone[parent]), F.col(column) == F.col("__gone"), "left_anti")
    for column, parent in _kept_keys(child, gone, "set null"):
        marked = df.join(_ids(gone[parent]), F.col(column) == F.col("__gone"), "left")
        cleared = F.when(F.col("__gone").isNull(), F.col(column)).alias(column)
        df = marked.select(*(cleared if n == column else F.col(n) for n in df.columns))
    return df


def delete_rows(tables: dict[str, DataFrame], table: str, condition: Column) -> dict[str, DataFrame]:
    """Tables after a delete: children cascade, or lose the reference. Rows where the condition is null stay."""
    gone = doomed(tables, table, condition)
    out = dict(tables)
    out[table] = tables[table].where(~F.coalesce(condition, F.lit(False)))
    for child in affected(gone):
        if child in out:
            out[child] = bereft(out[child], child, gone)
    return out
