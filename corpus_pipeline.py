"""A corpus pipeline of five stages over ``documents``.

Language ID, line dedup, near-dedup, decontamination and mixing, each working on
all that the stage before it kept. Every stage but the last returns the columns
of ``documents`` (doc_id, text, lang, source, n_chars); the last adds ``copies`` and
``taken``. A stage ignores columns beyond these, whatever their names. Ids may be
null or repeat, whole rows may repeat, any column may be null, texts may be empty or
of any length, and an empty table gives an empty one; what each stage does with
such rows its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libretto.llm import decontaminate, langid, line_dedup, mixing, simhash
from libretto.llm.common import remainder, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Cosine that a long text must reach with some language, and what a text needs per character until then: a few words say little.
LEAST_COSINE, COSINE_PER_CHAR = 0.2, 0.001


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that resemble no learned language, the longer the text the more it must.

    Null texts and those without a letter go. The languages are learned from rows
    with a lang whose id is not held out; rows without an id are judged but not
    learned from. Without a labelled row no language is known and every row goes.
    Rows are judged one by one, so repeated rows stay or go together.
    """
    admitted = F.coalesce(remainder(F.col("doc_id"), 4) != 2, F.lit(False))
    rows = docs.select(*COLUMNS)
    found = langid.predict(rows, langid.learn(rows, "text", "lang", admitted))
    least = F.least(F.lit(LEAST_COSINE), F.length("text") * COSINE_PER_CHAR)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines and counts the characters anew; no row goes.

    Null is a source of its own; a null text stays null, with null n_chars; repeated
    rows count as one page and lose the same lines.
    """
    found = line_dedup.drop_boilerplate(docs.select(*COLUMNS), carry=("lang",))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each near-duplicate class; one without an id where none has one.

    Null, empty and blank texts are one class; of rows with the same id and text one
    stays; rows that share an id but not their text are told apart.
    """
    return simhash.keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold ten words in a row of a benchmark item, or of which a shorter item makes up half the words.

    Null and empty texts stay; repeated rows stay or go together; a null id is an id
    like any other; items without words match nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), items)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds how many copies the mix takes of each row, and their words; rows it does not take go.

    Null is a source of its own, last in order; null and empty texts have no words
    and are taken as often as their source's share says, for no words; rows are told
    apart by a stored number, so repeated rows are taken each by itself.
    """
    rows = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    found = mixing.mix(rows, carry=("row",)).where(F.col("copies") > 0).select(F.col("row").alias("mixed"), "copies", "taken")
    return rows.join(found, F.col("row") == F.col("mixed")).select(*COLUMNS, "copies", "taken")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
]

#: Three stages are not expressible in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
