"""The cleaning step at size: what goes to Python, what travels, and the cheap tests in front of dear ones."""

import re

import pytest
from pyspark.sql import functions as F

from libretto import queries  # noqa: F401  (first: it imports composites)
from libretto import composites
from libretto.functions import repair
from libretto.functions import scores as S
from libretto.functions import text as T
from libretto.functions.fuzzy import indel_ratio
from libretto.operators import clean, resolve
from libretto.plans.store import BATCH, small_batches

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def cleaned(spark, sf, monkeypatch):
    """What holds while the resolver writes its cleaned texts: the bytes of a batch, and the plan."""
    seen, kept = {}, resolve.stored
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def stored(df, name):
        if name == "cleaned":
            seen["bytes"], seen["plan"] = spark.conf.get(BYTES, None), df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(resolve, "stored", stored)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    resolve.resolve_chapters(*composites.chapter_tables(spark, sf), composites.at())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    return seen


def test_python_gets_texts_by_their_bytes(spark, cleaned):
    assert int(cleaned["bytes"]) == BATCH and spark.conf.get(BYTES, None) is None


def test_texts_do_not_travel_to_few_titles(cleaned):
    assert "BroadcastHashJoin" in cleaned["plan"] and "Exchange hashpartitioning" not in cleaned["plan"]


def test_batches_are_cut_and_the_setting_returns(spark):
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"), "id")
    spark.conf.set(BYTES, "256m")
    with small_batches(spark):
        # the text goes along, so that it counts
        longest = texts.select(F.pandas_udf(lambda x, t: x * 0 + len(x), "long")("id", "t").alias("n")).agg(F.max("n")).first()[0]
    assert longest * 100_000 < 2 * BATCH and spark.conf.get(BYTES) == "256m"
    spark.conf.unset(BYTES)


def test_odd_is_what_repair_may_change(spark):
    texts = [f"a{chr(c)}b" for c in (*range(0x250), 0x2019, 0xFB01, 0xFEFF, 0xFF21, 0x1F600)] + ["", "tab\tand\nline", "x\r\ny", "a &amp; b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", repair.odd(F.col("t")).alias("odd"), repair.repaired(F.col("t")).alias("fixed")).collect()
    assert all(r["fixed"] == repair.fix_text(r["t"]) for r in rows)
    assert {r["t"] for r in rows if not r["odd"]} == {t for t in texts if t.isascii() and "&" not in t and "\r" not in t and not repair.CONTROL.search(t)}


def test_long_runs_are_not_kept():
    runs = repair.Runs(repair.TABLE)
    assert runs["日本" * 100, True, False] == "日本" * 100 and runs["“é”", False, False] == '"é"' and list(runs) == [("“é”", False, False)]
    assert repair.fix_text("“é”\x1b［0m") == '"é"[0m' and repair.fix_text("“é”\x1b[0m") == '"é"'


PARAGRAPHS = [
    "Please READ  the latest Chapter", "readers and bread", "SUPPORT\tthe author", "buy the raws", "stolen content", "This chapter is Stolen", "If you are reading this novel on any other site",
    "my PatReon page", "ko-fi", "donate now", "donated", "PayPal", "  TL note: x", "a TL note: x", "- end of chapter -", "Next  chapter", "next chapter is", "translator", "Volume 3", "ab", "été ß İI", "read on, Donate",
]


def test_cheap_tests_change_no_verdict(spark):
    rows = spark.createDataFrame([(p,) for p in PARAGRAPHS], "p string")
    plain = (F.length(T.strip("p")) < 3) | T.strip("p").rlike(T.BOILERPLATE_ANY)
    assert all(r[0] == r[1] for r in rows.select(T.is_boilerplate(F.col("p")), plain).collect())
    loose = [p for p in T.BOILERPLATE.values() if not p.startswith("^")]
    assert len(loose) == 4 and not T.BOILERPLATE_ANY.startswith("(?i)^")
    listed = rows.agg(F.collect_list("p").alias("ps")).select(S.hint_count(F.col("ps")).alias("n"), S.hint_count(F.array(F.lit("none"))).alias("z"), S.hint_count(F.lit(None).cast("array<string>")).alias("o")).first()
    assert listed["n"] == len(re.findall(S.HINTS, "\n".join(PARAGRAPHS))) and listed["z"] == 0 and listed["o"] is None


def test_words_are_counted_with_their_paragraphs(spark):
    blob = " ".join(f"Word {k} is “here”." for k in range(300)) + " Tail\tof it"
    paras = F.array(*map(F.lit, ["one two", " three　four five ", blob, "x " * 600]))
    for options in ({}, {"split_blobs": False}, {"merge": True}, {"blob_words": 3}):
        got = spark.range(1).select(T.fix_sized(paras, **options).alias("s"), T.fix_paragraphs(paras, **options).alias("p")).first()
        assert [x["p"] for x in got["s"]] == got["p"] and [x["n"] for x in got["s"]] == [len(p.split()) for p in got["p"]]
    row = spark.createDataFrame([("Start of it\n\n" + blob, "The start of it")], "raw_content string, source_title_text string")
    out = clean.clean_and_score(row, content_format="text").first()
    assert out["word_count"] == sum(len(p.split()) for p in out["paragraphs"]) == out["quality"]["word_count"] and out["paragraph_count"] > 1


def test_long_paragraphs_are_unlike_titles(spark):
    titles = ["The Start", "Chapter 12: It—begins", "été", "…", ""]
    paras = ["the start", "The  Start!!!" + "!" * 200, "The Start of it all " * 50, "Chapter 12 it begins", "日" * 300, "日" * 300 + "The Start", "t", "é t é"]
    rows = spark.createDataFrame([(t, paras[k : k + 4]) for t in titles for k in (0, 4)], "t string, p array<string>")
    for r in rows.withColumn("alike", clean.heading_likeness(F.col("p"), F.col("t"))).withColumns({"a": T.heading_key("t"), "b": F.transform("p", T.heading_key)}).collect():
        for key, got in zip(r["b"], r["alike"], strict=True):
            want = indel_ratio(r["a"], key)
            assert got == want if got is not None else want < T.HEADING_RATIO
