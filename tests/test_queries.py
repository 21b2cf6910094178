"""Every registered query runs, and agrees with its SQL oracle where it has one."""

import datetime
import hashlib
import re
from collections import Counter

import duckdb
import pytest

from libretto import queries
from libretto.fixtures import TABLES
from libretto.functions import scores, text


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    rows = got.collect()
    if name not in queries.ORACLES:
        return
    want = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(plain(r[c]) for c in names) for r in rows) == Counter(tuple(map(plain, r)) for r in want.fetchall())


LARGER = "/root/testdata/sf0.01"


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def lines_of(t):
    return [x for x in (line.strip() for line in t.split("\n")) if x]


def test_slugify_whole_text(spark):
    def slug(t):
        t = t.lower().translate(str.maketrans(text.ACCENTED, text.PLAIN)).replace("ß", "ss").replace("æ", "ae").replace("œ", "oe")
        return re.sub(r"[^a-z0-9]+", "-", re.sub(r"(?<=[0-9]),(?=[0-9])", "", t)).strip("-")

    docs = texts_of(spark, LARGER)
    got = {r["doc_id"]: r["slug"] or "" for r in queries.QUERIES["slugify"](spark, LARGER).collect()}
    assert got == {i: slug(t) for i, t in docs.items()} and max(map(len, got.values())) > 40


def test_paragraph_fix_with_blobs(spark, tmp_path):
    def groups(p):
        done = []
        for s in (s.strip() for s in re.split(r"(?<=[.!?…])\s+|(?<=[.!?…][\"'])\s+", p)):
            if s and done and len(f"{done[-1]} {s}".split()) <= 200:
                done[-1] += f" {s}"
            elif s:
                done.append(s)
        return done

    blob = " ".join(f"Sentence {k} has {'very ' * (k % 90)}many words." for k in range(100))
    rows = [(1, f"First line of three.\n{blob}\nToo short\n{'word ' * 600}"), (2, "Only one short line here.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for sf in (LARGER, str(tmp_path)):
        want, blobs = {}, 0
        for i, t in texts_of(spark, sf).items():
            blobs += any(len(p.split()) >= 500 for p in lines_of(t))
            p = [x for y in lines_of(t) for x in (groups(y) if len(y.split()) >= 500 else [y]) if len(x.split()) >= 3]
            want[i] = len(p), hashlib.md5("|".join(p).encode()).hexdigest()
        got = {r["doc_id"]: (r["n"], r["digest"]) for r in queries.QUERIES["paragraph_fix"](spark, sf).collect()}
        assert got == want and blobs
    assert got[1][0] > 10


def test_chapter_quality_counts_repetition(spark):
    docs = {i: lines_of(t) for i, t in texts_of(spark, LARGER).items()}
    again = {i: any(a[-k:] == b[:k] for a, b in zip(p, p[1:]) for k in range(20, min(len(a), len(b)) + 1)) for i, p in docs.items()}  # noqa: B905
    rows = queries.QUERIES["chapter_quality"](spark, LARGER).collect()
    for r in rows:
        hits = len(re.findall(scores.HINTS, "\n".join(docs[r["doc_id"]])))
        clean = max(0.0, 1 - min(hits * 0.1, 0.4) - 0.2 * again[r["doc_id"]])
        assert r["cleanliness_score"] == pytest.approx(clean, abs=1e-6)
        assert r["final_score"] == pytest.approx(0.35 * r["length_score"] + 0.35 * r["structure_score"] + 0.3 * clean, abs=6e-5)
    assert len(rows) == len(docs) and any(again.values())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(queries.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0
