"""Matching, resolution, ingestion, serving, jobs and streaming on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from libretto import schema
from libretto.functions.fuzzy import indel_ratio
from libretto.operators import ingest, match, resolve, serve
from libretto.plans import jobs
from libretto.sources.extract import extract_titles

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def at():
    return F.lit("2026-01-01").cast("timestamp")


def table(spark, name, rows):
    """A domain table from partial rows."""
    types = {f.name: f.dataType.simpleString() for f in schema.schema(name)}
    names = list(dict.fromkeys(k for r in rows for k in r))
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {types[n]}" for n in names))
    return schema.conform(df, name)


@pytest.fixture(scope="module")
def t(spark):
    out = {
        "works": table(spark, "works", [{"id": "w1", "slug": "one", "title": "One", "created_at": T0, "updated_at": T0}, {"id": "w2", "slug": "two", "title": "Two", "status": "completed", "created_at": T1, "updated_at": T1}, {"id": "w3", "slug": "three", "created_at": T0, "updated_at": T0}]),
        "versions": table(spark, "versions", [{"id": "v1", "work_id": "w1", "slug": "en", "language": "en", "version_type": "fan"}, {"id": "v2", "work_id": "w2", "slug": "en-x", "language": "en", "translator_group": "Wuxia World", "version_type": "fan"}]),
        "source_titles": table(spark, "source_titles", [{"id": "s1", "version_id": "v1", "source_site": "a", "source_id": "1", "source_url": "u1", "last_scraped_at": T1, "created_at": T0}, {"id": "s2", "version_id": "v2", "source_site": "b", "source_id": "2", "source_url": "u2", "created_at": T0}]),
        "metadata_claims": table(spark, "metadata_claims", [
            {"id": "c1", "source_title_id": "s1", "field_name": "title", "raw_value": "Low", "claim_hash": "x", "confidence": 0.4, "created_at": T1},
            {"id": "c2", "source_title_id": "s1", "field_name": "title", "raw_value": "High", "claim_hash": "y", "confidence": 0.9, "created_at": T0},
            {"id": "c3", "source_title_id": "s1", "field_name": "tags", "raw_value": "magic, war", "claim_hash": "z", "confidence": 0.5, "created_at": T0},
            {"id": "c4", "source_title_id": "s2", "field_name": "tags", "raw_value": "Magic", "normalised_value": "", "claim_hash": "q", "confidence": 0.5, "created_at": T0},
        ]),
        "cover_candidates": table(spark, "cover_candidates", [{"id": "k1", "source_title_id": "s1", "source_url": "i1", "width": 300, "height": 450, "file_size": 100_000}, {"id": "k2", "source_title_id": "s1", "source_url": "i2", "width": 90, "height": 450}]),
        "version_chapters": table(spark, "version_chapters", [{"id": "vc1", "version_id": "v1", "chapter_number": 10.0, "title": "Kept"}]),
        "source_chapters": table(spark, "source_chapters", [
            {"id": "sc1", "source_title_id": "s1", "source_url": "x1", "source_chapter_id": "1", "chapter_number": 10.0, "cleaned_content": "low text", "quality_score": 0.2, "cleaner_version": "1.0"},
            {"id": "sc2", "source_title_id": "s1", "source_url": "x2", "source_chapter_id": "2", "chapter_number": 10.0, "cleaned_content": "high text", "quality_score": 0.9, "cleaner_version": "1.0"},
            {"id": "sc3", "source_title_id": "s1", "source_url": "x3", "source_chapter_id": "3", "chapter_number": 11.0, "source_title_text": "Eleven", "raw_content": "<p>Some raw text here.</p><p>Next chapter</p>"},
            {"id": "sc4", "source_title_id": "s1", "source_url": "x4", "source_chapter_id": "4", "raw_content": "<p>No number on this one.</p>"},
        ]),
        "ingestion_jobs": table(spark, "ingestion_jobs", [{"id": "j1", "source_site": "a", "source_url": "u", "status": "failed", "created_at": T0}, {"id": "j2", "source_site": "a", "source_url": "u", "status": "completed", "created_at": T1}]),
    }
    return out


def test_schema(spark, t):
    assert set(schema.DDL) == set(schema.KEYS) and all(f.name for n in schema.DDL for f in schema.schema(n))
    schema.assert_unique(t["works"], ("slug",))
    with pytest.raises(AssertionError):
        schema.assert_unique(t["metadata_claims"], ("field_name",))
    left = schema.delete_rows(t, "works", F.col("id") == "w1")
    assert [left[n].count() for n in ("works", "versions", "source_titles", "metadata_claims", "cover_candidates", "version_chapters", "source_chapters")] == [2, 1, 1, 1, 0, 0, 0]
    cleared = schema.delete_rows(t | {"source_chapters": t["source_chapters"].withColumn("version_chapter_id", F.lit("vc1"))}, "version_chapters", F.lit(True))
    assert cleared["source_chapters"].where("version_chapter_id is not null").count() == 0


def test_resolve_all(spark, t):
    out = resolve.resolve_all(t, at())
    works = {r["id"]: r for r in out["works"].collect()}
    assert works["w1"]["title"] == "High" and works["w1"]["selected_cover_id"] == "k1" and works["w3"]["title"] is None and works["w2"]["title"] == "Two"
    assert {r["id"] for r in out["metadata_claims"].where("is_resolved").collect()} == {"c2", "c3", "c4"}
    assert {r["id"]: r["is_selected"] for r in out["cover_candidates"].collect()} == {"k1": True, "k2": False}
    chapters = {r["chapter_number"]: r for r in out["version_chapters"].collect()}
    assert chapters[10.0]["content"] == "high text" and chapters[10.0]["title"] == "Kept" and chapters[10.0]["promoted_from_id"] == "sc2"
    assert chapters[11.0]["content"] == "Some raw text here." and chapters[11.0]["title"] == "Eleven"
    sources = {r["id"]: r for r in out["source_chapters"].collect()}
    assert len(sources) == 4 and sources["sc4"]["version_chapter_id"] is None and sources["sc3"]["quality_score"] > 0
    assert out["report"].first().asDict() == {"version_id": "v1", "promoted": 2, "skipped": 0, "mapped": 3, "cleaned": 2}
    again = resolve.resolve_all({k: v for k, v in out.items() if k != "report"}, at())
    assert again["version_chapters"].count() == 2 and again["report"].first()["cleaned"] == 0


def test_fuzzy_blocking_loses_nothing(spark):
    import random

    random.seed(1)
    words = ["lord", "of", "the", "mysteries", "mystery", "legend", "legendary", "mechanic", "a", "moon"]
    titles = list(dict.fromkeys(" ".join(random.choices(words, k=random.randint(1, 4))) + random.choice(["", "s", "x"]) for _ in range(150)))
    df = spark.createDataFrame([(k, v) for k, v in enumerate(titles)], "id long, key string")
    for least in (90.0, 75.0):
        got = {(r["l_id"], r["r_id"]) for r in match.fuzzy_pairs(df, df, least).collect()}
        assert got == {(i, j) for i, a in enumerate(titles) for j, b in enumerate(titles) if indel_ratio(a, b) >= least}


def test_match_works(spark):
    works = spark.createDataFrame([("w1", "lord-of-mysteries", "Lord of Mysteries", T0), ("w2", "the-the", "The The", T0), ("w3", "x", None, T0)], "id string, slug string, title string, created_at timestamp")
    c = spark.createDataFrame([(1, "LORD OF MYSTERIES"), (2, "The Mysteries Lord"), (3, "Lord of Mysteriess"), (4, "Unrelated"), (5, "Of In"), (6, None), (7, "Unrelated")], "id long, title string")
    got = {r["id"]: (r["work_id"], r["reason"]) for r in match.match_works(c, works).collect()}
    assert got[1] == ("w1", "exact_slug") and got[2] == ("w1", "fuzzy_title") and got[3] == ("w1", "fuzzy_title")
    assert got[4][1] == got[5][1] == got[6][1] == "new" and got[4][0] == got[7][0] != got[5][0]


def test_match_versions(spark, t):
    c = spark.createDataFrame([(1, "w2", "en", "World Wuxia", "fan"), (2, "w2", "en", "Other", "fan"), (3, "w1", "en", None, "fan"), (4, "w1", "fr", None, "fan"), (5, "w2", "en", "Wuxia Worlds", "fan")], "id long, work_id string, language string, translator_group string, version_type string")
    got = {r["id"]: (r["version_id"], r["reason"]) for r in match.match_versions(c, t["versions"]).collect()}
    assert got == {1: ("v2", "translator_exact"), 3: ("v1", "language_only"), 5: ("v2", "translator_fuzzy")}
    placed = {r["id"]: (r["version_id"], r["is_new_version"], r["version_label"]) for r in match.find_versions(c, t["versions"]).collect()}
    assert placed[3] == ("v1", False, "Fan Translation (EN)") and placed[2][1] is True and placed[2][2] == "Other (EN)"


PAGE = "<h3 class='title'>{0}</h3><div class='info'><a href='/author/x'>Auth</a></div><ul class='list-chapter'><li><a href='/{1}/chapter-1.html'>Chapter 1</a><li><a href='/{1}/chapter-2.html'>Chapter 2</a></ul>"


def test_ingest_cycle(spark):
    page = lambda k, title: ("novelfull", f"https://novelfull.com/{k}.html", PAGE.format(title, k))
    titles = spark.createDataFrame([page("a", "My Long Story"), page("b", "The My Long Story"), page("c", "Elsewhere")], "site_key string, url string, html string")
    chapter = spark.createDataFrame([("novelfull", "https://novelfull.com/a/chapter-1.html", "<h2>Chapter 1: In</h2><div id='chapter-content'><p>It was a dark night.</p></div>")], "site_key string, url string, html string")
    once = jobs.ingest_cycle(jobs.new_tables(spark), titles, titles, chapter, at())
    counts = {n: once[n].count() for n in ("works", "versions", "source_titles", "metadata_claims", "source_chapters")}
    assert counts == {"works": 2, "versions": 2, "source_titles": 3, "metadata_claims": 12, "source_chapters": 6}
    for n in counts:
        schema.assert_unique(once[n], schema.KEYS[n])
    got = once["source_chapters"].where("raw_content is not null").first()
    assert got["source_title_text"] == "Chapter 1: In" and ingest.without_content(once["source_chapters"]).count() == 5


def test_upserts_are_idempotent(spark):
    pages = spark.createDataFrame([("novelfull", "https://novelfull.com/a.html", PAGE.format("T", "a"))], "site_key string, url string, html string")
    meta = extract_titles(pages, F.col("site_key"))
    st = ingest.overwrite_sources(ingest.source_title_rows(meta, at()), schema.empty(spark, "source_titles"))
    claims = ingest.upsert(ingest.claim_rows(meta, st, at()), schema.empty(spark, "metadata_claims"), "metadata_claims")
    assert claims.count() == ingest.upsert(ingest.claim_rows(meta, st, at()), claims, "metadata_claims").count() == 4
    assert ingest.overwrite_sources(ingest.source_title_rows(meta, at()), st).count() == 1


def test_create(spark, t):
    assert ingest.create_work(t["works"], "A New One", at()).first()["slug"] == "a-new-one"
    with pytest.raises(ingest.Conflict):
        ingest.create_work(t["works"], "One", at())
    with pytest.raises(ingest.Conflict):
        ingest.create_version(t["versions"], "w1", "en", at())


def test_jobs(spark, t, tmp_path):
    def fail(_):
        raise RuntimeError("no network")

    bad = jobs.audited(t, "a", "u9", fail, "2026-01-01")["ingestion_jobs"].where("source_url = 'u9'").first()
    assert bad["status"] == "failed" and bad["error_message"] == "no network" and "RuntimeError" in bad["error_detail"]
    good = jobs.audited(t, "a", "u9", lambda x: dict(x), "2026-01-01")["ingestion_jobs"].where("source_url = 'u9'").first()
    assert (good["status"], good["chapters_found"], good["chapters_new"]) == ("completed", 4, 0)
    assert [r["id"] for r in jobs.refresh_queue(t["source_titles"]).collect()] == ["s1", "s2"]
    assert jobs.refresh_jobs(t["source_titles"], at()).count() == 2
    root = jobs.save(t, str(tmp_path))
    assert {n: df.count() for n, df in jobs.load(spark, root).items()} == {n: t[n].count() for n in schema.DDL}


def test_serving(spark, t):
    t = t | {"metadata_claims": t["metadata_claims"].withColumn("is_resolved", F.lit(True))}
    assert [r["id"] for r in serve.listing(t, sort="az").collect()] == ["w3", "w1", "w2"]  # a missing title reads as the empty one
    assert [r["id"] for r in serve.search(t, q="TW").collect()] == ["w2"]
    assert [r["id"] for r in serve.search(t, tags="magic").collect()] == ["w1", "w2"]
    assert [r["id"] for r in serve.search(t, tags="magic", exclude_tags="war").collect()] == ["w2"]
    assert [r["id"] for r in serve.search(t, chap_min=1).collect()] == ["w1"] and serve.search(t, sort="unknown").count() == 3
    assert [r["id"] for r in serve.similar(t, "w1").collect()] == ["w2"]
    card = {r["id"]: r for r in serve.cards(t).collect()}
    assert card["w3"]["author"] == "Unknown" and card["w3"]["status"] == "ongoing" and card["w2"]["status"] == "completed" and card["w1"]["total_chapters"] == 1
    d = serve.detail(t, "one").first()
    assert d["tags"] == ["magic", "war"] and d["sites"] == ["a"]
    assert serve.page_meta(t["works"], 2).first().asDict() == {"total": 3, "pages": 2}
    assert serve.page_meta(t["works"].limit(0), 2).first().asDict() == {"total": 0, "pages": 1}
    assert serve.stats(t).first().asDict() == {"works": 3, "chapters": 1}
    h = {r["source_site"]: r for r in serve.source_health(t).collect()}
    assert h["a"]["last_job_status"] == "completed" and h["a"]["avg_quality"] == pytest.approx(0.55) and h["b"]["chapter_count"] == 0
    r = serve.read_chapter(t, "w1", 7.0).first()
    assert r["label"] == "Kept" and r["prev_number"] is None and r["paragraphs"] == []
    assert [r["id"] for r in serve.claims_of_work(t, "one", "title").collect()] == ["c2", "c1"]
    assert serve.recent_jobs(t["ingestion_jobs"], site="a", size=1).first()["id"] == "j2"
    assert serve.sources_of_site(t, "a").count() == 1
    assert {r["id"]: r["chapter_count"] for r in serve.versions_with_counts(t["versions"], t["version_chapters"]).collect()} == {"v1": 1, "v2": 0}


def test_routes(spark, t):
    from libretto.plans.api import call

    get = lambda path, **q: [r["id"] for r in call(t, "GET", path, **q).collect()]
    assert get("/api/v1/works", sort="az", size=2) == ["w3", "w1"]
    assert get("/api/v1/works/two") == ["w2"] and get("/api/v1/works/w1/versions") == ["v1"] and get("/api/v1/works/none") == []
    assert get("/api/v1/versions/v1/chapters") == get("/api/v1/versions/v1/chapters/10") == ["vc1"] and get("/api/v1/versions/v1/chapters/10.5") == []
    assert get("/api/v1/ingestion/jobs", status="failed") == get("/api/v1/ingestion/jobs/j1") == ["j1"]
    assert get("/api/novel/one/chapters") == ["vc1"] and get("/novel/one/chapter/3") == ["vc1"]
    assert call(t, "GET", "/api/v1/ingestion/adapters").count() == 26
    assert call(t, "POST", "/api/v1/ingestion/jobs", site="tapas", url="u", as_of=at()).first()["status"] == "pending"
    with pytest.raises(KeyError):
        call(t, "POST", "/api/v1/ingestion/jobs", site="nowhere", url="u", as_of=at())
    with pytest.raises(LookupError):
        call(t, "GET", "/nowhere")
    chapters = t["version_chapters"]
    assert serve.filter_chapters(chapters, "10").count() == serve.filter_chapters(chapters, "kept", True).count() == 1 and serve.filter_chapters(chapters, "zz").count() == 0


def test_streaming(spark, sf, tmp_path):
    from libretto.streaming.ingest import stream_claims, windowed_counts

    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{sf}/events.parquet")
    keys = ("user_id", "event_type", "h")
    claims = lambda e: e.select("user_id", "event_type", F.md5("props").alias("h"), F.col("event_id").alias("id"))
    run = lambda: stream_claims(spark, source, events.schema, str(tmp_path / "out"), str(tmp_path / "cp"), claims, keys).awaitTermination()
    events.where("event_id % 2 = 0").write.parquet(source)
    run()
    events.write.mode("append").parquet(source)
    run()
    run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == claims(events).select(*keys).distinct().count()
    stream = spark.readStream.schema(events.schema).parquet(source)
    assert windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp"))).isStreaming
