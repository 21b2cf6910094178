"""Indexed search, segment matching, deep pages, nearest chapters and similar works against brute force."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from libretto.functions.fuzzy import indel_ratio
from libretto.operators import bulk, match, search_index, serve
from test_operators import t  # noqa: F401  (the small domain tables)

SYLLABLES = "ka ro mi te lun dar ves ith mor sel tan gri pho bel cas dun eth fir gor hal".split()


def made_words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def folders(df, column):
    """Number of partition folders that the plan admits."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")
    found = [m for f in re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan) for m in re.findall(rf"{column}#\d+ (?:IN \(([^)]*)\)|= (\d+))", f)]
    return max((len((a or b).split(",")) for a, b in found), default=0)


def works_of(spark, n=3000):
    rng, words = random.Random(7), made_words(1500, 1)
    rows = [(f"w{k}", " ".join(rng.choices(words, k=3)).title(), " ".join(rng.choices(words, k=12)) if k % 9 else None) for k in range(n)]
    rows += [("odd1", None, None), ("odd2", "", "100%_sure\\done"), ("odd3", "ÀÉ Straße", "日本語の本"), ("odd4", "a_b", "a%b")]
    return spark.createDataFrame(rows, "id string, title string, synopsis string")


def patterns():
    words = made_words(1500, 1)
    some = [w.upper() for w in words[:25]] + [f"{a} {b}" for a, b in zip(words[30:40], words[40:50], strict=True)] + [w[:3] + "%" + w[-3:] for w in words[60:66]] + ["lun_ar", "ka%ro%mi", "_", "%", "", None, "q", "ro", "à", "straße", "本", r"100\%", r"a\_b", "a_b", r"\\", "nowhere at all"]
    return list(enumerate(some))


def test_search_equals_ilike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "CHUNK_BITS", 8)
    monkeypatch.setattr(search_index, "BUCKET_WORKS", 500)
    works = works_of(spark)
    asked = spark.createDataFrame(patterns(), "request long, pattern string")
    assert asked.count() > 50
    index = search_index.TextIndex.build(works, f"{tmp_path}/index")
    index = search_index.TextIndex.open(spark, index.path)
    got = {(r["request"], r["id"]) for r in index.search(asked).collect()}
    like = F.expr("title ilike concat('%', pattern, '%') or synopsis ilike concat('%', pattern, '%')")
    assert got == {(r["request"], r["id"]) for r in asked.join(works, like).select("request", "id").collect()}
    # of patterns with three letters in a row few works are looked at
    long = [i for i, p in patterns() if p and any(len(x) >= 4 for x in re.split(r"\\.|[%_]", p))]
    looked = index.candidates(asked.where(F.col("request").isin(long))).count()
    assert looked < 0.05 * len(long) * works.count()
    assert {r["id"] for r in index.ids("À").collect()} == {"odd3"}


def test_a_search_reads_the_buckets_it_needs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BUCKET_WORKS", 100)
    index = search_index.TextIndex.build(works_of(spark, 2000), f"{tmp_path}/index")
    assert index.buckets >= 20
    one = spark.createDataFrame([(1, "zzz"), (2, "lundarves")], "request long, pattern string")
    assert 1 <= folders(index.candidates(one), "bucket") <= 8 < index.buckets
    assert {r["id"] for r in index.search(one).collect()} == {r["id"] for r in works_of(spark, 2000).where("title ilike '%lundarves%' or synopsis ilike '%lundarves%'").collect()}


def test_search_of_nothing(spark):
    index = search_index.TextIndex.build(works_of(spark, 0).where("false"))
    asked = spark.createDataFrame(patterns(), "request long, pattern string")
    assert index.search(asked).count() == 0
    full = search_index.TextIndex.build(works_of(spark, 10))
    assert full.search(asked.where("false")).count() == 0


def test_containing_takes_terms_as_they_are(spark):
    values = spark.createDataFrame([("100%",), ("a_b",), ("axb",), ("back\\slash",), ("",), ("dark magic",)], "value string")
    terms = spark.createDataFrame([("%",), ("_",), ("\\",), ("magic",), ("a",), ("a_b",)], "term string")
    got = {(r["term"], r["value"]) for r in search_index.containing(values, terms).collect()}
    assert got == {(t, v) for (t,) in terms.collect() for (v,) in values.collect() if t in v}


def titles_of(spark, n, seed):
    rng, words = random.Random(seed), made_words(4000, 3)
    rows = [(k, " ".join(sorted(rng.choice(words) for _ in range(rng.randint(2, 5))))) for k in range(n)]
    return spark.createDataFrame(rows, "id long, key string").repartition(8)


def test_pairs_met_per_title_stay_few(spark):
    asked = titles_of(spark, 2000, 11)
    few, many = (match.close_pairs(asked, titles_of(spark, n, 12), 90.0).count() / 2000 for n in (20_000, 200_000))
    # of ten times the titles no one is met more often than a few times
    assert few < 2 and many < 8


@pytest.mark.parametrize("hot", [4096, 3])
def test_segments_lose_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(match, "HOT_ROWS", hot)
    monkeypatch.setattr(match, "MOST_HOT", 10**9)
    random.seed(2)
    words = ["lord", "of", "the", "mysteries", "mystery", "legend", "a", "moon", "x" * 30]
    titles = list(dict.fromkeys(" ".join(random.choices(words, k=random.randint(1, 5))) + random.choice(["", "s", "0"]) for _ in range(160))) + ["", "a", "b", "ab", "ba", "abc", "z9"]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, key string")
    for least in (90.0, 80.0, 70.0):
        got = [(r["l_id"], r["r_id"], r["score"]) for r in match.fuzzy_pairs(df, df, least).collect()]
        want = {(i, j): indel_ratio(a, b) for i, a in enumerate(titles) for j, b in enumerate(titles) if a and b and indel_ratio(a, b) >= least}
        assert len(got) == len(want) and all(want[i, j] == pytest.approx(s) for i, j, s in got)


def test_edits_everywhere_are_found(spark):
    rng, rows, left = random.Random(5), [], []
    for k in range(300):
        key = "".join(rng.choices("abcdefgh ", k=rng.randint(8, 45))).strip() or "a"
        rows.append((k, key))
        other = list(key)
        for _ in range(int(0.2 * len(key))):
            at = rng.randrange(len(other) + 1)
            if rng.random() < 0.5 and other:
                del other[min(at, len(other) - 1)]
            else:
                other.insert(at, rng.choice("abcdefgh "))
        left.append((k, "".join(other)))
    a, b = spark.createDataFrame(left, "id long, key string"), spark.createDataFrame(rows, "id long, key string")
    got = {(r["l_id"], r["r_id"]) for r in match.fuzzy_pairs(a, b, 90.0).collect()}
    want = {(i, j) for i, x in left for j, y in rows if x and indel_ratio(x, y) >= 90}
    assert got == want and len(want) > 100


def test_low_ratios_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "id long, key string")
    with pytest.raises(ValueError):
        match.fuzzy_pairs(df, df, 60.0)


def test_ranked_pages(spark, tmp_path):
    rows = [(k, k % 7, dt.datetime(2024, 1, 1 + k % 3) if k % 5 else None) for k in range(1003)]
    df = spark.createDataFrame(rows, "id long, total long, updated_at timestamp")
    order = [F.desc("total"), F.desc_nulls_last("updated_at"), F.asc("id")]
    built = bulk.RankedPages.build(df, order, f"{tmp_path}/ranked", block_rows=100)
    ranked = bulk.RankedPages.open(spark, built.path, order, df.schema)
    every = df.orderBy(*order).collect()
    assert ranked.total() == 1003 and ranked.directory().count() > 5
    for number, size in ((1, 20), (2, 20), (26, 20), (51, 20), (52, 20), (1, 500), (3, 333)):
        assert ranked.page(number, size).collect() == every[(number - 1) * size : number * size]
    # a deep page reads what it lies in
    assert 1 <= folders(ranked.page(40, 20), "block") <= 2 < ranked.directory().count()
    assert bulk.RankedPages.build(df.where("false"), order).page(1).count() == 0


def test_nearest_many(spark):
    rng = random.Random(3)
    chapters = [(f"g{k % 5}", rng.choice([None, 1.0, 2.0, 2.5, 4.0, 7.0, 7.0, 10.0]), f"c{k}") for k in range(60)]
    requests = [(k, f"g{k % 7}", rng.choice([None, -3.0, 0.0, 1.5, 2.25, 3.0, 3.25, 5.5, 7.0, 8.5, 99.0])) for k in range(300)]
    got = bulk.nearest_many(spark.createDataFrame(chapters, "work_id string, chapter_number double, id string"), spark.createDataFrame(requests, "request long, work_id string, target double"))
    want = {}
    for r, g, at in requests:
        own = [(abs(n - at), n, i) for w, n, i in chapters if w == g and n is not None] if at is not None else []
        if own:
            want[r] = min(own)[1:]
    assert {r["request"]: (r["chapter_number"], r["id"]) for r in got.collect()} == want and len(want) > 150


def test_similar_of_all_works(spark, t):  # noqa: F811
    t = t | {"metadata_claims": t["metadata_claims"].withColumn("is_resolved", F.lit(True))}
    got = {}
    for r in bulk.similar_all(t).orderBy("work_id", "place").collect():
        got.setdefault(r["work_id"], []).append(r["similar_id"])
    one_by_one = {w: [r["id"] for r in serve.similar(t, w).collect()] for w in ("w1", "w2", "w3")}
    assert got == {w: found for w, found in one_by_one.items() if found} == {"w1": ["w2"], "w2": ["w1"]}


def test_similar_works_of_all_meet_their_claims_once(spark, t, monkeypatch):  # noqa: F811
    met, kept = [], bulk.claims_of_works
    monkeypatch.setattr(bulk, "claims_of_works", lambda t: met.append(1) or kept(t))
    t = t | {"metadata_claims": t["metadata_claims"].withColumn("is_resolved", F.lit(True))}
    plan = bulk.similar_all(t)._jdf.queryExecution().executedPlan().toString()
    # one exchange: the terms, dealt by work, meet a broadcast; no pairs of works travel
    assert met == [1] and plan.count("hashpartitioning(") == plan.count("hashpartitioning(own") == 1, plan


def test_search_route_with_an_index(spark, t):  # noqa: F811
    index = search_index.TextIndex.build(t["works"])
    assert [r["id"] for r in serve.search(t, q="TW", index=index).collect()] == ["w2"]
    assert serve.search(t, q="", index=index).count() == 3
