"""Operators over the whole corpus against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from libretto.llm import decontaminate, exchange, line_dedup, maxscore, mixing, ngram_lm, simhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, size long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 7) for i, t, s in rows], DOCS)


# -- exchange -------------------------------------------------------------------


def test_exchange_round_trip():
    rng = np.random.default_rng(0)
    for dtype in (np.uint8, np.uint32, np.int64, ngram_lm.COUNTS):
        a = rng.integers(0, 200, 50).astype(np.uint8 if dtype == np.uint8 else np.int64)
        a = np.zeros(50, dtype=dtype) if dtype is ngram_lm.COUNTS else a.astype(dtype)
        assert np.array_equal(exchange.unsqueezed(exchange.squeezed(a), dtype), a)
    keys = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    own, at = exchange.cuts(keys, 7)
    assert at[-1] == len(keys) and list(own) == sorted(set(exchange.owner(keys, 7)))


# -- op2 --------------------------------------------------------------------------


def test_language_model(spark):
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(rng.choice(["a", "b", "Cc", "d", "É"], rng.integers(0, 12))), "s") for k in range(80)] + [(None, "a b", "s"), (90, None, "s"), (91, "", "s"), (3, "a a", "s")]
    got = ngram_lm.score_texts(docs_of(spark, rows)).collect()
    tokens = [(i, (t or "").encode().lower().split() + [b"\0end"]) for i, t, _ in rows]
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    uni, bi, before = Counter(), Counter(), Counter()
    for i, w in tokens:
        if i is not None and fold(i) != 2:
            uni.update(w)
            bi.update(zip([b"\0s", *w], w))
            before.update([b"\0s", *w[:-1]])
    n, v = sum(uni.values()), len(uni)
    want = Counter((i, fold(i) == 2, len(w), sum(uni[x] > 0 for x in w), n, round(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in tokens)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)
    assert ngram_lm.score_texts(docs_of(spark, rows).limit(0)).count() == 0


def test_no_training_rows(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = ngram_lm.score_texts(docs_of(spark, [(held, "a b", "s")])).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def test_weights_follow_the_likelier_part():
    lam = ngram_lm.expectation_maximisation(np.array([90.0, 10.0]), np.array([[0.5, 0.01, 0.001], [0.0, 0.01, 0.001]]))
    assert lam[0] > 0.8 and np.isclose(lam.sum(), 1)
    table = ngram_lm.weight_table({5: (100, lam)}, 2)
    assert table.shape == (ngram_lm.CONTEXTS, 3) and np.allclose(table.sum(axis=1), 1) and table[0, 0] == 0 and np.allclose(table[5], lam, atol=1e-5)
    third = ngram_lm.weight_table({}, 3)
    assert (third[: ngram_lm.CONTEXTS, 0] == 0).all() and (third[ngram_lm.CONTEXTS :] > 0).all() and third[0, 1] == 0


def brute_interpolation(rows, order, weights=None):
    """(score per row, weights) with dictionaries of n-grams and EM over single held-out tokens, if weights are not given."""
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 7
    texts = [(fold(i), (t or "").encode().lower().split() + [b"\0end"]) for i, t, _ in rows]

    def tables(keep):
        grams, contexts = Counter(), Counter()
        for f, w in texts:
            if keep(f):
                padded = [b"\0s"] * (order - 1) + w
                for k in range(len(w)):
                    for n in range(1, order + 1):
                        gram = tuple(padded[k + order - n : k + order])
                        grams[gram] += 1
                        contexts[gram[:-1]] += 1
        return grams, contexts

    def parts(grams, contexts, w, types):
        padded = [b"\0s"] * (order - 1) + w
        total, out = contexts[()], []
        for k in range(len(w)):
            f, bucket = [], 0
            for n in range(order, 1, -1):
                gram = tuple(padded[k + order - n : k + order])
                c = contexts[gram[:-1]]
                if c and not bucket:
                    bucket = ngram_lm.CONTEXTS * (n - 2) + min(c.bit_length(), ngram_lm.CONTEXTS - 1)
                f.append(grams[gram] / c if c else 0.0)
            out.append((bucket, [*f, grams[(w[k],)] / total if total else 0.0, 1 / (types + 1)]))
        return out

    trained = lambda f: f is not None and f != 2
    types = len({g for g in tables(trained)[0] if len(g) == 1})
    if weights is None:
        fitted = tables(lambda f: trained(f) and f != 3)
        by_bucket = {}
        for f, w in texts:
            if f == 3:
                for b, p in parts(*fitted, w, types):
                    by_bucket.setdefault(b, []).append(p)
        learned = {b: (len(p), ngram_lm.expectation_maximisation(np.ones(len(p)), np.array(p))) for b, p in by_bucket.items()}
        weights = ngram_lm.weight_table(learned, order)
    every = tables(trained)
    return [sum(math.log10(float(weights[b] @ np.array(p))) for b, p in parts(*every, w, types)) for _, w in texts], weights


@pytest.mark.parametrize("order", [1, 2, 3])
def test_interpolation_brute(spark, order):
    rng = np.random.default_rng(order)
    vocab = [f"w{k}" for k in range(60)]
    odds = 1 / np.arange(1, 61)
    text = lambda: " ".join(rng.choice(vocab, int(rng.integers(5, 60)), p=odds / odds.sum()))
    rows = [(k, text(), "s") for k in range(150)]
    rows += [(200 + k, rows[k][1], "s") for k in range(40)] + [(None, "w1 w2 w3", "s"), (300, None, "s"), (301, "W1 w2  w3", "s"), (302, "w1 " * 3000, "s")] + [(5, "the same row", "s")] * 60
    docs = docs_of(spark, rows)
    model = ngram_lm.Model(docs, "doc_id", "text", 7, 2, 3, order)
    got = Counter((r["id"], round(r["score"], 5)) for r in model.scores().collect())
    scores, _ = brute_interpolation(rows, order, model.weights)
    assert got == Counter((i, round(s, 5)) for (i, _, _), s in zip(rows, scores, strict=True))
    # the weights by cells against those of EM over every single held-out token
    exact, weights = brute_interpolation(rows, order)
    assert np.abs(weights - model.weights).max() < 0.05
    assert np.allclose(exact, scores, rtol=0.01, atol=0.02)


# -- op3 --------------------------------------------------------------------------


def brute_top(q, q_ids, x, ids, k=5):
    s = q @ x.T
    return [(int(q_ids[r]), int(i), int(-v)) for r in range(len(q)) for v, i in sorted((-s[r, j], ids[j]) for j in range(len(x)) if ids[j] != q_ids[r])[:k]]


NO_FLOOR = -np.inf


@pytest.mark.parametrize("n,d,seed,kept", [(3000, 16, 0, 1.0), (2500, 64, 1, 1.0), (5000, 40, 5, 0.1), (3, 4, 2, 1.0), (1, 2, 3, 1.0)])
def test_maxscore_brute(n, d, seed, kept):
    rng = np.random.default_rng(seed)
    x = np.floor(256 * rng.normal(size=(n, d)) * 0.2) * (rng.random((n, d)) < kept)
    x[rng.integers(0, n, n // 4)] = x[0]
    ids = rng.permutation(3 * n)[:n]
    q = x[:20]
    want = sorted(brute_top(q, ids[:20], x, ids))
    floors = {i: [s for j, _, s in want if j == i] for i in ids[:20].tolist()}
    best = np.array([min(floors[i]) if len(floors[i]) == 5 else NO_FLOOR for i in ids[:20].tolist()], dtype=float)
    for floor in (np.full(len(q), NO_FLOOR), best - 1000, best):
        got, _ = maxscore.top_of(q, ids[:20], floor, maxscore.Postings(ids, x), 5)
        assert sorted(zip(*map(list, got), strict=True)) == want


def test_maxscore_skips_postings():
    """Postings touched, of all of the shard: sparse vectors with few heavy terms, and dense ones of equal length."""
    rng = np.random.default_rng(6)
    share = {}
    for name, x in (
        ("sparse", np.floor(rng.exponential(20, (20_000, 200)) * (rng.random((20_000, 200)) < 0.05) * np.where(np.arange(200) < 8, 20, 1))),
        ("dense", np.floor(256 * (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(20_000, 64))))),
    ):
        ids = np.arange(len(x))
        shard = maxscore.Postings(ids, x)
        q = x[:40]
        # the floor that a pilot of a tenth of the vectors gives
        score = q @ x[::10].T
        score[np.arange(40)[:, None] == ids[::10]] = -np.inf
        got, touched = maxscore.top_of(q, ids[:40], np.partition(score, -5, axis=1)[:, -5], shard, 5)
        assert sorted(zip(*map(list, got), strict=True)) == sorted(brute_top(q, ids[:40], x, ids))
        share[name] = touched / sum(np.count_nonzero(x[:, np.flatnonzero(v)]) for v in q)
    assert max(share.values()) < 0.75, share


def test_maxscore_large_numbers():
    shard = maxscore.Postings(np.array([1, 2]), np.array([[2.0**60], [-1.0]]))
    (_, _, c), _ = maxscore.top_of(np.array([[2.0**60]]), np.array([0]), np.array([NO_FLOOR]), shard, 5)
    assert list(c) == [2**63 - 1, -(2**60)]


def test_maxscore_blocks_and_long_vectors(spark, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(maxscore, "BLOCK_BYTES", 400)
    monkeypatch.setattr(maxscore, "SHARD_BYTES", 4000)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    rows = [(int(k), v.tolist(), 0) for k, v in enumerate(x)] + [(100, x[100].tolist(), 1)] * 100
    got = maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).collect()
    whole = np.floor(256.0 * x.astype(float))
    ids = np.arange(300)
    assert sorted((r["query_id"], r["vec_id"], r["score"]) for r in got) == sorted(brute_top(whole[::50], ids[::50], whole, ids))
    long = [(k, [float(k)] * 50_000, 0) for k in (0, 1, 2)] + [(3, [1e306, 1.0], 0), (50, [1e300], 0)]
    got = maxscore.top_k(spark.createDataFrame(long, "vec_id long, embedding array<double>, rank int")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got][:3] == [(0, 1, 0), (0, 2, 0), (0, 50, 0)]
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 50] == [(1, 2**63 - 1), (2, 2**63 - 1), (0, 0)]


def test_maxscore_table(spark):
    rows = [(0, [0.5, 0.5], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (50, [-1.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (None, [1.0, 1.0], 1)]
    got = maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 50, -32768), (50, 1, 2, 0), (50, 2, 0, -32768), (50, 3, 1, -65536)]
    assert maxscore.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- op4 --------------------------------------------------------------------------


def brute_passages(rows, window):
    words = [(2**63 - 1 if i is None else i, i, (t or "").encode().split()) for i, t, _ in rows]
    first = {}
    for o, _, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, o), o)
    out = []
    for o, i, w in words:
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < o for p in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window,first", [(6, 3), (7, 2), (5, 5)])
def test_passages_brute(spark, window, first):
    rng = np.random.default_rng(window)
    pool = [" ".join(rng.choice(list("abcdefgh"), 14)) for _ in range(6)]
    rows = [(int(k), " \n".join(rng.choice(pool, 2)) + " " + " ".join(rng.choice(list("xyz"), rng.integers(0, 6))), "s") for k in range(40)]
    rows += [(None, rows[0][1], "s"), (99, None, "s"), (98, "", "s"), (5, rows[7][1], "s"), (3, "w " * 3000, "s"), (4, "w " * 2000, "s")]
    got = substring_dedup.repeated_passages(docs_of(spark, rows), window=window, first=first).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_passages(rows, window)
    for r in got:
        assert sum(b - a for a, b in zip(r["runs"][::2], r["runs"][1::2], strict=True)) == r["n_removed"]


def test_passages_empty(spark):
    assert substring_dedup.repeated_passages(docs_of(spark, [(1, "a", "s")]).limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(1,), (5,), (7, 3), (10,), (11,), (24,), (25,), (26, 49), (50,), (51, 9), (60, 60)])
def test_passages_of_few_words(spark, sizes):
    rows = [(k, " ".join(f"w{j}" for j in range(n)), "s") for k, n in enumerate(sizes)]
    got = substring_dedup.repeated_passages(docs_of(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_passages(rows, 50)


def test_windows_shorter_than_half():
    import pandas as pd

    for n in range(60):
        words = substring_dedup.Words(pd.DataFrame({"id": [1], "text": ["w " * n]}))
        assert len(words.windows(50)) == n and words.whole(50).sum() == max(0, n - 49)


def test_passages_of_a_crowd_of_one_row(spark):
    """A third of all rows is one row, another third has one id: they spread over the buckets and keep their words."""
    text = " ".join(f"w{j}" for j in range(60))
    rows = [(7, text, "s")] * 40 + [(8, f"{text} {k}", "s") for k in range(40)] + [(k, f"x{k} " * 70, "s") for k in range(100, 140)]
    docs = docs_of(spark, rows)
    got = substring_dedup.repeated_passages(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_passages(rows, 50)
    dealt, buckets = exchange.dealt(docs.select("doc_id", "text"), "text", per=400)
    sizes = [r["count"] for r in dealt.where("doc_id = 7").groupBy("bucket").count().collect()]
    assert len(buckets[0]) > 20 and max(sizes) <= 8 and sum(sizes) == 40


def test_dealt_table_needs_no_second_shuffle(spark):
    dealt, _ = exchange.dealt(docs_of(spark, [(k, "a b c", "s") for k in range(50)]).select("doc_id", "text"), "text", per=20)
    plan = dealt.groupBy("bucket").applyInPandas(lambda p: p[["doc_id"]], "doc_id long")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# -- op5 --------------------------------------------------------------------------


def brute_hits(rows, items, window=10):
    from re import findall

    cut = lambda t: findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for d, t, _ in rows:
        w, hit, names = cut(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (owners := wins.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= owners
        out.append((d, len(w), len(hit), tuple(sorted(names))))
    return Counter(out)


def test_contamination_brute(spark):
    rng = np.random.default_rng(5)
    vocab = ["the", "of", "Ä", "rare1", "x9", "b"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(k, text(int(n))) for k, n in enumerate([12, 15, 3, 1, 10])] + [(7, None), (8, "--"), (9, "of")]
    rows = [(k, "-" * (k % 2) + text(30) + " " + (items[k % 5][1] or "") + "." * (k % 3), "s") for k in range(30)] + [(None, items[0][1], "s"), (50, None, "s"), (51, "", "s"), (3, items[1][1], "s"), (4, "the " * 3000, "s")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = decontaminate.contamination(docs_of(spark, rows), bench).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == brute_hits(rows, items)
    none = decontaminate.contamination(docs_of(spark, rows[:3]), bench.limit(0)).collect()
    assert [r["n_hit"] for r in none] == [0, 0, 0]
    assert decontaminate.contamination(docs_of(spark, rows).limit(0), bench).count() == 0


def test_items_that_share_a_window(spark, monkeypatch):
    """What is broadcast is counted itself: few windows may have many holders."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 100)
    asked = []
    small = decontaminate.small

    def counted(df, rows):
        asked.append((df.count(), rows))
        return small(df, rows)

    monkeypatch.setattr(decontaminate, "small", counted)
    shared = "one prompt that ten thousand items of the test share"
    items = spark.createDataFrame([(k, shared) for k in range(500)] + [(900, "x" * 5_000), (901, None)], "item_id long, text string")
    docs = docs_of(spark, [(1, f"before {shared} after", "s"), (2, "nothing of it", "s"), (3, "x" * 5_000, "s")])
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[1]["n_hit"], len(got[1]["items"])) == (10, 500) and got[2]["n_hit"] == 0 and got[3]["items"] == ["900"]
    assert all(rows >= have for have, rows in asked) and any(rows == 501 for _, rows in asked)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 10**6)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 1)
    assert {r["doc_id"]: len(r["items"]) for r in decontaminate.contamination(docs, items).collect()} == {1: 500, 2: 0, 3: 1}


def test_contamination_of_repeated_rows(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "single")]
    dirty, clean = f"x y {items[0][1]} z", "nothing of that kind stands in here"
    rows = [(1, dirty, "s"), (1, dirty, "s"), (1, dirty, "s"), (2, "a single word", "s"), (2, "a single word", "s"), (None, dirty, "s"), (None, dirty, "s"), (3, clean, "s"), (3, clean, "s")]
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == brute_hits(rows, items)
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).orderBy("doc_id").collect()] == [2, 2, 3, 3]


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    rows = [(1, "x alpha beta gamma delta y", "s"), (2, "alpha new beta gamma delta", "s"), (3, "alpha x x x x x beta gamma delta", "s"), (4, "delta gamma", "s")]
    near = decontaminate.contamination(docs_of(spark, rows), items, slop=2)
    assert {r["doc_id"] for r in near.collect() if r["n_hit"]} == {1, 2}
    exact = decontaminate.contamination(docs_of(spark, rows), items)
    assert {r["doc_id"] for r in exact.collect() if r["n_hit"]} == {1}


@pytest.mark.parametrize("slop", [1, 2, 3])
def test_proximity_brute(spark, slop):
    rng = np.random.default_rng(slop)
    vocab = list("abcdefg")
    items = [(k, " ".join(rng.choice(vocab, int(n)))) for k, n in enumerate([5, 6, 4, 1, 9])]
    rows = [(k, " ".join(rng.choice(vocab, 20)), "s") for k in range(25)]
    for k in range(10):
        w = items[k % 5][1].split()
        for _ in range(2):
            w.insert(int(rng.integers(0, len(w) + 1)), "z")
        rows.append((100 + k, "y " * k + " ".join(w), "s"))
    want = Counter()
    wins = {(tuple(w[k : k + 5]), i) for i, t in items for w in [t.split()] for k in range(max(1, len(w) - 4))}
    for d, t, _ in rows:
        w, hit, names = t.split(), set(), set()
        for win, i in wins:
            for s in range(-slop, len(w) + slop):
                if all(x in w[max(s + j - slop, 0) : max(s + j + slop + 1, 0)] for j, x in enumerate(win)):
                    hit |= {p for p in range(s, s + len(win)) if 0 <= p < len(w)}
                    names.add(str(i))
        want[d, len(hit), tuple(sorted(names))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs_of(spark, rows), bench, window=5, slop=slop).collect()
    assert Counter((r["doc_id"], r["n_hit"], tuple(r["items"])) for r in got) == want


def test_contamination_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    rng = np.random.default_rng(11)
    vocab = ["The", "of", "Ä", "ä", "rare1", "ÉT", "b"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(k, text(int(n))) for k, n in enumerate([12, 15, 3, 1, 10])]
    rows = [(k, text(30) + " " + items[k % 5][1].upper().replace("Ä", "ä") * (k % 2), "s") for k in range(30)] + [(None, items[0][1], "s")] * 3 + [(5, "the " * 500, "s")]
    got = decontaminate.contamination(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == brute_hits(rows, items)


def test_drop_of_short_items(spark):
    items = spark.createDataFrame([(1, "what is two plus two"), (2, "the")], "item_id long, text string")
    rows = [(1, "What is two plus two? Four.", "s"), (2, "so what is two plus two in a long and clean text about the sums that children learn at school", "s"), (3, "the", "s"), (4, None, "s"), (5, "", "s")]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs_of(spark, rows), items).collect()) == [2, 4, 5]


# -- op6 --------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        level = left / sum(w[n] for n in open_)
        full = {n for n in open_ if most * sizes[n] < w[n] * level}
        if not full:
            target |= {n: w[n] * level for n in open_}
            break
        target |= {n: most * sizes[n] for n in full}
        open_ -= full
    return target


def test_mixing_invariants(spark):
    rng = np.random.default_rng(9)
    sources = ["a", "b", "B", "é", "z", None]
    rows = [(int(k), " ".join(["w"] * int(rng.integers(0, 40))), sources[int(rng.integers(0, 6) ** 2 / 6) % 6]) for k in range(700)] + [(1, "x y", "a"), (None, "q", None), (900, None, "a"), (901, " \t", "tiny"), (902, "one", "small")]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs).collect()
    sizes, most = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
        most[s] = max(most[s], len((t or "").split()))
    want = brute_targets(dict(sizes))
    by_id = {}
    for i, _, s in rows:
        by_id.setdefault(i, set()).add(s)
    taken = Counter()
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(sizes.values())
    for r in got:
        s = next(x for x in by_id[r["doc_id"]] if sizes[x] == r["source_size"])
        assert r["target"] == pytest.approx(want[s]) and r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= most[s] + 1e-6 for s in sizes)
    key = lambda rs: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rs)
    assert key(mixing.mix(docs.repartition(5)).collect()) == key(got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_a_crowd_of_one_row(spark, monkeypatch):
    """A third of all rows is one row, another third has no id: no block holds them all, and targets are met."""
    monkeypatch.setattr(mixing, "PIECE", 50)
    rows = [(7, "a b c", "x")] * 300 + [(None, "p q", "x")] * 300 + [(k, "w " * (1 + k % 5), "xy"[k % 2]) for k in range(300)]
    docs = docs_of(spark, rows)
    for carry in ((), ("words",)):
        got = mixing.mix(docs, carry=carry).collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t.split())) for i, t, _ in rows)
        assert len({r["taken"] for r in got if r["doc_id"] == 7}) <= 2
        for total in {r["source_size"] for r in got}:
            mine = [r for r in got if r["source_size"] == total]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) + 1e-6
    key = lambda rs: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rs)
    assert key(mixing.mix(docs.repartition(7)).collect()) == key(mixing.mix(docs).collect())


def test_mixing_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = docs_of(spark, [(k, "w " * (k % 6), "abc"[k % 3]) for k in range(90)])
    want = Counter(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    assert Counter(map(tuple, mixing.mix(docs).collect())) == want


def test_mixing_is_fair(spark):
    rows = [(k, "w " * (1 + k % 9), "a" if k < 300 else "b") for k in range(600)]
    docs = docs_of(spark, rows)
    n = 5
    total = Counter()
    for seed in range(n):
        for r in mixing.mix(docs, seed=seed).collect():
            total[r["doc_id"]] += r["copies"]
    r = mixing.mix(docs).where("source_size > 0").groupBy("source_size").agg({"target": "max"}).first()
    assert abs(sum(total[k] for k in range(300)) / (300 * n) - brute_targets({"a": 1497, "b": 1500})["a"] / 1497) < 0.15 and r


# -- op8 --------------------------------------------------------------------------


def test_lines(spark, monkeypatch):
    rows = [(k, f"menu\nline {k} \n\nfoot", "h") for k in range(8)] + [(k, f"menu\nother {k}", None) for k in range(20, 24)]
    rows += [(30, "copy a\ncopy b", "h")] * 4 + [(31, None, "h"), (32, "", "h"), (33, "menu", "solo"), (None, "menu\nx", "h")]
    want = {0: ("line 0 \n", 4, 2), 20: ("other 20", 2, 1), 30: ("copy a\ncopy b", 2, 0), 31: (None, 0, 0), 32: ("", 1, 0), 33: ("menu", 1, 0)}
    for limit in (line_dedup.BROADCAST_LINES, -1):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
        got = line_dedup.drop_boilerplate(docs_of(spark, rows), ratio=0.3, carry=("lang",)).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got if r["doc_id"] in want} == want
        assert [r["text"] for r in got if r["doc_id"] is None] == ["x"]
    assert line_dedup.drop_boilerplate(docs_of(spark, rows).limit(0)).count() == 0
    table = line_dedup.boilerplate(docs_of(spark, rows), "source", "text", 0.3).collect()
    assert {(r["host"], r["line"], r["pages"]) for r in table} == {("h", "menu", 9), ("h", "foot", 8), (None, "menu", 4)}


def test_lines_of_a_row_that_repeats(spark, monkeypatch):
    """Beyond the broadcast, a row of which there are thousands sends its lines once a task."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    pages = docs_of(spark, [(k, f"menu\nline {k}", "h") for k in range(20)])
    many = docs_of(spark, [(99, "menu\nsame\nsame\n", "h")]).join(spark.range(3000).select(F.lit("h").alias("source")), "source").select(*pages.columns)
    found = line_dedup.drop_boilerplate(pages.unionAll(many), ratio=0.3)
    got = [(r["text"], r["n_lines"], r["n_dropped"]) for r in found.where("doc_id = 99").collect()]
    assert got == [("same\nsame\n", 4, 1)] * 3000 and found.where("doc_id < 99 and n_dropped = 1").count() == 20
    assert "partial_collect_set" in found._jdf.queryExecution().toString()


def test_lines_of_a_long_text(spark):
    rows = [(k, "head\n" + "\n".join(f"line {j} of {k}" for j in range(20_000)) + "\nhead", "h") for k in range(4)]
    got = line_dedup.drop_boilerplate(docs_of(spark, rows), ratio=0.5).collect()
    assert {(r["n_lines"], r["n_dropped"]) for r in got} == {(20_002, 2)}


# -- op9 --------------------------------------------------------------------------


def brute_classes(fp):
    fp = np.array(fp, dtype=np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))
    return simhash.classes(len(fp), i, j, np.arange(len(fp)))


def test_gray_tree_brute():
    rng = np.random.default_rng(2)
    assert list(simhash.gray_rank(np.array([k ^ k >> 1 for k in range(50)], dtype=np.uint64))) == list(range(50))
    for _ in range(25):
        n = int(rng.integers(1, 300))
        fp = rng.integers(0, 2**63, 6).astype(np.uint64)[rng.integers(0, 6, n)]
        for _ in range(int(rng.integers(0, 6))):
            fp = fp ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        tree = simhash.GrayTree(np.zeros(n, dtype=np.int64), fp)
        assert np.array_equal(tree.link(), brute_classes(tree.fp))


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 20])
def test_links_of_large_buckets(spark, chunk):
    rng = np.random.default_rng(4)
    fp = np.full(150, 0xDEADBEEF12345678, dtype=np.uint64)
    for _ in range(5):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    fp = np.unique(fp)
    table = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(table, chunk=chunk)).collect()}
    signed = np.sort(fp.view(np.int64))
    label = brute_classes(signed.view(np.uint64))
    assert all(got.get(int(x), int(x)) == int(signed[label[k]]) for k, x in enumerate(signed))


def test_near_duplicates(spark):
    base = " ".join(f"w{k % 37}x{k}" for k in range(400))
    rows = [(5, base, "s"), (2, base.replace("w0x0", "changed"), "s"), (9, base, "s"), (9, base, "s"), (7, None, "s"), (8, "", "s"), (6, " \n", "s"), (None, "one two", "s"), (11, "ONE\ttwo", "s"), (12, "other words stand here", "s")]
    docs = docs_of(spark, rows)
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    by = {i: c for i, _, c in got}
    assert len(got) == len(rows) and by[5] == by[2] == by[9] == 2 and by[7] == by[8] == by[6] == 6 and by[11] == by[None] == 11 and by[12] == 12
    assert all(np.int64(np.uint64(simhash.fingerprint(t)).view(np.int64)) == next(f for j, f, _ in got if j == i) for i, t, _ in rows)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [2, 6, 11, 12]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_classes_beyond_the_broadcast_bound(spark, monkeypatch):
    base = [" ".join(f"w{k % 37}x{k}y{j}" for k in range(300)) for j in range(4)]
    rows = [(k, base[k % 3] + (" more" if k % 5 == 0 else ""), "s") for k in range(60)] + [(100, base[3], "s"), (None, base[3], "s"), (101, "alone here", "s"), (None, None, "s")]
    docs = docs_of(spark, rows)
    want = Counter(map(tuple, simhash.near_duplicates(docs).collect()))
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect())
    label = brute_classes([simhash.fingerprint(t) for _, t, _ in rows])
    assert sum(kept.values()) == len(set(label.tolist()))
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()) == kept


def test_keep_one_without_usable_ids(spark):
    texts = ["red fox runs over hills", "blue whale sings below waves", "green tree stands near rivers", "old clock ticks behind doors"]
    rows = [(None, t, "s") for t in texts] + [(None, texts[0], "s"), (4, texts[1], "s"), (5, "iron bridge spans wide valley", "s"), (5, "quiet monk copies ancient books", "s")]
    got = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one(docs_of(spark, rows)).collect())
    assert got == Counter([(None, texts[0]), (4, texts[1]), (None, texts[2]), (None, texts[3]), rows[6][:2], rows[7][:2]])


def test_mixing_stage_keeps_rows_of_one_id_apart(spark, sf):
    import corpus_pipeline as p

    rows = [(k % 3 or None, f"{'w ' * (1 + k % 4)}t{k // 2}", "ab"[k % 2]) for k in range(40)] + [(1, "same text", "a")] * 5
    docs = docs_of(spark, rows)
    got = p.mixing_stage(spark, docs, sf).collect()
    held = Counter((r["doc_id"], r["text"], r["source"]) for r in got)
    assert all(n <= Counter(rows)[k] for k, n in held.items())
    assert all(r["taken"] == r["copies"] * len(r["text"].split()) for r in got)


# -- oracles and pipeline -----------------------------------------------------------


@pytest.mark.parametrize("name", ["op3_maxscore_topk", "op4_substring_dedup", "op5_decontamination", "op8_line_dedup"])
def test_oracle(spark, sf, name):
    from libretto.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(want.fetchall())


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {}
    for name, stage in p.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = p.stored(stage(spark, docs, sf), f"test-{name}")
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        assert docs.columns[:5] == list(p.COLUMNS)
        held[name] = before, after
    before, after = held["language_id"]
    assert all(any(map(str.isalpha, before[i]["text"])) for i in after) and len(after) >= 0.98 * len(before)
    before, after = held["line_dedup"]
    assert set(before) == set(after) and all(r["n_chars"] == len(r["text"]) for r in after.values())
    before, after = held["near_dedup"]
    ids = sorted(before)
    label = brute_classes([simhash.fingerprint(before[i]["text"]) for i in ids])
    assert set(after) == {ids[k] for k in set(label.tolist())}
    before, after = held["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    long = [(i, t) for i, t in items if len(t.split()) >= 10]
    dirty = {d for d, _, hit, _ in brute_hits([(i, r["text"], "s") for i, r in before.items()], long) if hit}
    assert set(after) == set(before) - dirty
    before, after = held["mixing"]
    assert all(r["copies"] >= 1 and r["taken"] == r["copies"] * len(r["text"].split()) for r in after.values())


EDGE_DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, hash long, score double, line string, fp long, copies long"


def edge_rows():
    texts = ["the quick brown fox and the lazy dog with them all", "le renard brun et le chien paresseux avec eux tous", "", " \n ", None, "1234 5678", "a", "long " * 30_000]
    rows = [(k % 9 if k % 4 else None, texts[k % 8], ["en", "fr", None][k % 3], ["x", None, "y"][k % 3], k, k, k, 0.5, "l", 7, 3) for k in range(80)]
    return rows + [rows[1]] * 30 + [(5, f"shared id but text number {k} of many different ones", "en", "x", 1, 1, 1, 0.5, "l", 7, 3) for k in range(30)]


@pytest.mark.parametrize("k", range(5))
def test_stage_edge_cases(spark, sf, k):
    """Nulls everywhere, empty and long texts, repeated rows, an id of many texts, clashing extra columns, an empty table."""
    import corpus_pipeline as p

    name, stage = p.STAGES[k]
    docs = spark.createDataFrame(edge_rows(), EDGE_DOCS)
    extra = ["copies", "taken"] if name == "mixing" else []
    got = stage(spark, docs, sf)
    assert got.columns == [*p.COLUMNS, *extra]
    rows, before = got.collect(), Counter((r[0], r[1]) for r in edge_rows())
    after = Counter((r["doc_id"], r["text"]) for r in rows)
    if name == "language_id":
        assert after and not {t for _, t in after} & {None, "", " \n ", "1234 5678"}
        assert all(after[key] == before[key] for key in after)
    elif name == "line_dedup":
        assert len(rows) == sum(before.values()) and sum(t is None for _, t in after.elements()) == sum(t is None for _, t in before.elements())
    elif name == "near_dedup":
        assert all(n == 1 for n in after.values()) and sum(1 for _, t in after if t is not None and t.startswith("shared id")) >= 20
    elif name == "decontamination":
        assert after == before
    else:
        assert all(r["copies"] >= 1 and r["taken"] == r["copies"] * len((r["text"] or "").split()) for r in rows) and not after - before
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_language_stage_spares_short_texts_and_rejects_foreign_ones(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*p.COLUMNS)
    foreign = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    code = "xqzv kjwp qqzt vvbx zzkq wjxv pqkz vxjq kzzw qpvx jjkz wqvz xkpq zvjw " * 4
    extra = [(-1, "Avec.", None, "s", 5), (-2, "Eroö.", None, "s", 5), (-3, foreign * 3, None, "s", 1), (-4, code, None, "s", 1), (-5, "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 3, None, "s", 1)]
    kept = {r["doc_id"] for r in p.language_id(spark, docs.unionAll(spark.createDataFrame(extra, docs.schema)), sf).collect()}
    assert kept >= {-1, -2} and not kept & {-4, -5}
    assert len(kept) >= 0.98 * docs.where("text is not null").count()
