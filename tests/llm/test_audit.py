"""Exact dedup, hard negatives and source divergence against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from libretto.llm import divergence, exact_dedup, hard_negatives
from libretto.llm import queries as llm

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, keep_id long, p long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", 7, -1, 5) for i, t, lang, s in rows], DOCS)


# -- op11 -----------------------------------------------------------------------


def normal(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, keep[normal(t)], len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows)


def test_exact_duplicates_brute(spark):
    rng = np.random.default_rng(5)
    texts = ["a b", "a\t\tb", " a b", "a b ", "", None, " ", "\x0b\x0c", "é x", "é x", "x" * 300_000, "long " * 50_000]
    rows = [(int(i), texts[rng.integers(0, len(texts))]) for i in rng.permutation(400)] + [(None, "a b"), (None, "only null ids"), (None, "only null ids"), (7, "again"), (7, "again")]
    got = exact_dedup.exact_duplicates(docs_of(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_groups(rows)
    stay = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(stay.values()) == {1} and len(stay) == len({normal(t) for _, t in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_duplicates_empty(spark):
    got = exact_dedup.exact_duplicates(docs_of(spark, []))
    assert got.count() == 0 and got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_a_large_group_is_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_LARGE", 3)
    rows = [(k, "same" if k % 3 else f"text {k % 50}") for k in range(300)]
    got = exact_dedup.exact_duplicates(docs_of(spark, [(i, t, "en", "s") for i, t in rows]), batches=3).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_groups(rows)
    assert sum(r["kept"] for r in got) == len({t for _, t in rows})


def test_index_over_batches_and_sessions(spark, tmp_path):
    index = exact_dedup.DigestIndex.create(spark, f"file://{tmp_path}/index", 4)
    batches = [[(1, "a"), (2, "b"), (3, "a")], [(4, "b "), (5, "c"), (None, "d"), (6, "d")], [(7, "a"), (8, "e")]]
    kept = []
    for rows in batches:
        index.close()
        index = exact_dedup.DigestIndex.open(spark, f"file://{tmp_path}/index")
        kept.append(sorted(r["doc_id"] for r in exact_dedup.keep_new(docs_of(spark, [(i, t, "en", "s") for i, t in rows]), index).collect()))
    # "b " is not "b": only runs of white space are made one
    assert kept == [[1, 2], [4, 5, 6], [8]]
    before = index.rows().count()
    again = docs_of(spark, [(i, t, "en", "s") for i, t in batches[1]])
    assert exact_dedup.keep_new(again, index).count() == 0 and index.rows().count() == before == 6
    rebuilt = index.rebuilt(f"file://{tmp_path}/rebuilt", 2)
    assert sorted(rebuilt.rows().collect()) == sorted(index.rows().collect()) and rebuilt.buckets == 2


def test_an_interrupted_append_is_completed(spark, tmp_path):
    index = exact_dedup.DigestIndex.create(spark, f"file://{tmp_path}/index", 3)
    rows = exact_dedup.digested(docs_of(spark, [(k, f"t{k % 40}", "en", "s") for k in range(100)]))
    index.add(rows.where("id < 20"))  # as if a first attempt had come so far
    index.add(rows)
    index.add(rows)
    assert index.rows().count() == 40 and index.rows().select("digest").distinct().count() == 40


def test_the_index_is_not_shuffled(spark, tmp_path):
    index = exact_dedup.DigestIndex.create(spark, f"file://{tmp_path}/index", 4)
    rows = exact_dedup.digested(docs_of(spark, [(k, f"t{k}", "en", "s") for k in range(50)]))
    index.add(rows)
    new = rows.groupBy("digest").count().hint("merge").join(index.rows(), "digest", "left_anti")
    plan = new._jdf.queryExecution().executedPlan().toString()
    # the new rows are shuffled, the buckets are read in place
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


# -- op12 -----------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id long, row long, norm double, v int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2, 3.0, 4) for i, v, y in rows], VECTORS)


def brute_negatives(rows, positives=5, negatives=3):
    seen, rows_in = set(), []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
        if (i, whole, y) not in seen:
            seen.add((i, whole, y))
            rows_in.append((i, whole, y))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for i, v, y in rows_in:
        if i % 50:
            continue
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, dot(v, w))), j, z) for j, w, z in rows_in if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [(n, k) for n, k, z in scored if z != y and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(i, j, r, k, -s, -n) for r, (n, k) in enumerate(fit[:negatives], 1)]
    return Counter(out)


def found(df):
    return Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("seed,width,labels,spread", [(0, 8, 3, 1.0), (1, 33, 5, 0.2), (2, 3, 2, 0.05), (3, 1, 2, 1.0)])
def test_negatives_brute(spark, monkeypatch, seed, width, labels, spread):
    monkeypatch.setattr(hard_negatives, "SHARD_BYTES", 4000)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 100)
    monkeypatch.setattr(hard_negatives, "PILOT", 20)
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, width))
    rows = []
    for k in range(350):
        y = int(rng.integers(0, labels))
        rows.append((k, [float(x) for x in np.round(centre[y] + spread * rng.normal(size=width), 2)], y))
    # ties, repeated rows and rows that take no part
    rows += [(1000 + k, rows[k % 7][1], k % labels) for k in range(30)] + rows[:5] + [(2000, None, 1), (2001, [1.0] * width, None), (None, [1.0] * width, 1), (2050, [float("nan")] * width, 1), (2100, [None] * width, 0)]
    assert found(hard_negatives.mine(vectors_of(spark, rows))) == brute_negatives(rows)


def test_negatives_of_odd_vectors(spark):
    big = [(0, [1e30, 1.0], 0), (1, [3e30, 2.0], 0), (2, [2e30, 0.0], 1), (3, [1.0, 1.0], 1), (50, [0.0, 0.0], 1), (51, [0.0, -3.0], 0), (52, [-1.0, 0.0], 0), (100, [4e18, 0.5], 1), (53, [1e-9, 1.0], 1)]
    assert found(hard_negatives.mine(vectors_of(spark, big))) == brute_negatives(big)
    short = [(0, [1.0], 0), (1, [1.0, 5.0], 0), (2, [0.75], 1), (3, [], 1)]
    assert found(hard_negatives.mine(vectors_of(spark, short))) == Counter([(0, 1, 1, 2, 65536, 49152)])
    assert hard_negatives.mine(vectors_of(spark, [])).count() == 0
    assert hard_negatives.mine(vectors_of(spark, [(0, [1.0], 3)])).count() == 0


def test_rotation_discards_early_and_loses_nothing():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 64)) * np.array([900, 600, 400, 300, 200, 100])[:, None]
    whole = np.floor(rng.normal(size=(3000, 6)) @ base + rng.normal(size=(3000, 64)) * 3)
    turn = hard_negatives.rotation(whole.T @ whole)
    slack = hard_negatives.slack_factor(turn)
    assert slack < 1e-11 and np.allclose(turn.T @ turn, np.eye(64), atol=1e-12)
    ids = np.arange(3000)
    side = hard_negatives.Side.of(ids, ids, ids % 4, whole, turn)
    q = hard_negatives.Side.of(ids[:100], ids[:100], ids[:100] % 4, whole[:100], turn)
    exact = whole[:100].astype(np.int64) @ whole.T.astype(np.int64)
    floor = np.sort(exact, axis=1)[:, -20]
    seen = []
    qi, ci = hard_negatives.survivors(q, side, np.ones((100, 3000), dtype=bool), floor, np.full(100, hard_negatives.TOP), slack, seen)
    want = {(a, b) for a, b in zip(*np.nonzero(exact >= floor[:, None]), strict=True)}
    assert want <= set(zip(qi, ci, strict=True)) and len(qi) < 1.2 * len(want)
    assert sum(seen) < 0.5 * exact.size * 64
    assert (hard_negatives.products(q, side, qi, ci) == exact[qi, ci]).all()


def test_steps_reach_the_width():
    for width in (1, 2, 3, 64, 1000):
        assert hard_negatives.steps(width)[-1] == width and sorted(set(hard_negatives.steps(width))) == hard_negatives.steps(width)


# -- op13 -----------------------------------------------------------------------


def brute_audit(rows, least=10, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", s or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(lower))) for _, t, lang, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(w for g, _, words in docs if g == lang for w in set(words))
        kept = [w for w, n in df.items() if n >= least]
        counts = {s: Counter() for g, s, _ in docs if g == lang}
        for g, s, words in docs:
            if g == lang:
                counts[s].update(w for w in words if df[w] >= least)
        p_of = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}  # noqa: B023, E731
        p, q = {s: p_of(c) for s, c in counts.items()}, p_of(sum(counts.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(found, 1)]
    return Counter(out)


def audited(df):
    return Counter(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.mark.parametrize("seed,sources,block,bits", [(0, 7, 64, 15), (1, 12, 2, 3), (2, 5, 1, 2)])
def test_divergence_brute(spark, monkeypatch, seed, sources, block, bits):
    monkeypatch.setattr(divergence, "SLICE_BITS", bits)
    monkeypatch.setattr(divergence, "ROUNDS", 2)
    monkeypatch.setattr(divergence, "PIECE", 10)
    rng = np.random.default_rng(seed)
    words = ["a", "Ab", "été", "ÉTÉ", "x-y", "z9z", "\U0001d54f", "￿", "日本", "same"] + [f"w{c}" for c in "bcdefghijkl"]
    rows = []
    for k in range(160):
        n = int(rng.integers(0, 14))
        rows.append((k, " ".join(rng.choice(words, n, p=None)), str(rng.choice(["en", "de"])), f"s{rng.integers(0, sources)}"))
    rows += rows[:6] + [(900, None, "en", "s0"), (901, "", None, None), (902, "a b", None, "s1"), (903, "0123 --", "fr", "only"), (None, "same same", "en", None), (904, "same " * 30_000, "en", "s1")]
    got = audited(divergence.audit(docs_of(spark, rows), block=block))
    assert got == brute_audit(rows)


def test_divergence_empty(spark):
    got = divergence.audit(docs_of(spark, []))
    assert got.count() == 0 and got.columns == ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 7, 8, 13])
def test_tournament_meets_every_pair_once(spark, blocks):
    table = spark.range(blocks).select(F.col("id").cast("int").alias("b"), F.lit(blocks).alias("n"))
    met, hosts = Counter(), Counter()
    for first in range(0, blocks + 1, 3):
        trips, _ = divergence.visits(F.col("b"), F.col("n"), first, first + 3)
        rows = table.select("b", F.explode(trips).alias("t")).select("b", "t.*").collect()
        for r in range(first, first + 3):
            busy = [x for t in rows if t["round"] == r for x in (t["b"], t["host"])]
            assert len(busy) == len(set(busy)), "a block meets one other a round"
        met.update(frozenset((t["b"], t["host"])) for t in rows)
        hosts.update(t["host"] for t in rows)
    assert met == Counter({frozenset((a, b)): 1 for a in range(blocks) for b in range(a)})
    assert not hosts or max(hosts.values()) <= blocks // 2 + 1


def test_smoothing_is_exact():
    rng = np.random.default_rng(8)
    for _ in range(300):
        v = int(rng.integers(1, 10**7))
        c = int(rng.integers(0, 10 ** rng.integers(1, 15)))
        n = c + int(rng.integers(0, 10**15))
        assert int(divergence.smoothed(np.array([c]), n, v)[0]) == 1 + 10**9 * (c + 2) // (n + 2 * v)


def test_contract_queries_are_registered(spark, sf):
    for name in ("op11_exact_dedup", "op12_hard_negatives", "op13_source_divergence"):
        assert name in llm.QUERIES and name in llm.ORACLES
