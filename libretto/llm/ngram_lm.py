"""Language-model scores by deleted interpolation.

A word n-gram model: the maximum-likelihood estimates of every order up to n and
the uniform distribution are mixed with weights that depend on how often the
longest context that was seen occurs. The weights are learned by
expectation-maximisation on counts held out of the estimates; the final estimates
use all training counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, stored
from .exchange import REQUEST, WordHash, aligned, answered, dealt, joined, packed

#: Longest n-gram.
ORDER = 3
#: Hashes of the end token and of the start context, and what tells unigram keys from others.
END, START, UNIGRAM = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D)
#: What a bucket's documents are for: estimating, holding out, or scoring only.
FIT, HELD, SCORED = 0, 1, 2
#: Heads of requests: mode + MODES * (order - 1).
MODES = 4
#: Context buckets of an order: log2 of the context's count, up to this.
CONTEXTS = 32
#: Held-out likelihoods are gathered in cells of half an octave per estimate.
OCTAVE, CELLS = 2, 80
COUNTS = np.dtype([("fit", "<u8"), ("held", "<u8")])
#: Characters of a bucket.
PER_BUCKET = 8_000_000
#: Keys of trigrams and longer n-grams, the most there are, travel with 56 bits of their hash: with 10**12 of them one in 70 000 meets another.
SHORTER = ~np.uint64(0xFF)
#: EM rounds.
ROUNDS = 60


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and where each key is among them: hashed first, so that only distinct keys are sorted."""
    code, found = pd.factorize(keys)
    order = np.argsort(found)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return found[order], place[code]


class Tokens:
    """Token hashes of a bucket's documents and the n-gram keys it asks for, one list per order.

    The key of an n-gram is made of the key of its context, the (n-1)-gram before it,
    and its last token. ``opening`` is the context of a text's first token: it counts
    once per text, so that it has a context count like any other.
    """

    def __init__(self, texts: list[str | None], order: int = ORDER):
        cache, end = WordHash(), np.array([END], dtype=np.uint64)
        hashed = [np.concatenate([cache.array(_lowered(t).split()), end]) for t in texts]
        del cache
        self.sizes = np.array([len(h) for h in hashed], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        token = np.concatenate([end[:0], *hashed])
        grams = joined(np.full_like(token, UNIGRAM), token)
        opening = joined(np.array([UNIGRAM]), np.array([START]))
        self.keys, self.at, self.opening = [], [], []
        for k in range(order):
            keys, at = distinct(np.concatenate([grams, opening]) & (SHORTER if k > 1 else ~np.uint64(0)))
            self.keys.append(keys)
            self.at.append(at[:-1])
            self.opening.append(int(at[-1]))
            context = np.concatenate([opening, grams[:-1]])
            context[self.starts] = opening
            grams, opening = joined(context, token), joined(opening, np.array([START]))

    def counts(self, k: int) -> np.ndarray:
        out = np.bincount(self.at[k], minlength=len(self.keys[k])).astype(np.uint32)
        out[self.opening[k]] = len(self.sizes)
        return out

    def context(self, k: int) -> np.ndarray:
        """Per token, where its context of ``k + 1`` tokens is among the keys of that order."""
        before = np.concatenate([self.at[k][:0], [self.opening[k]], self.at[k][:-1]])
        before[self.starts] = self.opening[k]
        return before


def _lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def counted(texts: DataFrame, n: int, order: int) -> DataFrame:
    """Stored replies: training counts of each bucket's n-grams, those of order k in parts from ``n * (k - 1)`` on.

    Rows of bucket -1 hold, per unigram part, its distinct training tokens and the
    tokens of the fitted and the held-out rows.
    """
    opening = joined(np.array([UNIGRAM]), np.array([START]))[0]

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        t = Tokens(rows["text"].tolist(), order)
        bucket, mode = int(rows["bucket"].iloc[0]), int(rows["mode"].iloc[0])
        out = []
        for k in range(order):
            out.append(packed(bucket, mode + MODES * k, t.keys[k], t.counts(k), n))
            out[k]["part"] += np.int32(n * k)
        return pd.concat(out)

    def tally(keys: np.ndarray, index: np.ndarray, heads: np.ndarray, counts: np.ndarray):
        out = np.zeros(len(keys), dtype=COUNTS)
        for name, mode in (("fit", FIT), ("held", HELD)):
            mine = heads % MODES == mode
            out[name] = np.bincount(index[mine], counts[mine], minlength=len(keys))
        if not len(heads) or heads[0] >= MODES:
            return out, None
        real = out[keys != opening]
        return out, [int(np.count_nonzero(real["fit"] + real["held"])), int(real["fit"].sum()), int(real["held"].sum())]

    requests = texts.groupBy("bucket").applyInPandas(ask, REQUEST)
    return stored(answered(requests, np.uint32, tally), "counts")


def heard_counts(replies: pd.DataFrame, n: int, order: int) -> list[np.ndarray]:
    """A bucket's counts, per order, aligned with its keys."""
    which = replies["part"] // n
    return [aligned(replies[which == k], COUNTS) for k in range(order)]


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + 1, CONTEXTS - 1), 0)


def estimates(t: Tokens, counts: list[np.ndarray], total: float, types: float) -> tuple[np.ndarray, np.ndarray]:
    """Per token, (context bucket, estimates from the longest n-gram's to the uniform one) from float counts.

    The bucket is that of the longest context that occurs: CONTEXTS * (its length - 1)
    + log2 of its count + 1; 0 where not even the previous token occurs.
    """
    parts = [np.full(len(t.at[0]), 1.0 / (types + 1)), counts[0][t.at[0]] / total if total else np.zeros(len(t.at[0]))]
    bucket = np.zeros(len(t.at[0]), dtype=np.int64)
    for k in range(1, len(counts)):
        before = counts[k - 1][t.context(k - 1)]
        parts.append(np.where(before > 0, counts[k][t.at[k]] / np.maximum(before, 1), 0.0))
        bucket = np.where(before > 0, CONTEXTS * (k - 1) + context_bucket(before), bucket)
    return bucket, np.stack(parts[::-1], axis=1)


def _cell(value: np.ndarray) -> np.ndarray:
    """Half octave below 1 in which a likelihood lies, from 1; 0 for zero."""
    return np.where(value > 0, np.clip(1 - OCTAVE * np.log2(np.maximum(value, 1e-300)), 1, CELLS - 1).astype(np.int64), 0)


def cells_of(bucket: np.ndarray, f: np.ndarray) -> pd.DataFrame:
    """Tokens gathered by context bucket and cell: their number and the sums of their estimates but the uniform one."""
    cell = np.zeros(len(bucket), dtype=np.int64)
    for k in range(f.shape[1] - 1):
        cell = cell * CELLS + _cell(f[:, k])
    size = CELLS ** (f.shape[1] - 1)
    keys, at = np.unique(bucket * size + cell, return_inverse=True)
    out = {"b": keys // size, "cell": keys % size, "weight": np.bincount(at, minlength=len(keys)).astype(float)}
    return pd.DataFrame(out | {f"f{k}": np.bincount(at, f[:, k], minlength=len(keys)) for k in range(f.shape[1] - 1)})


def expectation_maximisation(weight: np.ndarray, f: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of the estimates ``f`` (rows by parts) of events that count ``weight``."""
    lam = np.full(f.shape[1], 1.0 / f.shape[1])
    for _ in range(rounds):
        p = lam * f
        lam = (weight[:, None] * p / p.sum(axis=1, keepdims=True)).sum(axis=0) / weight.sum()
    return lam


def weight_table(learned: dict[int, tuple[float, np.ndarray]], order: int) -> np.ndarray:
    """Weights of every context bucket from (held-out tokens, weights) of those that have any; the others take their mean."""
    size, mass = max(1, CONTEXTS * (order - 1)), sum(n for n, _ in learned.values())
    mean = sum(n * lam for n, lam in learned.values()) / mass if mass else np.full(order + 1, 1.0 / (order + 1))
    lam = np.stack([learned[b][1] if b in learned else mean for b in range(size)])
    # no event may become impossible, and an order whose context does not occur has no say
    lam = np.maximum(lam, 1e-6)
    for b in range(size):
        longest = b // CONTEXTS + 2 if b else 1
        lam[b, : order - longest] = 0.0
    return lam / lam.sum(axis=1, keepdims=True)


def learn_weights(gathered: DataFrame, uniform: float, order: int) -> np.ndarray:
    """Weights per context bucket by EM over the cells of all held-out tokens.

    Every bucket is a group of its own, of at most CELLS ** order cells, whatever the
    corpus. A cell stands for its tokens by their mean estimates, from which each
    differs by less than half an octave; so the weights are those of EM over single
    tokens but for second-order terms. Only the weights come to the driver.
    """
    names = [f"f{k}" for k in range(order)]
    cells = gathered.groupBy("b", "cell").agg(*(F.sum(c).alias(c) for c in ("weight", *names)))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell")
        weight = rows["weight"].to_numpy()
        f = np.column_stack([*(rows[c].to_numpy() / weight for c in names), np.full(len(rows), uniform)])
        return pd.DataFrame({"b": [int(rows["b"].iloc[0])], "n": [weight.sum()], "lam": [expectation_maximisation(weight, f).tolist()]})

    found = cells.groupBy("b").applyInPandas(learn, "b long, n double, lam array<double>").collect()
    return weight_table({r["b"]: (r["n"], np.array(r["lam"])) for r in sorted(found, key=lambda r: r["b"])}, order)


class Model:
    """Counts of the corpus, mixture weights and the dealt texts they belong to."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, modulus: int, scored: int, held: int, order: int):
        fold = remainder(F.col(id_col), modulus)
        mode = F.when(fold.isNull() | (fold == scored), SCORED).when(fold == held, HELD).otherwise(FIT)
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), mode.cast("int").alias("mode"))
        # a bucket holds documents of one mode
        self.order = order
        self.texts, buckets = dealt(rows, "text", PER_BUCKET, F.col("mode"))
        self.n = max(1, sum(map(len, buckets.values())))
        counts = counted(self.texts, self.n, order)
        stat = counts.where(F.col("bucket") == -1).agg(*(F.coalesce(F.sum(F.col("stat")[k]), F.lit(0)).alias(f"s{k}") for k in range(3))).first()
        self.types, self.fitted, self.total = stat["s0"], stat["s1"], stat["s1"] + stat["s2"]
        self.heard = counts.where(F.col("bucket") >= 0).select("bucket", "part", "vals")
        self.weights = learn_weights(self._held_cells(buckets.get(HELD, range(0))), 1.0 / (self.types + 1), order)

    def _held_cells(self, mine: range) -> DataFrame:
        n, order, fitted, types = self.n, self.order, self.fitted, self.types
        names = ["b", "cell", "weight", *(f"f{k}" for k in range(order))]

        def cells(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({c: [] for c in names})
            t = Tokens(rows["text"].tolist(), order)
            return cells_of(*estimates(t, [c["fit"].astype(float) for c in heard_counts(replies, n, order)], fitted, types))

        texts = self.texts.where(F.col("mode") == HELD).groupBy("bucket")
        heard = self.heard.where((F.col("bucket") >= mine.start) & (F.col("bucket") < mine.stop)).groupBy("bucket")
        return texts.cogroup(heard).applyInPandas(cells, "b long, cell long, " + ", ".join(f"{c} double" for c in names[2:]))

    def scores(self) -> DataFrame:
        """(id, n_tokens, n_known, base_score, score) of every row."""
        n, order, total, types, weights = self.n, self.order, self.total, self.types, self.weights

        def score(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
            out = {"id": rows["id"].astype("Int64")}
            if not len(rows):
                return pd.DataFrame({**out, "n_tokens": [], "n_known": [], "base_score": [], "score": []})
            t = Tokens(rows["text"].tolist(), order)
            counts = [c["fit"].astype(float) + c["held"].astype(float) for c in heard_counts(replies, n, order)]
            c = counts[0][t.at[0]]
            b, f = estimates(t, counts, total, types)
            p = (weights[b] * f).sum(axis=1) if total else np.ones(len(c))
            sums = [np.add.reduceat(x, t.starts) for x in (c > 0, np.log10((c + 1) / (total + types + 1)), np.log10(p))]
            return pd.DataFrame({**out, "n_tokens": t.sizes, "n_known": sums[0].astype(np.int64), "base_score": sums[1], "score": sums[2]})

        schema = "id long, n_tokens long, n_known long, base_score double, score double"
        return self.texts.groupBy("bucket").cogroup(self.heard.groupBy("bucket")).applyInPandas(score, schema)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, scored: int = 2, held: int = 3, order: int = ORDER) -> DataFrame:
    """Score every row: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    The model learns from rows whose crc32(id as text) mod ``modulus`` is not
    ``scored``; among those the fold ``held`` is what EM holds out. A null or empty
    text is its end token alone. A row with a null id is scored, neither learned
    from nor held out. Repeated rows are counted and scored as often as they come;
    other columns are ignored; without training rows every token has the uniform
    probability 1; an empty table gives an empty result. Each text is scored whole,
    in one bucket, so a task needs memory for its longest text. N-grams are compared
    by 64-bit hashes.
    """
    if order < 1:
        raise ValueError("an n-gram has one word at least")
    model = Model(docs, id_col, text_col, modulus, scored, held, order)
    out = F.when(remainder(F.col("id"), modulus) == scored, True).otherwise(False)
    return model.scores().select(F.col("id").alias(id_col), out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
