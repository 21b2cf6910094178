"""Repeated passages by level-wise doubling.

Level one hashes every window of half the final length; windows repeated there,
in two documents, are candidates, and two candidates in a row are extended to
one window of twice the length, until the final length is reached or no
candidate survives. At the final length each window learns the smallest id it
starts in. Exact and near copies need no path of their own: their windows are
repeated windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .exchange import REQUEST, WordHash, aligned, answered, dealt, joined, packed

#: Order of a null id: after all others.
LAST = 2**63 - 1
NONE = np.zeros(0, dtype=np.uint64)


class Words:
    """The documents of a bucket as one run of word hashes, and hashes of their windows."""

    def __init__(self, docs: pd.DataFrame):
        self.ids = np.array([LAST if i is None or i != i else int(i) for i in docs["id"]], dtype=np.int64)
        cache = WordHash()
        self.words = [(t or "").encode().split() for t in docs["text"]]
        sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        one = np.concatenate([cache.array(w) for w in self.words]) if len(sizes) else NONE
        self.hashes = {1: one}

    def windows(self, length: int) -> np.ndarray:
        """Hash of the window of ``length`` words from each word on (meaningless past a document's end)."""
        if length not in self.hashes:
            half = length // 2
            a, b = self.windows(half), self.windows(length - half)
            shifted = np.zeros_like(b)
            if len(b) > half:
                shifted[:-half] = b[half:]
            self.hashes[length] = joined(a, shifted)
        return self.hashes[length]

    def whole(self, length: int) -> np.ndarray:
        """Which words start a window of ``length`` inside their document."""
        return np.arange(len(self.doc)) + length <= self.ends[self.doc] if len(self.doc) else np.zeros(0, dtype=bool)


def lengths(window: int, first: int) -> list[int]:
    """Window lengths of the levels: doubled from about ``first`` up to ``window``."""
    out = [window]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


def survivors(words: Words, levels: list[int], replies: pd.DataFrame) -> np.ndarray:
    """Candidate window starts for the last of ``levels``, given the replies of the levels before it."""
    alive = words.whole(levels[0])
    for k, length in enumerate(levels[:-1]):
        index = np.flatnonzero(alive)
        keys, where = np.unique(words.windows(length)[index], return_inverse=True)
        again = aligned(replies[replies["level"] == k], np.uint8)
        if not len(again):
            return np.zeros(len(alive), dtype=bool)
        repeated = np.zeros(len(alive), dtype=bool)
        repeated[index] = again[where] > 0
        longer = levels[k + 1]
        shift = longer - length
        alive = np.zeros_like(repeated)
        alive[:-shift] = repeated[:-shift] & repeated[shift:]
        alive &= words.whole(longer)
    return alive


def smallest(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, LAST, dtype=np.int64)
    np.minimum.at(out, index, values)
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, first: int = 25) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, runs) of every row.

    A word is removed if a window of ``window`` words that covers it also starts in
    a row with a smaller id. ``kept_sha256`` is of the kept words joined by one
    space; ``runs`` lists the removed word positions as start, end, start, end, ...
    A null or empty text has no words; a null id counts as larger than all others;
    rows that repeat an id do not remove each other's words; other columns are
    ignored; an empty table gives an empty result. A text is handled whole in one
    bucket, so a task needs memory for its longest text. Windows are compared by
    64-bit hashes of whole words.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts, buckets = dealt(rows, "text")
    n = max(1, sum(map(len, buckets.values())))
    levels = lengths(window, min(first, window))
    spark = docs.sparkSession
    replies = spark.createDataFrame([], "bucket int, part int, vals binary, level int")

    def asking(upto: int):
        last = upto == len(levels) - 1

        def run(rows: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return pd.DataFrame({"part": [], "bucket": [], "head": [], "keys": [], "vals": []})
            words = Words(rows)
            index = np.flatnonzero(survivors(words, levels[: upto + 1], heard))
            keys, where = np.unique(words.windows(levels[upto])[index], return_inverse=True)
            low = smallest(where, words.ids[words.doc[index]], len(keys))
            if last:
                vals = low
            else:
                # in how many documents of this bucket, two at most
                doc = words.doc[index]
                a = np.full(len(keys), len(words.ids) + 1)
                b = np.full(len(keys), -1)
                np.minimum.at(a, where, doc)
                np.maximum.at(b, where, doc)
                vals = (1 + (a != b)).astype(np.uint8)
            return packed(int(rows["bucket"].iloc[0]), 0, keys, vals, n)

        return run

    def tally(keys: np.ndarray, index: np.ndarray, heads: np.ndarray, vals: np.ndarray):
        again = np.bincount(index, vals, len(keys)) > 1
        return again.astype(np.uint8), [int(again.sum())]

    for k in range(len(levels) - 1):
        requests = texts.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInPandas(asking(k), REQUEST)
        got = stored(answered(requests, np.uint8, tally), f"level{levels[k]}")
        replies = replies.unionAll(got.where("bucket >= 0").drop("stat").withColumn("level", F.lit(k)))
        if not got.where("bucket < 0").agg(F.sum(F.col("stat")[0])).first()[0]:
            break  # no candidate survives, so none does at any greater length
    else:
        requests = texts.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInPandas(asking(len(levels) - 1), REQUEST)
        got = stored(answered(requests, np.int64, lambda keys, index, heads, vals: (smallest(index, vals, len(keys)), None)), f"level{window}")
        replies = replies.unionAll(got.drop("stat").withColumn("level", F.lit(len(levels) - 1)))

    def drop(rows: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"id": rows["id"], "n_words": [], "n_removed": [], "kept_sha256": [], "runs": []}
        if len(rows):
            words = Words(rows)
            index = np.flatnonzero(survivors(words, levels, heard))
            _, where = np.unique(words.windows(window)[index], return_inverse=True)
            low = aligned(heard[heard["level"] == len(levels) - 1], np.int64)
            hit = index[low[where] < words.ids[words.doc[index]]] if len(low) else index[:0]
            edge = np.zeros(len(words.doc) + 1, dtype=np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            for d, there in enumerate(words.words):
                mask = gone[words.starts[d] : words.ends[d]]
                removed = int(mask.sum())
                turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))) if removed else NONE
                left = [w for w, g in zip(there, mask.tolist(), strict=True) if not g] if removed else there
                out["n_words"].append(len(there))
                out["n_removed"].append(removed)
                out["kept_sha256"].append(hashlib.sha256(b" ".join(left)).hexdigest())
                out["runs"].append(turns.tolist())
        return pd.DataFrame(out).astype({"id": "Int64"})

    schema = "id long, n_words long, n_removed long, kept_sha256 string, runs array<long>"
    return texts.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInPandas(drop, schema).withColumnRenamed("id", id_col)
