"""Distributed look-up of 64-bit keys held by buckets of documents.

Buckets send their distinct keys, each with a few numbers, to the part that owns
the key; the part reduces over all buckets and sends the result back to each
bucket that asked, aligned with the keys it sent. Keys travel as packed arrays,
repeats are combined in the bucket before they leave, and a key that every
bucket holds costs one entry per bucket: no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_out, forget, stored

#: Characters of text that a bucket holds on average.
BUCKET_CHARS = 4_000_000

REQUEST = "part int, bucket int, head long, keys binary, vals binary"
REPLY = "bucket int, part int, vals binary, stat array<long>"

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def n_buckets(chars: int, per: int = BUCKET_CHARS) -> int:
    return max(1, -(-chars // per))


def dealt(rows: DataFrame, text: str, per: int = BUCKET_CHARS, kind: Column | None = None) -> tuple[DataFrame, dict[int, range]]:
    """``rows`` as a stored table with a ``bucket`` each, bucketed by it; and the buckets of each ``kind`` (one kind, 0, by default).

    A bucket holds about ``per`` characters of rows of one kind. It is drawn from a
    stored number of the row: rows that repeat an id, have none or are the same
    throughout spread like any others. The texts are shuffled once, here; every
    later round finds its bucket's rows in place.
    """
    extra = {"__row": F.monotonically_increasing_id(), "__chars": F.length(text), "__kind": F.lit(0) if kind is None else kind}
    numbered = stored(rows.withColumns(extra), "numbered")
    at, buckets, place = 0, {}, F.lit(0)
    for r in sorted(numbered.groupBy("__kind").agg(F.sum("__chars").alias("chars")).collect(), key=lambda r: r["__kind"]):
        n = n_buckets(int(r["chars"] or 0), per)
        buckets[r["__kind"]] = range(at, at + n)
        place = F.when(F.col("__kind") == r["__kind"], at + F.pmod(F.xxhash64("__row"), F.lit(n))).otherwise(place)
        at += n
    out = dealt_out(numbered.withColumn("bucket", place.cast("int")).drop(*extra), "bucket", max(1, at), "dealt")
    forget(numbered)
    return out, buckets


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts."""
    return scramble(a * M1 + b)


def squeezed(a: np.ndarray) -> bytes:
    """An array's bytes, plane by plane and compressed: what is alike in all its numbers costs next to nothing."""
    import zstandard

    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(data: bytes, dtype) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


class WordHash(dict):
    """64-bit hashes of words, remembered while they fit."""

    LIMIT = 1 << 18

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 11)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def owner(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part that owns each key: keys in order have owners in order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cuts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners that hold some of the sorted ``keys``, and where each one's run starts (with the end)."""
    own = owner(keys, parts)
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, dtype=np.int64)
    return own[starts], np.append(starts, len(own))


def packed(bucket: int, head: int, keys: np.ndarray, vals: np.ndarray, parts: int) -> pd.DataFrame:
    """Request rows for sorted distinct ``keys`` with ``vals`` (one number per key); keys travel as steps."""
    own, at = cuts(keys, parts)
    spans = list(zip(at[:-1], at[1:], strict=True))
    out = {"part": own, "bucket": np.full(len(own), bucket), "head": np.full(len(own), head)}
    out["keys"] = [squeezed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in spans]
    out["vals"] = [squeezed(vals[a:b]) for a, b in spans]
    return pd.DataFrame(out).astype({"part": "int32", "bucket": "int32", "head": "int64"})


Reduce = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list[int] | None]]


def answered(requests: DataFrame, dtype, reduce: Reduce) -> DataFrame:
    """Replies to packed ``requests`` whose values have ``dtype``.

    ``reduce(keys, index, heads, vals)`` gets the distinct keys a part was asked
    for; for every asked key its number among them, the head of its request row and
    its value. It returns one reply per distinct key and, if wanted, numbers about
    the part, which go out in a row of bucket -1.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        steps = [np.cumsum(unsqueezed(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
        sizes = np.array([len(k) for k in steps], dtype=np.int64)
        keys, index = np.unique(np.concatenate(steps), return_inverse=True)
        del steps
        vals = np.concatenate([unsqueezed(v, dtype) for v in rows["vals"]])
        replies, stat = reduce(keys, index, np.repeat(rows["head"].to_numpy(), sizes), vals)
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = {"bucket": rows["bucket"].tolist(), "part": rows["part"].tolist(), "vals": [squeezed(replies[index[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]}
        out["stat"] = [None] * len(rows)
        if stat is not None:
            for name, value in (("bucket", -1), ("part", rows["part"].iloc[0]), ("vals", b""), ("stat", stat)):
                out[name].append(value)
        return pd.DataFrame(out)

    return requests.groupBy("part").applyInPandas(run, REPLY)


def aligned(replies: pd.DataFrame, dtype) -> np.ndarray:
    """A bucket's replies in the order of the keys it sent."""
    rows = replies.sort_values("part")
    return np.concatenate([np.zeros(0, dtype=dtype), *(unsqueezed(v, dtype) for v in rows["vals"])])
