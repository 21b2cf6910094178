"""Indel similarity: 100 * 2 * LCS / (both lengths), as an Arrow UDF, with a lossless length test in front."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over integers of any size."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs(a, b) / total


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="Float64")


@F.pandas_udf(ArrayType(DoubleType()))
def _ratios(a: pd.Series, bs: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or ys is None else [None if y is None else indel_ratio(x, y) for y in ys] for x, ys in zip(a, bs, strict=True)])


def ratio(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def ratios(a: Column, bs: Column) -> Column:
    """Similarity of a string to each of a list; null to null.

    Marked as non-deterministic so that its result is computed once, in a column of
    its own, instead of being written out again wherever that column is read.
    """
    return _ratios.asNondeterministic()(a, bs)


def can_reach(a: Column, b: Column, least: float) -> Column:
    """False only where the lengths alone keep the ratio below ``least``."""
    return 200.0 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))
