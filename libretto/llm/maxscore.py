"""Exact top-k inner-product search with MaxScore over sharded postings.

Dimensions are the terms of a query and a vector's integer components its
weights. A shard keeps, for every term, the postings of the vectors whose
component is not zero and the bounds of their weights. For a query the bounds
limit what each term can add to a score. The terms that together cannot lift a
vector to the k-th best score known are non-essential: only the postings of the
others, the essential ones, are traversed; vectors that stay competitive are
probed in the non-essential terms, widest bound first, and leave as soon as what
is left cannot lift them. The k best of each shard are merged by a window.

Every query starts from the k-th best score among a few pilot vectors, so that
all shards share a threshold from the start.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored

#: Bytes of vectors in a shard and in a block of queries; bytes and number of pilot vectors.
SHARD_BYTES, BLOCK_BYTES, PILOT_BYTES, PILOT = 32 << 20, 1 << 20, 2 << 20, 2048
#: Vectors of a shard that are traversed before the threshold is raised, and terms probed at once.
SEGMENT, PROBE = 2048, 8
#: Products and sums of integers up to this are exact in doubles.
EXACT = 2.0**53


class Postings:
    """Postings of a shard by term, cut into segments, and its vectors by row for probing."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], vectors[order]
        self.n, self.width = self.rows.shape
        self.low = np.minimum(self.rows.min(axis=0, initial=0.0), 0.0)
        self.high = np.maximum(self.rows.max(axis=0, initial=0.0), 0.0)
        self.segments = []
        for at in range(0, self.n, SEGMENT):
            part = self.rows[at : at + SEGMENT]
            lists = []
            for d in range(self.width):
                where = np.flatnonzero(part[:, d])
                # a term that every vector of the segment has needs no list of vectors
                lists.append((None if len(where) == len(part) else where, np.ascontiguousarray(part[where, d])))
            self.segments.append((at, len(part), lists))

    def search(self, query: np.ndarray, query_id: int, k: int, floor: float) -> tuple[list[tuple[float, int]], int]:
        """The ``k`` best (score, id) not below ``floor``, ties to smaller ids, and how many postings were touched."""
        q = np.zeros(self.width)
        q[: min(self.width, len(query))] = query[: self.width]
        bound = np.maximum(q * self.low, q * self.high)
        terms = np.flatnonzero(q)
        terms = terms[np.argsort(-bound[terms], kind="stable")]
        # left[t]: the most that the terms from place t on can add
        left = np.append(np.cumsum(bound[terms][::-1])[::-1], 0.0)
        best: list[tuple[float, int]] = []
        touched = 0
        for at, size, lists in self.segments:
            # non-essential: the longest tail of terms that cannot reach the floor by itself
            essential = min(len(terms), int(np.searchsorted(-left, -floor, side="right")))
            score = np.zeros(size)
            for d in terms[:essential].tolist():
                where, weights = lists[d]
                touched += len(weights)
                if where is None:
                    score += weights * q[d]
                else:
                    score[where] += weights * q[d]
            # a vector in no essential list stands at zero here, below the floor
            live = np.flatnonzero(score + left[essential] >= floor)
            found, done = score[live], essential
            rows = self.rows[at : at + size]
            while done < len(terms) and len(live):
                probe = terms[done : done + PROBE]
                touched += len(live) * len(probe)
                found = found + rows[np.ix_(live, probe)] @ q[probe]
                done += len(probe)
                keep = found + left[done] >= floor
                live, found = live[keep], found[keep]
            names = self.ids[at + live]
            other = names != query_id
            best = sorted([*best, *((-s, i) for s, i in zip(found[other].tolist(), names[other].tolist(), strict=True))])[:k]
            if len(best) == k:
                floor = max(floor, -best[-1][0])
        return best, touched


def exact(queries: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether all inner products are exact in doubles."""
    return not len(queries) or not len(vectors) or float(np.abs(queries).sum(axis=1).max()) * float(np.abs(vectors).max(initial=0)) < EXACT


def top_of(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, shard: Postings, k: int):
    """The ``k`` best (query id, id, score) of a shard for each query, and the postings touched."""
    out: tuple[list, list, list] = ([], [], [])
    touched = 0
    plain = not exact(queries, shard.rows)
    whole = [[int(c) for c in row] for row in shard.rows] if plain else []
    for query, name, floor in zip(queries, query_ids.tolist(), floors.tolist(), strict=True):
        if plain:
            # components too large for exact doubles: whole numbers without bound, cut to the range of a long at the end
            terms = [int(c) for c in query]
            best = sorted((-sum(a * b for a, b in zip(terms, v, strict=False)), i) for v, i in zip(whole, shard.ids.tolist(), strict=True) if i != name)[:k]
            best = [(max(-(2**63) + 1, min(2**63, s)), i) for s, i in best]
        else:
            best, n = shard.search(query, name, k, floor)
            touched += n
        out[0].extend([name] * len(best))
        out[1].extend(i for _, i in best)
        out[2].extend(min(2**63 - 1, int(-s)) for s, _ in best)
    return tuple(np.array(c, dtype=np.int64) for c in out), touched


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of each query with all other rows.

    Components x become floor(256 * x). Queries: ids divisible by ``every``.
    Returns (query_id, rank from 1, vec_id, score); fewer than ``k`` rows where
    there are fewer candidates; ties to the smaller id. Rows with a null id, a null
    vector, or a component that is null or not finite (256-fold) take no part. Rows that repeat an id
    and its vector count once, and no row with the query's id is its candidate. Of
    vectors of unequal length the missing components are 0. Scores beyond the range
    of a long are cut to it. Other columns are ignored; an empty table gives an
    empty result. A vector is held whole, whatever its length.

    The postings of a shard, at most SHARD_BYTES of vectors, are built once and
    stored. The stated query set meets them in blocks of at most BLOCK_BYTES, all in
    one job: every block streams past every shard, and no vector moves again.
    """
    v, x = F.col("v"), F.col(id_col).cast("long")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * 256) < F.lit(float("inf"))))
    rows = vectors.select(x.alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull()).where(finite)
    # floor gives a long; doubles beyond its range are whole numbers anyway
    rows = rows.withColumn("v", F.transform("v", lambda c: F.when(F.abs(c) < 2.0**44, F.floor(c * 256).cast("double")).otherwise(c * 256)))
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    rows = stored(rows.dropDuplicates(["id", "v"]).withColumn("norm", norm), "vectors")
    asked = F.col("id") % every == 0
    stat = rows.agg(F.count("*").alias("n"), F.count_if(asked).alias("q"), F.max(F.size("v")).alias("width")).first()
    width = max(1, stat["width"] or 0)
    blocks = max(1, min(stat["q"], -(-stat["q"] * width * 8 // BLOCK_BYTES)))
    # as many shards as their size asks for, and a few for every core
    shards = max(min(stat["n"], -(-stat["n"] * width * 8 // SHARD_BYTES)), min(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-stat["n"] // SEGMENT)), 1)
    place = F.xxhash64("id", "v")

    pilot = rows.orderBy(F.desc("norm"), "id").limit(max(k + 1, min(PILOT, PILOT_BYTES // (8 * width)))).select("id", "v").toPandas()
    pilot_ids, pilot_rows = pilot["id"].to_numpy(dtype=np.int64), matrix(pilot["v"], width)

    def start(rows: pd.DataFrame) -> pd.DataFrame:
        """A block of queries, with the k-th best score of each among the pilot vectors."""
        ids, q = rows["id"].to_numpy(dtype=np.int64), matrix(rows["v"], width)
        floors = np.full(len(q), -np.inf)
        if exact(q, pilot_rows):
            for at in range(0, len(q), 1024):
                score = q[at : at + 1024] @ pilot_rows.T
                score[ids[at : at + 1024, None] == pilot_ids] = -np.inf
                if score.shape[1] >= k:
                    floors[at : at + 1024] = np.partition(score, -k, axis=1)[:, -k]
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "data": [pickle.dumps((ids, q, floors))]})

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        postings = Postings(rows["id"].to_numpy(dtype=np.int64), matrix(rows["v"], width))
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "data": [pickle.dumps(postings)]})

    queries = stored(rows.where(asked).withColumn("block", F.pmod(place, F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(start, "block int, data binary"), "query-blocks")
    index = stored(rows.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int")).repartition(shards, "shard").groupBy("shard").applyInPandas(build, "shard int, data binary"), "postings")

    # one job: a part holds one shard's postings at a time and takes the blocks in turn
    every = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "block", "data")
    laid = index.select("shard", F.lit(-1).alias("block"), "data").unionAll(every).repartition(shards, "shard").sortWithinPartitions("shard", "block")

    def search(batches):
        here, postings = None, None
        for batch in batches:
            for shard, block, data in zip(*(batch.column(c) for c in range(3)), strict=True):
                if block.as_py() == -1:
                    here, postings = shard.as_py(), pickle.loads(data.as_py())
                elif shard.as_py() == here:
                    q_ids, q, floors = pickle.loads(data.as_py())
                    (names, found, scores), _ = top_of(q, q_ids, floors, postings, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (names, found, scores)], names=["query_id", "vec_id", "score"])

    near = stored(laid.mapInArrow(search, "query_id long, vec_id long, score long"), "near")
    forget(rows, queries, index)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
