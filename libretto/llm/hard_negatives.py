"""Hard-negative mining by exact inner products under an orthogonal PCA rotation.

Vectors are rotated so that the leading components carry most of their energy. The
products of the leading components are summed up, step by step; what the others can
still add is at most the product of the two residual norms, plus a slack for the
rounding of the rotation. Pairs that cannot reach the score asked for, or cannot
stay below its ceiling, are discarded early; the survivors' scores are whole-number
products of the vectors as they were.

Candidates stay in shards; blocks of anchors stream past each shard in one job. The
first pass finds every anchor's positives, the second its negatives for each of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored

#: Bytes of vectors in a shard, in a block of anchors, and of pilot vectors; number of pilot vectors at most.
SHARD_BYTES, BLOCK_BYTES, PILOT_BYTES, PILOT = 64 << 20, 256 << 10, 2 << 20, 2048
#: Leading components that are rotated at most; the others stay as they are.
ROTATED = 1024
#: Pairs of vectors that are bounded at once, and numbers that are multiplied at once for survivors.
PAIRS, PRODUCTS = 1 << 18, 1 << 21
#: Products of whole numbers are exact in 64 bits while the norms' product is below this.
EXACT = 2.0**62
TOP = 2**63 - 1


def steps(width: int) -> list[int]:
    """Numbers of leading components after which pairs are discarded: few at first, then each half of what is left."""
    out, k = [], max(1, width // 4)
    while k < width:
        out.append(k)
        k += max(1, (width - k) // 2)
    return [*out, width]


def rotation(second: np.ndarray) -> np.ndarray:
    """Columns: the eigenvectors of a second-moment matrix, those of the largest eigenvalues first."""
    if not np.isfinite(second).all() or not len(second):
        return np.eye(len(second))
    return np.linalg.eigh(second)[1][:, ::-1].copy()


def slack_factor(turn: np.ndarray) -> float:
    """What rounding may add to a rotated product, per unit of both norms: the rotation's distance from an orthogonal one, and the roundings of 3 products of ``width`` terms."""
    n = len(turn)
    return float(np.linalg.norm(turn.T @ turn - np.eye(n))) + 16 * (n + 1) ** 1.5 * 2.0**-53


@dataclass
class Side:
    """Vectors as whole numbers in doubles, rotated, with residual norms after each step."""

    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    turned: np.ndarray
    rest: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, ids, rows, labels, whole: np.ndarray, turn: np.ndarray) -> Side:
        k, whole = len(turn), whole.astype(np.float64)
        with np.errstate(all="ignore"):
            turned = np.hstack([whole[:, :k] @ turn, whole[:, k:]])
            tails = np.append(np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(whole), 1)), axis=1)
            rest = np.sqrt(tails[:, steps(whole.shape[1])])
            norm = np.sqrt((whole**2).sum(axis=1))
        return cls(ids, rows, labels, whole, turned, rest, norm)


def products(q: Side, c: Side, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """Whole-number inner products of pairs of rows, cut to the range of a long."""
    out = np.zeros(len(qi), dtype=np.int64)
    with np.errstate(all="ignore"):
        plain = q.norm[qi] * c.norm[ci] < EXACT
        step = max(1, PRODUCTS // max(1, q.whole.shape[1]))
        at = np.flatnonzero(plain)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            out[part] = np.einsum("ij,ij->i", q.whole[qi[part]].astype(np.int64), c.whole[ci[part]].astype(np.int64))
    for k in np.flatnonzero(~plain).tolist():
        score = sum(int(a) * int(b) for a, b in zip(q.whole[qi[k]].tolist(), c.whole[ci[k]].tolist(), strict=True))
        out[k] = max(-TOP, min(TOP, score))
    return out


def survivors(q: Side, c: Side, live: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, slack: float, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of q, row of c) among ``live`` whose score may lie between the row's ``floor`` and ``ceiling``.

    ``seen``, if given, gets the number of component products that were taken.
    """
    floor, ceiling = np.nextafter(floor.astype(float), -np.inf), np.nextafter(ceiling.astype(float), np.inf)
    at, before, qi, ci, part = steps(q.whole.shape[1]), 0, None, None, None
    with np.errstate(all="ignore"):
        score = np.zeros(live.shape)
        for s, end in enumerate(at):
            a, b = q.turned[:, before:end], c.turned[:, before:end]
            if qi is None:
                score += a @ b.T
                bound = q.rest[:, s, None] * c.rest[None, :, s] + slack * q.norm[:, None] * c.norm
                # a bound that is not a number discards nothing
                live = live & ~(score + bound < floor[:, None]) & ~(score - bound > ceiling[:, None])
                if seen is not None:
                    seen.append(live.size * (end - before))
                if live.mean() < 0.1 or end == at[-1]:
                    qi, ci = np.nonzero(live)
                    part = score[qi, ci]
            else:
                if seen is not None:
                    seen.append(len(qi) * (end - before))
                part = part + np.einsum("ij,ij->i", a[qi], b[ci])
                bound = q.rest[qi, s] * c.rest[ci, s] + slack * q.norm[qi] * c.norm[ci]
                keep = ~(part + bound < floor[qi]) & ~(part - bound > ceiling[qi])
                qi, ci, part = qi[keep], ci[keep], part[keep]
            before = end
    return qi, ci


class Best:
    """The ``k`` highest (score, smallest id, smallest row) of each slot, and the score that a newcomer has to reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor
        self.held = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        slot, score, ids, rows = (np.concatenate(x) for x in zip(self.held, (slot, score, ids, rows), strict=True))
        order = np.lexsort((rows, ids, -score, slot))
        slot, score, ids, rows = slot[order], score[order], ids[order], rows[order]
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        full = place == self.k - 1
        self.floor[slot[full]] = np.maximum(self.floor[slot[full]], score[full])
        keep = place < self.k
        self.held = slot[keep], score[keep], ids[keep], rows[keep]


@dataclass
class Block:
    """Anchors with what is sought for each: slots with a lowest and a highest score, and a start to the floor."""

    ids: np.ndarray
    rows: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray
    tags: np.ndarray


def sought(block: Block, c: Side, turn: np.ndarray, slack: float, k: int, same: bool, seen: list[int] | None = None) -> Best:
    """The best of a shard for every slot of a block."""
    q = Side.of(block.ids, block.rows, block.labels, block.whole, turn)
    best = Best(block.floor.copy(), k)
    n = len(q.ids)
    slots = np.argsort(block.owner, kind="stable")
    first = np.searchsorted(block.owner[slots], np.arange(n + 1))
    ceiling = np.full(n, -TOP)
    np.maximum.at(ceiling, block.owner, block.high)
    size = max(1, PAIRS // max(1, n))
    for at in range(0, len(c.ids), size):
        part = Side(*(x[at : at + size] for x in (c.ids, c.rows, c.labels, c.whole, c.turned, c.rest, c.norm)))
        floor = np.full(n, TOP)
        np.minimum.at(floor, block.owner, best.floor)
        live = ((q.labels[:, None] == part.labels) == same) & (q.ids[:, None] != part.ids)
        qi, ci = survivors(q, part, live, floor, ceiling, slack, seen)
        score = products(q, part, qi, ci)
        # a pair for every slot of its anchor
        many = (first[1:] - first[:-1])[qi]
        pair = np.repeat(np.arange(len(qi)), many)
        slot = slots[np.repeat(first[qi] - np.cumsum(many) + many, many) + np.arange(len(pair))]
        fits = (score[pair] >= best.floor[slot]) & (score[pair] >= block.low[slot]) & (score[pair] <= block.high[slot])
        slot, pair = slot[fits], pair[fits]
        best.add(slot, score[pair], part.ids[ci[pair]], part.rows[ci[pair]])
    return best


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def narrow(whole: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them all, to travel."""
    for kind in (np.int8, np.int16, np.int32):
        if np.abs(whole).max(initial=0) <= np.iinfo(kind).max:
            return whole.astype(kind)
    return whole


def second_moment(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer products of all vectors (leading ROTATED components), added up by row of the matrix on the executors."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        with np.errstate(all="ignore"):
            for batch in batches:
                part = matrix(batch["v"].map(lambda v: v[:width]), width)
                total += part.T @ part
        yield pd.DataFrame({"i": np.arange(width), "line": list(total)})

    def summed(lines: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": lines["i"].iloc[:1], "line": [np.sum(np.stack(lines["line"].to_list()), axis=0)]})

    lines = rows.select("v").mapInPandas(partial, "i int, line array<double>").groupBy("i").applyInPandas(summed, "i int, line array<double>")
    found = {r["i"]: r["line"] for r in lines.collect()}
    return np.array([found[i] for i in range(width)]) if found else np.zeros((width, width))


def least_of(score: int, percent: int) -> int:
    return -(-score * percent // 100)


FOUND = "anchor_row long, tag long, id long, row long, score long"


def met(shards: DataFrame, blocks: DataFrame, n_shards: int, turn: np.ndarray, slack: float, k: int, same: bool) -> DataFrame:
    """Stream every block past every shard, in one job: a part holds one shard at a time, then takes the blocks in turn."""
    every = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).select("shard", F.col("block"), "data")
    laid = shards.select("shard", F.lit(-1).alias("block"), "data").unionAll(every).repartition(n_shards, "shard").sortWithinPartitions("shard", "block")
    shipped = shards.sparkSession.sparkContext.broadcast((turn, slack))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, slack = shipped.value
        here, side = None, None
        for batch in batches:
            for shard, block, data in zip(*(batch.column(c) for c in range(3)), strict=True):
                if block.as_py() == -1:
                    here, side = shard.as_py(), Side.of(*pickle.loads(data.as_py()), turn)
                elif shard.as_py() == here:
                    asked: Block = pickle.loads(data.as_py())
                    slot, score, ids, rows = sought(asked, side, turn, slack, k, same).held
                    names = [f.split() for f in FOUND.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in (asked.rows[asked.owner[slot]], asked.tags[slot], ids, rows, score)], names=[n[0] for n in names])

    return laid.mapInArrow(run, FOUND)


def integers(v: Column) -> Column:
    """Each component x as floor(256 * x), in doubles; beyond 2**44 a double is whole already."""
    return F.transform(v, lambda c: F.when(F.abs(c) < 2.0**44, F.floor(c * 256).cast("double")).otherwise(c * 256))


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of every anchor, for each of its positives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components x become floor(256 * x); a score is the integer inner product. Anchors
    are the rows whose id is divisible by ``every``; their positives the first
    ``positives`` other rows of the same (integer) label, their negatives for a
    positive of score p the first ``negatives`` rows of another label with low*p <=
    100*score <= high*p. Higher scores come first, ties by smaller id. Fewer where
    there are fewer. Rows with a null id, label or vector, or a component that is null
    or not finite (256-fold), take no part. Rows that repeat id, label and vector
    count once; other rows of one id are rows of their own, each with its results, but
    no candidates of each other. Of vectors of unequal length the missing components
    are 0. Scores beyond the range of a long are cut to it before they are compared.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * 256) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.dropna().where(finite).withColumn("v", integers(F.col("v"))).dropDuplicates()
    rows = stored(rows.withColumns({"row": F.monotonically_increasing_id(), "norm": F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)}), "vectors")
    asked = F.col("id") % every == 0
    stat = rows.agg(F.count("*").alias("n"), F.count_if(asked).alias("q"), F.max(F.size("v")).alias("width")).first()
    n, width = stat["n"], max(1, stat["width"] or 0)
    cores = spark.sparkContext.defaultParallelism
    n_shards = max(1, -(-n * width * 8 // SHARD_BYTES), min(2 * cores, -(-n // 1024)))
    n_blocks = max(1, -(-stat["q"] * width * 8 // BLOCK_BYTES))
    turn = rotation(second_moment(rows, min(width, ROTATED)))
    slack = slack_factor(turn) if len(turn) == width else slack_factor(turn) + 16 * (width + 1) ** 1.5 * 2.0**-53
    # a bounded sample of long vectors, which score high: only the start of the floors depends on it
    pilot = rows.orderBy(F.desc("norm"), "row").limit(max(1, min(PILOT, PILOT_BYTES // (8 * width)))).toPandas()
    pilot = (*(pilot[c].to_numpy(dtype=np.int64) for c in ("id", "row", "label")), matrix(pilot["v"], width))

    def shard(part: pd.DataFrame) -> pd.DataFrame:
        data = (*(part[c].to_numpy(dtype=np.int64) for c in ("id", "row", "label")), narrow(matrix(part["v"], width)))
        return pd.DataFrame({"shard": part["shard"].iloc[:1], "data": [pickle.dumps(data)]})

    def packed(part: pd.DataFrame, slots: list[tuple[int, int, int, int]], same: bool, k: int) -> pd.DataFrame:
        """A block of anchors with slots (anchor's place, lowest score, highest, tag) and floors from the pilot vectors."""
        owner, least, most, tags = (np.array(x, dtype=np.int64) for x in zip(*slots, strict=True)) if slots else (np.zeros(0, dtype=np.int64),) * 4
        ids, at, labels = (part[c].to_numpy(dtype=np.int64) for c in ("id", "row", "label"))
        block = Block(ids, at, labels, narrow(matrix(part["v"], width)), owner, least, most, least.copy(), tags)
        block.floor = sought(block, Side.of(*pilot, turn), turn, slack, k, same).floor
        return pd.DataFrame({"block": part["block"].iloc[:1], "data": [pickle.dumps(block)]})

    def first_pass(part: pd.DataFrame) -> pd.DataFrame:
        return packed(part, [(k, -TOP, TOP, 0) for k in range(len(part))], True, positives)

    def second_pass(part: pd.DataFrame) -> pd.DataFrame:
        slots = [(k, least_of(p["score"], low), p["score"] * high // 100, p["row"]) for k, ps in enumerate(part["positives"]) for p in ps]
        return packed(part, slots, False, negatives)

    shards = stored(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int")).groupBy("shard").applyInPandas(shard, "shard int, data binary"), "shards")
    anchors = rows.where(asked).select("id", "row", "label", "v", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"))
    blocks = stored(anchors.groupBy("block").applyInPandas(first_pass, "block int, data binary"), "anchors")
    near = stored(_first(met(shards, blocks, n_shards, turn, slack, positives, True), ["anchor_row"], positives), "positives")
    own = near.groupBy(F.col("anchor_row").alias("row")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "row", "score"))).alias("positives"))
    again = stored(anchors.join(own, "row").groupBy("block").applyInPandas(second_pass, "block int, data binary"), "anchors-with-positives")
    far = _first(met(shards, again, n_shards, turn, slack, negatives, False), ["anchor_row", "tag"], negatives)
    good = near.select("anchor_row", F.col("row").alias("tag"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = rows.where(asked).select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    found = stored(far.join(good, ["anchor_row", "tag"]).join(names, "anchor_row"), "negatives")
    forget(rows, shards, blocks, near, again)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
