"""SimHash near-duplicate classes found with a Gray-order hierarchical index.

Distinct fingerprints that differ in at most 3 of 64 bits agree in one of four
16-bit blocks, so each goes to four buckets. Within a bucket they are sorted by
Gray rank; runs of neighbours become nodes that keep the bits all members share
(a mask and a pattern), nodes become nodes of the level above. Two nodes are
compared from the root down and dropped as soon as the shared bits in which
they differ exceed the limit, or all their members are in one class already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, stored

SEED = 42
#: Most distinct fingerprints of a bucket that one cell takes; a larger bucket becomes a grid of cells.
CHUNK = 4096
#: Children of a node, neighbours linked up front, node pairs handled at once, rows gathered before cells are searched.
FAN_OUT, LAGS, FRONTIER, GATHER = 4, 4, 1 << 17, 1 << 17
#: Words hashed and summed at once.
RUN = 1 << 15
#: Tables of at most so many counted rows of a few numbers are broadcast.
BROADCAST_ROWS = 200_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    total = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), RUN):
        spans = zip(starts[k : k + RUN].tolist(), ends[k : k + RUN].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        total += np.add.reduce(np.unpackbits(h.view(np.uint8)).reshape(-1, 64), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(starts)).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, row: Column | None = None) -> DataFrame:
    """(id, th, row, fp): the hash of each row's text, the row's number if there is one, and its fingerprint as a signed long."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = np.array([fingerprint(t, shingle) for t in batch.column(3).to_pylist()], dtype=np.uint64)
            return {"id": batch.column(0), "th": batch.column(1), "row": batch.column(2), "fp": found.view(np.int64)}

        return work

    number = F.lit(0) if row is None else row
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), number.cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, "id long, th long, row long, fp long", make)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray sequence."""
    r = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(shift)
    return r


def classes(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (smallest member index) after links a-b are added to those of ``label``."""
    label = label.copy()
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if np.array_equal(la, lb):
            return label
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(up := label[label], label):
            label = up


class GrayTree:
    """Hierarchical index over fingerprints sorted by (cell, Gray rank)."""

    def __init__(self, cell: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), cell))
        self.cell, self.fp = cell[order], fp[order]
        n = len(fp)
        first = np.concatenate([[True], self.cell[1:] != self.cell[:-1]]) if n else np.zeros(0, dtype=bool)
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        local = np.arange(n) - start
        ones = np.full(n, ~np.uint64(0))
        # per level: pattern, mask of shared bits, first child, number of children, first and last leaf
        self.levels = [(self.fp, ones, np.arange(n), np.zeros(n, dtype=np.int64), np.arange(n), np.arange(n))]
        span = 1
        while len(self.levels[-1][0]) and (local >= span).any():
            span *= FAN_OUT
            low = self.levels[-1]
            at = low[4]
            head = np.flatnonzero(local[at] % span == 0)
            every = np.bitwise_and.reduceat(low[0], head)
            some = np.bitwise_or.reduceat(low[0] | ~low[1], head)
            every_mask = np.bitwise_and.reduceat(low[1], head)
            mask = every_mask & ~(every ^ some)
            count = np.diff(np.append(head, len(at)))
            self.levels.append((every & mask, mask, head, count, at[head], low[5][head + count - 1]))

    def link(self, limit: int = 3) -> np.ndarray:
        """Class labels of the sorted leaves under links of at most ``limit`` differing bits within a cell."""
        n = len(self.fp)
        label = np.arange(n)
        for lag in range(1, min(LAGS, n - 1) + 1):
            near = (self.cell[lag:] == self.cell[:-lag]) & (np.bitwise_count(self.fp[lag:] ^ self.fp[:-lag]) <= limit)
            a = np.flatnonzero(near)
            label = classes(n, a, a + lag, label)
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0])) if n else np.zeros(0, dtype=np.int64)
        stack = [(top, roots, roots)]
        whole = self._whole(label)
        while stack:
            level, a, b = stack.pop()
            if len(a) > FRONTIER:
                stack += [(level, a[k : k + FRONTIER], b[k : k + FRONTIER]) for k in range(0, len(a), FRONTIER)]
                continue
            pattern, mask, child, count = self.levels[level][:4]
            open_ = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= limit
            same = whole[level]
            open_ &= (same[a] < 0) | (same[a] != same[b])
            a, b = a[open_], b[open_]
            if level == 0:
                fresh = label[a] != label[b]
                if fresh.any():
                    label = classes(n, a[fresh], b[fresh], label)
                    if stack:
                        whole = self._whole(label)
                continue
            step = np.arange(FAN_OUT)
            i = np.broadcast_to(child[a][:, None, None] + step[:, None], (len(a), FAN_OUT, FAN_OUT))
            j = np.broadcast_to(child[b][:, None, None] + step, i.shape)
            real = (step[:, None] < count[a][:, None, None]) & (step < count[b][:, None, None]) & (i <= j)
            if level == 1:
                real &= i < j
            stack.append((level - 1, i[real], j[real]))
        return label

    def _whole(self, label: np.ndarray) -> list[np.ndarray]:
        """Per level, the class that all leaves of a node are in, or -1."""
        out = [label]
        for _, _, head, _, _, _ in self.levels[1:]:
            low, high = np.minimum.reduceat(out[-1], head), np.maximum.reduceat(out[-1], head)
            out.append(np.where(low == high, low, -1))
        return out


def links(fps: DataFrame, limit: int = 3, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect exactly the classes of distinct fingerprints, at most one per fingerprint and cell."""
    if not 0 <= limit <= 3:
        raise ValueError("four blocks find at most 3 differing bits")
    block = [F.struct(F.lit(b).alias("b"), F.shiftrightunsigned("fp", 16 * b).bitwiseAND(0xFFFF).cast("int").alias("key")) for b in range(4)]
    spread = fps.select("fp", F.explode(F.array(*block)).alias("k")).select("fp", "k.b", "k.key")
    # at most 4 * 65536 buckets exist, so the table of large ones is bounded whatever the input
    large = spread.groupBy("b", "key").count().where(F.col("count") > chunk).select("b", "key", F.ceil(F.col("count") / chunk).cast("int").alias("s"))
    sized = spread.join(F.broadcast(large), ["b", "key"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
    slot: Column = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda t: F.struct(F.least(slot, t).alias("i"), F.greatest(slot, t).alias("j")))
    cells = sized.select("fp", "b", "key", F.explode(pairs).alias("c")).select("fp", F.xxhash64("b", "key", "c.i", "c.j").alias("cell"))
    # two cells under one hash are only searched together: no link is lost or made up
    placed = cells.repartition("cell").sortWithinPartitions("cell")

    def search(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        tree = GrayTree(cell, fp.view(np.uint64))
        label = tree.link(limit)
        a = np.flatnonzero(label != np.arange(len(label)))
        found = tree.fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[a]), pa.array(found[label[a]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            cell = np.concatenate([cell, batch.column(1).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(0).to_numpy(zero_copy_only=False)])
            if len(cell) >= GATHER and (cut := np.searchsorted(cell, cell[-1])):
                yield search(cell[:cut], fp[:cut])
                cell, fp = cell[cut:], fp[cut:]
        if len(cell):
            yield search(cell, fp)

    return placed.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the links and the smallest node of its component.

    Smallest-label spreading with a jump per round (a label takes its own label),
    so the rounds grow with the logarithm of a chain's length. Each round is a
    stored table; only the number of changed labels comes to the driver.
    """
    both = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")).select(F.col("u").alias("node"), "root", F.lit(True).alias("moved")), "labels")
    while True:
        heard = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("heard"))
        low = labels.select("node", F.col("root").alias("old")).join(heard, F.col("node") == F.col("u")).select("node", "old", F.least("old", "heard").alias("root"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("to"))
        new = low.join(jump, F.col("root") == F.col("at")).select("node", F.least("root", "to").alias("root"), (F.least("root", "to") != F.col("old")).alias("moved"))
        before, labels = labels, stored(new, "labels")
        forget(before)
        if labels.where("moved").isEmpty():
            forget(both)
            return labels.select("node", "root")


def members(found: DataFrame, limit: int) -> DataFrame:
    """``found`` (id, th, row, fp) with the ``head`` of each row's class: its row (nameless, id, th, row) with the smallest id, null last, then text hash.

    Rows whose fingerprint is their own and has no link head their own class and
    need no look-up: the others' classes are one counted table, broadcast where
    small; beyond, a plain join of two stored tables, whose hot fingerprints adaptive
    execution splits.
    """
    own = F.struct(F.col("id").isNull().alias("nameless"), "id", "th", "row")
    distinct = stored(found.groupBy("fp").agg(F.min(own).alias("first"), F.count("*").alias("n")), "distinct")
    linked = components(links(distinct.select("fp"), limit))
    classed = linked.join(distinct, linked["node"] == distinct["fp"]).select("fp", "root", "first")
    heads = classed.groupBy("root").agg(F.min("first").alias("head"))
    shared = classed.join(heads, "root").select(F.col("fp").alias("key"), "head")
    crowds = distinct.where(F.col("n") > 1).join(shared, F.col("fp") == F.col("key"), "left").select("fp", "first", "head")
    single = shared.join(distinct.where(F.col("n") == 1), F.col("key") == F.col("fp"), "left_semi")
    side = stored(crowds.select(F.col("fp").alias("key"), F.coalesce("head", "first").alias("head")).unionAll(single.select("key", "head")), "classes")
    forget(distinct)
    small = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    return found.join(small, F.col("fp") == F.col("key"), "left").select(*found.columns, F.when(F.col("key").isNull(), own).otherwise(F.col("head")).alias("head"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 3) -> DataFrame:
    """(id, fp, component_id): the class of each row, named by the smallest id reachable from it.

    A null or empty text has fingerprint 0 and is linked like any other; a text of
    fewer words than a shingle is one shingle; a very long text is hashed in runs.
    Null ids belong to classes but do not name them unless they are alone (the name
    is then null). Repeated rows give repeated rows of one class; other columns are
    ignored; an empty table gives an empty result. Copies share a fingerprint and are
    never paired with each other.
    """
    found = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return members(found, limit).select(F.col("id").alias(id_col), "fp", F.col("head.id").alias("component_id"))


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one with the smallest id, null last, then text hash; of repeated rows, one.

    Rows are told apart by a stored number, so ids may repeat or be null. What goes
    is joined by that number, and the texts stay where they are unless more than
    BROADCAST_ROWS rows go.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = stored(fingerprints(rows, id_col, text_col, shingle, F.col("__row")), "fingerprints")
    lost = stored(members(found, limit).where(F.col("row") != F.col("head.row")).select(F.col("row").alias("__lost")), "lost")
    side = F.broadcast(lost) if lost.count() <= BROADCAST_ROWS else lost
    return rows.join(side, F.col("__row") == F.col("__lost"), "left_anti").drop("__row")
