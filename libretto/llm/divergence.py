"""Audit of how each source's terms diverge from its peers and its language, by systolic rotation.

A group is one source of one language; its vector holds the counts of the language's
terms, cut into slices of the vocabulary. Groups stay resident in blocks. Compressed
vectors of peer blocks circulate in the rounds of a round-robin tournament: in each
round every block meets one other, as host or as visitor, and a meeting tells both
directions. The language's own vector calls on every block first; a heap for each
resident group ranks its terms. All arithmetic is on whole numbers.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, map_arrow, slices, stored
from .exchange import squeezed, unsqueezed

#: Terms in a slice of the vocabulary (a power of two) and most groups in a block.
SLICE_BITS, BLOCK = 15, 64
#: Rounds whose visitors travel in one job: at most half as many copies of the vectors.
ROUNDS = 32
#: Distinct terms that a task counts before it hands them on, and bytes of a text that are cut at once.
HELD, PIECE = 400_000, 1 << 20
#: p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)).
SCALE_STEP, SCALE_STEPS = 1000, 3

#: Letters A-Z in lower case, every other ASCII character but a-z as a space.
TERMS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 0x20 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, piece by piece."""
    text, at = text.translate(TERMS), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


COUNTS = "lang string, source string, term string, n long, docs long"


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it, added up; and a row with a null term for each group.

    Counted in the task first, so that a common term leaves it once for each group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def handed_on() -> pa.RecordBatch:
            rows = [(*group, None, 0, 0) for group in held]
            rows += [(*group, term, k, docs[term]) for group, (n, docs) in held.items() for term, k in n.items()]
            held.clear()
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
            lang, source, term, n, docs = (pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True))
            return pa.RecordBatch.from_arrays([lang, source, term.cast(pa.string()), n, docs], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for piece in slices(batch):
                for lang, source, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    seen: set[bytes] = set()
                    for words in terms_of(text):
                        n.update(words)
                        seen.update(words)
                    docs.update(seen)
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield handed_on()
        yield handed_on()

    return docs.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (n + 2v)), by long division: exact while n + 2v is below 9 * 10**15."""
    left, out, total = np.asarray(count, dtype=np.int64) + 2, np.int64(0), np.int64(n + 2 * v)
    for _ in range(SCALE_STEPS):
        left = left * SCALE_STEP
        out = out * SCALE_STEP + left // total
        left = left % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


class Vector:
    """A group's terms in one slice (places within it), its p there, and its p where it has no count."""

    def __init__(self, no: int, n: int, v: int, data: bytes | None):
        self.no, self.places, self.rest = no, np.zeros(0, dtype=np.int64), np.int64(1)
        if v:
            self.rest = smoothed(np.zeros(1), n, v)[0]
        if data:
            flat = unsqueezed(data, np.int64)
            self.places, self.p = np.cumsum(flat[: len(flat) // 2]), smoothed(flat[len(flat) // 2 :], n, v)
        else:
            self.p = np.zeros(0, dtype=np.int64)

    def spread(self) -> tuple[np.ndarray, np.ndarray]:
        """p at every place of the slice, and where the group has the term."""
        every, has = np.full(1 << SLICE_BITS, self.rest), np.zeros(1 << SLICE_BITS, dtype=bool)
        every[self.places], has[self.places] = self.p, True
        return every, has


def meeting(a: Vector, every_a: np.ndarray, b: Vector, has_b: np.ndarray, size: int) -> int:
    """Sum of ``apart`` over a slice of ``size`` terms."""
    only_a = a.p[~has_b[a.places]]
    neither = size - len(b.places) - len(only_a)
    return int(apart(every_a[b.places], b.p).sum()) + int(apart(only_a, b.rest).sum()) + neither * int(apart(a.rest, b.rest))


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    return squeezed(np.concatenate([np.diff(places, prepend=0), counts]).astype(np.int64))


MET = "lang string, a int, b long, value long, is_term boolean"


def met(laid: DataFrame, top: int) -> DataFrame:
    """Meetings of rows laid out by (lang, slice, block) and round: residents (-2), the language (-1), visitors."""

    def rows_of(lang: str, found: list[tuple[int, int, int]], is_term: bool) -> Iterator[pa.RecordBatch]:
        if found:
            a, b, value = zip(*found, strict=True)
            arrays = [pa.array([lang] * len(a)), pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(value, pa.int64()), pa.array([is_term] * len(a))]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", "a", "b", "value", "is_term"])

    def best_terms(a: Vector, every: np.ndarray, first: int) -> list[tuple[int, int, int]]:
        q = every[a.places]
        more = a.p > q
        value, ids = apart(a.p[more], q[more]), a.places[more] + first
        if len(value) > top:
            keep = value >= np.partition(value, -top)[-top]
            value, ids = value[keep], ids[keep]
        heap = heapq.nsmallest(top, zip((-value).tolist(), ids.tolist(), strict=True))
        return [(a.no, i, -f) for f, i in heap]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, residents = None, []
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 64) for r in batch.slice(at, 64).to_pylist()):
                lang, at = row["lang"], (row["lang"], row["slice"], row["block"])
                if at != here:
                    here, residents = at, []
                own = Vector(row["no"], row["n"], row["v"], row["data"])
                if row["round"] == -2:
                    residents.append((own, *own.spread()))
                    continue
                every, has = own.spread()
                if row["round"] == -1:
                    terms = [t for a, _, _ in residents for t in best_terms(a, every, row["slice"] << SLICE_BITS)]
                    yield from rows_of(lang, terms, True)
                    pairs = [(a.no, b.no, meeting(a, every_a, b, has_b, row["size"])) for k, (a, every_a, _) in enumerate(residents) for b, _, has_b in residents[:k]]
                else:
                    pairs = [(a.no, own.no, meeting(a, every_a, own, has, row["size"])) for a, every_a, _ in residents]
                yield from rows_of(lang, pairs + [(b, a, value) for a, b, value in pairs], False)

    return laid.mapInArrow(run, MET)


def visits(block: Column, blocks: Column, first: int, last: int) -> tuple[Column, Column]:
    """Rounds (first to last - 1) of the tournament of ``blocks`` blocks, as (array of (round, host)) that ``block`` travels in; and the number of rounds.

    The circle method: in round r of m - 1, with m the even number of players, i meets
    r - i modulo m - 1, or the last player if that is i itself; an odd number of blocks
    leaves one a round out. Of two that meet the host is the one from which the other
    is less than half the circle ahead, so that all host equally often.
    """
    m = blocks + blocks % 2
    ring = m - 1
    rounds = F.filter(F.sequence(F.lit(first), F.lit(last - 1)), lambda r: r < ring)

    def trip(r: Column) -> Column:
        met = F.pmod(r - block, ring)
        other = F.when(block == ring, F.pmod(r * (m / 2).cast("int"), ring)).when(met == block, ring).otherwise(met)
        return F.struct(r.alias("round"), other.cast("int").alias("host"))

    def travels(t: Column) -> Column:
        ahead = F.pmod(block - t["host"], m)
        return (t["host"] < blocks) & ((ahead * 2 < m) | ((ahead * 2 == m) & (t["host"] < block)))

    return F.filter(F.transform(rounds, trip), travels), ring


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """How far each source stands from the other sources and from the whole of its language: (lang, source, part, item, value, rank).

    Null text, lang and source are ''. Terms are runs of letters A-Z (lower-cased) and
    of characters beyond ASCII. A language keeps the V terms that at least
    ``least_docs`` of its documents hold. A group, and the language, gives each kept
    term p = 1 + floor(10**9 * (count + 2) / (N + 2V)), N its count of kept terms; two
    p are (p - q)**2 // (p + q) apart. Part ``pair``: every other source of the language,
    by the sum over all kept terms (0 without any). Part ``term``: the ``top`` kept terms
    that the group has and says more than the language, by their distance. Ranks go by
    value, then item in UTF-8 order. Groups without terms take part in pairs; a language
    of one group without terms has no row. Repeated rows count as often as they stand;
    other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = stored(count_terms(named), "term-counts")
    # kept terms in order of language and term: ids follow that order, and a slice is a run of them
    held = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = stored(held.orderBy("lang", "term").withColumn("id", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("id", SLICE_BITS)), "kept-terms")
    place = F.col("id").bitwiseAND((1 << SLICE_BITS) - 1)
    entries = stored(counts.where("term is not null").select("lang", "source", "term", "n").join(kept.select("lang", "term", "id", "slice"), ["lang", "term"]).select("lang", "source", "slice", place.alias("place"), "n"), "entries")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    per_lang = Window.partitionBy("lang")
    groups = counts.where("term is null").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    groups = groups.withColumns({"no": F.row_number().over(per_lang.orderBy("source")) - 1, "groups": F.count("*").over(per_lang)})
    # about as many blocks as groups in each, until blocks are full
    size = F.least(F.lit(block), F.ceil(F.sqrt("groups"))).cast("int")
    groups = stored(groups.withColumns({"block": F.floor(F.col("no") / size).cast("int"), "blocks": F.ceil(F.col("groups") / size).cast("int")}), "groups")
    cuts = kept.groupBy("lang", "slice").agg(F.count("*").cast("int").alias("size"), F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("total").alias("n")))).alias("vector"))
    bare = groups.where("v = 0").select("lang", F.lit(-1).cast("long").alias("slice"), F.lit(0).alias("size")).distinct()
    parts = cuts.select("lang", "slice", "size").unionAll(bare)
    vectors = entries.groupBy("lang", "source", "slice").agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("vector"))
    # every group has a row in every slice of its language, empty where it has none of the terms
    full = groups.join(parts, "lang").join(vectors, ["lang", "source", "slice"], "left")
    own = full.select("lang", "slice", "block", "blocks", "no", "n", "v", "size", "vector")
    ends = groups.groupBy("lang").agg(F.max("blocks").alias("blocks"), F.max("v").alias("v"), F.max("lang_n").alias("n"))
    whole = ends.join(parts.join(cuts.select("lang", "slice", "vector"), ["lang", "slice"], "left"), "lang").select("lang", "slice", F.lit(-1).alias("block"), "blocks", F.lit(-1).alias("no"), "n", "v", "size", "vector")

    def pack():
        def work(batch: pa.RecordBatch) -> dict:
            out = {n: batch.column(n) for n in batch.schema.names if n != "vector"}
            lists = batch.column("vector").to_pylist()
            out["data"] = [packed(*(np.array([e[k] for e in v], dtype=np.int64) for k in ("place", "n"))) if v else None for v in lists]
            return out

        return work

    schema = "lang string, slice long, block int, blocks int, no int, n long, v long, size int, data binary"
    compressed = stored(map_arrow(own.unionAll(whole), schema, pack), "vectors")
    resident = compressed.where("block >= 0")
    caller = compressed.where("block < 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("round", F.lit(-1))
    most = groups.agg(F.max("blocks")).first()[0] or 1
    found = None
    for first in range(0, max(1, most + most % 2 - 1), ROUNDS):
        trips, _ = visits(F.col("block"), F.col("blocks"), first, first + ROUNDS)
        travelling = resident.withColumn("trip", F.explode(trips)).withColumns({"block": F.col("trip.host"), "round": F.col("trip.round")}).drop("trip")
        laid = resident.withColumn("round", F.lit(-2)).unionByName(travelling)
        laid = laid.unionByName(caller) if first == 0 else laid
        laid = laid.repartition("lang", "slice", "block").sortWithinPartitions("lang", "slice", "block", "round", "no")
        done = stored(met(laid, top), "meetings")
        found = done if found is None else found.unionAll(done)
    forget(entries, compressed)
    names = groups.select("lang", "no", "source")
    host, peer = names.withColumnRenamed("no", "a"), names.select("lang", F.col("no").cast("long").alias("b"), F.col("source").alias("item"))
    pairs = found.where("not is_term").groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).join(peer, ["lang", "b"]).join(host, ["lang", "a"])
    # few terms a group and slice: ranked by id, which is UTF-8 order, before their texts are looked up
    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    best = found.where("is_term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    terms = best.join(kept.select(F.col("id").alias("b"), F.col("term").alias("item")), "b").join(host, ["lang", "a"])
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    return pairs.unionAll(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
