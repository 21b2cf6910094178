"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source wants the same number of copies, target / source
size. The whole part is taken; the fractional part is rounded dependently: two
documents meet, words move from one to the other at random until one of them
wants all of its words or none, and the other goes on. Blocks of documents are
folded side by side and what each leaves over is folded again, in a tree whose
depth is the logarithm of the largest source. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Most copies of one document.
MOST = 3
#: Documents folded in one block of the tree.
BLOCK = 64
#: Sources whose table may be broadcast.
BROADCAST_SOURCES = 100_000
#: Repeated rows that one task makes of their count.
PIECE = 65_536


def word_count(text: str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"[{ASCII_SPACE}]+"))).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) of rows (source, size, m of them): shares by weight, filled up to ``most`` times each source's size."""
    stats = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n_docs"))
    # rank in code-point order without one task over all sources: position in a range partition plus the rows before it
    placed = stored(stats.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before += [F.lit(p), F.lit(total)]
        total += n
    offset = F.element_at(F.create_map(*before), part) if before else F.lit(0)
    rank = (offset + F.col("at").bitwiseAND((1 << 33) - 1)) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    table = stored(placed.select("source", "source_size", "n_docs", weight.alias("weight"), cap.alias("cap")), "weights")
    whole = table.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    size, level = float(whole["t"] or 0), 0.0
    if size > 0:
        level = size / whole["w"]
        while True:
            full = F.col("cap") < F.col("weight") * level
            r = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("c"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
            if not r["w"] or (raised := (size - r["c"]) / r["w"]) <= level:
                break
            level = raised
    return table.select("source", "source_size", "n_docs", F.least("cap", F.col("weight") * level).alias("target"))


def _coin(*parts) -> Column:
    """Number in [0, 1) drawn from a hash, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * (2.0**-53)


def _fold(items: Column, level: int, seed: int, carried: str) -> Column:
    """Fold a block: ``out`` has the decided items (with ``extra`` 0 or 1), ``rest`` the one left over, if any."""
    kind = f"struct<size:long,h:long,doc_id:long,mass:double,base:long,source_size:long,target:double{carried}>"
    start = F.struct(F.lit(None).cast(kind).alias("rest"), F.array().cast(f"array<struct<item:{kind},extra:long>>").alias("out"))

    def meet(acc: Column, x: Column) -> Column:
        r, out = acc["rest"], acc["out"]
        a, room_a = r["mass"], r["size"] - r["mass"]
        b, room_b = x["mass"], x["size"] - x["mass"]
        up, down = F.least(room_a, b), F.least(a, room_b)
        raised = _coin(r["h"], x["h"], F.lit(level), F.lit(seed)) * (up + down) < down

        def step(left: Column, mass: Column, done: Column, extra: int) -> Column:
            one = F.struct(done.alias("item"), F.lit(extra).cast("long").alias("extra"))
            return F.struct(left.withField("mass", mass).alias("rest"), F.concat(out, F.array(one)).alias("out"))

        return (
            F.when(r.isNull(), F.struct(x.alias("rest"), out.alias("out")))
            .when(raised & (room_a <= b), step(x, b - room_a, r, 1))
            .when(raised, step(r, a + b, x, 0))
            .when(a <= room_b, step(x, a + b, r, 0))
            .otherwise(step(r, a - room_b, x, 1))
        )

    return F.aggregate(items, start, meet)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, copies, taken) and the columns of ``carry``: one row per document.

    ``taken`` = copies * size; a source's taken words differ from its target by less
    than its largest document, and no document has more than ``most`` copies. Null
    text has size 0 and takes nothing; null is a source of its own, last in order;
    rows that repeat an id are documents of their own; other columns are ignored; an
    empty table gives an empty result; texts of any length are counted whole. Every
    draw is a hash of ids, sizes and ``carry``, so reruns agree.

    Rows that are the same in id, source, size and ``carry`` are counted before
    anything is dealt out. Among themselves they are rounded at once: their common
    fraction times their number says how many take one copy more, and one of them at
    most goes on into the tree with what is left. So no crowd meets in a block.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), *carry)
    sized = stored(sized.groupBy("doc_id", "source", "size", *carry).agg(F.count("*").alias("m")), "sized")
    carried = "".join(f",{c}:{sized.schema[c].dataType.simpleString()}" for c in carry)
    of_item = [f"item.{c}" for c in carry]
    targets = source_targets(sized, weights, most)
    sources = targets.agg(F.count("*").alias("n"), F.max("n_docs").alias("most")).first()
    small = targets.select(F.col("source").alias("name"), "source_size", "n_docs", "target")
    if sources["n"] <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(ratio + 1e-12)
    rows = sized.join(small, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "source", "size", "m", "source_size", "n_docs", "target", base.alias("base"), F.when(F.col("size") == 0, 0.0).otherwise(F.greatest(ratio - base, F.lit(0.0))).alias("part"), *carry
    )
    wanted = F.col("m") * F.col("part")
    extra = F.floor(wanted + 1e-9)
    rows = rows.withColumn("extra", extra).withColumn("rest", F.greatest(wanted - extra, F.lit(0.0)))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(PIECE).cast("long")))
    pieces = rows.withColumn("first", first)
    if (sized.agg(F.max("m")).first()[0] or 0) > PIECE:
        pieces = pieces.repartition("doc_id", "size", "first")
    every = pieces.withColumn("r", F.explode(F.sequence(F.col("first"), F.least(F.col("m"), F.col("first") + PIECE) - 1)))
    goes_on = (F.col("r") == F.col("extra")) & (F.col("rest") > 0)
    plain = every.where(~goes_on).select("doc_id", "size", "source_size", "target", (F.col("base") + (F.col("r") < F.col("extra")).cast("long")).alias("copies"), *carry)
    item = F.struct("size", F.xxhash64("doc_id", "size", F.lit(seed), *carry).alias("h"), "doc_id", F.col("mass").cast("double").alias("mass"), "base", "source_size", "target", *carry)
    level, blocks = 0, -(-(sources["most"] or 0) // BLOCK)
    left = rows.where(F.col("rest") > 0).withColumn("mass", F.col("rest") * F.col("size")).select("source", F.col("n_docs").alias("n"), item.alias("item"))
    done = [plain]
    while True:
        # a source's items are dealt over ceil(n / BLOCK) blocks by hash
        count = F.ceil(F.col("n") / BLOCK)
        block = F.pmod(F.xxhash64("item.h", F.lit(level)), count)
        groups = left.groupBy("source", block.alias("block")).agg(F.first(count).alias("n"), F.array_sort(F.collect_list("item")).alias("items"))
        folded = stored(groups.select("source", "n", _fold(F.col("items"), level, seed, carried).alias("f")), f"fold{level}")
        decided = folded.select(F.inline("f.out"))
        done.append(decided.select("item.doc_id", "item.size", "item.source_size", "item.target", (F.col("item.base") + F.col("extra")).alias("copies"), *of_item))
        left = folded.where(F.col("f.rest").isNotNull()).select("source", "n", F.col("f.rest").alias("item"))
        if blocks <= 1:
            break
        level, blocks = level + 1, -(-blocks // BLOCK)
    last = F.when(_coin("item.h", F.lit(-1), F.lit(seed)) * F.col("item.size") < F.col("item.mass"), 1).otherwise(0)
    done.append(left.select("item.doc_id", "item.size", "item.source_size", "item.target", (F.col("item.base") + last).alias("copies"), *of_item))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), *carry)
