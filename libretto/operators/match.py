"""Record linkage: titles to works, translator groups to versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from libretto.functions import text as T
from libretto.functions.fuzzy import can_reach, ratio
from libretto.plans.store import forget, stored
from libretto.schema import det_id

WORK_RATIO, TRANSLATOR_RATIO, EXACT_RATIO = 90.0, 85.0, 98.0


#: Letters of a key's signature, twelve to a long: of each, up to five occurrences are told apart.
LETTERS = ("abcdefghijkl", "mnopqrstuvwx", "yz0123456789")
#: Rows of one segment from which on it counts as hot, and most segments that can be hot.
HOT_ROWS, MOST_HOT = 4096, 100_000


def signature(key: Column) -> list[Column]:
    """Longs that differ in at most as many bits as letters have to be put in or taken out to make one key of another."""
    many = lambda c: F.length(key) - F.length(F.replace(key, F.lit(c), F.lit("")))
    unary = lambda c: F.call_function("shiftleft", F.lit(1), F.least(many(c), F.lit(5))) - 1
    return [reduce(lambda a, b: a + b, (F.shiftleft(unary(c).cast("long"), 5 * k) for k, c in enumerate(letters))) for letters in LETTERS]


def edits(least: float, total: Column) -> Column:
    """Most letters that two keys of ``total`` letters may have apart at a ratio of ``least``."""
    return F.floor((100 - least) / 100 * total + 1e-9).cast("int")


def _parts(n: Column, least: float) -> Column:
    """Segments of a key of ``n`` letters: one more than the edits to its longest partner."""
    return edits(least, n + F.floor(n * (200 - least) / least + 1e-9)) + 1


def indexed_segments(side: DataFrame, least: float) -> DataFrame:
    """(segment, id, n, s0, s1, s2): each key (id, key) cut into even segments, each known by the key's length, its own place and its letters."""
    n = F.length("key")
    cut = side.where(n > 0).select("id", "key", n.alias("n"), _parts(n, least).alias("m")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    start = F.floor(F.col("j") * F.col("n") / F.col("m")).cast("int")
    end = F.floor((F.col("j") + 1) * F.col("n") / F.col("m")).cast("int")
    letters = F.substring(F.col("key"), start + 1, end - start)
    signs = [s.alias(f"s{k}") for k, s in enumerate(signature(F.col("key")))]
    return cut.select(F.xxhash64("n", "j", letters).alias("segment"), "id", "n", *signs)


def probed_segments(side: DataFrame, least: float) -> DataFrame:
    """(segment, id, n, s0, s1, s2): where a partner's segments may stand in each key (id, key).

    For each partner's length, and each of its segments j: some segment is whole, with
    exactly j edits before it and the rest of them behind it. So it has moved by j, j -
    2, ... or -j letters, and what the lengths still differ by has to fit behind it.
    """
    own, reach = F.col("n"), (200 - least) / least
    signs = [s.alias(f"s{k}") for k, s in enumerate(signature(F.col("key")))]
    keyed = side.where(F.length("key") > 0).select("id", "key", F.length("key").alias("n"), *signs)
    lengths = F.sequence(F.ceil(own / reach - 1e-9).cast("int"), F.floor(own * reach + 1e-9).cast("int"))
    cut = keyed.withColumn("other", F.explode(lengths))
    cut = cut.withColumns({"most": edits(least, own + F.col("other")), "m": _parts(F.col("other"), least)})
    cut = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.col("m") - 1, F.col("most")))))
    cut = cut.withColumn("moved", F.explode(F.sequence(-F.col("j"), F.col("j"), F.when(F.col("j") > 0, 2).otherwise(1))))
    start = F.floor(F.col("j") * F.col("other") / F.col("m")).cast("int")
    size = F.floor((F.col("j") + 1) * F.col("other") / F.col("m")).cast("int") - start
    cut = cut.withColumns({"start": start + F.col("moved"), "size": size})
    fits = (F.abs(own - F.col("other") - F.col("moved")) <= F.col("most") - F.col("j")) & (F.col("start") >= 0) & (F.col("start") + F.col("size") <= own)
    letters = F.substring(F.col("key"), F.col("start") + 1, F.col("size"))
    return cut.where(fits).select(F.xxhash64(F.col("other"), "j", letters).alias("segment"), "id", "n", "s0", "s1", "s2")


def close_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(l_id, r_id): distinct pairs of (id, key) rows that share a segment and whose letters do not already differ too much.

    All pairs of a ratio of at least ``least`` are among them, and few others. A hot
    segment's rows are dealt into cells of about HOT_ROWS on either side, each side
    repeated for the other's; that there are few hot segments follows from their size.
    """
    held, asked = stored(indexed_segments(right, least), "segments"), stored(probed_segments(left, least), "probes")
    sizes = stored(held.groupBy("segment").agg(F.count("*").alias("held")).join(asked.groupBy("segment").agg(F.count("*").alias("asked")), "segment"), "segment-sizes")
    total = sizes.agg(F.sum(F.col("held") + F.col("asked"))).first()[0] or 0
    limit = max(HOT_ROWS, -(-total // MOST_HOT))
    hot = F.broadcast(sizes.where((F.col("held") > limit) | (F.col("asked") > limit)).select("segment", F.ceil(F.col("held") / limit).cast("int").alias("rows"), F.ceil(F.col("asked") / limit).cast("int").alias("columns")))

    def celled(df: DataFrame, own: str, other: str) -> DataFrame:
        # a row stands in one line of cells of its own side, and in all of the other's
        spread = df.join(hot, "segment", "left").withColumn(own[0], F.pmod(F.xxhash64("id"), F.coalesce(own, F.lit(1))).cast("int"))
        return spread.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("rows", "columns")

    l, r = celled(asked, "columns", "rows"), celled(held, "rows", "columns")
    r = r.select("segment", "r", "c", F.col("id").alias("r_id"), F.col("n").alias("r_n"), *(F.col(f"s{k}").alias(f"t{k}") for k in range(3)))
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}"))) for k in range(3)))
    met = l.join(r, ["segment", "r", "c"]).where(apart <= edits(least, F.col("n") + F.col("r_n")))
    out = stored(met.select(F.col("id").alias("l_id"), "r_id").distinct(), "close-pairs")
    forget(held, asked, sizes)
    return out


def fuzzy_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(l_id, r_id, score): pairs of (id, key) rows, ids distinct on either side, whose keys have an indel ratio of at least ``least``.

    Blocking loses nothing. A ratio of ``least`` allows d = (1 - least/100) * (both
    lengths) letters put in or taken out. The right key, cut into more than d segments,
    keeps one whole, which stands in the left key near its place. So keys meet by
    (length, number of the segment, its letters); pairs whose letters alone, counted,
    differ by more than d go before the similarity is computed. Keys that are empty
    match nothing. ``least`` has to be above 200 / 3: below, segments would be shorter
    than a letter.
    """
    if least <= 200 / 3:
        raise ValueError("a ratio of 66.7 or less leaves no segment whole")
    pairs = close_pairs(left, right, least)
    keyed = pairs.join(left.select(F.col("id").alias("l_id"), F.col("key").alias("l_key")), "l_id").join(right.select(F.col("id").alias("r_id"), F.col("key").alias("r_key")), "r_id")
    score = F.when(F.col("l_key") == F.col("r_key"), 100.0).otherwise(ratio(F.col("l_key"), F.col("r_key")))
    return keyed.withColumn("score", score).where(F.col("score") >= least).select("l_id", "r_id", "score")


def match_works(candidates: DataFrame, works: DataFrame, least: float = WORK_RATIO) -> DataFrame:
    """Each candidate (id, title) with the work it belongs to.

    Returns (id, slug, work_id, confidence, reason, is_new_work): the work with the
    same slug, else the most similar title of at least ``least``, ties to the older
    work and then the smaller id, else a new work whose id is the md5 of the slug.
    A title without a slug is always new, under its own id.
    """
    slugged = candidates.select("id", "title", T.slugify(F.coalesce("title", F.lit(""))).alias("slug"))
    first = Window.partitionBy("slug").orderBy("created_at", "id")
    known = works.where(F.col("slug") != "").withColumn("__n", F.row_number().over(first)).where("__n = 1").select(F.col("slug").alias("w_slug"), F.col("id").alias("w_id"))
    exact = slugged.join(known, F.col("slug") == F.col("w_slug"), "left")
    hit = exact.where(F.col("w_id").isNotNull()).select("id", "slug", F.col("w_id").alias("work_id"), F.lit(1.0).alias("confidence"), F.lit("exact_slug").alias("reason"), F.lit(False).alias("is_new_work"))
    rest = exact.where(F.col("w_id").isNull()).select("id", "title", "slug")
    # equal titles are compared once
    forms = rest.select(T.token_sort(T.match_key("title")).alias("key")).distinct().select(F.col("key").alias("id"), "key")
    targets = works.where(F.coalesce("title", F.lit("")) != "").select("id", T.token_sort(T.match_key("title")).alias("key"))
    ages = works.select(F.col("id").alias("r_id"), "created_at")
    best = Window.partitionBy("l_id").orderBy(F.desc("score"), "created_at", "r_id")
    pairs = fuzzy_pairs(forms, targets, least).join(ages, "r_id").withColumn("__n", F.row_number().over(best)).where("__n = 1").select(F.col("l_id").alias("key"), F.col("r_id").alias("work_id"), "score")
    linked = rest.withColumn("key", T.token_sort(T.match_key("title"))).join(pairs, "key", "left")
    new = F.when(F.col("slug") == "", det_id(F.lit("work"), F.col("id"))).otherwise(det_id(F.lit("work"), F.col("slug")))
    other = linked.select(
        "id", "slug", F.coalesce("work_id", new).alias("work_id"), F.coalesce(F.col("score") / 100, F.lit(1.0)).alias("confidence"),
        F.when(F.col("work_id").isNull(), "new").otherwise("fuzzy_title").alias("reason"), F.col("work_id").isNull().alias("is_new_work"),
    )
    return hit.unionByName(other)


def founders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (node, rank) that come first: those of which no earlier founder is a neighbour by ``edges`` (earlier, later).

    Decided in rounds, each a stored table: a node founds once all earlier neighbours
    are known to be none, and is out once one of them is. Rounds are as many as the
    longest chain of neighbours that wait for each other.
    """
    state = stored(nodes.withColumn("found", F.lit(None).cast("boolean")), "founders")
    while not state.where(F.col("found").isNull()).isEmpty():
        before = state.select(F.col("node").alias("earlier"), F.col("found").alias("was"))
        told = edges.join(before, "earlier").groupBy(F.col("later").alias("node")).agg(F.max(F.coalesce("was", F.lit(False))).alias("taken"), F.max(F.col("was").isNull()).alias("waits"))
        now = F.when(F.col("taken"), False).when(F.coalesce("waits", F.lit(False)), None).otherwise(True)
        done = stored(state.join(told, "node", "left").select("node", "rank", F.coalesce("found", now).alias("found")), "founders")
        forget(state)
        state = done
    return state.where("found").select("node", "rank")


def match_batch(candidates: DataFrame, works: DataFrame, least: float = WORK_RATIO) -> DataFrame:
    """``match_works`` as if candidates came one by one, in order of id: each also sees the works that earlier ones made.

    The earliest candidates that match no work and no earlier such one found works.
    Every other takes the work of its slug, else the most similar title, ties to the
    works there were, then to the earlier founder. Same columns as ``match_works``.
    """
    first = stored(match_works(candidates, works, least), "matched")
    keyed = stored(first.where(F.col("reason") != "exact_slug").join(candidates.select("id", "title"), "id").withColumn("key", T.token_sort(T.match_key("title"))), "keyed")
    # alike in slug and key: one node, which stands where its earliest candidate does
    nodes = stored(keyed.where(F.col("is_new_work") & (F.col("slug") != "")).groupBy("slug", "key").agg(F.min("id").alias("rank")).withColumn("node", det_id("slug", "key")), "nodes")
    forms = keyed.select(F.col("key").alias("id"), "key").distinct()
    pairs = stored(fuzzy_pairs(forms, nodes.select(F.col("key").alias("id"), "key").distinct(), least), "pairs")
    a = nodes.select(F.col("node").alias("earlier"), F.col("rank").alias("a_rank"), F.col("key").alias("l_id"), F.col("slug").alias("a_slug"))
    b = nodes.select(F.col("node").alias("later"), F.col("rank").alias("b_rank"), F.col("key").alias("r_id"), F.col("slug").alias("b_slug"))
    alike = a.join(pairs, "l_id").join(b, "r_id").where("a_rank < b_rank").select("earlier", "later")
    named = a.join(b, (F.col("a_slug") == F.col("b_slug")) & (F.col("a_rank") < F.col("b_rank"))).select("earlier", "later")
    edges = stored(alike.unionAll(named).distinct(), "edges")
    made = stored(founders(nodes.select("node", "rank"), edges).join(nodes.select("node", "slug", "key"), "node").select("rank", F.col("slug").alias("f_slug"), F.col("key").alias("f_key"), det_id(F.lit("work"), "slug").alias("f_work")), "made")
    by_slug = made.groupBy("f_slug").agg(F.min("rank").alias("s_rank"), F.first("f_work").alias("s_work"))
    close = keyed.select("id", "key").join(pairs, F.col("key") == F.col("l_id")).join(made, F.col("r_id") == F.col("f_key")).where(F.col("rank") < F.col("id"))
    best = close.groupBy("id").agg(F.min_by(F.struct("f_work", F.col("score").alias("f_score")), F.struct(-F.col("score"), "rank")).alias("b"))
    met = keyed.join(by_slug, (F.col("slug") == F.col("f_slug")) & (F.col("s_rank") <= F.col("id")), "left").join(best, "id", "left")
    own = F.col("s_rank") == F.col("id")
    same = F.col("s_rank") < F.col("id")
    better = F.col("b").isNotNull() & (F.col("is_new_work") | (F.col("b.f_score") / 100 > F.col("confidence")))
    placed = met.select(
        "id", "slug", F.when(own | same, F.col("s_work")).when(better, F.col("b.f_work")).otherwise(F.col("work_id")).alias("work_id"),
        F.when(own | same, 1.0).when(better, F.col("b.f_score") / 100).otherwise(F.col("confidence")).alias("confidence"),
        F.when(own, "new").when(same, "exact_slug").when(better, "fuzzy_title").otherwise(F.col("reason")).alias("reason"),
        F.when(own, True).when(same | better, False).otherwise(F.col("is_new_work")).alias("is_new_work"),
    )
    return first.where(F.col("reason") == "exact_slug").unionByName(placed)


def find_versions(matched: DataFrame, versions: DataFrame) -> DataFrame:
    """Each matched row (id, work_id, language, translator_group, version_type) with its version by (work, slug), existing or new."""
    rows = matched.withColumn("version_slug", T.version_slug("language", "translator_group"))
    there = versions.select(F.col("id").alias("v_id"), F.col("work_id").alias("v_work"), F.col("slug").alias("v_slug"))
    joined = rows.join(there, (F.col("work_id") == F.col("v_work")) & (F.col("version_slug") == F.col("v_slug")), "left")
    return joined.select(
        *rows.columns, F.coalesce("v_id", det_id("work_id", "version_slug")).alias("version_id"), F.col("v_id").isNull().alias("is_new_version"),
        T.version_label("language", "translator_group", "version_type").alias("version_label"),
    )


def match_versions(candidates: DataFrame, versions: DataFrame, least: float = TRANSLATOR_RATIO) -> DataFrame:
    """(id, version_id, confidence, reason) for candidates (id, work_id, language, translator_group, version_type) that match a version.

    With a translator group: the most similar group of the same work and language,
    at least ``least``, or none. Without: the only version of that work, language
    and type, or none.
    """
    has = T.truthy("translator_group").isNotNull()
    v = versions.select(F.col("id").alias("version_id"), F.col("work_id").alias("v_work"), F.col("language").alias("v_lang"), F.col("translator_group").alias("v_group"), F.col("version_type").alias("v_type"))
    same = (F.col("work_id") == F.col("v_work")) & (F.col("language") == F.col("v_lang"))
    a, b = T.token_sort(F.lower("translator_group")), T.token_sort(F.lower("v_group"))
    # each pair of names of a work and language is compared once, equal ones not at all
    ours = candidates.where(has).select("work_id", "language", a.alias("a")).distinct()
    theirs = v.where(T.truthy("v_group").isNotNull()).select("v_work", "v_lang", b.alias("b")).distinct()
    met = ours.join(theirs, same).where(can_reach(F.col("a"), F.col("b"), least)).select(F.col("work_id").alias("p_work"), F.col("language").alias("p_lang"), "a", "b")
    alike = F.col("a") == F.col("b")
    different = met.where(~alike).select("a", "b").distinct().withColumn("score", ratio(F.col("a"), F.col("b"))).where(F.col("score") >= least)
    scored = met.where(alike).withColumn("score", F.lit(100.0)).unionByName(met.where(~alike).join(different, ["a", "b"]))
    ours = candidates.where(has).select("id", F.col("work_id").alias("p_work"), F.col("language").alias("p_lang"), a.alias("a"))
    theirs = v.where(T.truthy("v_group").isNotNull()).select("version_id", F.col("v_work").alias("p_work"), F.col("v_lang").alias("p_lang"), b.alias("b"))
    named = ours.join(scored, ["p_work", "p_lang", "a"]).join(theirs, ["p_work", "p_lang", "b"])
    best = Window.partitionBy("id").orderBy(F.desc("score"), "version_id")
    by_name = named.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("id", "version_id", (F.col("score") / 100).alias("confidence"), F.when(F.col("score") >= EXACT_RATIO, "translator_exact").otherwise("translator_fuzzy").alias("reason"))
    only = v.groupBy("v_work", "v_lang", "v_type").agg(F.min("version_id").alias("version_id"), F.count("*").alias("n")).where("n = 1")
    alone = candidates.where(~has).join(only, same & (F.col("version_type") == F.col("v_type"))).select("id", "version_id", F.lit(0.6).alias("confidence"), F.lit("language_only").alias("reason"))
    return by_name.unionByName(alone)
