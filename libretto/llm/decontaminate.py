"""Benchmark decontamination with a distributed positional inverted index.

A first pass counts how often each test term occurs in the training texts. A test
window is looked up by its rarest terms; the index holds the postings (term,
document, position) of the terms that are so used, stored in segments sorted by
term. Their posting lists are shifted by the terms' offsets and intersected, which
leaves few candidate places; each is then compared word by word. DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import forget, stored, stored_bytes

#: Separators: ASCII that is no letter or digit.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window; rarest terms whose lists are intersected.
WINDOW, RAREST = 10, 2
#: Share of a document's words that items of fewer words than a window must make up for it to go.
SHORT_SHARE = 0.5
#: Test-side tables of at most so many rows, and bytes as stored, are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def pieces(text: Column) -> Column:
    """The text cut at separators, in its own case; its first and last piece may be empty, others are words."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def words_of(text: Column) -> Column:
    return F.filter(pieces(lowered(text)), lambda w: w != "")


def n_words(cut: Column) -> Column:
    """Words of a cut text: its pieces without an empty first and last one."""
    size = F.size(cut)
    return (size - (cut[0] == "").cast("int") - ((size > 1) & (F.element_at(cut, -1) == "")).cast("int")).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast where its counted rows, and its bytes if it is a stored table, allow it."""
    fits = rows <= BROADCAST_ROWS and (not hasattr(df, "stored_at") or stored_bytes(df) <= BROADCAST_BYTES)
    return F.broadcast(df) if fits else df


def test_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win, words) and which items hold them (win, item). An item of fewer words is one window."""
    words = words_of(F.col(text_col))
    rows = items.select(F.col(id_col).cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    every = stored(rows.select("item", F.explode(F.transform(starts, lambda k: F.slice("w", k, window))).alias("words")).distinct(), "windows")
    named = stored(every.select("words").distinct().withColumn("win", F.monotonically_increasing_id()), "named-windows")
    return named, stored(every.join(named, "words").select("win", "item"), "holders")


def met_terms(tokens: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """Tokens (word, ...) with the ``term`` each is, of terms (word, term).

    Words are compared in full lower case first, which is cheap, and the few that
    meet with only A-Z lowered.
    """
    asked = small(terms.select(F.col("word").alias("asked"), "term"), rows)
    return tokens.join(asked, (F.lower("word") == F.lower("asked")) & (lowered(F.col("word")) == F.col("asked")))


def term_counts(docs: DataFrame, text_col: str, terms: DataFrame, term_rows: int) -> DataFrame:
    """Stored (term, df): how often each term of ``terms`` occurs; counted before anything is shuffled."""
    tokens = docs.select(F.explode(pieces(F.col(text_col))).alias("word"))
    if term_rows > BROADCAST_ROWS:
        # words are counted where they are, so that a common word is no hot key
        counted = tokens.groupBy("word").agg(F.count("*").alias("n"))
        met = met_terms(counted, terms, term_rows).groupBy("term").agg(F.sum("n").alias("df"))
    else:
        met = met_terms(tokens, terms, term_rows).groupBy("term").agg(F.count("*").alias("df"))
    return stored(met, "term-counts")


def build_index(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, term_rows: int) -> DataFrame:
    """Stored postings (term, id, th, pos) of the terms in ``terms`` (word, term); th tells rows of one id apart."""
    cut = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), pieces(F.col(text_col)).alias("cut"))
    lead = (F.col("cut")[0] == "").cast("int")
    tokens = cut.select("id", "th", lead.alias("lead"), F.posexplode("cut").alias("at", "word"))
    postings = met_terms(tokens, terms, term_rows).select("term", "id", "th", (F.col("at") - F.col("lead")).alias("pos"))
    return stored(postings.sortWithinPartitions("term"), "index")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, rarest: int = RAREST, slop: int = 0) -> DataFrame:
    """Stored (id, th, size, full, spans, items): documents in which test windows occur.

    ``size`` is the number of words; ``full`` whether a window of ``window`` words
    occurs (others are whole items); ``spans`` are the (start, end) word positions of
    the occurrences, sorted; ``items`` the ids (as text) of the items they belong to.
    With ``slop`` 0 a window occurs where its words stand in a row; with a larger one
    at every start from which each of its words stands within ``slop`` words of its
    place. The hits of a document meet in one row: they are at most its words times
    the windows that occur at a place.
    """
    if not 1 <= rarest <= 63:
        raise ValueError("the anchors of a window are the bits of a long")
    windows, holders = test_windows(items, item_col, item_text_col, window)
    placed = windows.select("win", F.size("words").alias("len"), F.posexplode("words").alias("off", "word"))
    terms = stored(placed.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    term_rows, window_rows = terms.count(), windows.count()
    lengths = term_counts(docs, text_col, terms, term_rows)
    order = Window.partitionBy("win").orderBy("df", "off")
    known = placed.join(small(terms, term_rows), "word").join(small(lengths, term_rows), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    anchors = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rarest)
    anchors = stored(anchors.select("term", "word", "win", "off", F.expr("shiftleft(1L, r - 1)").alias("bit"), F.least("len", F.lit(rarest)).alias("need")), "anchors")
    index = build_index(docs, id_col, text_col, anchors.select("word", "term").distinct(), term_rows)
    start = F.col("pos") - F.col("off")
    shifted = index.join(small(anchors.drop("word"), window_rows * rarest), "term").select("id", "th", "win", "bit", "need", start.alias("start"))
    if slop:
        shifted = shifted.withColumn("start", F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop)))
    else:
        shifted = shifted.where(F.col("start") >= 0)
    # one bit per anchor: a row that occurs more than once sets the same bits again
    met_anchors = F.bit_count(F.bit_or("bit"))
    hits = shifted.groupBy("id", "th", "win", "start").agg(met_anchors.alias("n"), F.min("need").alias("need")).where(F.col("n") == F.col("need"))
    hits = stored(hits.select("id", "th", "win", "start"), "candidates")
    forget(index)
    keys = hits.select(F.col("id").alias("kid"), F.col("th").alias("kth")).distinct()
    every = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    held = every.join(small(keys, keys.count()), F.col("id").eqNullSafe(F.col("kid")) & (F.col("th") == F.col("kth")), "left_semi").dropDuplicates(["id", "th"])
    by_doc = hits.join(small(windows, window_rows), "win").groupBy(F.col("id").alias("hid"), F.col("th").alias("hth")).agg(F.collect_set(F.struct("win", "start", "words")).alias("hits"))
    # cut once: inside the comparison below the texts would be cut for every hit
    cut = stored(held.select("id", "th", words_of(F.col("text")).alias("w")), "candidate-texts")
    met = cut.join(by_doc, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")))

    def there(h: Column) -> Column:
        if not slop:
            return F.slice("w", h["start"] + 1, F.size(h["words"])) == h["words"]

        def near(word: Column, j: Column) -> Column:
            low = F.greatest(h["start"] + j - slop, F.lit(0))
            return F.array_contains(F.slice("w", low + 1, F.greatest(h["start"] + j + slop - low + 1, F.lit(0))), word)

        return F.forall(F.transform(h["words"], near), lambda x: x)

    sure = met.select("id", "th", F.size("w").alias("size"), F.filter("hits", there).alias("hits")).where(F.size("hits") > 0)
    span = F.transform("hits", lambda h: F.struct(F.greatest(h["start"], F.lit(0)).cast("int").alias("start"), F.least(h["start"] + F.size(h["words"]), F.col("size")).cast("int").alias("end")))
    full = F.exists("hits", lambda h: F.size(h["words"]) >= window)
    exact = stored(sure.select("id", "th", "size", full.alias("full"), F.array_sort(F.array_distinct(span)).alias("spans"), F.array_distinct(F.col("hits.win")).alias("wins")), "exact")
    named = exact.select("id", "th", F.explode("wins").alias("win")).join(small(holders, holders.count()), "win")
    owners = named.groupBy(F.col("id").alias("owner"), F.col("th").alias("owner_th")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = exact.join(owners, F.col("id").eqNullSafe(F.col("owner")) & (F.col("th") == F.col("owner_th"))).select("id", "th", "size", "full", "spans", "items")
    return stored(found, "matches")


def covered(spans: Column) -> Column:
    """Positions that sorted (start, end) spans cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("at"))

    def add(acc: Column, s: Column) -> Column:
        fresh = F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["at"], s["end"]).cast("int").alias("at"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, rarest: int = RAREST, slop: int = 0) -> DataFrame:
    """(id, n_words, n_hit, items, spans) of every document row.

    A null or empty text has no words and no hits; items without words match
    nothing; a null id is an id like any other; repeated rows give repeated rows;
    other columns are ignored; with no items or no documents nothing is hit. Texts of
    any length are read whole.
    """
    found = matches(docs, items, id_col, text_col, item_col, item_text_col, window, rarest, slop)
    every = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("hash"), n_words(pieces(F.col(text_col))).alias("n_words"))
    side = small(found, found.count())
    joined = every.join(side, F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("th")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    return joined.select(F.col("doc").alias(id_col), "n_words", covered(spans).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), spans.alias("spans"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, short_share: float = SHORT_SHARE) -> DataFrame:
    """``docs`` without the rows in which a full window of ``window`` words of a test item occurs.

    Items of fewer words, which common words may spell by chance, drop a row where
    they make up at least ``short_share`` of its words. Null and empty texts stay;
    repeated rows stay or go together; a null id is an id like any other.
    """
    found = matches(docs, items, id_col, text_col, window=window)
    dirty = found.where(F.col("full") | (covered(F.col("spans")) >= F.col("size") * short_share)).select(F.col("id").alias("__id"), F.col("th").alias("__th"))
    return docs.join(small(dirty, dirty.count()), docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__th")), "left_anti")
