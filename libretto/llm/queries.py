"""The registered queries of the pipeline operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_pii

    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op3_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxscore import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).drop("runs")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_blocks import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_boilerplate

    found = drop_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op9_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_of, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_deleted_interpolation": op2_deleted_interpolation,
    "op3_maxscore_topk": op3_maxscore_topk,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_pivotal_mixing": op6_pivotal_mixing,
    "op7_html_main_text": op7_html_main_text,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash_gray": op9_simhash_gray,
    "op10_language_id": op10_language_id,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_divergence": op13_source_divergence,
}

#: A-Z to lower case, and the separators of decontamination words, in DuckDB.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CUT = "list_filter(string_split_regex(" + _LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op4_substring_dedup": r"""
        with docs as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        wins as (select doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 48)) k from docs where len(w) >= 50)),
        firsts as (select h, min(doc_id) lowest from wins group by h),
        gone as (select distinct doc_id, unnest(range(k, k + 50)) pos from wins join firsts using (h) where lowest < doc_id),
        lists as (select doc_id, list(pos) ps, count(*) n from gone group by doc_id),
        words as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) pos from docs),
        kept as (select doc_id, string_agg(x, ' ' order by pos) t from words anti join gone using (doc_id, pos) group by doc_id)
        select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256
        from docs left join lists using (doc_id) left join kept using (doc_id)""",
    "op8_line_dedup": """
        with pages as (select distinct source, text from documents where text is not null),
        totals as (select source, count(*) total from pages group by source),
        held as (select distinct source, text, trim(unnest(string_split(text, chr(10))), e'\\t \\r\\v\\f') line from pages),
        bad as (
            select source, line from held join totals using (source) where line <> ''
            group by source, line, total having count(*) >= 3 and count(*) / total > 0.02),
        lines as (
            select doc_id, source, unnest(string_split(text, chr(10))) raw, generate_subscripts(string_split(text, chr(10)), 1) pos
            from documents where text is not null),
        marked as (select l.*, b.line is not null gone from lines l left join bad b on l.source = b.source and trim(raw, e'\\t \\r\\v\\f') = b.line),
        done as (
            select doc_id, count(*) n_lines, count(*) filter (where gone) n_dropped, string_agg(raw, chr(10) order by pos) filter (where not gone) t
            from marked group by doc_id)
        select doc_id, source, cast(coalesce(n_lines, 0) as bigint) n_lines, cast(coalesce(n_dropped, 0) as bigint) n_dropped, sha256(coalesce(t, '')) text_sha256
        from documents left join done using (doc_id)""",
    "op5_decontamination": f"""
        with items as (select item_id, {_CUT.format("coalesce(text, '')")} w from benchmark),
        wins as (
            select distinct cast(item_id as varchar) item, array_to_string(w[k : k + 9], ' ') phrase, least(len(w), 10) n
            from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) k from items where len(w) > 0)),
        docs as (select doc_id, {_CUT.format("coalesce(text, '')")} w from documents),
        sizes as (select distinct n from wins),
        places as (
            select doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') phrase
            from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) k from docs, sizes where len(w) >= n)),
        hits as (select doc_id, k, p.n, item from places p join wins using (phrase, n)),
        words as (select doc_id, count(distinct pos) n_hit from (select doc_id, unnest(range(k, k + n)) pos from hits) group by doc_id),
        names as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from hits group by doc_id)
        select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
               sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
        from docs left join words using (doc_id) left join names using (doc_id)""",
    "op3_maxscore_topk": """
        with rows as (
            select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select q.vec_id query_id, c.vec_id,
                   cast(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0) as bigint) score
            from rows q join rows c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) "rank", vec_id, score
        from scored qualify "rank" <= 5""",
    "op11_exact_dedup": r"""
        with texts as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) text_sha256 from documents)
        select doc_id, min(doc_id) over same keep_id, count(*) over same group_size, doc_id = min(doc_id) over same kept, text_sha256
        from texts window same as (partition by text_sha256)""",
    "op12_hard_negatives": """
        with rows as (
            select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select a.vec_id anchor_id, c.vec_id, a.label = c.label same,
                   cast(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0) as bigint) score
            from rows a join rows c on a.vec_id % 50 = 0 and c.vec_id <> a.vec_id),
        positives as (
            select anchor_id, vec_id positive_id, score positive_score from scored where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) "rank",
               vec_id negative_id, positive_score, score negative_score
        from positives join scored using (anchor_id)
        where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
        qualify "rank" <= 3""",
    "op13_source_divergence": f"""
        with docs as (
            select coalesce(lang, '') lang, coalesce(source, '') source,
                   list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') w
            from documents),
        groups as (select distinct lang, source from docs),
        said as (select lang, source, unnest(w) term from docs),
        kept as (select lang, term from (select lang, unnest(list_distinct(w)) term from docs) group by lang, term having count(*) >= 10),
        vocabulary as (select lang, count(*) v from kept group by lang),
        counts as (select lang, source, term, count(*) n from said semi join kept using (lang, term) group by lang, source, term),
        full_counts as (select g.lang, g.source, k.term, coalesce(n, 0) n from groups g join kept k using (lang) left join counts using (lang, source, term)),
        ps as (
            select lang, source, term, n, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang, source) + 2 * v) p
            from full_counts join vocabulary using (lang)),
        totals as (select lang, term, sum(n) n from full_counts group by lang, term),
        qs as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over (partition by lang) + 2 * v) q from totals join vocabulary using (lang)),
        sums as (
            select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) value
            from ps a join ps b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        pairs as (
            select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(value, 0) as bigint) value
            from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
        terms as (
            select lang, source, 'term' part, term item, cast((p - q) * (p - q) // (p + q) as bigint) value
            from ps join qs using (lang, term) where n > 0 and p > q),
        ranked as (
            select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) "rank"
            from (select * from pairs union all select * from terms))
        select * from ranked where part = 'pair' or "rank" <= 10""",
}
