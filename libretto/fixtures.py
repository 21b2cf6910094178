"""The driver's tables shaped as domain tables, in Spark and, for the oracles, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each domain table as SQL that Spark and DuckDB both run over the driver's tables.
VIEWS: dict[str, str] = {
    "works": """
        select cast(c_custkey as string) id, lower(replace(c_name, '#', '-')) slug, c_name title, n_name original_language,
               case c_mktsegment when 'BUILDING' then 'ongoing' when 'MACHINERY' then 'completed' when 'HOUSEHOLD' then 'hiatus' else '' end status,
               concat(c_mktsegment, ' of ', n_name, ' in ', r_name) synopsis,
               case when c_custkey % 3 = 0 then concat('cover-', cast(c_custkey as string)) end selected_cover_id, first_at created_at, last_at updated_at
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        left join (select o_custkey, min(o_orderdate) first_at, max(o_orderdate) last_at from orders group by o_custkey) o on c_custkey = o_custkey""",
    "versions": """
        select cast(o_orderkey as string) id, cast(o_custkey as string) work_id, concat('en-', cast(o_orderkey as string)) slug, o_orderpriority label,
               case when o_orderkey % 4 = 0 then cast(null as string) else o_orderpriority end translator_group, 'en' language,
               case o_orderstatus when 'F' then 'official' else 'fan' end version_type, o_orderstatus <> 'F' is_active, o_orderdate created_at, o_orderdate updated_at
        from orders""",
    "source_titles": """
        select concat('st-', cast(o_orderkey as string)) id, cast(o_orderkey as string) version_id, o_orderpriority source_site, cast(o_orderkey as string) source_id,
               o_totalprice / 1000000 quality_score, case when o_orderkey % 10 = 0 then null else o_orderdate end last_scraped_at, false is_metadata_authoritative,
               o_orderdate created_at, concat('https://example.com/novel/', cast(o_orderkey as string)) source_url
        from orders""",
    "version_chapters": """
        select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) id, cast(l_orderkey as string) version_id, cast(l_linenumber as double) chapter_number,
               concat('Chapter ', cast(l_linenumber as string)) title, case when min(l_returnflag) = 'R' then '' else min(l_returnflag) end content,
               cast(sum(l_quantity) as int) word_count, min(concat(cast(l_partkey as string), '/', cast(l_suppkey as string))) promoted_from_id
        from lineitem group by l_orderkey, l_linenumber""",
    "source_chapters": """
        select concat(cast(l_partkey as string), '/', cast(l_suppkey as string)) id, concat('st-', cast(l_orderkey as string)) source_title_id,
               concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) version_chapter_id, cast(l_linenumber as double) chapter_number,
               case when l_tax = 0 then cast(null as double) else l_discount end quality_score, l_shipdate last_scraped_at
        from lineitem""",
    "metadata_claims": """
        select concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string)) id,
               concat('st-', cast(l_orderkey as string)) source_title_id, case l_returnflag when 'A' then 'author' when 'N' then 'tags' else 'genres' end field_name,
               case l_returnflag when 'A' then s_name when 'N' then replace(p_name, ' ', ', ') else p_type end raw_value,
               case when l_tax = 0 then '' else cast(null as string) end normalised_value, l_discount * 10 confidence, l_linestatus = 'O' is_resolved, l_shipdate created_at
        from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey""",
    "cover_candidates": """
        select concat('cover-', cast(p_partkey as string)) id, concat('st-', cast(p_partkey as string)) source_title_id, concat('https://img.example.com/', cast(p_partkey as string)) source_url,
               case when p_size > 40 then concat('covers/', cast(p_partkey as string)) end local_path, cast(50 + p_size * 10 as int) width, cast(75 + p_size * 15 + p_partkey % 50 as int) height,
               cast(p_retailprice * p_size * 100 as int) file_size, cast(null as double) quality_score, false is_selected
        from part""",
    "ingestion_jobs": """
        select cast(event_id as string) id, event_type source_site, case when event_type = 'error' then 'failed' when value < 5 then 'pending' else 'completed' end status, ts created_at
        from events""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cluster's tasks, for rows that take long each: a file of many short rows is read by one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def domain(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named domain tables (all by default) over the tables in ``sf_dir``."""
    out = {}
    for name in names or VIEWS:
        sql = VIEWS[name]
        used = {t: raw(spark, sf_dir, t) for t in TABLES if f" {t} " in f"{sql} " or sql.rstrip().endswith(f" {t}")}
        for t in sorted(used, key=len, reverse=True):
            sql = _mark(sql, t)
        out[name] = spark.sql(sql, **used)
    return out


def _mark(sql: str, table: str) -> str:
    import re

    return re.sub(rf"\b(from|join) {table}\b", rf"\1 {{{table}}}", sql)


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL with the named domain views in front."""
    views = ", ".join(f"{n} as ({VIEWS[n]})" for n in names or VIEWS)
    body = sql.strip()
    return f"with {views}, {body[5:]}" if body.lower().startswith("with ") else f"with {views} {body}"
