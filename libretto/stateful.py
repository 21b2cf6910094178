"""Queries over several batches: incremental resolution, snapshots, streams with state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libretto.composites import ALL, BEST, at, told_tables
from libretto.fixtures import domain, raw
from libretto.operators.resolve import owners
from libretto.plans import incremental
from libretto.plans.snapshots import Conflict, Snapshots, delete_rows
from libretto.plans.store import fresh, stored
from libretto.queries import CLAIMS, query
from libretto.streaming import ingest as streams

# -- incremental resolution ---------------------------------------------------------

BATCHES = 3
NUMBER = "cast(split_part(id, '-', 1) as int)"


def resolved_in_batches(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The domain tables, and the state after the claims came in three batches, of which the second came twice."""
    t = told_tables(spark, sf_dir)
    store = Snapshots(spark, fresh(spark, "resolved"))
    known = stored(owners(t["source_titles"], t["versions"]).select("source_title_id", "work_id"), "owners")
    for k in (0, 1, 1, 2):
        batch = t["metadata_claims"].where(F.expr(f"{NUMBER} % {BATCHES} = {k}"))
        done, _ = incremental.apply_claims(store, batch, t["source_titles"], t["versions"], parts=16, known=known)
    return t, done.read(incremental.STATE)


@query("resolve_incremental", f"with {BEST} select work_id, field field_name, v \"value\", confidence, id from best", ("works", *CLAIMS))
def resolve_incremental(spark, sf_dir):
    """Winners kept up to date over batches of claims."""
    return resolved_in_batches(spark, sf_dir)[1].select("work_id", "field_name", "value", "confidence", "id")


@query("resolve_incremental_works", f"""
    with {BEST},
    wide as (select work_id, max(v) filter (where field = 'title') title, max(v) filter (where field = 'synopsis') synopsis, max(v) filter (where field = 'status') status,
        max(v) filter (where field = 'original_language') original_language, count(*) filter (where field <> 'author') n from best group by work_id)
    select w.id, coalesce(nullif(b.title, ''), w.title) title, coalesce(nullif(b.synopsis, ''), w.synopsis) synopsis, coalesce(nullif(b.status, ''), w.status) status,
           coalesce(nullif(b.original_language, ''), w.original_language) original_language, coalesce(n, 0) > 0 touched
    from works w left join wide b on w.id = b.work_id""", ("works", *CLAIMS))
def resolve_incremental_works(spark, sf_dir):
    """Works as the state has them, which is what resolving everything at once gives."""
    t, state = resolved_in_batches(spark, sf_dir)
    done = incremental.resolved_works(t["works"], state, at())
    return done.select("id", "title", "synopsis", "status", "original_language", F.coalesce(F.col("updated_at") == at(), F.lit(False)).alias("touched"))


# -- snapshots ------------------------------------------------------------------------


@query("snapshot_commits", " union all ".join([f"select 1 version, '{n}' \"table\", count(*) n from {n}" for n in ALL] + [
    "select 2, 'works', count(*) from works where id <> '7'", "select 2, 'versions', count(*) from versions where work_id <> '7'",
    "select 2, 'source_titles', count(*) from source_titles s join versions v on s.version_id = v.id where work_id <> '7'",
    "select 2, 'version_chapters', count(*) from version_chapters c join versions v on c.version_id = v.id where work_id <> '7'",
    "select 2, 'metadata_claims', count(*) from metadata_claims c join source_titles s on c.source_title_id = s.id join versions v on s.version_id = v.id where work_id <> '7'",
    "select 2, 'source_chapters', count(*) from source_chapters c join source_titles s on c.source_title_id = s.id join versions v on s.version_id = v.id where work_id <> '7'",
    "select 2, 'cover_candidates', count(*) from cover_candidates where source_title_id not in (select s.id from source_titles s join versions v on s.version_id = v.id where work_id = '7')",
    "select 2, 'ingestion_jobs', count(*) from ingestion_jobs", "select 2, 'conflicts', 1"]), ALL)
def snapshot_commits(spark, sf_dir):
    """All eight tables in one commit; a delete that cascades as the second. A writer that fails changes nothing, one that comes too late is told so."""
    store = Snapshots(spark, fresh(spark, "snapshots"))
    first = store.begin()
    for name, df in domain(spark, sf_dir, *ALL).items():
        first.write(name, df)
    first.commit()
    fails, deletes, late = store.begin(), store.begin(), store.begin()
    try:
        fails.write("works", fails.base.read("works").where("false"))
        fails.write("versions", fails.base.read("no such table"))
        fails.commit()
    except KeyError:
        pass
    delete_rows(deletes, "works", F.col("id") == "7", tuple(n for n in ALL if n != "ingestion_jobs"))
    deletes.commit()
    conflicts = 0
    try:
        late.append("works", late.base.read("works")).commit()
    except Conflict:
        conflicts += 1
    counts = [store.at(v).read(n).agg(F.lit(v).alias("version"), F.lit(n).alias("table"), F.count("*").alias("n")) for v in store.versions() for n in ALL]
    counts.append(spark.range(1).select(F.lit(store.latest().version).alias("version"), F.lit("conflicts").alias("table"), F.lit(conflicts).cast("long").alias("n")))
    return reduce(DataFrame.unionAll, counts)


# -- streams --------------------------------------------------------------------------

KEYS = ("source_title_id", "field_name", "claim_hash")


def _claims(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").alias("source_title_id"), F.col("event_type").alias("field_name"), F.md5("props").alias("claim_hash"))


@query("streaming_once", "select user_id source_title_id, event_type field_name, md5(props) claim_hash, 1 n from events group by all")
def streaming_once(spark, sf_dir):
    """Claims in files that repeat each other, a file a batch; the stream stops, goes on from its checkpoint, and finds every claim again in more files."""
    root = fresh(spark, "once")
    events, store = raw(spark, sf_dir, "events"), Snapshots(spark, f"{root}/store")
    for turn in (("event_id % 3 <> 0", "event_id % 2 = 0"), ("event_id % 5 <> 1", "true"), ()):
        for chosen in turn:
            events.where(chosen).coalesce(1).write.mode("append").parquet(f"{root}/in")
        streams.stream_claims_once(spark, f"{root}/in", events.schema, store, "claims", f"{root}/checkpoint", _claims, KEYS, "claims", files=1).awaitTermination()
    return store.latest().read("claims").groupBy(*KEYS).agg(F.count("*").cast("int").alias("n"))


#: Events by six days, some of them one to three such spans late.
SPAN = "least(4, (day(ts) - 1) // 6 + case when event_id % 13 = 0 then 3 when event_id % 11 = 0 then 2 when event_id % 7 = 0 then 1 else 0 end)"


def in_spans(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Events written a span a file, one after the other."""
    events = raw(spark, sf_dir, "events")
    spans = events.withColumn("span", F.expr(SPAN.replace("//", "div")))
    for k in range(5):
        spans.where(F.col("span") == k).drop("span").coalesce(1).write.mode("append").parquet(f"{root}/in")
    return events


#: What each batch's late rows are measured by: the latest event of the batches before the last one, less two days; and what the stream's end has closed.
MARKS = f"""
    e as (select *, {SPAN} span from events),
    marks as (select s span, (select max(ts) from e where span < s - 1) - interval 2 days late from range(5) t(s)),
    ending as (select max(ts) - interval 2 days closed from e)"""


@query("streaming_sliding", f"""
    with {MARKS},
    w as (
        select unnest([time_bucket(interval 6 hours, ts), time_bucket(interval 6 hours, ts) - interval 6 hours]) start, event_type, value, late
        from e join marks using (span))
    select start, event_type, count(*) n, round(avg(value) * count(*), 2) total from w, ending
    where (late is null or start + interval 12 hours > date_trunc('milliseconds', late)) and start + interval 12 hours <= date_trunc('milliseconds', closed) group by 1, 2""")
def streaming_sliding(spark, sf_dir):
    """Windows of twelve hours, one every six, in append mode over five batches: what is later than two days is dropped."""
    root = fresh(spark, "sliding")
    events = in_spans(spark, sf_dir, root)
    windows = lambda e: streams.sliding_counts(e, "12 hours", "6 hours", "2 days")
    streams.run_windows(spark, f"{root}/in", events.schema, windows, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round(F.col("mean_value") * F.col("n"), 2).alias("total"))
