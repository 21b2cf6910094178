"""Snapshots, incremental resolution and streams with state, over several batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_operators import at, t, table  # noqa: F401  (the small domain tables)

from libretto import schema
from libretto.operators import resolve
from libretto.plans import incremental, jobs, snapshots
from libretto.plans.snapshots import Conflict, Snapshots
from libretto.streaming import ingest as streams


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def numbers(spark, *rows):
    return spark.createDataFrame([(k, k % 4) for k in rows], "id long, part int")


# -- snapshots ------------------------------------------------------------------------


def test_a_commit_is_all_or_nothing(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    assert store.latest().version == 0
    store.begin().write("a", numbers(spark, 1, 2)).write("b", numbers(spark, 3)).commit()
    seen = store.latest()
    tx = store.begin()
    tx.write("a", numbers(spark, 9))
    with pytest.raises(Exception):
        tx.write("b", numbers(spark, 1).select(F.raise_error(F.lit("midway")).alias("id"), "part"))
    # the writer dies here: readers see the old version, and the next writer starts from it
    assert store.latest().version == 1 and ids(store.latest().read("a")) == [1, 2]
    store.begin().append("a", numbers(spark, 5)).commit()
    assert ids(store.latest().read("a")) == [1, 2, 5] and ids(seen.read("a")) == [1, 2] and ids(store.at(1).read("a")) == [1, 2]
    assert ids(store.latest().read("b")) == [3]


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    store.begin().write("a", numbers(spark, 1)).commit()
    one, two = store.begin(), store.begin()
    one.append("a", numbers(spark, 2)).commit()
    two.append("a", numbers(spark, 3))
    with pytest.raises(Conflict):
        two.commit()
    assert ids(store.latest().read("a")) == [1, 2] and store.versions() == [1, 2]
    two = store.begin().append("a", numbers(spark, 3)).commit()
    assert two.version == 3 and ids(two.read("a")) == [1, 2, 3]


def test_manifests_are_never_seen_in_part(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    store.begin().write("a", numbers(spark, 1)).commit()
    store._publish(2, {"version": 2, "tables": {}, "marks": {}})
    with pytest.raises(Conflict):
        store._publish(2, {"version": 2, "tables": {}, "marks": {}})
    left = list((tmp_path / "s" / "aside").glob("*.json"))
    assert not left and store.versions() == [1, 2]


def test_parts_that_do_not_change_keep_their_files(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    first = store.begin().write("a", numbers(spark, *range(12)), "part").commit()
    second = store.begin().replace_parts("a", numbers(spark, 1, 101), "part").commit()
    assert first.parts("a") == second.parts("a") == ["0", "1", "2", "3"]
    assert [first.folders("a", [p]) == second.folders("a", [p]) for p in "0123"] == [True, False, True, True]
    assert ids(second.read("a")) == [0, 1, 2, 3, 4, 6, 7, 8, 10, 11, 101] and ids(second.read("a", ["1"])) == [1, 101]
    third = store.begin().append("a", numbers(spark, 201), "part").commit()
    assert len(third.folders("a", ["1"])) == 2
    small = snapshots.compacted(store, "a", "part")
    assert len(small.folders("a")) == 4 and ids(small.read("a")) == ids(third.read("a"))
    store.begin().write("b", numbers(spark, 7)).commit()
    whole = snapshots.compacted(store, "b")
    assert ids(whole.read("b")) == [7]
    assert store.expire(1) > 0 and store.versions() == [whole.version]
    assert ids(store.latest().read("a")) == ids(third.schema("a") and small.read("a")) and store.expire(1) == 0


def test_a_delete_keeps_the_files_it_does_not_touch(spark, t, tmp_path):  # noqa: F811
    store = Snapshots(spark, f"file://{tmp_path}/s")
    names = ("works", "versions", "source_titles", "version_chapters", "source_chapters")
    linked = t["source_chapters"].withColumn("version_chapter_id", F.lit("vc1"))
    tables = {n: t[n] for n in names} | {"source_chapters": linked}
    tx = store.begin()
    for n in names:
        # rows of work "other" lie in files of their own
        far = tables[n].limit(1).select(*(F.lit("far").alias(f.name) if f.name == "id" or (n, f.name) in {(c, k) for c, k, *_ in schema.FOREIGN_KEYS} else F.col(f.name) for f in tables[n].schema))
        tx.write(n, tables[n]).append(n, far)
    first = tx.commit()
    tx = store.begin()
    snapshots.delete_rows(tx, "works", F.col("id") == "w1", names)
    after = tx.commit()
    want = schema.delete_rows({n: first.read(n) for n in names}, "works", F.col("id") == "w1")
    for n in names:
        assert sorted(map(str, after.read(n).collect())) == sorted(map(str, want[n].collect())), n
        assert "far" in ids(after.read(n))
        far = {r[0] for r in first.read(n).where("id = 'far'").select(F.input_file_name()).collect()}
        assert far <= set(after.read(n).inputFiles()), n
    # an older version is as it was, and a delete of nothing writes nothing
    assert ids(first.read("works")) == ids(store.at(1).read("works")) and "w1" in ids(store.at(1).read("works"))
    tx = store.begin()
    snapshots.delete_rows(tx, "works", F.col("id") == "none", names)
    assert tx.tables == after.tables


def test_empty_tables(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    done = store.begin().write("a", numbers(spark, 1).where("false"), "part").write("b", numbers(spark, 1).where("false")).commit()
    assert done.read("a").count() == done.read("b").count() == 0 and done.read("a").columns == ["id", "part"]
    assert store.begin().replace_parts("a", numbers(spark, 3), "part").commit().read("a").count() == 1


# -- incremental resolution ---------------------------------------------------------------


def many_claims(spark, n=400):
    rng = random.Random(4)
    fields = ("title", "status", "tags", "synopsis")
    rows = [{"id": f"c{k:04d}", "source_title_id": f"s{rng.randint(1, 40)}", "field_name": rng.choice(fields), "raw_value": rng.choice(["x", "y", "", "z"]), "normalised_value": rng.choice([None, "", "n"]), "claim_hash": str(k), "confidence": rng.choice([0.2, 0.5, 0.9]), "created_at": rng.choice([None, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)])} for k in range(n)]
    titles = [{"id": f"s{k}", "version_id": f"v{k % 30}" if k % 8 else None, "source_site": "a", "source_id": str(k), "source_url": "u"} for k in range(1, 41)]
    versions = [{"id": f"v{k}", "work_id": f"w{k % 20}", "slug": str(k), "language": "en", "version_type": "fan"} for k in range(30)]
    works = [{"id": f"w{k}", "slug": f"w{k}", "title": f"Old {k}"} for k in range(20)]
    return {n: table(spark, n, r) for n, r in (("metadata_claims", rows), ("source_titles", titles), ("versions", versions), ("works", works))}


def told(df):
    return {(r["work_id"], r["field_name"]): (r["value"], r["id"]) for r in df.collect()}


def test_batches_give_what_all_at_once_gives(spark, tmp_path):
    t = many_claims(spark)  # noqa: F811
    store, claims = Snapshots(spark, f"file://{tmp_path}/s"), t["metadata_claims"]
    number = F.substring("id", 2, 4).cast("int")
    for k in (2, 0, 1, 0):
        snap, changed = incremental.apply_claims(store, claims.where(number % 3 == k), t["source_titles"], t["versions"], parts=8)
    assert changed.count() == 0  # the batch that came again
    state = snap.read(incremental.STATE)
    owned = resolve._claims_of_works(claims, t["source_titles"], t["versions"])
    assert told(state) == told(resolve.winning_claims(owned, ["work_id"]))
    works, flagged = resolve.resolve_metadata(t["works"], claims, t["source_titles"], t["versions"], at())
    assert sorted(works.collect()) == sorted(incremental.resolved_works(t["works"], state, at()).collect())
    assert {r["id"] for r in flagged.where("is_resolved").collect()} == {r["id"] for r in incremental.resolved_flags(claims, state).where("is_resolved").collect()}


def test_a_batch_writes_the_parts_it_changes(spark, tmp_path):
    t = many_claims(spark)  # noqa: F811
    store = Snapshots(spark, f"file://{tmp_path}/s")
    first, _ = incremental.apply_claims(store, t["metadata_claims"], t["source_titles"], t["versions"], parts=8)
    better = table(spark, "metadata_claims", [{"id": "new", "source_title_id": "s1", "field_name": "title", "raw_value": "Won", "claim_hash": "h", "confidence": 1.0}])
    second, changed = incremental.apply_claims(store, better, t["source_titles"], t["versions"], parts=8)
    assert [(r["work_id"], r["value"]) for r in changed.collect()] == [("w1", "Won")]
    same = [first.folders(incremental.STATE, [p]) == second.folders(incremental.STATE, [p]) for p in first.parts(incremental.STATE)]
    assert same.count(False) == 1 and len(same) > 3
    worse = better.withColumns({"confidence": F.lit(0.1), "id": F.lit("worse")})
    third, changed = incremental.apply_claims(store, worse, t["source_titles"], t["versions"], parts=8)
    assert changed.count() == 0 and third.folders(incremental.STATE) == second.folders(incremental.STATE)
    # the winner is taken back: its work alone is resolved again
    back = incremental.refresh(store, spark.createDataFrame([("w1",)], "work_id string"), t["metadata_claims"], t["source_titles"], t["versions"], parts=8)
    assert told(back.read(incremental.STATE)) == told(first.read(incremental.STATE))
    moved = t["source_titles"].withColumn("version_id", F.when(F.col("version_id") == "v1", "v2").otherwise(F.col("version_id")))
    again = incremental.refresh(store, spark.createDataFrame([("w1",), ("w2",)], "work_id string"), t["metadata_claims"], moved, t["versions"], parts=8)
    want = resolve.winning_claims(resolve._claims_of_works(t["metadata_claims"], moved, t["versions"]), ["work_id"])
    assert told(again.read(incremental.STATE)) == told(want)


# -- streams ----------------------------------------------------------------------------

EVENTS = "ts timestamp, user_id long, event_type string, value double"
DAY = dt.datetime(2024, 1, 1)


def written(spark, path, rows):
    spark.createDataFrame([(DAY + dt.timedelta(minutes=m), u, "view", 1.0) for m, u in rows], EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_a_batch_that_comes_again_is_not_committed_again(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/s")
    write = streams.commit_unseen(store, "claims", "stream", ("k",), parts=4)
    batch = spark.createDataFrame([(k % 10,) for k in range(30)], "k long")
    write(batch, 0)
    write(batch, 0)  # the stream died after the commit, before it noted it
    assert store.latest().version == 1 and store.latest().read("claims").count() == 10
    write(spark.createDataFrame([(k,) for k in range(5, 15)], "k long"), 1)
    assert sorted(r["k"] for r in store.latest().read("claims").collect()) == list(range(15)) and store.latest().marks == {"stream": 1}
    streams.commit_unseen(store, "claims", "other", ("k",), parts=4)(batch, 0)
    assert store.latest().read("claims").count() == 15


def test_state_removes_repeats_over_batches_and_a_restart(spark, tmp_path):
    source, store = f"{tmp_path}/in", Snapshots(spark, f"file://{tmp_path}/s")
    keys = ("user_id", "event_type")
    run = lambda: streams.stream_claims_once(spark, source, spark.createDataFrame([], EVENTS).schema, store, "claims", f"{tmp_path}/cp", lambda e: e.select(*keys), keys, "s", files=1)
    for rows in ([(0, 1), (1, 1), (2, 2)], [(3, 2), (4, 3)]):
        written(spark, source, rows)
    q = run()
    q.awaitTermination()
    assert any("rocksdb" in name for p in q.recentProgress for s in p["stateOperators"] for name in map(str.lower, s["customMetrics"]))
    written(spark, source, [(5, 1), (6, 4)])
    q = run()
    q.awaitTermination()
    dropped = sum(s["customMetrics"].get("numDroppedDuplicateRows", 0) for p in q.recentProgress for s in p["stateOperators"])
    assert dropped == 1  # known from before the restart
    assert sorted(r["user_id"] for r in store.latest().read("claims").collect()) == [1, 2, 3, 4]


def test_late_rows_within_the_watermark_count_and_others_do_not(spark, tmp_path):
    source = f"{tmp_path}/in"
    # lateness is measured by the batches before the last: at the fourth the watermark is 80, the end of 65's windows is behind it, of 15's before; the last batch closes the windows
    for rows in ([(10, 1), (70, 1)], [(180, 1)], [(181, 1)], [(65, 1), (15, 1), (185, 1)], [(900, 1)]):
        written(spark, source, rows)
    schema = spark.createDataFrame([], EVENTS).schema
    streams.run_windows(spark, source, schema, lambda e: streams.sliding_counts(e, "1 hour", "30 minutes", "100 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r["window"]["start"] - DAY).total_seconds() / 60: r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {-30: 1, 0: 1, 30: 2, 60: 2, 150: 3, 180: 3}


def sessions(batches, gap, late):
    """What append mode gives: rows behind the watermark of the batch before are dropped, sessions behind the present one are given out."""
    open_, out, seen, past, now = {}, [], None, None, None
    for batch in [*batches, []]:
        past, now = now, None if seen is None else seen - late
        for m, u in batch:
            if past is not None and m + gap <= past:
                continue
            mine = [(a, b, n) for a, b, n in open_.get(u, []) if a <= m + gap and m <= b]
            rest = [s for s in open_.get(u, []) if s not in mine]
            open_[u] = [*rest, (min([m, *(a for a, _, _ in mine)]), max([m + gap, *(b for _, b, _ in mine)]), 1 + sum(n for _, _, n in mine))]
        for u in open_:
            out += [(u, a, b, n) for a, b, n in open_[u] if now is not None and b <= now]
            open_[u] = [s for s in open_[u] if now is None or s[1] > now]
        seen = max([m for m, _ in batch] + ([] if seen is None else [seen]), default=None)
    return sorted(out)


def test_sessions(spark, tmp_path):
    rng, source = random.Random(9), f"{tmp_path}/in"
    batches = [[(300 * b + rng.randint(0, 299) - rng.choice([0, 0, 0, 300, 900]), rng.randint(1, 4)) for _ in range(40)] for b in range(5)] + [[(5000, 9)]]
    for rows in batches:
        written(spark, source, rows)
    schema = spark.createDataFrame([], EVENTS).schema
    streams.run_windows(spark, source, schema, lambda e: streams.session_counts(e, "25 minutes", "150 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    minutes = lambda x: (x - DAY).total_seconds() / 60
    got = sorted((r["user_id"], minutes(r["session_window"]["start"]), minutes(r["session_window"]["end"]), r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sessions(batches, 25, 150) and len(got) > 10
    assert sum(r[3] for r in got) < 200  # some were too late


# -- jobs in transactions ---------------------------------------------------------------


def test_a_job_runs_again_after_a_conflict(spark, t, tmp_path):  # noqa: F811
    store = Snapshots(spark, f"file://{tmp_path}/s")
    jobs.commit(t, store)
    runs = []

    def add(name):
        row = table(spark, "works", [{"id": name, "slug": name}])
        return lambda tables: tables | {"works": tables["works"].unionByName(row)}

    def slow(tables):
        runs.append(store.latest().version)
        if len(runs) == 1:
            jobs.transact(store, add("other"))
        return add("slow")(tables)

    done = jobs.transact(store, slow)
    assert runs == [1, 2] and done.version == 3 and {"other", "slow"} < set(ids(done.read("works")))
    # what a job does not touch keeps its files
    assert done.folders("versions") == store.at(1).folders("versions")
    with pytest.raises(Conflict):
        jobs.transact(store, lambda tables: (jobs.transact(store, add("x")), add("y")(tables))[1], tries=1)


def test_a_failed_job_changes_nothing(spark, t, tmp_path):  # noqa: F811
    store = Snapshots(spark, f"file://{tmp_path}/s")
    jobs.commit(t, store)
    with pytest.raises(Exception):
        jobs.transact(store, lambda tables: tables | {"works": tables["works"].limit(0), "versions": tables["versions"].withColumn("id", F.raise_error(F.lit("midway")))})
    assert store.latest().version == 1 and ids(store.latest().read("works")) == ["w1", "w2", "w3"]
    done = jobs.transact(store, lambda tables: resolve.resolve_all(tables, at()))
    assert {r["id"]: r["title"] for r in done.read("works").collect()}["w1"] == "High" and done.version == 2
    assert jobs.checkout(Snapshots(spark, f"file://{tmp_path}/new").latest())["works"].count() == 0


def test_a_periodic_trigger_runs_again_and_again(spark, tmp_path):
    source, store = f"{tmp_path}/in", Snapshots(spark, f"file://{tmp_path}/s")
    keys = ("user_id", "event_type")
    written(spark, source, [(0, 1)])
    q = streams.stream_claims_once(spark, source, spark.createDataFrame([], EVENTS).schema, store, "claims", f"{tmp_path}/cp", lambda e: e.select(*keys), keys, "periodic", trigger={"processingTime": "1 second"})
    try:
        for more in ([(1, 2), (2, 1)], [(3, 3), (4, 2)]):
            q.processAllAvailable()
            written(spark, source, more)
        q.processAllAvailable()
    finally:
        q.stop()
    assert len({p["batchId"] for p in q.recentProgress if p["numInputRows"]}) == 3
    assert sorted(r["user_id"] for r in store.latest().read("claims").collect()) == [1, 2, 3]


def test_claims_travel_once_to_their_source(spark, sf):
    """With shuffled joins throughout: claims meet titles that know their work, are ranked once, and are not joined back to themselves."""
    from libretto.queries import QUERIES

    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        moves = {q: QUERIES[q](spark, sf)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for q in ("resolve_works", "resolved_claims", "route_resolve")}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert moves["resolved_claims"] <= 9 and moves["route_resolve"] <= 9 and moves["resolve_works"] <= 24, moves


def test_batches_share_the_owners_of_sources(spark, sf):
    """Titles and versions meet once for all batches, and the state is the same."""
    from libretto.fixtures import domain
    from libretto.operators.resolve import owners
    from libretto.plans.store import fresh, stored

    t = domain(spark, sf, "metadata_claims", "source_titles", "versions")
    told = []
    for known in (None, stored(owners(t["source_titles"], t["versions"]), "owners")):
        store = Snapshots(spark, fresh(spark, "shared-owners"))
        for k in (0, 1):
            done, _ = incremental.apply_claims(store, t["metadata_claims"].where(f"length(id) % 2 = {k}"), t["source_titles"], t["versions"], parts=4, known=known)
        told.append(sorted(done.read(incremental.STATE).select("work_id", "field_name", "value", "id").collect()))
    assert told[0] == told[1] and told[0]
