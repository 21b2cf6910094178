"""Resolution that is kept up to date: the winning claim and cover of every work, as claims come in.

The state holds the winner of each (work, field) and is cut into parts by a hash of
the work. A batch of claims is reduced to its own winners, met with the parts it falls
in, and only those parts are written again, in a new version of the snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from libretto.functions.text import truthy
from libretto.operators.resolve import WORK_FIELDS, owners

from .snapshots import Snapshot, Snapshots, Transaction
from .store import stored

STATE = "resolved"
#: Parts of the state: as many as there may be, for 100 million works some 100 000 in each.
PARTS = 1024
#: What makes one claim better than another: confidence, then the later one, then the smaller id.
ORDER = ("confidence", "created_at", "id")


def part_of(work: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(work), F.lit(parts)).cast("int")


def winners(owned: DataFrame) -> DataFrame:
    """Of each (work_id, field_name) the best (value, confidence, created_at, id): one pass with map-side combine."""
    best = F.min_by(F.struct("value", *ORDER), F.struct(-F.col("confidence"), F.coalesce(-F.unix_micros("created_at"), F.lit(2**63 - 1)), "id"))
    return owned.groupBy("work_id", "field_name").agg(best.alias("b")).select("work_id", "field_name", "b.*")


def owned_claims(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Claims with the work they are about, by the ``owners`` known."""
    value = F.coalesce(truthy("normalised_value"), F.col("raw_value"))
    return claims.join(known, "source_title_id").select("work_id", "field_name", value.alias("value"), "confidence", F.col("created_at").cast("timestamp").alias("created_at"), "id")


def apply_claims(store: Snapshots, claims: DataFrame, source_titles: DataFrame, versions: DataFrame, parts: int = PARTS, tx: Transaction | None = None, known: DataFrame | None = None) -> tuple[Snapshot, DataFrame]:
    """Take a batch of claims into the state. Returns the new version and what changed: (work_id, field_name, value, id).

    The state is what resolving all claims so far at once would give, in whatever
    batches they came; a batch that comes again changes nothing. Claims without a work
    yet are left out: ``refresh`` their work once they are linked. Many batches over the
    same titles and versions may share ``known``, their stored ``owners``.
    """
    tx = tx or store.begin()
    known = owners(source_titles, versions) if known is None else known
    new = stored(winners(owned_claims(claims, known)).withColumn("part", part_of(F.col("work_id"), parts)), "batch-winners")
    if STATE not in tx.base.tables:
        tx.write(STATE, new, "part")
        return tx.commit(), new.select("work_id", "field_name", "value", "id")
    touched = [str(r["part"]) for r in new.select("part").distinct().collect()]  # at most as many as there are parts
    old = tx.base.read(STATE, touched)
    merged = stored(winners(old.unionByName(new)).withColumn("part", part_of(F.col("work_id"), parts)), "merged")
    before = old.select("work_id", "field_name", F.col("id").alias("was"))
    changed = merged.join(before, ["work_id", "field_name"], "left").where(~F.col("id").eqNullSafe(F.col("was"))).select("work_id", "field_name", "value", "id")
    # a part in which nothing wins anew keeps its files
    moved = stored(changed.select(part_of(F.col("work_id"), parts).alias("part")).distinct(), "moved-parts")
    tx.replace_parts(STATE, merged.join(F.broadcast(moved), "part", "left_semi").select(*new.columns), "part")
    return tx.commit(), changed


def refresh(store: Snapshots, works: DataFrame, claims: DataFrame, source_titles: DataFrame, versions: DataFrame, parts: int = PARTS) -> Snapshot:
    """Resolve some works (work_id) anew from all their claims: after sources were linked to another work, or claims were taken back."""
    tx = store.begin()
    own = works.select("work_id").distinct()
    titles = source_titles.join(versions.join(own, "work_id", "left_semi").select(F.col("id").alias("version_id")), "version_id", "left_semi")
    again = winners(owned_claims(claims, owners(titles, versions))).withColumn("part", part_of(F.col("work_id"), parts))
    touched = [str(r["part"]) for r in own.select(part_of(F.col("work_id"), parts).alias("part")).distinct().collect()]
    kept = tx.base.read(STATE, touched).join(own, "work_id", "left_anti")
    merged = stored(kept.unionByName(again), "refreshed")
    for p in touched:
        tx.tables[STATE]["parts"].pop(p, None)  # a part may be left with no row
    tx.replace_parts(STATE, merged, "part")
    return tx.commit()


def resolved_works(works: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """Works with the winning values of the state; those without a claim on their fields stay as they are."""
    told = state.where(F.col("field_name").isin(*WORK_FIELDS))
    chosen = [F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f"__{f}") for f in WORK_FIELDS]
    wide = told.groupBy(F.col("work_id").alias("__w")).agg(*chosen)
    joined = works.join(wide, works["id"] == F.col("__w"), "left")
    new = {c: F.coalesce(truthy(F.col(f"__{f}")), F.col(c)) for f, c in WORK_FIELDS.items()}
    new["updated_at"] = F.when(F.col("__w").isNotNull(), as_of).otherwise(F.col("updated_at"))
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in works.columns))


def resolved_flags(claims: DataFrame, state: DataFrame) -> DataFrame:
    """Claims with ``is_resolved`` as the state has it: false for claims without a work."""
    won = state.select(F.col("id").alias("__won"))
    joined = claims.join(won, F.col("id") == F.col("__won"), "left")
    return joined.select(*(F.col("__won").isNotNull().alias(c) if c == "is_resolved" else F.col(c) for c in claims.columns))
