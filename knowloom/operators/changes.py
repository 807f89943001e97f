"""Change capture: discovered objects -> objects, versions, sync runs, audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowloom.functions.hashing import stable_id
from knowloom.functions.skew import hot_join, top_k
from knowloom.sources.sinks import absent, delete_where_in, upsert


def new_objects(objects: DataFrame, discovered: DataFrame) -> DataFrame:
    """Objects of the listing that are not known yet; identity is (source_id, external_id)."""
    listed = discovered.select("source_id", "external_id", "object_type").withColumn(
        "object_id", stable_id("object", F.col("source_id"), F.col("external_id"))
    )
    return absent(objects, listed, ["source_id", "external_id"])


def removed_objects(objects: DataFrame, discovered: DataFrame) -> DataFrame:
    """Known objects of the listed sources that the listing no longer contains (tombstones)."""
    in_scope = objects.join(discovered.select("source_id").distinct(), "source_id", "left_semi")
    return in_scope.join(discovered, ["source_id", "external_id"], "left_anti")


def latest_versions(versions: DataFrame) -> DataFrame:
    """Latest content hash per (object_id, pipeline_version); ties go to the larger version id."""
    last = F.max_by(F.struct("content_hash", "version_id", "observed_at"), F.struct("observed_at", "version_id"))
    return versions.groupBy("object_id", "pipeline_version").agg(last.alias("_l")).select(
        "object_id", "pipeline_version", F.col("_l.version_id").alias("version_id"),
        F.col("_l.content_hash").alias("latest_hash"), F.col("_l.observed_at").alias("latest_at"),
    )


def changed_versions(versions: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of ``listed(object_id, pipeline_version, content_hash, ...)`` that need a new version.

    A hash already stored for the object (also an older one) creates no row.
    """
    latest = latest_versions(versions).select("object_id", "pipeline_version", "latest_hash")
    moved = listed.join(latest, ["object_id", "pipeline_version"], "left").filter(
        ~F.col("content_hash").eqNullSafe(F.col("latest_hash"))
    )
    return absent(versions, moved.drop("latest_hash"), ["object_id", "content_hash", "pipeline_version"])


def change_points(observations: DataFrame) -> DataFrame:
    """First sighting of every (object, hash): the versions a replay of all observations stores.

    Each row also tells how often the same content was seen again.
    """
    return observations.groupBy("object_id", "content_hash").agg(
        F.min_by("version_id", F.struct("observed_at", "version_id")).alias("version_id"),
        F.min("observed_at").alias("observed_at"),
        F.count(F.lit(1)).alias("sightings"),
    )


def sync_summary(outcomes: DataFrame, max_errors: int = 5) -> DataFrame:
    """Counts and status per run from ``outcomes(run_id, seq, external_id, error)``."""
    totals = outcomes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("objects_discovered"),
        F.count_if(F.col("error").isNull()).alias("objects_processed"),
        F.count_if(F.col("error").isNotNull()).alias("objects_failed"),
    )
    first = top_k(outcomes.filter("error is not null"), ["run_id"], [F.col("seq")], max_errors)
    messages = first.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "rank", F.concat_ws(": ", F.col("external_id").cast("string"), F.col("error")).alias("m")
        ))).alias("_e")
    ).select("run_id", F.array_join(F.transform("_e", lambda x: x["m"]), "; ").alias("error_summary"))
    status = (
        F.when((F.col("objects_failed") > 0) & (F.col("objects_processed") > 0), "partial")
        .when(F.col("objects_failed") > 0, "failed")
        .otherwise("completed")
    )
    return totals.join(messages, "run_id", "left").withColumn("status", status)


def sync_audit(summary: DataFrame) -> DataFrame:
    """Audit row per finished run."""
    ok = F.col("status").isin("completed", "partial")
    return summary.select(
        stable_id("audit", F.col("run_id"), "sync").alias("audit_id"),
        F.when(ok, "sync_completed").otherwise("sync_failed").alias("action"),
        F.lit("sync_run").alias("object_type"),
        F.col("run_id").cast("string").alias("object_id"),
        F.to_json(F.struct("objects_discovered", "objects_processed", "objects_failed")).alias("metadata"),
    )


def accepted_run_requests(requests: DataFrame, history: DataFrame, sources: DataFrame) -> DataFrame:
    """Requests that start a run: enabled source, and an idempotency key not used before.

    Requests without a key always start one; the earliest request of a repeated key wins.
    """
    enabled = sources.filter("enabled").select("source_id")
    live = requests.join(enabled, "source_id", "left_semi")
    keyed = live.filter("idempotency_key is not null")
    first = keyed.groupBy("source_id", "idempotency_key").agg(
        F.min_by(F.struct(*[F.col(c) for c in requests.columns]), F.struct("requested_at", "request_id")).alias("_r")
    ).select("_r.*")
    used = history.filter("idempotency_key is not null").select("source_id", "idempotency_key").distinct()
    fresh = first.join(used, ["source_id", "idempotency_key"], "left_anti")
    return live.filter("idempotency_key is null").unionByName(fresh)


def remove_sources(tables: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """Cascade over every table that carries ``source_id``; canonical tables are not passed in."""
    return {name: delete_where_in(t, removed, ["source_id"]) for name, t in tables.items()}


def removal_impact(removed: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per removed source and table, counted in one aggregation over the tagged tables."""
    tagged = None
    for name, t in tables.items():
        part = t.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy("source_id").pivot("table", list(tables)).agg(F.sum("n"))
    filled = removed.select("source_id").distinct().join(counts, "source_id", "left")
    return filled.na.fill(0, list(tables))


def pending_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    return runs.filter(F.col("status") == "pending").orderBy("run_id").limit(limit)


def run_history(runs: DataFrame, source_id=None, cursor=None, limit: int = 20) -> DataFrame:
    """Newest first; without ``source_id`` the newest ``limit`` runs of every source."""
    if cursor is not None:
        runs = runs.filter(F.col("run_id") < F.lit(cursor))
    if source_id is not None:
        return runs.filter(F.col("source_id") == F.lit(source_id)).orderBy(F.desc("run_id")).limit(limit)
    return top_k(runs, ["source_id"], [F.desc("run_id")], limit)


def sync(objects: DataFrame, versions: DataFrame, listing: DataFrame, pipeline_version: str = "v1", incremental: bool = True) -> dict[str, DataFrame]:
    """One run over complete listings: every table that it leaves.

    ``listing(run_id, source_id, external_id, object_type, content_hash, version_id, observed_at, seq, error)``: one row per
    object found, ``error`` for those that could not be read. An incremental run leaves an object whose latest hash is
    the listed one alone; a full run compares with every stored hash, which keeps the same versions. Rows with an error
    count as failed and store nothing. Returns the new snapshots of ``objects`` and ``versions``, the ``created``
    versions, the ``removed`` objects (known ones of the listed sources that are not found), the run ``summary`` and its ``audit``.
    """
    found = listing.filter("error is null")
    known = objects.unionByName(new_objects(objects, found), allowMissingColumns=True)
    ids = known.select("source_id", "external_id", "object_id")
    listed = hot_join(found, ids, ["source_id", "external_id"]).select(
        "object_id", F.lit(pipeline_version).alias("pipeline_version"), "content_hash", "version_id", "observed_at")
    # A content that is listed more than once for an object is stored at its first place.
    first = listed.groupBy("object_id", "pipeline_version", "content_hash").agg(
        F.min_by(F.struct("version_id", "observed_at"), F.struct("observed_at", "version_id")).alias("_v")
    ).select("object_id", "pipeline_version", "content_hash", "_v.version_id", "_v.observed_at")
    created = changed_versions(versions, first) if incremental else absent(versions, first, ["object_id", "content_hash", "pipeline_version"])
    summary = sync_summary(listing.select("run_id", "seq", "external_id", "error"))
    return {
        "objects": known, "versions": versions.unionByName(created.select(*versions.columns)), "created": created,
        "removed": removed_objects(objects, listing), "summary": summary, "audit": sync_audit(summary)}


def upsert_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["source_id"], keep=("created_at",))


def list_sources(sources: DataFrame, limit: int = 50, cursor=None) -> DataFrame:
    """Sources of every owner by id, ``limit`` per owner, after an optional cursor."""
    if cursor is not None:
        sources = sources.filter(F.col("source_id") > F.lit(cursor))
    return top_k(sources, ["owner_id"], [F.col("source_id")], limit)


def version_context(versions: DataFrame, objects: DataFrame, sources: DataFrame) -> DataFrame:
    """versions with their object's external id and their source's owner and configuration.

    Sources may be many: both sides are shuffled once, and adaptive execution splits the partition of a large source.
    """
    o = objects.select("object_id", "source_id", "external_id")
    s = sources.select("source_id", "owner_id", "configuration")
    return hot_join(versions.join(o.hint("merge"), "object_id"), s.hint("merge"), ["source_id"])
