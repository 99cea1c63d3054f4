"""Change data: scan differences, synchronisation, cascading deletes, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Outcomes of synchronising a record, in order of precedence.
OUTCOMES = ("created", "stale", "conflict", "deleted", "updated", "metadata_updated", "unchanged")


def scan_difference(known: DataFrame, found: DataFrame) -> DataFrame:
    """``path_hash, change`` of a directory scan against the registry.

    ``known(path_hash, content_hash, exists_status)``, ``found(path_hash, content_hash)``.
    """
    k = known.select("path_hash", F.col("content_hash").alias("old"), "exists_status")
    f = found.select("path_hash", F.col("content_hash").alias("new"))
    both = k.join(f, "path_hash", "full_outer")
    change = (
        F.when(F.col("exists_status").isNull(), "new")
        .when(F.col("new").isNull() & (F.col("exists_status") == "active"), "deleted")
        .when(F.col("new").isNull(), "gone")
        .when(F.col("exists_status") == "deleted", "restored")
        .when(F.col("old") != F.col("new"), "changed")
        .otherwise("unchanged")
    )
    return both.select("path_hash", change.alias("change")).filter("change != 'gone'")


def classify(joined: DataFrame) -> Column:
    """The outcome of an incoming record (``in_*``) beside the stored row (``old_*``, null if none)."""
    live = F.col("old_exists") == "active"
    same = F.col("in_hash") == F.col("old_hash")
    revised = F.col("in_revision").eqNullSafe(F.col("old_revision"))
    first = F.when(F.col("in_deleted"), "unchanged").otherwise("created")
    meta = (
        ~F.col("in_updated_at").eqNullSafe(F.col("old_updated_at"))
        | ~revised
        | ~F.col("in_metadata").eqNullSafe(F.col("old_metadata"))
    )
    return (
        F.when(F.col("old_exists").isNull(), first)
        .when(F.col("in_updated_at") < F.col("old_updated_at"), "stale")
        .when(~F.col("in_deleted") & live & revised & ~same, "conflict")
        .when(F.col("in_deleted"), F.when(live, "deleted").when(meta, "metadata_updated").otherwise("unchanged"))
        .when(~live | ~same, "updated")
        .when(meta, "metadata_updated")
        .otherwise("unchanged")
    )


def canonical(content: Column) -> Column:
    """Line ends as LF, one at the end."""
    return F.concat(F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), r"\n+$", ""), F.lit("\n"))


STATE = "source_uri string, revision string, updated_at timestamp, content_hash string, metadata string, exists_status string"


def synchronise(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new state, and the batch's outcomes ``source_uri, outcome``.

    A batch names each ``source_uri`` once; raises otherwise.
    """
    if not batch.groupBy("source_uri").count().filter("count > 1").isEmpty():
        raise ValueError("a batch names each source once")
    incoming = batch.select(
        "source_uri", F.col("revision").alias("in_revision"), F.col("updated_at").alias("in_updated_at"), F.col("metadata").alias("in_metadata"),
        F.coalesce("deleted", F.lit(False)).alias("in_deleted"), F.sha2(canonical(F.coalesce("content", F.lit(""))), 256).alias("in_hash"),
    )
    stored = state.select(
        "source_uri", F.col("revision").alias("old_revision"), F.col("updated_at").alias("old_updated_at"), F.col("metadata").alias("old_metadata"),
        F.col("content_hash").alias("old_hash"), F.col("exists_status").alias("old_exists"),
    )
    joined = incoming.join(stored, "source_uri", "full_outer")
    told = joined.withColumn("outcome", F.when(F.col("in_deleted").isNotNull(), classify(joined)))
    take = F.col("outcome").isin("created", "updated", "metadata_updated", "deleted")
    pick = lambda new, old: F.when(take, F.col(new)).otherwise(F.col(old))
    after = told.filter(take | F.col("old_exists").isNotNull()).select(
        "source_uri",
        pick("in_revision", "old_revision").alias("revision"),
        pick("in_updated_at", "old_updated_at").alias("updated_at"),
        F.when(take & ~F.col("in_deleted"), F.col("in_hash")).otherwise(F.col("old_hash")).alias("content_hash"),
        pick("in_metadata", "old_metadata").alias("metadata"),
        F.when(take, F.when(F.col("in_deleted"), "deleted").otherwise("active")).otherwise(F.col("old_exists")).alias("exists_status"),
    )
    return after, told.filter("outcome IS NOT NULL").select("source_uri", "outcome")


def tombstone_time(previous: Column, now: Column) -> Column:
    """A delete's time: now, but later than what it deletes."""
    return F.greatest(now, previous + F.expr("INTERVAL '0.000001' SECOND"))


def latest_state(log: DataFrame, key: str, time: str, tie: str, deleted: Column) -> DataFrame:
    """Per key the newest change of a whole log and whether it leaves the key live; one partial aggregate."""
    last = F.max(F.struct(F.col(time).alias("at"), F.col(tie).alias("tie"), deleted.alias("deleted")))
    return log.groupBy(key).agg(last.alias("m"), F.count("*").alias("changes")).select(
        key, F.col("m.at").alias("updated_at"), F.col("m.tie").alias("revision"), F.when(F.col("m.deleted"), "deleted").otherwise("active").alias("exists_status"), "changes"
    )


def arrival_outcomes(log: DataFrame, key: str, arrival: str, time: str) -> DataFrame:
    """How a log plays out record by record: later ones with an older time than any before are stale."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    high = F.max(time).over(before)
    return log.withColumn("outcome", F.when(high.isNull(), "created").when(F.col(time) < high, "stale").otherwise("updated"))


def managed_path(kind: Column, name: Column, identity: Column) -> Column:
    stem = F.substring(F.regexp_replace(F.lower(name), r"[^a-z0-9_-]+", "-"), 1, 80)
    return F.concat(F.lit("_managed/"), kind, F.lit("/"), stem, F.lit("-"), F.substring(F.sha2(identity, 256), 1, 12), F.lit(".md"))


def import_name(stem: Column, identity: Column) -> Column:
    return F.concat(stem, F.lit("-"), F.substring(F.sha2(identity, 256), 1, 10), F.lit(".md"))


def delete_sources(bindings: DataFrame, gone: DataFrame) -> DataFrame:
    """Bindings without those of deleted sources; what they supported alone vanishes on aggregation."""
    return bindings.join(gone.select("source_id"), "source_id", "left_anti")


def sources_of_node_only(bindings: DataFrame, node_id: str) -> DataFrame:
    """Sources that bind this node and no other: they go with it."""
    return bindings.groupBy("source_id").agg(F.count_distinct("node_id").alias("n"), F.bool_or(F.col("node_id") == node_id).alias("bound")).filter("bound AND n = 1").select("source_id")


def expired(bin_rows: DataFrame, now: Column, force: bool = False) -> DataFrame:
    return bin_rows if force else bin_rows.filter(F.col("expires_at") <= now)


def integrity_violations(sources: DataFrame, bindings: DataFrame) -> DataFrame:
    """``source_id, violation``: bindings without source, or of another content than the source has."""
    s = sources.select("source_id", F.col("content_hash").alias("_current"))
    joined = bindings.select("source_id", "content_hash").distinct().join(s, "source_id", "left")
    kind = F.when(F.col("_current").isNull(), "missing_source").when(F.col("_current") != F.col("content_hash"), "hash_mismatch")
    return joined.select("source_id", kind.alias("violation")).filter("violation IS NOT NULL").distinct()


def file_map_upsert(file_map: DataFrame, new: DataFrame) -> DataFrame:
    """``original, markdown`` pairs, each side unique: a new pair takes over both of its ends."""
    kept = file_map.join(new.select("original"), "original", "left_anti").join(new.select("markdown"), "markdown", "left_anti")
    return kept.select("original", "markdown").unionByName(new.select("original", "markdown"))
