"""Summaries of several origins: quality gate, merge, scopes and freshness.

A snapshot table holds one row per (origin, metric): peer_id, environment_id,
instance_id, tenant_id, generated_at_ns, kind, name, value, and for activity
rows bucket_ns. `kind` is total, state, status, accepted or committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftlog import vocab

TOTALS = ["receipts", "revisions", "raw_bytes", "pending", "failed", "delivered", "accepted_total", "committed_total"]


def snapshot_violations(metrics: DataFrame, recent: DataFrame, tenant_id: str, now_ns: int) -> DataFrame:
    """Origins that may not be merged, with the first reason for each.

    `recent`: peer_id, tenant_id, revision_id of the snapshot's recent events.
    """
    known = F.when(F.col("kind") == "total", F.col("name").isin(TOTALS))
    known = known.when(F.col("kind") == "state", F.col("name").isin(vocab.RECEIPT_STATES))
    known = known.when(F.col("kind") == "status", F.col("name").isin(vocab.STATUSES))
    known = known.when(F.col("kind").isin("accepted", "committed"), F.lit(True)).otherwise(False)
    late = F.col("generated_at_ns") > now_ns + vocab.CLOCK_SKEW_SECONDS * 10**9
    per_row = metrics.select(
        "peer_id",
        (~F.col("tenant_id").eqNullSafe(F.lit(tenant_id))).alias("tenant"),
        (F.coalesce("generated_at_ns", F.lit(0)) <= 0).alias("no_time"),
        F.coalesce(late, F.lit(False)).alias("late"),
        (~known).alias("group"),
        (F.col("value") < 0).alias("negative"),
        F.when(F.col("kind") == "accepted", F.col("bucket_ns")).alias("bucket_ns"),
    )
    flags = per_row.groupBy("peer_id").agg(
        F.max("tenant").alias("tenant"), (F.max("no_time") | F.max("late")).alias("time"), F.max("group").alias("group"),
        F.max("negative").alias("negative"), (F.count_distinct("bucket_ns") > vocab.ACTIVITY_BUCKETS).alias("buckets"),
    )
    events = recent.groupBy("peer_id").agg(
        (F.count(F.lit(1)) > vocab.RECENT_LIMIT).alias("many"), F.max(F.col("tenant_id") != tenant_id).alias("foreign")
    )
    reason = (
        F.when(F.col("tenant"), "TENANT_MISMATCH").when(F.col("time"), "TIME_INVALID")
        .when(F.col("buckets") | F.coalesce("many", F.lit(False)), "TOO_MANY_ROWS")
        .when(F.col("negative"), "NEGATIVE_COUNTER").when(F.col("group"), "UNKNOWN_GROUP")
        .when(F.coalesce("foreign", F.lit(False)), "CROSS_TENANT_EVENT")
    )
    return flags.join(events, "peer_id", "left").select("peer_id", reason.alias("reason")).filter("reason IS NOT NULL")


def merge_metrics(metrics: DataFrame, local_peer: str = "local") -> DataFrame:
    """Sum counters over origins; activity only in buckets of the local spine."""
    plain = metrics.filter(~F.col("kind").isin("accepted", "committed"))
    buckets = metrics.filter(F.col("kind").isin("accepted", "committed"))
    spine = buckets.filter(F.col("peer_id") == local_peer).select("bucket_ns").distinct()
    aligned = buckets.join(spine, "bucket_ns", "left_semi").select(plain.columns)
    return plain.unionByName(aligned).groupBy("kind", "name", "bucket_ns").agg(F.sum("value").alias("value"))


def merge_recent(recent: DataFrame) -> DataFrame:
    """Newest events over all origins."""
    return recent.orderBy(F.desc("received_at_ns"), "peer_id", "revision_id").limit(vocab.RECENT_LIMIT)


def scoped_metrics(metrics: DataFrame) -> DataFrame:
    """Sums for every scope at once: all, per environment, per instance.

    NULL environment or instance means "all"; grouping sets expand each row
    before the partial aggregate, so one shuffle of small partial sums serves
    the three levels.
    """
    sets = "GROUPING SETS ((environment_id, instance_id, kind, name), (environment_id, kind, name), (kind, name))"
    view = "siftlog_scoped_metrics"
    metrics.createOrReplaceTempView(view)
    return metrics.sparkSession.sql(
        f"SELECT environment_id, instance_id, kind, name, sum(value) AS value FROM {view} GROUP BY {sets}"
    )


def origin_status(snapshots: DataFrame, now_ns: int) -> DataFrame:
    """Freshness per origin from its last attempts.

    `snapshots`: peer_id, attempted_at_ns, generated_at_ns (NULL when the attempt
    failed), error_code. A failed last attempt keeps the last good snapshot.
    """
    good = F.col("generated_at_ns").isNotNull()
    rows = snapshots.groupBy("peer_id").agg(
        F.max_by(F.struct(good.alias("good"), "error_code"), F.struct("attempted_at_ns", "generated_at_ns")).alias("l"),
        F.max(F.when(good, F.struct("attempted_at_ns", "generated_at_ns"))).alias("g"),
    )
    available = F.col("l.good")
    stale = F.when(available, F.lit(now_ns) - F.col("g.generated_at_ns") > vocab.STALE_AFTER_SECONDS * 10**9).otherwise(True)
    return rows.select(
        "peer_id", available.alias("available"), stale.alias("stale"), (~available & F.col("g").isNotNull()).alias("retained"),
        F.col("g.generated_at_ns").alias("generated_at_ns"), F.col("g.attempted_at_ns").alias("last_seen_at_ns"),
        F.when(~available, F.col("l.error_code")).alias("error_code"),
    )
