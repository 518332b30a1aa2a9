"""Retention, holds, reference integrity, snapshots and audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlog import vocab

DAY_NS = 86_400_000_000_000
HOUR_US = 3_600_000_000
RAW_FILE = r"^[0-9]{4}/[0-9]{2}/[0-9]{2}/[A-Za-z0-9-]+\.bin$"


def hold_states(holds: DataFrame, now_ns: int) -> DataFrame:
    state = (
        F.when(F.col("released_at_ns").isNotNull(), "released")
        .when(F.col("expires_at_ns") <= now_ns, "expired")
        .otherwise("open")
    )
    return holds.withColumn("hold_state", state)


def active_holds(holds: DataFrame, now_ns: int) -> DataFrame:
    return hold_states(holds, now_ns).filter("hold_state = 'open'")


def hold_violations(holds: DataFrame, receipts: DataFrame) -> DataFrame:
    """Holds with missing text, a wrong expiry, or a receipt of another tenant."""
    owner = receipts.select("receipt_id", F.col("tenant_id").alias("_owner"))
    joined = holds.join(owner, "receipt_id", "left")
    problem = (
        F.when((F.trim("hold_id") == "") | (F.trim("tenant_id") == "") | (F.trim("reason") == "") | (F.trim("actor") == "")
               | (F.octet_length("reason") > 512) | (F.octet_length("actor") > 128), "HOLD_INVALID")
        .when(F.col("expires_at_ns") <= F.col("created_at_ns"), "EXPIRY_BEFORE_CREATION")
        .when(F.col("receipt_id").isNotNull() & F.col("_owner").isNull(), "RECEIPT_NOT_FOUND")
        .when(F.col("_owner") != F.col("tenant_id"), "RECEIPT_OF_OTHER_TENANT")
    )
    return joined.withColumn("problem", problem).filter("problem IS NOT NULL").select("hold_id", "tenant_id", "receipt_id", "problem")


def retention_candidates(receipts: DataFrame, holds: DataFrame, cutoff_ns: int, now_ns: int) -> DataFrame:
    """Terminal receipts older than the cutoff, raw available and not on hold.

    The hold test is split: receipt holds and tenant-wide holds are two equi
    anti-joins, so no join has the tenant (a few huge keys) as its only key
    against a long hold list.
    """
    old = receipts.filter(
        (F.col("received_at_ns") < cutoff_ns) & F.col("raw_available") & F.col("state").isin(vocab.TERMINAL_STATES)
    )
    active = active_holds(holds, now_ns)
    by_receipt = active.filter("receipt_id IS NOT NULL").select("tenant_id", "receipt_id").distinct()
    by_tenant = active.filter("receipt_id IS NULL").select("tenant_id").distinct()
    return old.join(by_receipt, ["tenant_id", "receipt_id"], "left_anti").join(by_tenant, "tenant_id", "left_anti")


def verify_candidates(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates with `verified`: the stored bytes are there, of the size and digest of the receipt.

    `stored`: ref, sha256, size_bytes.
    """
    held = stored.select(F.col("ref").alias("raw_ref"), F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size"))
    ok = F.coalesce((F.col("_sha") == F.col("raw_sha256")) & (F.col("_size") == F.col("raw_size")), F.lit(False))
    return candidates.join(held, "raw_ref", "left").withColumn("verified", ok).drop("_sha", "_size")


def retention_report(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Examined, expired and freed bytes per tenant.

    Only verified bytes may expire. `stored`: ref, sha256, size_bytes.
    """
    ok = F.col("verified")
    return verify_candidates(candidates, stored).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("examined"),
        F.count_if(ok).alias("expired"),
        F.coalesce(F.sum(F.when(ok, F.col("raw_size"))), F.lit(0)).alias("bytes_freed"),
        F.count_if(~ok).alias("unverified"),
    )


def expire_raw(receipts: DataFrame, candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Receipts table with verified candidates marked unavailable (id and digest must match).

    Candidates whose bytes are missing or altered keep their flag: they are evidence of a fault.
    """
    gone = verify_candidates(candidates, stored).filter("verified").select("receipt_id", "raw_sha256").distinct().withColumn("_gone", F.lit(True))
    joined = receipts.join(gone, ["receipt_id", "raw_sha256"], "left")
    flag = F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("raw_available"))
    return joined.withColumn("raw_available", flag).select(*receipts.columns)


def reference_verdicts(receipts: DataFrame, inventory: DataFrame) -> DataFrame:
    """verified / missing / corrupt / unavailable_expected for each receipt."""
    held = inventory.select(F.col("ref").alias("raw_ref"), F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size"))
    joined = receipts.select("receipt_id", "tenant_id", "raw_ref", "raw_sha256", "raw_size", "raw_available").join(held, "raw_ref", "left")
    verdict = (
        F.when(~F.col("raw_available"), "unavailable_expected")
        .when(F.col("_sha").isNull(), "missing")
        .when((F.col("_sha") != F.col("raw_sha256")) | (F.col("_size") != F.col("raw_size")), "corrupt")
        .otherwise("verified")
    )
    return joined.select("receipt_id", "tenant_id", "raw_ref", verdict.alias("verdict"))


def reconcile_report(verdicts: DataFrame) -> DataFrame:
    names = ["verified", "missing", "corrupt", "unavailable_expected"]
    return verdicts.agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(F.col("verdict") == n).alias(n) for n in names])


def stray_files(inventory: DataFrame, receipts: DataFrame, now_us: int, grace_us: int = HOUR_US) -> DataFrame:
    """Old temporary files and committed files that no receipt knows."""
    old = inventory.filter(F.lit(now_us) - F.col("mtime_us") >= grace_us)
    name = F.element_at(F.split("ref", "/"), -1)
    temps = old.filter(name.endswith(".tmp")).select("ref", F.lit("stale_temporary").alias("kind"))
    named = old.filter(F.col("ref").rlike(RAW_FILE)).withColumn("receipt_id", F.regexp_replace(name, r"\.bin$", ""))
    orphans = named.join(receipts.select("receipt_id"), "receipt_id", "left_anti").select("ref", F.lit("orphan").alias("kind"))
    return temps.unionByName(orphans)


def list_raw(receipts: DataFrame, tenant_id: str | None, after_receipt_id: str, limit: int) -> DataFrame:
    """Raw references in receipt order, strictly after a receipt id."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    rows = receipts.filter(F.col("receipt_id") > after_receipt_id)
    if tenant_id:
        rows = rows.filter(F.col("tenant_id") == tenant_id)
    return rows.select(
        "receipt_id", "tenant_id", "received_at_ns", "state", "raw_ref", "raw_sha256", "raw_size", "raw_available"
    ).orderBy("receipt_id").limit(limit)


def snapshot_differences(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Manifest against files: missing, extra, wrong digest or size, duplicates.

    Both sides: ref, sha256, size_bytes.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("ref").agg(
            F.count(F.lit(1)).alias(f"{tag}_n"), F.min("sha256").alias(f"{tag}_sha"), F.min("size_bytes").alias(f"{tag}_size")
        )

    both = side(manifest, "m").join(side(actual, "a"), "ref", "full_outer")
    kind = (
        F.when(F.col("m_n") > 1, "duplicate_entry")
        .when(F.col("a_n").isNull(), "missing_file")
        .when(F.col("m_n").isNull(), "extra_file")
        .when(F.col("m_sha") != F.col("a_sha"), "wrong_digest")
        .when(F.col("m_size") != F.col("a_size"), "wrong_size")
    )
    return both.withColumn("difference", kind).filter("difference IS NOT NULL").select("ref", "difference")


def snapshot_counts(receipts: DataFrame, created_at_ns: int) -> DataFrame:
    """Receipt and available-raw counts with the recovery-point gap in ns."""
    gap = F.greatest(F.lit(0).cast("bigint"), F.lit(created_at_ns) - F.max("received_at_ns"))
    return receipts.agg(
        F.count(F.lit(1)).alias("receipt_count"), F.count_if(F.col("raw_available")).alias("available_raw_count"),
        F.coalesce(gap, F.lit(0)).alias("recovery_point_ns"),
    )


# --- audit ---------------------------------------------------------------------


def is_sensitive(key: Column) -> Column:
    name = F.lower(F.trim(key))
    suffix = F.lit(False)
    for s in vocab.SENSITIVE_SUFFIXES:
        suffix = suffix | name.endswith(s)
    return name.isin(vocab.SENSITIVE_FIELDS) | suffix


def audit_violations(records: DataFrame) -> DataFrame:
    """One row per failed check.

    `records`: audit_id, time_ns, actor, action, target, outcome, metadata MAP.
    """
    def blank(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))

    keys = F.map_keys(F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    checks = F.array(
        F.when(blank("audit_id"), "AUDIT_ID_REQUIRED"),
        F.when(F.coalesce("time_ns", F.lit(0)) == 0, "TIME_REQUIRED"),
        F.when(blank("actor"), "ACTOR_REQUIRED"),
        F.when(blank("action"), "ACTION_REQUIRED"),
        F.when(blank("target"), "TARGET_REQUIRED"),
        F.when(~F.coalesce(F.col("outcome").isin("succeeded", "denied", "failed"), F.lit(False)), "OUTCOME_INVALID"),
        F.when(F.exists(keys, lambda k: F.trim(k) == ""), "METADATA_KEY_EMPTY"),
        F.when(F.exists(keys, is_sensitive), "SENSITIVE_FIELD"),
    )
    return records.select("audit_id", F.explode(F.array_compact(checks)).alias("problem"))


def redact(logs: DataFrame, column: str = "fields") -> DataFrame:
    """Log rows without sensitive fields; an empty field map becomes NULL."""
    kept = F.map_filter(column, lambda k, _v: ~is_sensitive(k))
    return logs.withColumn(column, F.when(F.size(kept) > 0, kept))
