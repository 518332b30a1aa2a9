"""Registered queries: retention, integrity, snapshots and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.operators import governance as gov
from siftlog.operators import telemetry
from siftlog.plans import domain
from siftlog.plans.domain import NOW_NS, NOW_US
from siftlog.plans.registry import query
from siftlog.sources import evidence

CUTOFF_NS = NOW_NS - 10 * gov.DAY_NS

_CAND = f"""SELECT r.* FROM receipts r WHERE r.received_at_ns < {CUTOFF_NS} AND r.raw_available AND r.state IN ('DELIVERED', 'DEAD_LETTER')
 AND NOT EXISTS (SELECT 1 FROM holds h WHERE h.tenant_id = r.tenant_id AND (h.receipt_id IS NULL OR h.receipt_id = r.receipt_id)
 AND h.released_at_ns IS NULL AND (h.expires_at_ns IS NULL OR h.expires_at_ns > {NOW_NS}))"""


def _candidates(s, d):
    return gov.retention_candidates(domain.receipts(s, d), domain.holds(s, d), CUTOFF_NS, NOW_NS)


query("retention_candidates", f"SELECT receipt_id, tenant_id, raw_size FROM ({_CAND})")(
    lambda s, d: _candidates(s, d).select("receipt_id", "tenant_id", "raw_size")
)
query(
    "retention_report",
    f"""SELECT c.tenant_id, count(*) AS examined, count(*) FILTER (ok) AS expired, CAST(coalesce(sum(raw_size) FILTER (ok), 0) AS BIGINT) AS bytes_freed,
 count(*) FILTER (NOT ok) AS unverified FROM (SELECT c.*, coalesce(i.sha256 = c.raw_sha256 AND i.size_bytes = c.raw_size, false) AS ok
 FROM ({_CAND}) c LEFT JOIN inventory i ON i.ref = c.raw_ref) c GROUP BY 1""",
)(lambda s, d: gov.retention_report(_candidates(s, d), domain.inventory(s, d)))
query(
    "retention_expire",
    f"""SELECT receipt_id, raw_available AND receipt_id NOT IN (SELECT c.receipt_id FROM ({_CAND}) c JOIN inventory i ON i.ref = c.raw_ref
 AND i.sha256 = c.raw_sha256 AND i.size_bytes = c.raw_size) AS raw_available FROM receipts""",
)(lambda s, d: gov.expire_raw(domain.receipts(s, d), _candidates(s, d), domain.inventory(s, d)).select("receipt_id", "raw_available"))
query(
    "hold_states",
    f"""SELECT hold_id, CASE WHEN released_at_ns IS NOT NULL THEN 'released' WHEN expires_at_ns <= {NOW_NS} THEN 'expired' ELSE 'open' END AS hold_state FROM holds""",
)(lambda s, d: gov.hold_states(domain.holds(s, d), NOW_NS).select("hold_id", "hold_state"))
query(
    "hold_violations",
    """SELECT h.hold_id, h.tenant_id, h.receipt_id, CASE WHEN r.receipt_id IS NULL THEN 'RECEIPT_NOT_FOUND' ELSE 'RECEIPT_OF_OTHER_TENANT' END AS problem
 FROM holds h LEFT JOIN receipts r ON r.receipt_id = h.receipt_id WHERE h.receipt_id IS NOT NULL AND (r.receipt_id IS NULL OR r.tenant_id <> h.tenant_id)""",
)(lambda s, d: gov.hold_violations(domain.holds(s, d), domain.receipts(s, d)))

_VERDICT = """SELECT r.receipt_id, CASE WHEN NOT r.raw_available THEN 'unavailable_expected' WHEN i.sha256 IS NULL THEN 'missing'
 WHEN i.sha256 <> r.raw_sha256 OR i.size_bytes <> r.raw_size THEN 'corrupt' ELSE 'verified' END AS verdict FROM receipts r LEFT JOIN inventory i ON i.ref = r.raw_ref"""
query("reconcile_references", _VERDICT)(
    lambda s, d: gov.reference_verdicts(domain.receipts(s, d), domain.inventory(s, d)).select("receipt_id", "verdict")
)
query(
    "reconcile_report",
    f"""SELECT count(*) AS checked, count(*) FILTER (verdict = 'verified') AS verified, count(*) FILTER (verdict = 'missing') AS missing,
 count(*) FILTER (verdict = 'corrupt') AS corrupt, count(*) FILTER (verdict = 'unavailable_expected') AS unavailable_expected FROM ({_VERDICT})""",
)(lambda s, d: gov.reconcile_report(gov.reference_verdicts(domain.receipts(s, d), domain.inventory(s, d))))
query(
    "stray_files",
    f"""SELECT ref, 'stale_temporary' AS kind FROM inventory WHERE ends_with(ref, '.tmp') AND {NOW_US} - mtime_us >= 3600000000
 UNION ALL SELECT ref, 'orphan' FROM inventory i WHERE ends_with(ref, '.bin') AND {NOW_US} - mtime_us >= 3600000000
 AND NOT EXISTS (SELECT 1 FROM receipts r WHERE r.raw_ref = i.ref)""",
)(lambda s, d: gov.stray_files(domain.inventory(s, d), domain.receipts(s, d), NOW_US))
_HELD = "CASE WHEN doc_id % 9 = 2 THEN text || '!' ELSE text END"


@query(
    "content_hash_verify",
    f"""SELECT doc_id, CASE WHEN doc_id % 19 = 7 OR text IS NULL THEN 'missing' WHEN doc_id % 9 = 2 OR doc_id % 14 = 3 THEN 'corrupt' ELSE 'verified' END AS verdict,
 CASE WHEN doc_id % 19 <> 7 THEN sha256({_HELD}) END AS sha256, CASE WHEN doc_id % 19 <> 7 THEN strlen({_HELD}) END AS size_bytes FROM documents""",
)
def content_hash_verify(spark, sf_dir):
    """Contents of which some are lost or altered, against declared digests and sizes of which some are wrong."""
    k, text = F.col("doc_id"), F.col("text")
    held = F.when(k % 19 != 7, F.when(k % 9 == 2, F.concat(text, F.lit("!"))).otherwise(text).cast("binary"))
    size = F.octet_length(text) + F.when(k % 14 == 3, 1).otherwise(0)
    found = evidence.content_verdict(held, F.sha2(text.cast("binary"), 256), size)
    return domain.table(spark, sf_dir, "documents").select("doc_id", found.alias("found")).select("doc_id", "found.*")


query(
    "raw_listing",
    """SELECT receipt_id, tenant_id, state, raw_ref, raw_size, raw_available FROM receipts WHERE tenant_id = 't0' AND receipt_id > '00000000-0000-7000-8000-000000000100'
 ORDER BY receipt_id LIMIT 1000""",
)(lambda s, d: gov.list_raw(domain.receipts(s, d), "t0", "00000000-0000-7000-8000-000000000100", 1000).select("receipt_id", "tenant_id", "state", "raw_ref", "raw_size", "raw_available"))
query(
    "snapshot_differences",
    """SELECT coalesce(m.raw_ref, i.ref) AS ref, CASE WHEN i.ref IS NULL THEN 'missing_file' WHEN m.raw_ref IS NULL THEN 'extra_file' WHEN m.raw_sha256 <> i.sha256 THEN 'wrong_digest' END AS difference
 FROM (SELECT * FROM receipts WHERE raw_available) m FULL OUTER JOIN inventory i ON i.ref = m.raw_ref WHERE i.ref IS NULL OR m.raw_ref IS NULL OR m.raw_sha256 <> i.sha256""",
)(lambda s, d: gov.snapshot_differences(
    domain.receipts(s, d).filter("raw_available").select(F.col("raw_ref").alias("ref"), F.col("raw_sha256").alias("sha256"), F.col("raw_size").alias("size_bytes")),
    domain.inventory(s, d)))
query(
    "snapshot_counts",
    f"""SELECT count(*) AS receipt_count, count(*) FILTER (raw_available) AS available_raw_count, greatest(0, {NOW_NS} - max(received_at_ns)) AS recovery_point_ns FROM receipts""",
)(lambda s, d: gov.snapshot_counts(domain.receipts(s, d), NOW_NS))


def _audit(spark, sf_dir):
    ev = domain.events(spark, sf_dir)
    e = F.col("event_id")
    key = domain.pick(["note", "Raw_Payload ", "http.PAYLOAD", " ", "reason", "event.body", "payload_size"], e % 7)
    return ev.select(
        "event_id", F.concat(F.lit("a-"), e.cast("string")).alias("audit_id"), (F.col("us") * 1000).alias("time_ns"),
        F.when(e % 13 == 0, " ").otherwise("operator").alias("actor"), F.col("event_type").alias("action"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("target"),
        domain.pick(["succeeded", "denied", "failed", "maybe"], e % 4).alias("outcome"),
        F.create_map(key, F.lit("v"), F.lit("kind"), F.lit("x")).alias("metadata"),
    )


query(
    "audit_violations",
    """SELECT 'a-' || event_id AS audit_id, 'ACTOR_REQUIRED' AS problem FROM events WHERE event_id % 13 = 0
 UNION ALL SELECT 'a-' || event_id, 'OUTCOME_INVALID' FROM events WHERE event_id % 4 = 3
 UNION ALL SELECT 'a-' || event_id, 'METADATA_KEY_EMPTY' FROM events WHERE event_id % 7 = 3
 UNION ALL SELECT 'a-' || event_id, 'SENSITIVE_FIELD' FROM events WHERE event_id % 7 IN (1, 2, 5)""",
)(lambda s, d: gov.audit_violations(_audit(s, d)))
query(
    "redact_log_fields",
    "SELECT event_id, CASE WHEN event_id % 7 IN (1, 2, 5) THEN 'kind' ELSE list_value('kind,note', '', '', ' ,kind', 'kind,reason', '', 'kind,payload_size')[1 + event_id % 7] END AS keys FROM events",
)(lambda s, d: gov.redact(_audit(s, d).withColumnRenamed("metadata", "fields")).select("event_id", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("keys")))
query(
    "maintenance_counters",
    f"SELECT verdict AS kind, count(*) AS total FROM ({_VERDICT}) GROUP BY 1",
)(lambda s, d: telemetry.maintenance_counters(
    gov.reference_verdicts(domain.receipts(s, d), domain.inventory(s, d)).select(F.col("verdict").alias("kind"), F.lit(1).cast("bigint").alias("amount"))))
