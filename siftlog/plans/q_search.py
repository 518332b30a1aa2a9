"""Registered queries: event search, revisions and traces."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from siftlog import vocab
from siftlog.operators import revisions as rv
from siftlog.operators import search
from siftlog.operators.detect import Fingerprint
from siftlog.operators.mapping import Mapping
from siftlog.plans import bundles, domain
from siftlog.plans.backfill import Bundle, run_backfill, stored_revisions
from siftlog.plans.domain import NOW_NS
from siftlog.plans.q_mapping import ACTION
from siftlog.plans.registry import query
from siftlog.session import shared_dir

COLS = "receipt_id, revision_id, tenant_id, received_at_ns, source_profile_id, class_uid, action, src_ip, dst_ip, status, quality_score"
OUT = [c.strip() for c in COLS.split(",")]
FROM_NS, TO_NS = 1_704_499_200_000_000_000, 1_705_708_800_000_000_000
KEY = "received_at_ns, receipt_id, revision_id"


def _flat(spark, sf_dir):
    return domain.flat_events(spark, sf_dir)


@query("search_by_tenant", f"SELECT {COLS} FROM flat_events WHERE tenant_id = 't1'")
def search_by_tenant(spark, sf_dir):
    return search.match_events(_flat(spark, sf_dir), search.EventFilter("t1")).select(*OUT)


@query("search_time_range_inclusive", f"SELECT {COLS} FROM flat_events WHERE tenant_id = 't1' AND received_at_ns BETWEEN {FROM_NS} AND {TO_NS}")
def search_time_range(spark, sf_dir):
    f = search.EventFilter("t1", received_from_ns=FROM_NS, received_to_ns=TO_NS)
    return search.match_events(_flat(spark, sf_dir), f).select(*OUT)


@query(
    "search_equality_filters",
    f"SELECT {COLS} FROM flat_events WHERE tenant_id = 't2' AND source_profile_id = 'p3' AND class_uid = 4001 AND action = 'allow' AND status = 'PARSED'",
)
def search_equality(spark, sf_dir):
    f = search.EventFilter("t2", source_profile_id="p3", class_uid=4001, action="allow", status="PARSED")
    return search.match_events(_flat(spark, sf_dir), f).select(*OUT)


@query("search_ip_either_endpoint", f"SELECT {COLS} FROM flat_events WHERE tenant_id = 't0' AND (src_ip = '198.51.100.4' OR dst_ip = '198.51.100.4')")
def search_ip(spark, sf_dir):
    return search.match_events(_flat(spark, sf_dir), search.EventFilter("t0", ip="198.51.100.4")).select(*OUT)


@query(
    "search_keyset_order",
    f"SELECT {COLS}, row_number() OVER (ORDER BY {KEY}) AS position FROM flat_events WHERE tenant_id = 't1' ORDER BY {KEY} LIMIT 200",
)
def search_order(spark, sf_dir):
    return search.search_page(_flat(spark, sf_dir), search.EventFilter("t1", limit=200)).select(*OUT, "position")


_AFTER = search.Cursor(FROM_NS, "00000000-0000-7000-8000-000000000001", "00000000-0000-7000-9000-000000000001")
_CURSOR = (
    "rtrim(translate(base64(('{\"v\":1,\"received_at\":\"' || strftime(make_timestamp(received_at_ns // 1000), '%Y-%m-%dT%H:%M:%S') "
    "|| regexp_replace('.' || strftime(make_timestamp(received_at_ns // 1000), '%f'), '\\.?0*$', '') "
    "|| 'Z\",\"receipt_id\":\"' || receipt_id || '\",\"revision_id\":\"' || revision_id || '\"}')::BLOB), '+/', '-_'), '=')"
)
_PAGE = f"""SELECT {COLS}, row_number() OVER (ORDER BY {KEY}) AS position, {_CURSOR} AS cur FROM flat_events
 WHERE tenant_id = 't1' AND (received_at_ns, receipt_id, revision_id) > ({_AFTER.received_at_ns}, '{_AFTER.receipt_id}', '{_AFTER.revision_id}')
 ORDER BY {KEY} LIMIT 51"""


@query(
    "search_keyset_page",
    f"SELECT {COLS}, position, CASE WHEN (SELECT count(*) FROM ({_PAGE})) > 50 THEN (SELECT cur FROM ({_PAGE}) WHERE position = 50) END AS next_cursor "
    f"FROM ({_PAGE}) WHERE position <= 50",
)
def search_keyset_page(spark, sf_dir):
    """Page strictly after a cursor, with the cursor of the following page."""
    page = search.search_page(_flat(spark, sf_dir), search.EventFilter("t1", after=_AFTER))
    return page.select(*OUT, "position", "next_cursor")


@query("cursor_round_trip", f"SELECT {_CURSOR} AS cursor_text, received_at_ns, receipt_id, revision_id FROM flat_events")
def cursor_round_trip(spark, sf_dir):
    """Encode every row's position, decode it, report the decoded values."""
    rows = domain.flat_events(spark, sf_dir, dealt=True).select(search.encode_cursor().alias("cursor_text"))
    return rows.select("cursor_text", search.decode_cursor(F.col("cursor_text")).alias("c")).select("cursor_text", "c.*")


def _stored_twice(spark, sf_dir):
    """Flat events, of which every hundredth is stored twice."""
    rows = _flat(spark, sf_dir)
    return rows.unionByName(rows.filter("event_id % 100 = 7"))


@query(
    "event_lookup",
    """SELECT CASE WHEN event_id % 9 = 4 THEN 'other' ELSE tenant_id END AS tenant_id, revision_id,
 CASE WHEN event_id % 9 = 4 THEN 'NOT_FOUND' WHEN event_id % 100 = 7 THEN 'DUPLICATE' ELSE 'FOUND' END AS verdict,
 CASE WHEN event_id % 9 <> 4 AND event_id % 100 <> 7 THEN receipt_id END AS receipt_id, CASE WHEN event_id % 9 <> 4 AND event_id % 100 <> 7 THEN received_at_ns END AS received_at_ns FROM flat_events""",
)
def event_lookup(spark, sf_dir):
    """Every revision looked up, some under another tenant, in a table that holds some of them twice."""
    wanted = _flat(spark, sf_dir).select(F.when(F.col("event_id") % 9 == 4, "other").otherwise(F.col("tenant_id")).alias("tenant_id"), "revision_id")
    found = search.lookup_events(_stored_twice(spark, sf_dir).select(*OUT), wanted)
    return found.select("tenant_id", "revision_id", "verdict", "event.receipt_id", "event.received_at_ns")


@query("duplicate_event_check", "SELECT tenant_id, revision_id, 2 AS count FROM flat_events WHERE event_id % 100 = 7")
def duplicate_event_check(spark, sf_dir):
    return search.duplicate_events(_stored_twice(spark, sf_dir))


@query(
    "receipt_trace",
    """SELECT r.receipt_id, r.tenant_id, r.state, r.raw_sha256, v.revision_id, v.pipeline_version, v.parser_id, v.status AS revision_status, v.created_at_ns
 FROM receipts r LEFT JOIN revisions v ON v.receipt_id = r.receipt_id""",
)
def receipt_trace(spark, sf_dir):
    later = domain.revisions(spark, sf_dir)
    rows = search.receipt_trace(domain.receipts(spark, sf_dir), later)
    return rows.select("receipt_id", "tenant_id", "state", "raw_sha256", "revision_id", "pipeline_version", "parser_id", "revision_status", "created_at_ns")


@query(
    "envelope_trace",
    """SELECT revision_id, CASE WHEN event_id % 3 <> 0 THEN 'stored ' || revision_id WHEN event_id % 2 = 0 THEN 'indexed ' || revision_id END AS envelope_json,
 CASE WHEN event_id % 3 <> 0 THEN 'stored' WHEN event_id % 2 = 0 THEN 'index' ELSE 'NOT_FOUND' END AS origin FROM revisions""",
)
def envelope_trace(spark, sf_dir):
    rev = domain.revisions(spark, sf_dir).select("revision_id", "receipt_id", "tenant_id", "event_id")
    stored = rev.withColumn("envelope_json", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("stored "), "revision_id")))
    indexed = rev.filter("event_id % 2 = 0").withColumn("envelope_json", F.concat(F.lit("indexed "), "revision_id"))
    return search.envelope_trace(stored, indexed).select("revision_id", "envelope_json", "origin")


@query(
    "raw_retrieval_verdict",
    """SELECT r.receipt_id, CASE WHEN NOT raw_available THEN 'RAW_EXPIRED' WHEN i.sha256 IS NULL THEN 'RAW_UNAVAILABLE'
 WHEN i.sha256 <> raw_sha256 OR i.size_bytes <> raw_size THEN 'RAW_INTEGRITY_FAILED' ELSE 'OK' END AS raw_verdict
 FROM receipts r LEFT JOIN inventory i ON i.ref = r.raw_ref""",
)
def raw_retrieval_verdict(spark, sf_dir):
    rows = search.raw_verdicts(domain.receipts(spark, sf_dir), domain.inventory(spark, sf_dir))
    return rows.select("receipt_id", "raw_verdict")


@query(
    "envelope_listing",
    f"""SELECT r.receipt_id, v.revision_id, r.received_at_ns, v.status FROM revisions v JOIN receipts r ON r.receipt_id = v.receipt_id
 WHERE r.tenant_id = 't2' AND (r.received_at_ns, r.receipt_id, v.revision_id) > ({FROM_NS}, 'a', 'a')
 ORDER BY r.received_at_ns, r.receipt_id, v.revision_id LIMIT 200""",
)
def envelope_listing(spark, sf_dir):
    page = search.list_envelopes(
        domain.revisions(spark, sf_dir), domain.receipts(spark, sf_dir), "t2", search.Cursor(FROM_NS, "a", "a"), 200
    )
    return page.select("receipt_id", "revision_id", "received_at_ns", "status")


# --- revisions -----------------------------------------------------------------

query("latest_revision", "SELECT receipt_id, revision_id, created_at_ns, status FROM latest")(
    lambda s, d: rv.latest_revisions(domain.revisions(s, d), ["revision_id", "created_at_ns", "status"])
)


@query(
    "revision_history",
    """SELECT receipt_id, revision_id, created_at_ns, row_number() OVER (PARTITION BY receipt_id ORDER BY created_at_ns, revision_id) AS commit_no
 FROM revisions""",
)
def revision_history(spark, sf_dir):
    return rv.revision_history(domain.revisions(spark, sf_dir)).select("receipt_id", "revision_id", "created_at_ns", "commit_no")


@query(
    "append_revisions_idempotent",
    """SELECT receipt_id, pipeline_version, bundle_sha256, min(revision_id) AS revision_id FROM revisions
 WHERE NOT (event_id % 4 = 0 AND k = 0) GROUP BY 1, 2, 3""",
)
def append_revisions(spark, sf_dir):
    """Every revision arrives twice; the stored part must not be added again."""
    rev = domain.revisions(spark, sf_dir)
    again = rev.withColumn("revision_id", F.concat("revision_id", F.lit("-retry"))).withColumn("created_at_ns", F.col("created_at_ns") + 1)
    stored = rev.filter("event_id % 4 = 0 AND k = 0")
    new = rv.append_revisions(rev.unionByName(again), stored)
    return new.select("receipt_id", "pipeline_version", "bundle_sha256", "revision_id")


_LOG = f"""SELECT receipt_id, created_at_ns AS changed_at_ns, k AS seq, list_value({", ".join(f"'{s}'" for s in vocab.RECEIPT_STATES)})[1 + (event_id + k * 2 + k * k) % 6] AS state
 FROM revisions"""
_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in vocab.RECEIPT_EDGES)


@query(
    "state_transition_audit",
    f"""SELECT receipt_id, changed_at_ns, from_state, to_state, 'TRANSITION_NOT_ALLOWED' AS problem FROM (
 SELECT receipt_id, changed_at_ns, state AS to_state, lag(state) OVER (PARTITION BY receipt_id ORDER BY changed_at_ns, seq) AS from_state FROM ({_LOG}) s)
 WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (VALUES {_EDGES})""",
)
def state_transition_audit(spark, sf_dir):
    rev = domain.revisions(spark, sf_dir)
    k = F.col("k")
    state = domain.pick(vocab.RECEIPT_STATES, (F.col("event_id") + k * 2 + k * k) % 6)
    log = rev.select("receipt_id", F.col("created_at_ns").alias("changed_at_ns"), k.alias("seq"), state.alias("state"))
    return rv.transition_violations(log)


@query(
    "overdue_work",
    f"SELECT receipt_id, lease_until_ns FROM receipts WHERE state = 'PROCESSING' AND lease_until_ns <= {TO_NS}",
)
def overdue_work(spark, sf_dir):
    return rv.overdue_work(domain.receipts(spark, sf_dir), TO_NS).select("receipt_id", "lease_until_ns")


def _jobs(spark, sf_dir):
    ev = domain.events(spark, sf_dir)
    e = F.col("event_id")
    return ev.select(
        F.concat(F.lit("job-"), e.cast("string")).alias("job_id"), domain.receipt_id(e).alias("receipt_id"),
        F.lit("2.0.0").alias("pipeline_version"), F.sha2(F.lit("bundle-9"), 256).alias("bundle_sha256"),
        domain.pick(["QUEUED", "QUEUED", "COMPLETE"], e % 3).alias("status"), (F.col("us") * 1000).alias("requested_at_ns"),
    )


JOBS_SQL = """(SELECT 'job-' || event_id AS job_id, '00000000-0000-7000-8000-' || printf('%012x', event_id) AS receipt_id,
 list_value('QUEUED', 'QUEUED', 'COMPLETE')[1 + event_id % 3] AS status, event_id FROM events)"""


@query("backfill_candidates", f"SELECT j.job_id, j.receipt_id, r.raw_sha256 FROM {JOBS_SQL} j JOIN receipts r ON r.receipt_id = j.receipt_id WHERE j.status = 'QUEUED' AND r.raw_available")
def backfill_candidates(spark, sf_dir):
    return rv.backfill_candidates(_jobs(spark, sf_dir), domain.receipts(spark, sf_dir)).select("job_id", "receipt_id", "raw_sha256")


@query(
    "backfill_settle",
    f"""SELECT j.job_id, CASE WHEN j.status <> 'QUEUED' THEN j.status WHEN r.raw_available THEN 'COMPLETE' ELSE 'FAILED' END AS status
 FROM {JOBS_SQL} j JOIN receipts r ON r.receipt_id = j.receipt_id""",
)
def backfill_settle(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    results = rv.backfill_candidates(jobs, domain.receipts(spark, sf_dir)).select(
        *rv.REVISION_KEY, F.concat(F.lit("rev-"), "job_id").alias("revision_id")
    )
    return rv.settle_backfill(jobs, results, NOW_NS).select("job_id", "status")


@query(
    "backfill_identity_check",
    f"""SELECT j.job_id, 'rev-' || j.job_id AS revision_id, CASE WHEN j.event_id % 7 = 1 THEN 'PIPELINE_MISMATCH' WHEN j.event_id % 7 = 2 THEN 'RAW_MISMATCH' END AS problem
 FROM {JOBS_SQL} j WHERE j.event_id % 7 IN (1, 2)""",
)
def backfill_identity_check(spark, sf_dir):
    jobs, rec = _jobs(spark, sf_dir), domain.receipts(spark, sf_dir)
    n = F.substring("job_id", 5, 20).cast("bigint")
    results = jobs.join(rec.select("receipt_id", "raw_sha256", "raw_size"), "receipt_id").select(
        "job_id", F.concat(F.lit("rev-"), "job_id").alias("revision_id"), "receipt_id", "bundle_sha256",
        F.when(n % 7 == 1, "0.0.1").otherwise(F.col("pipeline_version")).alias("pipeline_version"),
        F.when(n % 7 == 2, F.sha2("raw_sha256", 256)).otherwise(F.col("raw_sha256")).alias("raw_sha256"), "raw_size",
    )
    return rv.backfill_mismatches(results, jobs, rec)


KV_BUNDLE, CEF_BUNDLE = (hashlib.sha256(name.encode()).hexdigest() for name in ("bundle-kv", "bundle-cef"))


def installed_bundles():
    """Two bundles: one reads key=value text and knows one vendor word more, the other reads CEF as usual."""
    more = bundles.TAXONOMIES | {"network-action": bundles.TAXONOMIES["network-action"] | {"vendor-magic": "allow"}}
    kv, cef = bundles.MAPPINGS["kv"], bundles.MAPPINGS["cef"]
    return [
        Bundle(KV_BUNDLE, (Fingerprint("bundle-kv", "kv", ("time=", "synthetic=true", "sport="), 950, 200, bundle_sha256=KV_BUNDLE),),
               {"kv": Mapping("vendor-kv", "2.0.0", kv.rules, more)}),
        Bundle(CEF_BUNDLE, (Fingerprint("bundle-cef", "cef", ("CEF:0|",), 950, 200, bundle_sha256=CEF_BUNDLE),), {"cef": cef}),
    ]


def backfill_inputs(spark, sf_dir):
    """A job for every event, and receipts with raw bytes of which some are gone or altered."""
    rec = domain.receipts(spark, sf_dir, with_raw=True)
    e = F.col("event_id")
    receipts = rec.withColumn("raw", F.when(e % 17 != 2, F.when(e % 23 == 4, F.concat("raw", F.lit(b"x"))).otherwise(F.col("raw")))).drop("event_id")
    jobs = domain.events(spark, sf_dir).select(
        F.concat(F.lit("job-"), e.cast("string")).alias("job_id"), F.when(e % 13 == 5, "no-such-receipt").otherwise(domain.receipt_id(e)).alias("receipt_id"),
        F.lit("2.0.0").alias("pipeline_version"), domain.pick([KV_BUNDLE, CEF_BUNDLE, hashlib.sha256(b"unknown").hexdigest()], e % 3).alias("bundle_sha256"),
        domain.pick(["QUEUED", "QUEUED", "COMPLETE", "QUEUED"], e % 4).alias("status"), F.lit(None).cast("string").alias("last_error_code"))
    return jobs, receipts


_VENDOR = "CASE WHEN f_action = 'vendor-magic' THEN 'allow' ELSE " + ACTION + " END"


@query(
    "backfill_run",
    f"""SELECT 'job-' || event_id AS job_id, CASE WHEN event_id % 4 = 2 THEN 'COMPLETE' WHEN code IS NULL THEN 'COMPLETE' ELSE 'FAILED' END AS status,
 CASE WHEN event_id % 4 <> 2 THEN code END AS last_error_code, CASE WHEN event_id % 4 <> 2 AND code IS NULL THEN fresh END AS revision_status,
 CASE WHEN event_id % 4 <> 2 AND code IS NULL THEN act END AS action, CAST(event_id % 4 <> 2 AND code IS NULL AS INT) AS revisions FROM
 (SELECT event_id, CASE WHEN event_id % 13 = 5 THEN 'RECEIPT_UNAVAILABLE' WHEN event_id % 3 = 2 THEN 'BUNDLE_UNAVAILABLE' WHEN event_id % 11 = 0 OR event_id % 17 = 2 THEN 'EVIDENCE_UNAVAILABLE'
  WHEN event_id % 23 = 4 THEN 'EVIDENCE_INTEGRITY' WHEN fmt <> CASE event_id % 3 WHEN 0 THEN 'kv' ELSE 'cef' END THEN 'BUNDLE_MISMATCH' END AS code,
  CASE WHEN f_dpt = '99999' OR (event_id % 3 = 1 AND f_action = 'vendor-magic') THEN 'PARTIALLY_PARSED' ELSE 'PARSED' END AS fresh,
  CASE WHEN event_id % 3 = 0 THEN {_VENDOR} ELSE {ACTION} END AS act FROM pl)""",
)
def backfill_run(spark, sf_dir):
    """Every queued job runs with its bundle; a second run finds nothing left to do."""
    root, now = shared_dir(spark, "backfill"), F.timestamp_micros(F.lit(domain.NOW_US))
    jobs, receipts = backfill_inputs(spark, sf_dir)
    for run in ("first", "second"):
        settled = run_backfill(root, run, jobs, receipts, installed_bundles(), now)
    new = stored_revisions(spark, root)
    action = F.get_json_object("envelope_json", "$.event.action")
    per_job = new.groupBy(F.col("revision_id").alias("completed_revision_id")).agg(
        F.first("status").alias("revision_status"), F.first(action).alias("action"), F.count(F.lit(1)).cast("int").alias("revisions"))
    return settled.join(per_job, "completed_revision_id", "left").select(
        "job_id", "status", "last_error_code", "revision_status", "action", F.coalesce("revisions", F.lit(0)).alias("revisions"))


@query(
    "active_bundles",
    """SELECT source_profile_id, sha256('bundle-' || max(event_id) % 3) AS bundle_sha256, max(event_id) AS activated_revision FROM
 (SELECT 'p' || (user_id % 20) AS source_profile_id, event_id FROM events) GROUP BY 1 HAVING max(event_id) % 3 <> 2""",
)
def active_bundles(spark, sf_dir):
    ev = domain.events(spark, sf_dir)
    bundle = F.sha2(F.concat(F.lit("bundle-"), (F.col("event_id") % 3).cast("string")), 256)
    log = ev.select(
        F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("source_profile_id"), bundle.alias("bundle_sha256"),
        F.col("event_id").alias("activated_revision"),
    )
    installed = log.select("bundle_sha256").distinct().filter(F.col("bundle_sha256") != F.sha2(F.lit("bundle-2"), 256))
    return rv.active_bundles(log, installed).select("source_profile_id", "bundle_sha256", "activated_revision")
