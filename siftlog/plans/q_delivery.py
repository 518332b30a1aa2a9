"""Registered queries: delivery state, batches and sink checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.operators import delivery as dl
from siftlog.functions.text import drop_controls
from siftlog.plans import domain
from siftlog.plans.domain import NOW_NS
from siftlog.plans.registry import query
from siftlog.sources import sinks

TARGETS = [("lake", True), ("siem", False), ("archive", True)]
MID_NS = 1_705_320_000_000_000_000


def _records(spark, sf_dir):
    return domain.revisions(spark, sf_dir).select("revision_id", "receipt_id", "tenant_id", "event_id", "k")


_T = "(VALUES ('lake', true), ('siem', false), ('archive', true)) t(connector_id, required)"

query(
    "delivery_reconcile",
    f"""SELECT t.connector_id, v.revision_id, v.tenant_id, t.required, 'PENDING' AS state FROM revisions v CROSS JOIN {_T}
 WHERE NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.connector_id = t.connector_id AND d.revision_id = v.revision_id AND d.event_id % 3 <> 0)""",
)(lambda s, d: dl.enqueue(_records(s, d), domain.deliveries(s, d).filter("event_id % 3 <> 0"), TARGETS, NOW_NS).select(
    "connector_id", "revision_id", "tenant_id", "required", "state"))

query(
    "delivery_policy_conflicts",
    f"""SELECT v.revision_id, t.connector_id FROM revisions v CROSS JOIN {_T} JOIN deliveries d ON d.connector_id = t.connector_id AND d.revision_id = v.revision_id
 WHERE v.event_id % 50 = 3 OR (v.event_id % 50 = 4 AND t.connector_id = 'siem')""",
)(lambda s, d: dl.policy_conflicts(
    _records(s, d),
    domain.deliveries(s, d).withColumn("tenant_id", F.when(F.col("event_id") % 50 == 3, "tx").otherwise(F.col("tenant_id")))
    .withColumn("required", F.when((F.col("event_id") % 50 == 4) & (F.col("connector_id") == "siem"), True).otherwise(F.col("required"))),
    TARGETS).select("revision_id", "connector_id"))

query(
    "delivery_due_work",
    f"""SELECT connector_id, revision_id, available_at_ns, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY connector_id ORDER BY available_at_ns, revision_id) AS INTEGER) AS rank
 FROM deliveries WHERE state IN ('PENDING', 'RETRY') AND available_at_ns <= {MID_NS}) WHERE rank <= 100""",
)(lambda s, d: dl.due_work(domain.deliveries(s, d), MID_NS, 100).select("connector_id", "revision_id", "available_at_ns", "rank"))


def _outcomes(spark, sf_dir):
    """Several outcomes per claimed row; some rows get none."""
    claimed = domain.deliveries(spark, sf_dir).filter("state = 'PROCESSING'")
    e = F.col("event_id")
    kinds = domain.pick(["SUCCEEDED", "PERMANENT_FAILURE", "RETRYABLE", "BROKEN"], e % 4)
    one = claimed.filter("event_id % 6 <> 5").select(
        "connector_id", "revision_id", F.lit(1).alias("position"), kinds.alias("outcome"), F.lit("C\u0001ODE").alias("code"), F.lit("m").alias("message")
    )
    late = one.withColumn("position", F.lit(2)).withColumn("outcome", F.lit("SUCCEEDED"))
    return claimed, one.unionByName(late)


query(
    "delivery_apply_outcomes",
    f"""SELECT connector_id, revision_id,
 CASE WHEN o = 'SUCCEEDED' THEN 'DELIVERED' WHEN o = 'RETRYABLE' AND attempts < 4 THEN 'RETRY' ELSE 'DEAD_LETTER' END AS state,
 CASE WHEN o = 'SUCCEEDED' THEN '' WHEN o = 'RETRYABLE' AND attempts >= 4 THEN 'RETRY_EXHAUSTED' WHEN o = 'BROKEN' OR event_id % 6 = 5 THEN 'CONNECTOR_PROTOCOL' ELSE 'CODE' END AS last_code,
 CASE WHEN o = 'RETRYABLE' AND attempts < 4 THEN {NOW_NS} + least(3000, 1000 * CAST(pow(2, greatest(attempts - 1, 0)) AS BIGINT)) * 1000000 ELSE available_at_ns END AS available_at_ns
 FROM (SELECT *, CASE WHEN event_id % 6 = 5 THEN 'RETRYABLE' ELSE list_value('SUCCEEDED', 'PERMANENT_FAILURE', 'RETRYABLE', 'BROKEN')[1 + event_id % 4] END AS o
 FROM deliveries WHERE state = 'PROCESSING')""",
)(lambda s, d: dl.apply_outcomes(*_outcomes(s, d), NOW_NS, 4, 1000, 3000).select("connector_id", "revision_id", "state", "last_code", "available_at_ns"))

query(
    "delivery_backoff",
    "SELECT connector_id, revision_id, least(60000, 500 * CAST(pow(2, greatest(attempts - 1, 0)) AS BIGINT)) AS wait_ms FROM deliveries",
)(lambda s, d: domain.deliveries(s, d).select("connector_id", "revision_id", dl.backoff_ms(F.col("attempts"), 500, 60000).alias("wait_ms")))

_ROLL = """SELECT receipt_id, CASE WHEN bool_or(required AND state = 'DEAD_LETTER') THEN 'DEAD_LETTER' WHEN bool_or(required AND state <> 'DELIVERED') THEN 'DELIVERY_PENDING'
 ELSE 'DELIVERED' END AS target_state FROM deliveries GROUP BY 1"""
query("receipt_rollup", _ROLL)(lambda s, d: dl.receipt_rollup(domain.deliveries(s, d)))
query(
    "receipt_state_refresh",
    f"""SELECT r.receipt_id, r.state, t.target_state, CASE WHEN r.state = t.target_state THEN 'unchanged'
 WHEN (r.state, t.target_state) IN (VALUES ('REVISION_COMMITTED', 'DELIVERY_PENDING'), ('REVISION_COMMITTED', 'DELIVERED'), ('DELIVERED', 'DELIVERY_PENDING'),
 ('DELIVERY_PENDING', 'DELIVERED'), ('DELIVERY_PENDING', 'DEAD_LETTER'), ('DEAD_LETTER', 'DELIVERY_PENDING')) THEN 'moved' ELSE 'not_allowed' END AS verdict
 FROM receipts r JOIN ({_ROLL}) t ON t.receipt_id = r.receipt_id""",
)(lambda s, d: dl.refreshed_states(domain.receipts(s, d), domain.deliveries(s, d), True).select("receipt_id", "state", "target_state", "verdict"))

query(
    "connector_summary",
    """SELECT connector_id, bool_or(required) AS required, count(*) FILTER (state = 'PENDING') AS pending, count(*) FILTER (state = 'PROCESSING') AS processing,
 count(*) FILTER (state = 'RETRY') AS retry, count(*) FILTER (state = 'DELIVERED') AS delivered, count(*) FILTER (state = 'DEAD_LETTER') AS dead_letter
 FROM deliveries WHERE tenant_id = 't1' GROUP BY 1""",
)(lambda s, d: dl.connector_summary(domain.deliveries(s, d), "t1"))

query(
    "dead_letter_listing",
    """SELECT connector_id, revision_id, last_code, updated_at_ns FROM deliveries WHERE tenant_id = 't3' AND state = 'DEAD_LETTER'
 ORDER BY updated_at_ns DESC, connector_id, revision_id LIMIT 200""",
)(lambda s, d: dl.list_deliveries(domain.deliveries(s, d), "t3", state="DEAD_LETTER", limit=200).select("connector_id", "revision_id", "last_code", "updated_at_ns"))

query(
    "delivery_replay",
    f"""SELECT connector_id, revision_id, CASE WHEN hit THEN 'PENDING' ELSE state END AS state, CASE WHEN hit THEN 0 ELSE attempts END AS attempts,
 CASE WHEN hit THEN {NOW_NS} ELSE available_at_ns END AS available_at_ns, hit AS replayed FROM
 (SELECT *, state = 'DEAD_LETTER' AND event_id % 2 = 0 AND event_id % 10 <> 0 AS hit FROM deliveries)""",
)(lambda s, d: dl.replay(
    domain.deliveries(s, d),
    domain.deliveries(s, d).filter("event_id % 2 = 0").select("connector_id", "revision_id", F.when(F.col("event_id") % 10 == 0, "wrong").otherwise(F.col("tenant_id")).alias("tenant_id")),
    NOW_NS).select("connector_id", "revision_id", "state", "attempts", "available_at_ns", "replayed"))


def _dirty(spark, sf_dir):
    docs = domain.table(spark, sf_dir, "documents")
    noisy = F.concat(F.lit("\u0001"), F.col("text"), F.lit("\u007f"))
    clean, short = drop_controls(noisy, 1 << 30), drop_controls(noisy, 512)
    return docs.select(
        "doc_id", clean.alias("clean"), (F.octet_length(short) <= 512).alias("bounded"),
        # No whole character that still fits may be lost.
        (F.startswith(clean, short) & (F.octet_length(short) >= F.least(F.octet_length(clean), F.lit(509)))).alias("is_prefix"),
    )


query(
    "sanitize_state_text",
    "SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g') AS clean, true AS bounded, true AS is_prefix FROM documents",
)(_dirty)

# --- batches -----------------------------------------------------------------------


def batch_rows(spark, sf_dir):
    """Flat rows of event 0..n with a body large enough for byte-bounded batches."""
    rows = domain.flat_events(spark, sf_dir)
    body = F.concat(F.lit('{"id":"'), "revision_id", F.lit('","pad":"'), F.repeat(F.lit("x"), (F.col("event_id") % 400).cast("int")), F.lit('"}'))
    return rows.select("revision_id", "receipt_id", "tenant_id", "received_at_ns", body.alias("envelope_json"))


@query(
    "batch_bounds",
    "SELECT tenant_id, count(*) AS rows, CAST(sum(strlen('{\"id\":\"' || revision_id || '\",\"pad\":\"' || repeat('x', event_id % 400) || '\"}')) AS BIGINT) AS bytes, 0 AS broken FROM flat_events GROUP BY 1",
)
def batch_bounds(spark, sf_dir):
    """All rows are in some batch, and no batch breaks a bound (40 rows, 8 KiB)."""
    batched = sinks.assign_batches(batch_rows(spark, sf_dir), "lake", 40, 8192)
    per = sinks.batch_identity(batched)
    broken = F.count_if((F.col("rows") > 40) | (F.col("bytes") > 8192))
    return per.groupBy("tenant_id").agg(F.sum("rows").alias("rows"), F.sum("bytes").cast("bigint").alias("bytes"), broken.alias("broken"))


_DAY = "strftime(make_timestamp(received_at_ns // 1000), '%Y-%m-%d')"
_STEP = 8 << 20


def _digests(spark, sf_dir):
    """Batches of at most 100 rows and 16 MiB with their three identity digests."""
    day = F.date_format("received_date", "yyyy-MM-dd").alias("received_day")
    batched = sinks.assign_batches(batch_rows(spark, sf_dir), "lake", 100)
    out = None
    for style in ("after_nul", "after_newline", "before_nul"):
        one = sinks.batch_identity(batched, style).select("tenant_id", day, "batch_key", F.lit(style).alias("style"), "rows", "batch_id")
        out = one if out is None else out.unionByName(one)
    return out


_BODY = "strlen('{\"id\":\"' || revision_id || '\",\"pad\":\"' || repeat('x', event_id % 400) || '\"}')"
_BATCHED = f"""(SELECT *, ((rn - 1) // 100) || '.' || CAST((total - b) // {_STEP} AS BIGINT) || '.0' AS batch_key FROM (
 SELECT *, {_DAY} AS received_day, {_BODY} AS b, row_number() OVER w AS rn, CAST(sum({_BODY}) OVER w AS BIGINT) AS total FROM flat_events
 WINDOW w AS (PARTITION BY tenant_id, {_DAY} ORDER BY received_at_ns, revision_id ROWS UNBOUNDED PRECEDING)))"""


def _digest_sql(style, text):
    return f"SELECT tenant_id, received_day, batch_key, '{style}' AS style, count(*) AS rows, sha256({text}) AS batch_id FROM {_BATCHED} GROUP BY 1, 2, 3"


query(
    "batch_identity_digest",
    " UNION ALL ".join([
        _digest_sql("after_nul", "'lake' || chr(0) || string_agg(revision_id || chr(0), '' ORDER BY revision_id)"),
        _digest_sql("after_newline", "'lake' || chr(10) || string_agg(revision_id || chr(10), '' ORDER BY revision_id)"),
        _digest_sql("before_nul", "'lake' || string_agg(chr(0) || revision_id, '' ORDER BY revision_id)"),
    ]),
)(_digests)


@query("batch_duplicate_revisions", "SELECT tenant_id, revision_id, 2 AS count FROM flat_events WHERE event_id % 100 = 7")
def batch_duplicates(spark, sf_dir):
    rows = batch_rows(spark, sf_dir)
    again = rows.join(domain.flat_events(spark, sf_dir).filter("event_id % 100 = 7").select("revision_id"), "revision_id", "left_semi")
    both = rows.unionByName(again).select(F.lit("lake").alias("connector_id"), "tenant_id", sinks.received_date().alias("received_date"), F.lit("0").alias("batch_key"), "revision_id")
    return sinks.duplicate_revisions(both).select("tenant_id", "revision_id", "count")


@query(
    "batch_conflict_check",
    """SELECT revision_id, CASE WHEN event_id % 50 = 1 THEN 'missing_row' WHEN event_id % 50 = 2 THEN 'unexpected_row' ELSE 'different_row' END AS conflict
 FROM flat_events WHERE event_id % 50 IN (1, 2, 3)""",
)
def batch_conflict_check(spark, sf_dir):
    rows = domain.flat_events(spark, sf_dir).select(F.lit("b").alias("batch_id"), "revision_id", "event_id", F.sha2(F.concat_ws("|", "revision_id", "status"), 256).alias("row_digest"))
    m = rows.filter("event_id % 50 <> 2")
    st = rows.filter("event_id % 50 <> 1").withColumn("row_digest", F.when(F.col("event_id") % 50 == 3, "x").otherwise(F.col("row_digest")))
    return sinks.batch_conflicts(m, st).select("revision_id", "conflict")


@query(
    "sink_record_validation",
    """SELECT revision_id, 'IDENTITY_REQUIRED' AS problem FROM flat_events WHERE event_id % 20 = 1
 UNION ALL SELECT revision_id, 'ORIGIN_INCOMPLETE' FROM flat_events WHERE event_id % 20 = 2
 UNION ALL SELECT revision_id, 'STATUS_OR_DIGEST_INVALID' FROM flat_events WHERE event_id % 20 IN (3, 4)
 UNION ALL SELECT revision_id, 'ENVELOPE_JSON_INVALID' FROM flat_events WHERE event_id % 20 = 4
 UNION ALL SELECT revision_id, 'QUALITY_OR_ISSUES_INVALID' FROM flat_events WHERE event_id % 20 = 5""",
)
def sink_record_validation(spark, sf_dir):
    f = domain.flat_events(spark, sf_dir)
    c = F.col("event_id") % 20
    rows = f.select(
        "revision_id", F.when(c == 1, " ").otherwise(F.col("receipt_id")).alias("receipt_id"), "tenant_id", "received_at_ns",
        F.lit("prod").alias("environment_id"), F.when(c == 2, "").otherwise("i").alias("instance_id"),
        "status", F.lit("s/1").alias("schema_version"), F.when(c.isin(3, 4), "ABC").otherwise(F.sha2("revision_id", 256)).alias("raw_sha256"),
        F.when(c == 4, '{"a":').otherwise('{"a":1}').alias("envelope_json"), F.array(F.lit("X")).alias("issue_codes"),
        F.when(c == 5, 1.5).otherwise(F.col("quality_score")).alias("quality_score"),
    )
    return sinks.record_violations(rows)
