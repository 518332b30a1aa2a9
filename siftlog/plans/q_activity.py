"""Registered queries: dashboard aggregates, origins and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog import vocab
from siftlog.operators import activity as act
from siftlog.operators import federation as fed
from siftlog.operators import telemetry as tel
from siftlog.plans import domain
from siftlog.plans.domain import NOW_NS
from siftlog.plans.registry import query

STATE_DIM = ", ".join(f"('{s}')" for s in vocab.RECEIPT_STATES)
STATUS_DIM = ", ".join(f"('{s}')" for s in vocab.STATUSES)
# A mid-range instant so the activity window holds rows.
ACT_NS = 1_705_320_137_000_000_000
B = act.BUCKET_NS

query(
    "receipt_state_counts",
    f"""SELECT t.tenant_id, d.name, count(r.state) AS count FROM (SELECT DISTINCT tenant_id FROM receipts) t
 CROSS JOIN (VALUES {STATE_DIM}) d(name) LEFT JOIN receipts r ON r.tenant_id = t.tenant_id AND r.state = d.name GROUP BY 1, 2""",
)(lambda s, d: act.receipt_state_counts(domain.receipts(s, d), ["tenant_id"]))

query(
    "latest_status_counts",
    f"""SELECT t.tenant_id, d.name, count(r.status) AS count FROM (SELECT DISTINCT tenant_id FROM revisions) t
 CROSS JOIN (VALUES {STATUS_DIM}) d(name) LEFT JOIN latest r ON r.tenant_id = t.tenant_id AND r.status = d.name GROUP BY 1, 2""",
)(lambda s, d: act.latest_status_counts(domain.revisions(s, d), ["tenant_id"]))

query(
    "revision_status_counts",
    "SELECT r.tenant_id, v.status, count(*) AS count FROM revisions v JOIN receipts r ON r.receipt_id = v.receipt_id GROUP BY 1, 2",
)(lambda s, d: act.revision_status_counts(domain.revisions(s, d), domain.receipts(s, d)))

query(
    "receipt_totals",
    "SELECT tenant_id, count(*) AS receipts, CAST(sum(CASE WHEN raw_available THEN raw_size ELSE 0 END) AS BIGINT) AS raw_bytes FROM receipts GROUP BY 1",
)(lambda s, d: act.receipt_totals(domain.receipts(s, d)))

query(
    "revision_totals",
    "SELECT r.tenant_id, count(*) AS revisions FROM revisions v JOIN receipts r ON r.receipt_id = v.receipt_id GROUP BY 1",
)(lambda s, d: act.revision_totals(domain.revisions(s, d), domain.receipts(s, d)))

DT = """SELECT r.tenant_id, count(*) FILTER (d.state IN ('PENDING', 'PROCESSING', 'RETRY')) AS pending,
 count(*) FILTER (d.state = 'DEAD_LETTER') AS failed, count(*) FILTER (d.state = 'DELIVERED') AS delivered
 FROM deliveries d JOIN revisions v ON v.revision_id = d.revision_id JOIN receipts r ON r.receipt_id = v.receipt_id GROUP BY 1"""
query("delivery_totals", DT)(
    lambda s, d: act.delivery_totals(domain.deliveries(s, d), domain.revisions(s, d), domain.receipts(s, d))
)

CT = f"""SELECT tenant_id, CAST(sum(pending) AS BIGINT) AS pending, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(delivered) AS BIGINT) AS delivered FROM (
 SELECT tenant_id, count(*) FILTER (state IN ('ACCEPTED', 'PROCESSING', 'DELIVERY_PENDING')) AS pending,
 count(*) FILTER (state = 'DEAD_LETTER') AS failed, 0 AS delivered FROM receipts GROUP BY 1 UNION ALL {DT}) GROUP BY 1"""
query("composite_totals", CT)(
    lambda s, d: act.composite_totals(domain.receipts(s, d), domain.revisions(s, d), domain.deliveries(s, d))
)

END = ACT_NS - ACT_NS % B
query(
    "activity_buckets",
    f"""SELECT t.tenant_id, s.bucket_ns, (SELECT count(*) FROM receipts r WHERE r.tenant_id = t.tenant_id AND r.received_at_ns - r.received_at_ns % {B} = s.bucket_ns) AS accepted,
 (SELECT count(*) FROM revisions v WHERE v.tenant_id = t.tenant_id AND v.created_at_ns - v.created_at_ns % {B} = s.bucket_ns) AS committed
 FROM (SELECT DISTINCT tenant_id FROM receipts) t CROSS JOIN (SELECT {END} - 11 * {B} + i * {B} AS bucket_ns FROM range(12) x(i)) s""",
)(lambda s, d: act.activity(domain.receipts(s, d), domain.revisions(s, d), ACT_NS, ["tenant_id"]))

query(
    "pipeline_stages",
    f"""SELECT f.tenant_id, s.stage, s.label, CASE s.col WHEN 1 THEN f.receipts WHEN 2 THEN f.revisions ELSE f.delivered END AS count,
 CASE WHEN s.stage = 'deliver' AND f.failed > 0 THEN 'attention' WHEN s.stage = 'interpret' AND f.processing > 0 THEN 'active'
 WHEN (CASE s.col WHEN 1 THEN f.receipts WHEN 2 THEN f.revisions ELSE f.delivered END) > 0 THEN 'active' ELSE 'idle' END AS status
 FROM (SELECT a.*, b.revisions, c.failed, c.delivered FROM (SELECT tenant_id, count(*) AS receipts, count(*) FILTER (state = 'PROCESSING') AS processing FROM receipts GROUP BY 1) a
 JOIN (SELECT r.tenant_id, count(*) AS revisions FROM revisions v JOIN receipts r ON r.receipt_id = v.receipt_id GROUP BY 1) b USING (tenant_id)
 JOIN ({CT}) c USING (tenant_id)) f CROSS JOIN (VALUES ('frame', 'Frame', 1), ('admit', 'Admit', 1), ('interpret', 'Interpret', 2), ('commit', 'Commit', 2), ('deliver', 'Deliver', 3)) s(stage, label, col)""",
)(lambda s, d: act.pipeline_stages(domain.receipts(s, d), domain.revisions(s, d), domain.deliveries(s, d)).drop("ord"))

query("queue_depth", "SELECT tenant_id, count(*) FILTER (state NOT IN ('DELIVERED', 'DEAD_LETTER')) AS depth FROM receipts GROUP BY 1")(
    lambda s, d: act.queue_depth(domain.receipts(s, d))
)
query(
    "oldest_active_age",
    f"""SELECT tenant_id, coalesce(greatest(0, {NOW_NS} - min(CASE WHEN state NOT IN ('DELIVERED', 'DEAD_LETTER') THEN received_at_ns END)), 0) AS age_ns
 FROM receipts GROUP BY 1""",
)(lambda s, d: act.oldest_active_age(domain.receipts(s, d), NOW_NS))

# --- source identity -------------------------------------------------------------

_NAMES = ["palo-edge_fw", "okta_system log", "aws cloudtrail", "windows security", "nginx_access", "linux-audit", "mystery box", ""]


def _sources(spark, sf_dir):
    ev = domain.events(spark, sf_dir)
    e = F.col("event_id")
    return ev.select(
        "event_id",
        domain.pick(_NAMES, e % 8).alias("source_name"),
        F.when(e % 9 == 0, " Custom ").otherwise("").alias("source_family"),
        F.concat(F.lit("profile-"), (e % 5).cast("string")).alias("source_profile_id"),
        domain.pick(["generic-json", "generic-kv", ""], e % 3).alias("parser_id"),
        domain.pick(["json", "", "kv", ""], e % 4).alias("format"),
        domain.pick(vocab.STATUSES, e % 5).alias("status"),
        domain.pick(["http", "syslog_udp"], e % 2).alias("transport"),
        F.col("event_type").alias("action"),
        F.lit("listener-main").alias("listener_id"),
    )


_SRC = f"""(SELECT event_id, event_type AS action, list_value({", ".join(f"'{n}'" for n in _NAMES)})[1 + event_id % 8] AS source_name,
 CASE WHEN event_id % 9 = 0 THEN 'Custom' WHEN event_id % 8 = 0 THEN 'Network' WHEN event_id % 8 = 1 THEN 'Identity' WHEN event_id % 8 = 2 THEN 'Cloud'
 WHEN event_id % 8 = 3 THEN 'Endpoint' WHEN event_id % 8 = 4 THEN 'Application' WHEN event_id % 8 = 5 THEN 'Infrastructure' ELSE 'Other' END AS family,
 list_value('Palo Edge Fw', 'Okta System Log', 'Aws Cloudtrail', 'Windows Security', 'Nginx Access', 'Linux Audit', 'Mystery Box', 'Profile ' || event_id % 5)[1 + event_id % 8] AS display_name,
 CASE WHEN event_id % 4 = 0 THEN 'JSON' WHEN event_id % 4 = 2 THEN 'KV' ELSE list_value('JSON', 'KV', 'UNKNOWN')[1 + event_id % 3] END AS display_format,
 list_value('PARSED', 'PARTIALLY_PARSED', 'UNPARSED', 'INVALID', 'ERROR')[1 + event_id % 5] AS status,
 list_value('http', 'syslog_udp')[1 + event_id % 2] AS transport FROM events)"""

query("source_identity", f"SELECT event_id, family, display_name, display_format FROM {_SRC}")(
    lambda s, d: act.source_identity(_sources(s, d)).select("event_id", "family", "display_name", "display_format")
)
query(
    "source_coverage",
    f"SELECT family, count(*) AS events, CAST(floor(count(*) * 1.0 / (SELECT count(*) FROM events) * 100 + 0.5) AS BIGINT) AS percent FROM {_SRC} GROUP BY 1",
)(lambda s, d: act.source_coverage(act.source_identity(_sources(s, d))))
query("distinct_sources", f"SELECT count(DISTINCT display_name) AS sources, count(DISTINCT family) AS families FROM {_SRC}")(
    lambda s, d: act.distinct_sources(act.source_identity(_sources(s, d)))
)
query(
    "status_groups",
    """SELECT g AS status_group, n AS events, CAST(floor(n * 1.0 / sum(n) OVER () * 100 + 0.5) AS BIGINT) AS percent FROM (
 SELECT CASE status WHEN 'PARSED' THEN 'parsed' WHEN 'PARTIALLY_PARSED' THEN 'partial' WHEN 'ERROR' THEN 'failed' ELSE 'other' END AS g, count(*) AS n
 FROM latest GROUP BY 1)""",
)(lambda s, d: act.status_groups(act.latest_status_counts(domain.revisions(s, d))))
query(
    "search_facets",
    f"""SELECT DISTINCT 'family' AS facet, family AS value FROM {_SRC} UNION SELECT DISTINCT 'format', display_format FROM {_SRC}
 UNION SELECT DISTINCT 'status', status FROM {_SRC}""",
)(lambda s, d: act.facets(act.source_identity(_sources(s, d))))
query(
    "text_search",
    f"""SELECT event_id, display_name FROM {_SRC} WHERE family = 'Cloud' AND
 contains(lower(display_name || ' ' || family || ' ' || display_format || ' ' || transport || ' ' || action || ' ' || status || ' listener-main'), 'http click')""",
)(lambda s, d: act.text_search(act.source_identity(_sources(s, d)), "HTTP Click", family="Cloud").select("event_id", "display_name"))

# --- origins -------------------------------------------------------------------


def _snapshots(spark, sf_dir):
    """Metric rows of three origins, aggregated from the receipts by instance."""
    r = domain.receipts(spark, sf_dir)
    peer = F.when(F.col("instance_id") == "node-0", "local").otherwise(F.col("instance_id"))
    base = r.withColumn("peer_id", peer)
    keys = ["peer_id", "environment_id", "instance_id"]
    states = base.groupBy(*keys, F.col("state").alias("name")).agg(F.count(F.lit(1)).alias("value")).withColumn("kind", F.lit("state"))
    totals = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("receipts"), F.sum("raw_size").alias("raw_bytes")).unpivot(
        keys, ["receipts", "raw_bytes"], "name", "value"
    ).withColumn("kind", F.lit("total"))
    start = ACT_NS - 3_600_000_000_000
    # Peer node-2 reports from a clock one bucket ahead: its newest bucket is outside the local spine.
    ahead = F.when(F.col("instance_id") == "node-2", F.lit(B)).otherwise(F.lit(0))
    recent = base.filter((F.col("received_at_ns") >= start) & (F.col("received_at_ns") < ACT_NS))
    acc = recent.groupBy(*keys, (F.col("received_at_ns") - F.col("received_at_ns") % B + ahead).alias("bucket_ns")).agg(F.count(F.lit(1)).alias("value")).select(
        *keys, "bucket_ns", "value", F.lit("accepted").alias("kind"), F.lit("bucket").alias("name")
    )
    none = F.lit(None).cast("bigint")
    plain = states.withColumn("bucket_ns", none).unionByName(totals.withColumn("bucket_ns", none))
    return plain.unionByName(acc).withColumn("tenant_id", F.lit("t")).withColumn("generated_at_ns", F.lit(ACT_NS))


_BASE = "(SELECT *, CASE WHEN instance_id = 'node-0' THEN 'local' ELSE instance_id END AS peer_id FROM receipts)"
_SNAP = f"""(SELECT peer_id, environment_id, instance_id, 'state' AS kind, state AS name, NULL AS bucket_ns, count(*) AS value FROM {_BASE} GROUP BY ALL
 UNION ALL SELECT peer_id, environment_id, instance_id, 'total', 'receipts', NULL, count(*) FROM {_BASE} GROUP BY ALL
 UNION ALL SELECT peer_id, environment_id, instance_id, 'total', 'raw_bytes', NULL, sum(raw_size) FROM {_BASE} GROUP BY ALL
 UNION ALL SELECT peer_id, environment_id, instance_id, 'accepted', 'bucket', received_at_ns - received_at_ns % {B} + CASE WHEN instance_id = 'node-2' THEN {B} ELSE 0 END, count(*)
 FROM {_BASE} WHERE received_at_ns >= {ACT_NS - 3_600_000_000_000} AND received_at_ns < {ACT_NS} GROUP BY ALL)"""

query(
    "merge_origin_summaries",
    f"""SELECT kind, name, bucket_ns, CAST(sum(value) AS BIGINT) AS value FROM {_SNAP} s
 WHERE kind <> 'accepted' OR bucket_ns IN (SELECT bucket_ns FROM {_SNAP} x WHERE peer_id = 'local' AND kind = 'accepted') GROUP BY 1, 2, 3""",
)(lambda s, d: fed.merge_metrics(_snapshots(s, d)))
query(
    "merge_recent_events",
    "SELECT instance_id AS peer_id, tenant_id, receipt_id AS revision_id, received_at_ns FROM receipts ORDER BY received_at_ns DESC, instance_id, receipt_id LIMIT 20",
)(lambda s, d: fed.merge_recent(domain.receipts(s, d).select(F.col("instance_id").alias("peer_id"), "tenant_id", F.col("receipt_id").alias("revision_id"), "received_at_ns")))
query(
    "origin_scopes",
    f"""SELECT environment_id, instance_id, kind, name, CAST(sum(value) AS BIGINT) AS value FROM {_SNAP} GROUP BY
 GROUPING SETS ((environment_id, instance_id, kind, name), (environment_id, kind, name), (kind, name))""",
)(lambda s, d: fed.scoped_metrics(_snapshots(s, d)))


def _attempts(spark, sf_dir):
    ev = domain.events(spark, sf_dir)
    e = F.col("event_id")
    ns = F.col("us") * 1000
    return ev.select(
        F.concat(F.lit("peer-"), F.col("user_id").cast("string")).alias("peer_id"), ns.alias("attempted_at_ns"),
        F.when(e % 3 != 0, ns - (e % 5) * 60_000_000_000).alias("generated_at_ns"),
        F.when(e % 3 == 0, domain.pick(["UNAVAILABLE", "RESPONSE_INVALID"], e % 2)).alias("error_code"),
    )


query(
    "origin_freshness",
    f"""WITH a AS (SELECT 'peer-' || user_id AS peer_id, epoch_us(ts) * 1000 AS att, CASE WHEN event_id % 3 <> 0 THEN epoch_us(ts) * 1000 - (event_id % 5) * 60000000000 END AS gen,
 CASE WHEN event_id % 3 = 0 THEN list_value('UNAVAILABLE', 'RESPONSE_INVALID')[1 + event_id % 2] END AS err FROM events),
 l AS (SELECT *, row_number() OVER (PARTITION BY peer_id ORDER BY att DESC) AS n FROM a), g AS (SELECT *, row_number() OVER (PARTITION BY peer_id ORDER BY att DESC) AS n FROM a WHERE gen IS NOT NULL)
 SELECT l.peer_id, l.gen IS NOT NULL AS available, CASE WHEN l.gen IS NOT NULL THEN {NOW_NS} - l.gen > 120000000000 ELSE true END AS stale,
 l.gen IS NULL AND g.gen IS NOT NULL AS retained, g.gen AS generated_at_ns, g.att AS last_seen_at_ns, l.err AS error_code
 FROM l LEFT JOIN g ON g.peer_id = l.peer_id AND g.n = 1 WHERE l.n = 1""",
)(lambda s, d: fed.origin_status(_attempts(s, d), NOW_NS))


def _gate(spark, sf_dir):
    """One snapshot per user; some break exactly one rule."""
    ev = domain.events(spark, sf_dir)
    u = F.col("user_id")
    per = ev.groupBy("user_id", F.col("event_type").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("us"))
    metrics = per.select(
        F.concat(F.lit("peer-"), u.cast("string")).alias("peer_id"),
        F.when(u % 11 == 1, "other").otherwise("t").alias("tenant_id"),
        F.when(u % 11 == 2, F.lit(NOW_NS + 61 * 10**9)).otherwise(F.lit(NOW_NS)).alias("generated_at_ns"),
        F.lit("state").alias("kind"),
        F.when(u % 11 == 3, "LOST").otherwise("ACCEPTED").alias("name"),
        F.when(u % 11 == 4, -F.col("n")).otherwise(F.col("n")).alias("value"),
        F.lit(None).cast("bigint").alias("bucket_ns"),
    )
    recent = ev.groupBy("user_id").agg(F.min("event_id").alias("e")).select(
        F.concat(F.lit("peer-"), u.cast("string")).alias("peer_id"),
        F.when(u % 11 == 5, "other").otherwise("t").alias("tenant_id"), F.col("e").alias("revision_id"),
    )
    return fed.snapshot_violations(metrics, recent, "t", NOW_NS)


query(
    "snapshot_quality_gate",
    """SELECT DISTINCT 'peer-' || user_id AS peer_id, list_value('TENANT_MISMATCH', 'TIME_INVALID', 'UNKNOWN_GROUP', 'NEGATIVE_COUNTER', 'CROSS_TENANT_EVENT')[user_id % 11] AS reason
 FROM events WHERE user_id % 11 BETWEEN 1 AND 5""",
)(_gate)

# --- telemetry -------------------------------------------------------------------


def _samples(spark, sf_dir):
    """Counter samples per origin: one every 5 s of event order, with resets and gaps."""
    ev = domain.events(spark, sf_dir)
    e = F.col("event_id")
    n = F.expr("event_id div 8")
    cycle = n % 50
    return ev.select(
        F.concat(F.lit("o"), (e % 8).cast("string")).alias("origin"),
        # 20 s jump after every 30th sample of an origin.
        (F.lit(1_700_000_000_000_000_000) + n * 5_000_000_000 + F.expr("(event_id div 8) div 30") * 20_000_000_000).alias("time_ns"),
        (cycle * 10).alias("receipts"), (cycle * 8).alias("revisions"), (cycle * 6).alias("delivered"),
        (e % 13).alias("pending"), (e % 3).alias("failed"),
    )


_SAMP = """s AS (SELECT 'o' || (event_id % 8) AS origin, 1700000000000000000 + (event_id // 8) * 5000000000 + ((event_id // 8) // 30) * 20000000000 AS time_ns,
 ((event_id // 8) % 50) * 10 AS receipts, ((event_id // 8) % 50) * 8 AS revisions, ((event_id // 8) % 50) * 6 AS delivered, event_id % 13 AS pending, event_id % 3 AS failed FROM events),
 w AS (SELECT *, lag(time_ns) OVER o AS pt, lag(receipts) OVER o AS pr, lag(revisions) OVER o AS pv, lag(delivered) OVER o AS pd FROM s WINDOW o AS (PARTITION BY origin ORDER BY time_ns)),
 p AS (SELECT *, pt IS NULL OR time_ns - pt > 15000000000 OR receipts < pr AS brk FROM w),
 q AS (SELECT *, CAST(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY origin ORDER BY time_ns ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM p),
 pts AS (SELECT origin, time_ns, segment, (receipts - pr) / ((time_ns - pt) / 1e9) AS receipts_per_s, (revisions - pv) / ((time_ns - pt) / 1e9) AS revisions_per_s,
 (delivered - pd) / ((time_ns - pt) / 1e9) AS delivered_per_s, pending, failed FROM q WHERE NOT brk)"""
query("counter_rates", f"WITH {_SAMP} SELECT * FROM pts")(lambda s, d: tel.counter_rates(_samples(s, d)))
query(
    "live_rate_points",
    f"""WITH {_SAMP}, l AS (SELECT origin, max(time_ns) AS t, max_by(segment, time_ns) AS g FROM pts GROUP BY 1)
 SELECT pts.* FROM pts JOIN l ON l.origin = pts.origin AND pts.segment = l.g AND l.t - pts.time_ns <= 120000000000""",
)(lambda s, d: tel.live_points(tel.counter_rates(_samples(s, d)), _samples(s, d)))


def _history(spark, sf_dir):
    """Minute samples of the queue age and the rejection counter, per tenant."""
    ev = domain.events(spark, sf_dir)
    minute = F.expr("us div 60000000") * 60
    per = ev.groupBy((F.col("user_id") % 4).alias("t"), minute.alias("time_s")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    series = F.concat(F.lit("t"), F.col("t").cast("string"))
    age = per.select(F.lit("queue_oldest_age_seconds").alias("metric"), series.alias("series"), F.lit("all").alias("label"), "time_s", (F.col("v") * 20).alias("value"))
    rej = per.select(F.lit("admission_requests_total").alias("metric"), series.alias("series"), F.lit("rejected_capacity").alias("label"), "time_s",
                     (F.expr("time_s div 1800") % 7).cast("double").alias("value"))
    return age.unionByName(rej)


_HIST = """h AS (SELECT 't' || (user_id % 4) AS series, epoch_us(ts) // 60000000 * 60 AS time_s, max(value) * 20 AS age FROM events GROUP BY 1, 2),
 a AS (SELECT 'OldestQueueItemStale' AS alert, 'warning' AS severity, series, time_s, age AS value, age > 300 AS active FROM h),
 a2 AS (SELECT *, min(active) OVER w AS held, time_s - min(time_s) OVER w >= 300 AS long FROM a WINDOW w AS (PARTITION BY series ORDER BY time_s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW)),
 c0 AS (SELECT series, time_s, CAST((time_s // 1800) % 7 AS DOUBLE) AS value FROM h),
 c1 AS (SELECT *, CASE WHEN value < lag(value) OVER w THEN value ELSE coalesce(value - lag(value) OVER w, 0) END AS step FROM c0 WINDOW w AS (PARTITION BY series ORDER BY time_s)),
 c2 AS (SELECT *, sum(step) OVER w - first(step) OVER w AS inc FROM c1 WINDOW w AS (PARTITION BY series ORDER BY time_s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW))"""
query(
    "alert_rules",
    f"""WITH {_HIST} SELECT alert, severity, series, time_s, value, CASE WHEN NOT active THEN 'inactive' WHEN held AND long THEN 'firing' ELSE 'pending' END AS state FROM a2
 UNION ALL SELECT 'CapacityRejections', 'critical', series, time_s, value, CASE WHEN inc > 0 THEN 'firing' ELSE 'inactive' END FROM c2""",
)(lambda s, d: tel.alert_evaluations(_history(s, d)))


# alert, severity, metric, label of its series, value while the fault is on and off (SQL), test (SQL), hold or window in seconds
_FAULTS = [
    ("DiskAdmissionBlocked", "critical", "storage_admission_blocked", None, "1.0", "0.0", "value = 1", 60),
    ("DiskApproachingWatermark", "warning", "storage_used_ratio", None, "0.9", "0.5", "value > 0.8", 900),
    ("RawEvidenceIntegrityFailure", "critical", "reconciliation_findings_total", "corrupt", "(m div 7) % 13", None, None, 600),
    ("ReconciliationStale", "warning", "maintenance_last_success_timestamp_seconds", "reconcile", "time_s - 2000", "time_s - 100", "time_s - value > 900", 300),
    ("RequiredConnectorDeadLetter", "critical", "connector_deliveries", "required:DEAD_LETTER", "2.0", "0.0", "value > 0", 120),
    ("ProcessingBacklog", "warning", "receipts", "PROCESSING", "1500.0", "10.0", "value > 1000", 600),
    ("OldestQueueItemStale", "warning", "queue_oldest_age_seconds", None, "400.0", "5.0", "value > 300", 300),
    ("RequiredDependencyUnavailable", "critical", "dependency_healthy", "required", "0.0", "1.0", "value = 0", 120),
    ("CapacityRejections", "critical", "admission_requests_total", "rejected_capacity", "(m div 11) % 9", None, None, 300),
]
_ON = "((m div 20) % 3 <> 0 AND m % 97 <> 5)"


def _fault_value(on, off):
    return f"CAST({on} AS DOUBLE)" if off is None else f"CAST(CASE WHEN {_ON} THEN {on} ELSE {off} END AS DOUBLE)"


def _alert_sql(alert, severity, _, label, on, off, test, seconds):
    base = f"SELECT series, time_s, {_fault_value(on, off)} AS value FROM h{' WHERE s4 <> 3' if label else ''}"
    window = f"WINDOW w AS (PARTITION BY series ORDER BY time_s RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW)"
    if test is None:
        steps = f"SELECT *, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS step FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY time_s) AS p FROM ({base}))"
        state, rows = "CASE WHEN inc > 0 THEN 'firing' ELSE 'inactive' END", f"SELECT *, sum(step) OVER w - first(step) OVER w AS inc FROM ({steps}) {window}"
    else:
        state = "CASE WHEN NOT active THEN 'inactive' WHEN held THEN 'firing' ELSE 'pending' END"
        rows = f"SELECT *, min(CAST(active AS INT)) OVER w = 1 AND time_s - min(time_s) OVER w >= {seconds} AS held FROM (SELECT *, {test} AS active FROM ({base})) {window}"
    return f"SELECT '{alert}' AS alert, '{severity}' AS severity, series, time_s, value, {state} AS state FROM ({rows})".replace(" div ", " // ")


@query(
    "alert_rules_all",
    "WITH h AS (SELECT event_id % 4 AS s4, 's' || (event_id % 4) AS series, event_id // 4 AS m, 1700000000 + (event_id // 4) * 60 AS time_s FROM events) "
    + " UNION ALL ".join(_alert_sql(*f) for f in _FAULTS),
)
def alert_rules_all(spark, sf_dir):
    """Every rule over four series a metric, with faults that come and go; the last series of a labelled metric has another label."""
    ev = domain.events(spark, sf_dir).select(
        (F.col("event_id") % 4).alias("s4"), F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("series"), F.expr("event_id div 4").alias("m"),
        F.expr("1700000000 + event_id div 4 * 60").alias("time_s"))
    samples = F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.when(F.col("s4") == 3, "other").otherwise(F.lit(label or "any")).alias("label"), F.expr(_fault_value(on, off)).alias("value"))
        for _, _, metric, label, on, off, _, _ in _FAULTS])
    return tel.alert_evaluations(ev.select("series", "time_s", F.explode(samples).alias("x")).select("x.metric", "series", "x.label", "time_s", "x.value"))


def _allowed(spark, sf_dir):
    n = domain.table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("metric_"), (F.col("n_regionkey")).cast("string")).alias("metric"), F.lit("nation").alias("label"), F.col("n_name").alias("value"))


query(
    "label_value_violations",
    """SELECT DISTINCT 'metric_' || (c_custkey % 5) AS metric, 'nation' AS label, n_name AS value FROM customer JOIN nation ON n_nationkey = c_nationkey
 WHERE n_regionkey <> c_custkey % 5""",
)(lambda s, d: tel.label_violations(
    domain.table(s, d, "customer").join(domain.table(s, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.concat(F.lit("metric_"), (F.col("c_custkey") % 5).cast("string")).alias("metric"), F.lit("nation").alias("label"), F.col("n_name").alias("value")),
    _allowed(s, d)))
query(
    "series_budget",
    """SELECT 'orders' AS metric, CAST(count(DISTINCT o_orderstatus) * count(DISTINCT o_orderpriority) * count(DISTINCT o_custkey) AS BIGINT) AS possible_series,
 count(DISTINCT o_orderstatus) * count(DISTINCT o_orderpriority) * count(DISTINCT o_custkey) > 10000 AS over_budget FROM orders""",
)(lambda s, d: tel.series_budget(domain.table(s, d, "orders").select(
    F.lit("orders").alias("metric"), F.explode(F.array(
        F.struct(F.lit("status").alias("label"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("priority").alias("label"), F.col("o_orderpriority").alias("value")),
        F.struct(F.lit("customer").alias("label"), F.col("o_custkey").cast("string").alias("value")))).alias("x")).select("metric", "x.*").distinct()))
