"""Registered queries: mapping, normalisation and the whole interpretation."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.functions.ip import canonical_ip
from siftlog.functions.variant import document_rows
from siftlog.operators import mapping as mp
from siftlog.plans import bundles, domain
from siftlog.plans.interpret import interpret
from siftlog.plans.q_parse import parsed_as
from siftlog.plans.registry import query
from siftlog.session import spread

_PLANS: dict = {}


def envelopes(spark, sf_dir):
    """Envelopes of every rendered event. The lazy plan is kept per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANS:
        rows = domain.receipts(spark, sf_dir, with_raw=True, dealt=True)
        _PLANS[key] = interpret(rows, F.timestamp_micros(F.lit(domain.NOW_US)))
    domain.ensure_utc(spark)
    return _PLANS[key]


LOST = "fmt IN ('malformed_json', 'unknown')"
MAPPED = "fmt IN ('json', 'kv', 'cef', 'leef', 'syslog', 'csv', 'xml')"
ACTION = "CASE f_action WHEN 'permit' THEN 'allow' WHEN 'ALLOW' THEN 'allow' WHEN 'blocked' THEN 'deny' WHEN 'allow' THEN 'allow' END"
HAS_DPT = "fmt IN ('json', 'kv', 'cef', 'syslog', 'csv')"
ISSUE_LIST = (
    "concat_ws(',', CASE WHEN f_action = 'vendor-magic' THEN 'MAPPING_TAXONOMY_MISS' END, "
    f"CASE WHEN {HAS_DPT} AND f_dpt = '99999' THEN 'MAPPING_CONVERSION_FAILED' END)"
)
STATUS = (
    f"CASE WHEN {LOST} THEN 'UNPARSED' WHEN fmt = 'duplicate_json' THEN 'INVALID' WHEN {MAPPED} AND {ISSUE_LIST} = '' THEN 'PARSED' ELSE 'PARTIALLY_PARSED' END"
)
EID = "event_id"


def _event_id():
    return F.conv(F.substring("receipt.id", 25, 12), 16, 10).cast("bigint").alias("event_id")


@query(
    "interpret_status_by_action",
    f"""SELECT CASE fmt WHEN 'router' THEN 'delimited_text' WHEN 'syslog' THEN 'syslog_rfc5424' WHEN 'duplicate_json' THEN 'json' WHEN 'malformed_json' THEN NULL WHEN 'unknown' THEN NULL ELSE fmt END AS format,
 {STATUS} AS status, CASE WHEN {MAPPED} THEN {ACTION} END AS action, count(*) AS events FROM pl GROUP BY 1, 2, 3""",
)
def interpret_status_by_action(spark, sf_dir):
    """Flagship: render, detect, parse, map, envelope, then count."""
    e = envelopes(spark, sf_dir)
    return e.groupBy(F.col("parsed.format").alias("format"), F.col("processing.status").alias("status"), F.col("event.action").alias("action")).agg(
        F.count(F.lit(1)).alias("events"))


@query(
    "mapping_event_fields",
    f"""SELECT event_id, CASE WHEN {MAPPED} THEN CASE WHEN f_kind = 'error' THEN 2004 ELSE 4001 END END AS class_uid, CASE WHEN {MAPPED} THEN {ACTION} END AS action,
 CASE WHEN {MAPPED} THEN CASE f_severity WHEN 'warning' THEN 'medium' ELSE lower(f_severity) END END AS severity, CASE WHEN {MAPPED} THEN lower(f_proto) END AS protocol,
 CASE WHEN {MAPPED} AND fmt <> 'xml' THEN f_src END AS src_ip, CASE WHEN {MAPPED} AND fmt <> 'xml' THEN f_dst END AS dst_ip,
 CASE WHEN {HAS_DPT} THEN CAST(f_spt AS INTEGER) END AS src_port, CASE WHEN {HAS_DPT} AND f_dpt <> '99999' THEN CAST(f_dpt AS INTEGER) END AS dst_port,
 CASE WHEN {MAPPED} AND fmt <> 'leef' THEN us END AS time_us, CASE WHEN {MAPPED} AND fmt <> 'leef' THEN f_user END AS user_name FROM pl""",
)
def mapping_event_fields(spark, sf_dir):
    e = F.col("event")
    return envelopes(spark, sf_dir).select(
        _event_id(), e["class_uid"].alias("class_uid"), e["action"].alias("action"), e["severity"].alias("severity"),
        e["connection_info"]["protocol_name"].alias("protocol"), e["src_endpoint"]["ip"].alias("src_ip"), e["dst_endpoint"]["ip"].alias("dst_ip"),
        e["src_endpoint"]["port"].alias("src_port"), e["dst_endpoint"]["port"].alias("dst_port"), F.unix_micros(e["time"]).alias("time_us"),
        F.try_variant_get(e["extensions"], "$.actor.user", "string").alias("user_name"))


_N = "CASE fmt WHEN 'leef' THEN 7 WHEN 'xml' THEN 7 ELSE 11 END"
_REQ = "CASE fmt WHEN 'xml' THEN 3 ELSE 5 END"
_MISS = "CASE WHEN f_action = 'vendor-magic' THEN 1 ELSE 0 END"
_BADPORT = f"CASE WHEN {HAS_DPT} AND f_dpt = '99999' THEN 1 ELSE 0 END"


@query(
    "envelope_issues_and_quality",
    f"""SELECT event_id, {STATUS} AS status, CASE WHEN {LOST} THEN 'DETECT_BELOW_THRESHOLD' WHEN fmt = 'duplicate_json' THEN 'JSON_DUPLICATE_KEY' WHEN fmt = 'router' THEN 'MAPPING_NOT_CONFIGURED'
 ELSE {ISSUE_LIST} END AS codes, CASE WHEN {MAPPED} THEN {_N} - {_MISS} - {_BADPORT} ELSE 0 END AS provenance,
 CASE WHEN {MAPPED} THEN ({_REQ} - {_MISS} + {_N} - {_MISS} - {_BADPORT}) / CAST({_REQ} + {_N} - {_MISS} - {_BADPORT} AS DOUBLE) ELSE 0.0 END AS score FROM pl""",
)
def envelope_issues_and_quality(spark, sf_dir):
    return envelopes(spark, sf_dir).select(
        _event_id(), F.col("processing.status").alias("status"), F.array_join(F.transform("processing.issues", lambda i: i["code"]), ",").alias("codes"),
        F.coalesce(F.size(F.map_keys("provenance")), F.lit(0)).alias("provenance"), F.col("quality.score").alias("score"))


@query(
    "mapping_unmapped_fields",
    """SELECT event_id, p.path FROM pf, (VALUES ('fields.attributes.note'), ('fields.attributes.synthetic'), ('fields.attributes.action'), ('fields.attributes.dport')) p(path)
 WHERE p.path IN ('fields.attributes.note', 'fields.attributes.synthetic') OR (p.path = 'fields.attributes.action' AND f_action = 'vendor-magic') OR (p.path = 'fields.attributes.dport' AND f_dpt = '99999')""",
)
def mapping_unmapped_fields(spark, sf_dir):
    out = mp.apply_mapping(parsed_as(spark, sf_dir, "kv"), bundles.MAPPINGS["kv"], with_unmapped=True)
    return out.select("event_id", F.explode_outer(F.map_keys("mapped.unmapped")).alias("path")).filter("path IS NOT NULL")


@query(
    "mapping_provenance",
    """SELECT event_id, r.target, r.kind, r.source_path, 'rendered-kv/1.0.0' AS mapping_version FROM pf, (VALUES
 ('event.class_uid', 'normalized', 'fields.attributes.type'), ('event.class_name', 'normalized', 'fields.attributes.type'), ('event.time', 'normalized', 'fields.attributes.time'),
 ('event.action', 'normalized', 'fields.attributes.action'), ('event.severity', 'normalized', 'fields.attributes.severity'), ('event.connection_info.protocol_name', 'normalized', 'fields.attributes.proto'),
 ('event.src_endpoint.ip', 'normalized', 'fields.attributes.src'), ('event.src_endpoint.port', 'normalized', 'fields.attributes.sport'), ('event.dst_endpoint.ip', 'normalized', 'fields.attributes.dst'),
 ('event.dst_endpoint.port', 'normalized', 'fields.attributes.dport'), ('event.extensions.actor.user', 'mapped', 'fields.attributes.user')) r(target, kind, source_path)
 WHERE NOT (r.target = 'event.action' AND f_action = 'vendor-magic') AND NOT (r.target = 'event.dst_endpoint.port' AND f_dpt = '99999')""",
)
def mapping_provenance(spark, sf_dir):
    out = mp.apply_mapping(parsed_as(spark, sf_dir, "kv"), bundles.MAPPINGS["kv"])
    return out.select("event_id", F.explode_outer("mapped.provenance").alias("target", "p")).filter("target IS NOT NULL").select("event_id", "target", "p.kind", "p.source_path", "p.mapping_version")


@query(
    "flatten_documents",
    """SELECT event_id, p.path FROM events, (VALUES ('timestamp'), ('event_type'), ('src_ip'), ('src_port'), ('dst_ip'), ('dst_port'), ('protocol'), ('action'), ('severity'), ('actor.name'),
 ('note'), ('tags.0'), ('tags.1'), ('synthetic')) q(name), LATERAL (SELECT 'fields.' || q.name AS path) p""",
)
def flatten_documents(spark, sf_dir):
    return document_rows(parsed_as(spark, sf_dir, "json"), ["event_id"], "parsed.fields").select("event_id", "path")


@query(
    "convert_ip_canonical",
    "SELECT event_id, '2001:db8::' || lower(to_hex(event_id % 65535 + 1)) AS v6, f_src AS mapped_v4, '::ffff:' || f_src AS kept_v4, NULL AS bad FROM pf",
)
def convert_ip_canonical(spark, sf_dir):
    ev = domain.fields(domain.events(spark, sf_dir))
    long_form = F.concat(F.lit("2001:0DB8:0:0:0:0:0:"), F.hex(F.col("event_id") % 65535 + 1))
    rows = ev.select("event_id", long_form.alias("a"), F.concat(F.lit("::FFFF:"), "f_src").alias("b"), F.concat("f_src", F.lit(".1")).alias("c"))
    return rows.select("event_id", canonical_ip(F.col("a")).alias("v6"), canonical_ip(F.col("b")).alias("mapped_v4"), canonical_ip(F.col("b"), unmap=False).alias("kept_v4"),
                       canonical_ip(F.col("c")).alias("bad"))


@query(
    "convert_timestamp_layouts",
    """SELECT o_orderkey, epoch_us(o_orderdate) - 19800000000 AS offset_us, epoch_us(o_orderdate) AS plain_us, epoch_us(date_trunc('day', o_orderdate)) AS day_us FROM orders""",
)
def convert_timestamp_layouts(spark, sf_dir):
    """Text in three layouts: fixed offset +05:30, RFC 3339, date first."""
    o = domain.table(spark, sf_dir, "orders")
    ts = F.col("o_orderdate").cast("timestamp")
    layouts = ("RFC3339Nano", "2006-01-02 15:04:05", "02/01/2006")

    def us(pattern, zone=""):
        return F.unix_micros(mp.parse_timestamp(F.date_format(ts, pattern), layouts, zone))

    return o.select("o_orderkey", us("yyyy-MM-dd HH:mm:ss", "+05:30").alias("offset_us"), us("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("plain_us"), us("dd/MM/yyyy").alias("day_us"))


_SHAPES = {
    "rfc1123": ("Mon, 02 Jan 2006 15:04:05 MST", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"),
    "ansi": ("Mon Jan _2 15:04:05 2006", "EEE MMM d HH:mm:ss yyyy"),
    "one_digit": ("1/2/2006 15:04:05", "M/d/yyyy HH:mm:ss"),
    "named": ("Jan 2 2006 15:04:05", "MMM d yyyy HH:mm:ss.SSS"),
    "full_name": ("January 02, 2006 03:04:05 PM", "MMMM dd, yyyy hh:mm:ss a"),
    "zoned": ("2006-01-02 15:04:05 -0700", "yyyy-MM-dd HH:mm:ss '-0130'"),
    "short_year": ("02.01.06 15:04", "dd.MM.yy HH:mm"),
    "fraction": ("20060102150405.000", "yyyyMMddHHmmss.SSS"),
}


@query(
    "convert_timestamp_shapes",
    "SELECT o_orderkey, " + ", ".join(
        f"epoch_us(o_orderdate) + ({'o_orderkey % 1000 * 1000' if name in ('named', 'fraction') else 0}) + {5_400_000_000 if name == 'zoned' else 0} AS {name}" for name in _SHAPES) + " FROM orders",
)
def convert_timestamp_shapes(spark, sf_dir):
    """Weekdays, one-digit and named months, half days, zones, two-digit years, fractions with and without a layout for them."""
    o = domain.table(spark, sf_dir, "orders")
    ts = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1000 * 1000)
    return o.select("o_orderkey", *[F.unix_micros(mp.parse_timestamp(F.date_format(ts, shown), (layout,), "")).alias(name) for name, (layout, shown) in _SHAPES.items()])


@query(
    "mapping_rule_checks",
    """WITH r AS (SELECT p_brand AS mapping_id, p_type || '-' || (p_partkey % 50) AS rule_id, CASE WHEN p_partkey % 9 = 0 THEN 'receipt.peer' ELSE 'event.extensions.k' || p_partkey END AS target FROM part),
 a AS (SELECT p_brand AS mapping_id, p_type AS alias, p_size % 2 AS canonical FROM part)
 SELECT mapping_id, rule_id AS subject, 'DUPLICATE_RULE' AS problem FROM r GROUP BY 1, 2 HAVING count(*) > 1
 UNION ALL SELECT mapping_id, target, 'DUPLICATE_TARGET' FROM r GROUP BY 1, 2 HAVING count(*) > 1
 UNION ALL SELECT mapping_id, target, 'TARGET_NOT_ALLOWED' FROM r WHERE target = 'receipt.peer'
 UNION ALL SELECT mapping_id, 'types/' || alias, 'ALIAS_AMBIGUOUS' FROM a GROUP BY 1, 2 HAVING count(DISTINCT canonical) > 1
 UNION ALL SELECT mapping_id, 'rules', 'TOO_MANY_RULES' FROM r GROUP BY 1 HAVING count(*) > 512""",
)
def mapping_rule_checks(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rules = p.select(
        F.col("p_brand").alias("mapping_id"), F.concat("p_type", F.lit("-"), (k % 50).cast("string")).alias("rule_id"),
        F.when(k % 9 == 0, "receipt.peer").otherwise(F.concat(F.lit("event.extensions.k"), k.cast("string"))).alias("target"),
        F.lit("string").alias("convert"), F.lit("").alias("lookup"))
    aliases = p.select(F.col("p_brand").alias("mapping_id"), F.lit("types").alias("taxonomy"), F.col("p_type").alias("alias"), (F.col("p_size") % 2).alias("canonical"))
    return mp.rule_violations(rules, aliases)
