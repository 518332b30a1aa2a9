"""SQL statements of the derived tables, for the DuckDB side of the checks.

Each entry is a CTE body; `with_views` prefixes a query with the ones it uses.
They restate the derivation rules of `domain.py` independently of Spark.
"""

from __future__ import annotations

import re

from siftlog import vocab
from siftlog.plans.domain import NOW_NS


def _pick(options: list[str], index: str) -> str:
    values = ", ".join(f"'{o}'" for o in options)
    return f"(list_value({values})[1 + ({index})])"


def _rid(e: str) -> str:
    return f"('00000000-0000-7000-8000-' || printf('%012x', {e}))"


def _vid(e: str, k: str) -> str:
    return f"('00000000-0000-7000-9' || printf('%03x', {k}) || '-' || printf('%012x', {e}))"


def _chain(text: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        text = f"replace({text}, {old}, {new})"
    return text


_NL = "chr(10)"
_QJ = "'\"' || " + _chain("f_note", [("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), (_NL, "'\\n'")]) + " || '\"'"
_CEF = _chain("f_note", [("'\\'", "'\\\\'"), ("'='", "'\\='"), (_NL, "'\\n'")])
_CSV = f"CASE WHEN regexp_matches(f_note, '[\",\\n]') THEN '\"' || replace(f_note, '\"', '\"\"') || '\"' ELSE f_note END"
_XML = _chain("f_note", [("'&'", "'&amp;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"), ("'\"'", "'&quot;'")])
_SD = _chain("f_note", [("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("']'", "'\\]'"), (_NL, "' '")])

_PAYLOAD = f"""CASE fmt
 WHEN 'malformed_json' THEN '{{"src_ip":"' || f_src || '", "action":'
 WHEN 'duplicate_json' THEN '{{"src_ip":"' || f_src || '","action":"allow","action":"' || f_action || '"}}'
 WHEN 'unknown' THEN 'VX9~a=' || f_src || '~z=' || f_action || '~opaque=17'
 WHEN 'json' THEN '{{"timestamp":"' || f_time || '","event_type":"' || f_kind || '","src_ip":"' || f_src || '","src_port":' || f_spt
   || ',"dst_ip":"' || f_dst || '","dst_port":' || f_dpt || ',"protocol":"' || f_proto || '","action":"' || f_action
   || '","severity":"' || f_severity || '","actor":{{"name":"' || f_user || '"}},"note":' || {_QJ} || ',"tags":["a","b"],"synthetic":true}}'
 WHEN 'kv' THEN 'time=' || f_time || ' type=' || f_kind || ' src=' || f_src || ' dst=' || f_dst || ' sport=' || f_spt || ' dport=' || f_dpt
   || ' proto=' || f_proto || ' action=' || f_action || ' severity=' || f_severity || ' user=' || f_user || ' note=' || {_QJ} || ' synthetic=true'
 WHEN 'cef' THEN 'CEF:0|Example|Synthetic Firewall|1.0|100|' || f_kind || '|' || f_severity || '|rt=' || f_time || ' src=' || f_src
   || ' dst=' || f_dst || ' spt=' || f_spt || ' dpt=' || f_dpt || ' proto=' || f_proto || ' act=' || f_action || ' suser=' || f_user
   || ' msg=' || {_CEF}
 WHEN 'leef' THEN 'LEEF:2.0|Example|Synthetic Sensor|1.0|' || f_kind || '|^|devTime=' || f_time || '^src=' || f_src || '^dst=' || f_dst
   || '^srcPort=' || f_spt || '^dstPort=' || f_dpt || '^proto=' || f_proto || '^action=' || f_action || '^sev=' || f_severity
   || '^usrName=' || f_user || '^msg=' || replace(f_note, {_NL}, ' ')
 WHEN 'syslog' THEN '<134>1 ' || f_time || ' edge-01 sensor - ' || f_kind || ' [net src="' || f_src || '" dst="' || f_dst || '" spt="' || f_spt
   || '" dpt="' || f_dpt || '" proto="' || f_proto || '" action="' || f_action || '" severity="' || f_severity || '" user="' || f_user
   || '" note="' || {_SD} || '"] synthetic event'
 WHEN 'csv' THEN 'timestamp,event_type,src_ip,src_port,dst_ip,dst_port,protocol,action,severity,user,note' || {_NL} || f_time || ',' || f_kind
   || ',' || f_src || ',' || f_spt || ',' || f_dst || ',' || f_dpt || ',' || f_proto || ',' || f_action || ',' || f_severity || ',' || f_user
   || ',' || {_CSV} || {_NL}
 WHEN 'xml' THEN '<?xml version="1.0" encoding="UTF-8"?>' || {_NL} || '<event synthetic="true"><timestamp>' || f_time || '</timestamp><type>'
   || f_kind || '</type><source ip="' || f_src || '" port="' || f_spt || '"/><destination ip="' || f_dst || '" port="' || f_dpt
   || '"/><protocol>' || f_proto || '</protocol><action>' || f_action || '</action><severity>' || f_severity || '</severity><user>'
   || f_user || '</user><note>' || {_XML} || '</note></event>'
 WHEN 'router' THEN upper(f_kind) || '|ts=' || f_time || '|src=' || f_src || '|dst=' || f_dst || '|action=' || f_action || '|user=' || f_user
   || '|synthetic=true' END"""

_FORMATS = ["json", "kv", "cef", "leef", "syslog", "csv", "xml", "router"]

VIEWS: dict[str, str] = {
    "pf": f"""SELECT *, epoch_us(ts) AS us,
 CASE WHEN event_id % 97 = 13 THEN 'malformed_json' WHEN event_id % 101 = 7 THEN 'unknown'
      WHEN event_id % 89 = 5 THEN 'duplicate_json' ELSE {_pick(_FORMATS, 'event_id % 8')} END AS fmt,
 strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS f_time, event_type AS f_kind,
 '10.' || (user_id % 250) || '.' || (event_id % 250) || '.' || ((event_id * 7) % 250) AS f_src,
 CASE WHEN event_id % 6 = 0 THEN '2001:db8::' || lower(to_hex(event_id % 65535 + 1)) ELSE '198.51.100.' || (event_id % 250) END AS f_dst,
 CAST(1024 + event_id % 60000 AS VARCHAR) AS f_spt, {_pick(['443', '53', '22', '99999'], 'event_id % 4')} AS f_dpt,
 {_pick(['tcp', 'UDP', 'icmp'], 'event_id % 3')} AS f_proto,
 CASE event_type WHEN 'view' THEN 'permit' WHEN 'click' THEN 'ALLOW' WHEN 'error' THEN 'blocked' WHEN 'purchase' THEN 'allow'
      ELSE 'vendor-magic' END AS f_action,
 {_pick(['low', 'warning', 'HIGH'], 'user_id % 3')} AS f_severity, 'user-' || user_id AS f_user,
 CASE event_id % 5 WHEN 0 THEN 'say "hi" ' || event_id WHEN 1 THEN 'a=b\\c, ' || event_id
      WHEN 2 THEN 'line one' || {_NL} || 'line ' || event_id WHEN 3 THEN '<tag> & ]' || event_id ELSE 'plain note ' || event_id END AS f_note
 FROM events""",
    "pl": f"SELECT *, {_PAYLOAD} AS payload FROM pf",
    "receipts": f"""SELECT event_id, {_rid('event_id')} AS receipt_id, 't' || (user_id % 4) AS tenant_id,
 {_pick(['prod', 'lab'], 'user_id % 2')} AS environment_id, 'node-' || (user_id % 3) AS instance_id, us * 1000 AS received_at_ns,
 ts AS received_at,
 {_pick(['http', 'syslog_udp', 'syslog_tcp', 'syslog_tcp'], 'event_id % 4')} AS transport,
 {_pick(['http_octets', 'datagram', 'octet_counting', 'non_transparent'], 'event_id % 4')} AS framing_mode,
 'p' || (event_id % 5) AS source_profile_id, f_src AS peer_ip, 1024 + event_id % 50000 AS peer_port,
 strftime(ts, '%Y/%m/%d/') || {_rid('event_id')} || '.bin' AS raw_ref, sha256(payload) AS raw_sha256,
 CAST(strlen(payload) AS BIGINT) AS raw_size, event_id % 11 <> 0 AS raw_available,
 {_pick(vocab.RECEIPT_STATES, '(event_id + user_id) % 6')} AS state, event_id % 4 AS attempts,
 CASE WHEN (event_id + user_id) % 6 = 1 THEN (us + 600000000) * 1000 END AS lease_until_ns, payload, fmt
 FROM pl""",
    "revisions": f"""SELECT {_vid('event_id', 'k')} AS revision_id, {_rid('event_id')} AS receipt_id, 't' || (user_id % 4) AS tenant_id,
 '1.0.' || k AS pipeline_version, {_pick(['generic-json', 'generic-kv', 'generic-cef', 'generic-syslog'], 'event_id % 4')} AS parser_id,
 sha256('bundle-' || (k % 2)) AS bundle_sha256, {_pick(vocab.STATUSES, '(event_id + 2 * k + user_id) % 5')} AS status,
 (epoch_us(ts) + least(k, 1) * 420000000 + 60000000) * 1000 AS created_at_ns,
 ((event_id * 37 + k * 11) % 1000) / 1000.0::DOUBLE AS quality_score, event_id, k
 FROM (SELECT *, unnest(range(0, event_id % 3 + 1)) AS k FROM events)""",
    "latest": """SELECT * FROM revisions rv WHERE NOT EXISTS (SELECT 1 FROM revisions newer WHERE newer.receipt_id = rv.receipt_id
 AND (newer.created_at_ns > rv.created_at_ns OR (newer.created_at_ns = rv.created_at_ns AND newer.revision_id > rv.revision_id)))""",
    "deliveries": f"""SELECT c.connector_id, revision_id, receipt_id, tenant_id, c.required,
 {_pick(vocab.DELIVERY_STATES, '(event_id * 3 + k + c.c * 2) % 5')} AS state, CAST((event_id + k) % 6 AS INTEGER) AS attempts,
 created_at_ns + (event_id % 30) * 60000000000 AS available_at_ns,
 CASE WHEN (event_id * 3 + k + c.c * 2) % 5 IN (2, 4) THEN 'CONNECTOR_TIMEOUT' END AS last_code,
 created_at_ns + c.c * 1000 + (event_id % 60) * 60000000000 AS updated_at_ns, event_id, k
 FROM revisions CROSS JOIN (VALUES ('lake', true, 0), ('siem', false, 1)) c(connector_id, required, c)""",
    "flat_events": f"""SELECT {_rid('event_id')} AS receipt_id, {_vid('event_id', 'k')} AS revision_id, 't' || (user_id % 4) AS tenant_id,
 us * 1000 AS received_at_ns, 'p' || (event_id % 5) AS source_profile_id,
 CASE WHEN event_type = 'error' THEN 2004 ELSE 4001 END AS class_uid,
 CASE WHEN event_type = 'error' THEN 'deny' WHEN event_type <> 'signup' THEN 'allow' END AS action,
 f_src AS src_ip, f_dst AS dst_ip, {_pick(vocab.STATUSES, '(event_id + 2 * k + user_id) % 5')} AS status,
 ((event_id * 37 + k * 11) % 1000) / 1000.0::DOUBLE AS quality_score, event_id, k
 FROM (SELECT *, unnest(range(0, event_id % 3 + 1)) AS k FROM pf)""",
    "holds": f"""SELECT 'hold-' || s_suppkey AS hold_id,
 CASE WHEN s_suppkey % 40 = 0 THEN 't3' ELSE 't' || (s_suppkey % 3) END AS tenant_id,
 CASE WHEN s_suppkey % 40 <> 0 THEN {_rid('s_suppkey * 3')} END AS receipt_id, s_name AS actor,
 {NOW_NS} - 86400000000000 AS created_at_ns,
 CASE WHEN s_suppkey % 5 = 0 THEN {NOW_NS} - 86400000000000 + 3600000000000 END AS expires_at_ns,
 CASE WHEN s_suppkey % 7 = 0 THEN {NOW_NS} - 86400000000000 + 60000000000 END AS released_at_ns
 FROM supplier""",
    "inventory": f"""SELECT strftime(ts, '%Y/%m/%d/') || {_rid('CASE WHEN event_id % 41 = 9 THEN event_id + 1099511627776 ELSE event_id END')} || '.bin' AS ref,
 sha256(payload || CASE WHEN event_id % 23 = 4 THEN 'x' ELSE '' END) AS sha256,
 CAST(strlen(payload) + CASE WHEN event_id % 23 = 4 THEN 1 ELSE 0 END AS BIGINT) AS size_bytes, us AS mtime_us
 FROM pl WHERE event_id % 17 <> 2 AND event_id % 11 <> 0
 UNION ALL SELECT strftime(ts, '%Y/%m/%d/') || '.' || {_rid('event_id')} || '.part.tmp', sha256(payload), CAST(strlen(payload) AS BIGINT), us
 FROM pl WHERE event_id % 59 = 3""",
}
_NEEDS = {
    "pl": ["pf"], "receipts": ["pl"], "latest": ["revisions"], "deliveries": ["revisions"], "inventory": ["pl"],
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix `sql` with the CTEs it mentions (and what those need), in order."""
    pool = {**VIEWS, **(extra or {})}
    wanted: list[str] = []

    def add(name: str) -> None:
        if name in wanted:
            return
        body = pool[name]
        for other in pool:
            if other != name and re.search(rf"\b(?:FROM|JOIN|,)\s*{other}\b", body):
                add(other)
        wanted.append(name)

    for name in pool:
        if re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", sql) or re.search(rf",\s*{name}\b(?!\s*\()", sql):
            add(name)
    if not wanted:
        return sql
    ctes = ",\n".join(f"{name} AS ({pool[name]})" for name in wanted)
    return f"WITH {ctes}\n{sql}"
