"""Registered queries: one round trip per parser, over every event."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.operators.parse import parse, parse_captures, document_limits, parse_kv
from siftlog.plans import domain
from siftlog.plans.registry import query
from siftlog.session import spread
from siftlog.sources import render

NAMES = ["time", "kind", "src", "dst", "spt", "dpt", "proto", "action", "severity", "user", "note"]


def rendered(spark, sf_dir, fmt):
    """Every event rendered in one format."""
    ev = domain.fields(domain.events(spark, sf_dir, dealt=True))
    body = render.payload(F.lit(fmt), {n: F.col(f"f_{n}") for n in NAMES})
    return ev.select("event_id", body.cast("binary").alias("raw"))


def parsed_as(spark, sf_dir, fmt, impl=None):
    rows = rendered(spark, sf_dir, fmt).withColumn("impl", F.lit(impl or fmt))
    return parse(rows, impl="impl", only=(impl or fmt,))


def _get(path):
    return F.try_variant_get("parsed.fields", path, "string")


def _round_trip(name, fmt, paths, note=None, status="PARSED"):
    cols = ", ".join(f"f_{role} AS {role}" if role != "note" else f"{note or 'f_note'} AS note" for role in paths)

    @query(name, f"SELECT event_id, '{status}' AS status, {cols} FROM pf")
    def run(spark, sf_dir):
        out = parsed_as(spark, sf_dir, fmt)
        return out.select("event_id", "parsed.status", *[_get(p).alias(r) for r, p in paths.items()])

    return run


_round_trip("parse_json", "json", {"time": "$.timestamp", "kind": "$.event_type", "src": "$.src_ip", "spt": "$.src_port", "dst": "$.dst_ip",
                                   "action": "$.action", "user": "$.actor.name", "note": "$.note"})
_round_trip("parse_kv", "kv", {r: f"$.attributes.{k}" for r, k in {"time": "time", "kind": "type", "src": "src", "dst": "dst", "spt": "sport", "dpt": "dport",
                                                                  "proto": "proto", "action": "action", "severity": "severity", "user": "user", "note": "note"}.items()})
_round_trip("parse_cef", "cef", {"kind": "$.header.name", "severity": "$.header.severity", **{r: f"$.extension.{k}" for r, k in {
    "time": "rt", "src": "src", "dst": "dst", "spt": "spt", "dpt": "dpt", "proto": "proto", "action": "act", "user": "suser", "note": "msg"}.items()}})
_round_trip("parse_leef", "leef", {"kind": "$.header.event_id", **{r: f"$.attributes.{k}" for r, k in {
    "time": "devTime", "src": "src", "dst": "dst", "spt": "srcPort", "action": "action", "severity": "sev", "user": "usrName", "note": "msg"}.items()}},
    note="replace(f_note, chr(10), ' ')")
_round_trip("parse_csv", "csv", {r: f"$.records[0].{k}" for r, k in {"time": "timestamp", "kind": "event_type", "src": "src_ip", "dst": "dst_ip",
                                                                    "action": "action", "user": "user", "note": "note"}.items()})
_round_trip("parse_xml", "xml", {"time": "$.event.timestamp", "kind": "$.event.type", "src": "$.event.source['@attributes'].ip", "spt": "$.event.source['@attributes'].port",
                                 "action": "$.event.action", "user": "$.event.user", "note": "$.event.note"})
_round_trip("parse_syslog_5424", "syslog", {"time": "$.timestamp", "kind": "$.msg_id", **{
    r: f"$.structured_data[0].parameters[{i}].value" for i, r in enumerate(["src", "dst", "spt", "dpt", "proto", "action", "severity", "user", "note"])}},
    note="replace(f_note, chr(10), ' ')")


@query(
    "parse_syslog_3164",
    """SELECT event_id, 'PARTIALLY_PARSED' AS status, 'SYSLOG_RFC3164_YEAR_UNKNOWN' AS codes, CAST(event_id % 24 AS BIGINT) AS facility, CAST(event_id % 8 AS BIGINT) AS severity,
 CAST(1 + event_id % 12 AS BIGINT) AS month, CAST(1 + event_id % 28 AS BIGINT) AS day, f_user AS tag, CAST(event_id AS VARCHAR) AS proc_id, f_note AS message FROM pf""",
)
def parse_syslog_3164(spark, sf_dir):
    ev = domain.fields(domain.events(spark, sf_dir, dealt=True))
    e = F.col("event_id")
    months = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    day = F.lpad((1 + e % 28).cast("string"), 2, " ")
    text = F.concat(F.lit("<"), ((e % 24) * 8 + e % 8).cast("string"), F.lit(">"), domain.pick(months, e % 12), F.lit(" "), day,
                    F.lit(" 03:04:05 edge-01 "), "f_user", F.lit("["), e.cast("string"), F.lit("]: "), "f_note")
    out = parse(ev.select("event_id", text.cast("binary").alias("raw"), F.lit("syslog").alias("impl")), impl="impl", only=("syslog",))

    def num(p):
        return F.try_variant_get("parsed.fields", p, "bigint")

    return out.select(
        "event_id", "parsed.status", F.array_join(F.transform("parsed.issues", lambda i: i["code"]), ",").alias("codes"),
        num("$.facility").alias("facility"), num("$.severity").alias("severity"), num("$.timestamp_month").alias("month"), num("$.timestamp_day").alias("day"),
        _get("$.tag").alias("tag"), _get("$.proc_id").alias("proc_id"), F.try_variant_get("parsed.fields", "$.message", "binary").cast("string").alias("message"))


@query(
    "parse_named_captures",
    r"""SELECT page_id, CASE WHEN scheme <> '' THEN 'PARSED' ELSE 'INVALID' END AS status, scheme, host, nullif(query, '') AS query FROM (SELECT page_id,
 regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', 1) AS scheme, regexp_extract(url, '^(https?)://([^/?#]+)', 2) AS host,
 regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$', 4) AS query FROM pages)""",
)
def parse_named_captures(spark, sf_dir):
    pattern = r"^(?P<scheme>https?)://(?P<host>[^/?#]+)(?P<path>[^?#]*)(?:\?(?P<query>[^#]*))?(?:#(?P<fragment>.*))?$"
    pages = domain.table(spark, sf_dir, "pages").select("page_id", "url")
    out = parse_captures(pages, "url", "parsed", pattern, "url", required=("scheme",))
    return out.select("page_id", "parsed.status", _get("$.scheme").alias("scheme"), _get("$.host").alias("host"), F.nullif(_get("$.query"), F.lit("")).alias("query"))


@query(
    "parse_unmatched_text",
    r"""SELECT doc_id, 'INVALID' AS status, 'KV_TOKEN_MALFORMED' AS code, strlen(ltrim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS unmatched_bytes FROM documents
 WHERE NOT regexp_matches(text, '^[ \t\r\n]*[A-Za-z0-9_.:-]+=') AND trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''""",
)
def parse_unmatched_text(spark, sf_dir):
    """Prose handed to the key=value parser: everything is kept as unmatched bytes."""
    docs = domain.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = parse_kv(spread(docs), "text", "parsed")
    return out.select("doc_id", "parsed.status", F.get("parsed.issues", F.lit(0))["code"].alias("code"), F.octet_length("parsed.unmatched").cast("bigint").alias("unmatched_bytes"))


@query(
    "parse_duplicate_keys",
    "SELECT event_id, 'PARTIALLY_PARSED' AS status, f_kind || '|' || f_user || '|' || f_src AS repeated, f_proto AS single, 2 AS duplicate_issues FROM pf",
)
def parse_duplicate_keys(spark, sf_dir):
    ev = domain.fields(domain.events(spark, sf_dir, dealt=True))
    text = F.concat(F.lit("a="), "f_kind", F.lit(" b="), "f_proto", F.lit(" a="), "f_user", F.lit(" a="), "f_src")
    out = parse_kv(ev.select("event_id", text.alias("t")), "t", "parsed")
    repeated = F.array_join(F.try_variant_get("parsed.fields", "$.attributes.a", "array<string>"), "|")
    dup = F.size(F.filter("parsed.issues", lambda i: i["code"] == "KV_DUPLICATE_KEY"))
    return out.select("event_id", "parsed.status", repeated.alias("repeated"), _get("$.attributes.b").alias("single"), dup.alias("duplicate_issues"))


@query(
    "parse_limits",
    "SELECT s_suppkey, CASE WHEN 4000 + s_suppkey * 2 > 4096 THEN 'KV_FIELD_LIMIT_EXCEEDED' END AS hit_limit FROM supplier",
)
def parse_limits(spark, sf_dir):
    s = spread(domain.table(spark, sf_dir, "supplier").select("s_suppkey"))
    pairs = F.transform(F.sequence(F.lit(1), (F.lit(4000) + F.col("s_suppkey") * 2).cast("int")), lambda i: F.concat(F.lit("k"), i.cast("string"), F.lit("=v")))
    out = parse_kv(s.select("s_suppkey", F.array_join(pairs, " ").alias("t")), "t", "parsed")
    return out.select("s_suppkey", document_limits().alias("hit_limit"))
