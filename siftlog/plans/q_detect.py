"""Registered queries: format detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.operators.detect import Fingerprint, Routes, detect, route_profiles
from siftlog.plans import domain
from siftlog.plans.registry import query
from siftlog.session import spread

_PARSER = """CASE fmt WHEN 'json' THEN 'generic-json' WHEN 'duplicate_json' THEN 'generic-json' WHEN 'kv' THEN 'generic-kv' WHEN 'cef' THEN 'generic-cef'
 WHEN 'leef' THEN 'generic-leef' WHEN 'syslog' THEN 'generic-syslog' WHEN 'csv' THEN 'generic-csv' WHEN 'xml' THEN 'generic-xml' WHEN 'router' THEN 'generic-router-text' END"""
_SCORE = "CASE fmt WHEN 'json' THEN 900 WHEN 'duplicate_json' THEN 900 WHEN 'xml' THEN 900 WHEN 'cef' THEN 1000 WHEN 'leef' THEN 1000 WHEN 'syslog' THEN 950 ELSE 850 END"
_LOST = "fmt IN ('malformed_json', 'unknown')"


def _raw(spark, sf_dir):
    return domain.payloads(spark, sf_dir, dealt=True).select("event_id", "user_id", "fmt", "raw")


@query(
    "detect_outcome",
    f"""SELECT event_id, CASE WHEN {_LOST} THEN 'UNKNOWN' ELSE 'SELECTED' END AS outcome,
 CASE WHEN {_LOST} THEN 'DETECT_BELOW_THRESHOLD' ELSE 'DETECT_SELECTED' END AS reason_code, {_PARSER} AS parser_id,
 CASE WHEN NOT {_LOST} THEN {_SCORE} END AS score FROM pl""",
)
def detect_outcome(spark, sf_dir):
    out = detect(_raw(spark, sf_dir), keep_read=False)
    return out.select("event_id", "detection.outcome", "detection.reason_code", "detection.parser_id", "detection.score")


@query(
    "detect_candidate_ranking",
    f"SELECT event_id, coalesce({_PARSER}, 'generic-text') AS top, CASE WHEN {_LOST} THEN 200 ELSE {_SCORE} END AS top_score, CASE WHEN {_LOST} THEN 1 ELSE 2 END AS scoring, 9 AS candidates FROM pl",
)
def detect_candidate_ranking(spark, sf_dir):
    """Best candidate, number of scoring candidates, number of candidates."""
    out = detect(_raw(spark, sf_dir), with_candidates=True, keep_read=False)
    best = F.get("candidates", F.lit(0))
    scoring = F.size(F.filter("candidates", lambda c: c["neg_score"] < 0))
    return out.select("event_id", best["parser_id"].alias("top"), (-best["neg_score"]).alias("top_score"), scoring.alias("scoring"), F.size("candidates").alias("candidates"))


@query(
    "detect_reason_codes",
    f"""SELECT event_id, CASE fmt WHEN 'json' THEN 'STRUCTURE_JSON' WHEN 'duplicate_json' THEN 'STRUCTURE_JSON' WHEN 'kv' THEN 'STRUCTURE_KEY_VALUE' WHEN 'cef' THEN 'SIGNATURE_CEF'
 WHEN 'leef' THEN 'SIGNATURE_LEEF' WHEN 'syslog' THEN 'SIGNATURE_SYSLOG_HEADER' WHEN 'csv' THEN 'STRUCTURE_CSV' WHEN 'xml' THEN 'STRUCTURE_XML' WHEN 'router' THEN 'STRUCTURE_DELIMITED_TEXT' END AS reasons
 FROM pl""",
)
def detect_reason_codes(spark, sf_dir):
    out = detect(_raw(spark, sf_dir), keep_read=False)
    return out.select("event_id", F.array_join("detection.reason_codes", ",").alias("reasons"))


@query(
    "detect_pinned_hint",
    f"SELECT event_id, CASE WHEN NOT {_LOST} THEN least(1000, {_SCORE} + CASE WHEN fmt IN ('json', 'duplicate_json') THEN 100 ELSE 0 END) END AS score FROM pl",
)
def detect_pinned_hint(spark, sf_dir):
    rows = _raw(spark, sf_dir).withColumn("pinned", F.lit("generic-json"))
    return detect(rows, pinned="pinned", keep_read=False).select("event_id", "detection.score")


@query(
    "detect_truncated_sample",
    f"""SELECT event_id, CASE WHEN strlen(payload) > 48 THEN 'RISK_SAMPLE_TRUNCATED' ELSE '' END AS risks, least(48, strlen(payload)) AS sampled_bytes
 FROM (SELECT *, 'CEF:0|a|b|c|d|e|5|msg=' || f_note AS payload FROM pf)""",
)
def detect_truncated_sample(spark, sf_dir):
    """A 48-byte sample of CEF text: the signature still decides, the risk is noted."""
    ev = domain.fields(domain.events(spark, sf_dir))
    rows = ev.select("event_id", F.concat(F.lit("CEF:0|a|b|c|d|e|5|msg="), "f_note").cast("binary").alias("raw"))
    out = detect(rows, maximum=48, keep_read=False)
    return out.select("event_id", F.array_join("detection.risk_codes", ",").alias("risks"), "detection.sampled_bytes")


@query(
    "detect_bundle_route",
    f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN fmt = 'kv' THEN 'bundle-kv' END WHEN 1 THEN NULL ELSE {_PARSER} END AS parser_id FROM pl",
)
def detect_bundle_route(spark, sf_dir):
    """Profiles p0 and p1 have an active bundle; their rows only meet its fingerprints.

    The bundle of p1 has two close, incompatible fingerprints, so nothing is selected.
    """
    rows = _raw(spark, sf_dir).withColumn("source_profile_id", F.concat(F.lit("p"), (F.col("event_id") % 5).cast("string")))
    profile = F.col("source_profile_id")
    active = rows.filter(profile.isin("p0", "p1")).select(profile, F.concat(F.lit("bundle-"), F.substring(profile, 2, 1)).alias("bundle_sha256")).distinct()
    kv = Fingerprint("bundle-kv", "kv", ("time=", "synthetic=true", "sport="), 950, 200, bundle_sha256="bundle-0")
    twins = [
        Fingerprint("twin-a", "kv", ("=",), 900, 200, bundle_sha256="bundle-1", format="a"),
        Fingerprint("twin-b", "kv", ("=",), 850, 200, bundle_sha256="bundle-1", format="b"),
    ]
    routed = route_profiles(rows, active)
    out = detect(routed, bundle="active_bundle", routes=Routes({"bundle-0": [kv], "bundle-1": twins}), keep_read=False)
    return out.select("event_id", "detection.parser_id")


def _texts(spark, sf_dir):
    docs = domain.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    pages = domain.table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    talk = domain.table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), "text")
    return docs.unionByName(pages).unionByName(talk)


@query("detect_free_text")
def detect_free_text(spark, sf_dir):
    """Detection over documents, pages and conversations (whole texts)."""
    rows = spread(_texts(spark, sf_dir).select("id", F.col("text").cast("binary").alias("raw")))
    return detect(rows, keep_read=False).groupBy("detection.outcome", "detection.reason_code", "detection.parser_id").count()
