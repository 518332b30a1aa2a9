"""Registered queries: bundle regression jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.operators import mapping as mp
from siftlog.operators import regress
from siftlog.operators.detect import Fingerprint, Routes, detect
from siftlog.operators.parse import parse, parse_captures
from siftlog.plans import bundles, domain
from siftlog.plans.q_parse import rendered
from siftlog.plans.registry import query
from siftlog.session import ensure_utc, shared_dir


def _run(spark, sf_dir, lost="false"):
    """Every event as a key=value fixture, detected, parsed and mapped; fixtures `lost` are prose."""
    raw = F.when(F.expr(lost), F.encode(F.lit("nothing to read here"), "UTF-8")).otherwise(F.col("raw"))
    rows = detect(rendered(spark, sf_dir, "kv").withColumn("raw", raw), keep_read=False).withColumn("impl", F.lit("kv"))
    out = mp.apply_mapping(parse(rows, impl="impl", only=("kv",)), bundles.MAPPINGS["kv"])
    return out.select(F.col("event_id").cast("string").alias("fixture"), "detection.outcome", F.col("parsed.status").alias("parse_status"), "mapped")


@query(
    "regress_fixture_events",
    "SELECT CAST(event_id AS VARCHAR) AS fixture, CASE WHEN event_id % 45 = 11 THEN 'NOT_SELECTED' WHEN f_action = 'vendor-magic' OR f_dpt = '99999' THEN 'NOT_NORMALIZED' "
    "WHEN event_id % 60 = 13 THEN 'NO_EXPECTED_EVENT' ELSE 'EVENT_DIFFERS' END AS problem FROM pf "
    "WHERE event_id % 45 = 11 OR f_action = 'vendor-magic' OR f_dpt = '99999' OR event_id % 50 = 8 OR event_id % 60 = 13",
)
def regress_fixture_events(spark, sf_dir):
    """Expected events are rendered from the columns; some are made to differ or left away, and some fixtures are not selected."""
    ev = domain.fields(domain.events(spark, sf_dir))
    action = F.when(F.col("f_action") == "blocked", "deny").otherwise("allow")
    sev = F.when(F.col("f_severity") == "warning", "medium").otherwise(F.lower("f_severity"))
    kind = F.col("f_kind") == "error"
    stamp = F.regexp_replace("f_time", r"\.?0*Z$", "Z")
    text = F.to_json(F.struct(
        F.when(kind, 2004).otherwise(4001).alias("class_uid"), F.when(kind, "Detection Finding").otherwise("Network Activity").alias("class_name"), stamp.alias("time"),
        F.when(F.col("event_id") % 50 == 8, "redirect").otherwise(action).alias("action"), sev.alias("severity"),
        F.struct(F.col("f_src").alias("ip"), F.col("f_spt").cast("int").alias("port")).alias("src_endpoint"),
        F.struct(F.col("f_dst").alias("ip"), F.col("f_dpt").cast("int").alias("port")).alias("dst_endpoint"),
        F.struct(F.lower("f_proto").alias("protocol_name")).alias("connection_info"), F.struct(F.struct(F.col("f_user").alias("user")).alias("actor")).alias("extensions")))
    run = _run(spark, sf_dir, lost="event_id % 45 = 11")
    return regress.fixture_failures(run, ev.filter("event_id % 60 <> 13").select(F.col("event_id").cast("string").alias("fixture"), text.alias("event_json")))


@query("regress_determinism", "SELECT event_id AS fixture FROM events WHERE event_id % 71 = 6")
def regress_determinism(spark, sf_dir):
    """Mapped events of two different physical plans (other partitions, other batches); rows that one of them alters must be found."""
    own = ensure_utc(spark.newSession())
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    own.conf.set("spark.sql.codegen.wholeStage", "false")

    def stored_run(session, altered):
        rows = _run(session, sf_dir).select(F.col("fixture").cast("bigint").alias("fixture"), F.to_json("mapped").alias("m"))
        if altered:
            rows = rows.withColumn("m", F.when(F.col("fixture") % 71 == 6, F.concat("m", F.lit(" "))).otherwise(F.col("m")))
        path = shared_dir(spark, "regress")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    return regress.unstable_keys(stored_run(spark, False), stored_run(own, True).repartition(3), ["fixture"])


@query("regress_wrongly_selected", "SELECT 'e' || event_id AS fixture FROM pl WHERE fmt = 'kv'")
def regress_wrongly_selected(spark, sf_dir):
    """Prose and events of all formats as fixtures that the fingerprint of the key=value source must not select: the events of that source are found, no prose is."""
    kv = Fingerprint("bundle-kv", "kv", ("time=", "synthetic=true", "sport="), 950, 200, bundle_sha256="b0")
    docs = domain.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("fixture"), F.col("text").cast("binary").alias("raw"))
    events = domain.payloads(spark, sf_dir).select(F.concat(F.lit("e"), "event_id").alias("fixture"), "raw")
    invalid = docs.unionByName(events).withColumn("bundle", F.lit("b0"))
    run = detect(invalid, bundle="bundle", routes=Routes({"b0": [kv]}), keep_read=False).select("fixture", "detection.outcome")
    return regress.wrongly_selected(invalid.select("fixture"), run)


@query(
    "regress_artifact_drift",
    """SELECT raw_ref AS path, CASE WHEN i.sha256 IS NULL THEN 'missing' ELSE 'changed' END AS drift FROM receipts r LEFT JOIN inventory i ON i.ref = r.raw_ref
 WHERE i.sha256 IS NULL OR i.sha256 <> r.raw_sha256""",
)
def regress_artifact_drift(spark, sf_dir):
    declared = domain.receipts(spark, sf_dir).select(F.col("raw_ref").alias("path"), F.col("raw_sha256").alias("sha256"))
    return regress.artifact_drift(declared, domain.inventory(spark, sf_dir).select(F.col("ref").alias("path"), "sha256"))


@query(
    "regress_compatibility",
    """SELECT p_partkey AS bundle_id, CASE WHEN p_partkey % 7 = 0 THEN 'SCHEMA' WHEN p_partkey % 5 = 0 THEN 'TAXONOMY' WHEN p_size > 25 THEN 'ENGINE_TOO_OLD' ELSE 'ENGINE_TOO_NEW' END AS reason
 FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 5 = 0 OR p_size > 25 OR p_partkey % 3 = 0""",
)
def regress_compatibility(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return regress.incompatible_bundles(p.select(
        k.alias("bundle_id"), F.when(k % 7 == 0, "old/1").otherwise("s/1").alias("envelope_schema"), F.when(k % 5 == 0, "0.9").otherwise("1.9").alias("taxonomy_version"),
        F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit(".0")).alias("minimum_engine"), F.when(k % 3 == 0, "1.25.0-rc.1").otherwise("").alias("maximum_engine")),
        "s/1", "1.9", "1.25.0")


@query(
    "regress_capture_fixtures",
    "SELECT page_id AS fixture, CASE WHEN page_id % 20 = 3 THEN 'MATCH_DIFFERS' ELSE 'FIELDS_DIFFER' END AS problem FROM pages WHERE page_id % 20 IN (3, 4)",
)
def regress_capture_fixtures(spark, sf_dir):
    """Captured URL parts against parts cut by string functions; two kinds of wrong expectation are put in."""
    pages = domain.table(spark, sf_dir, "pages").select(F.col("page_id").alias("fixture"), "url")
    out = parse_captures(pages, "url", "parsed", r"^(?P<scheme>https?)://(?P<host>[^/?#]+)(?P<rest>.*)$", "url")
    parsed = out.select("fixture", "parsed.status", F.try_variant_get("parsed.fields", "$", "map<string,string>").alias("fields"))
    scheme, host = F.substring_index("url", "://", 1), F.regexp_extract("url", "://([^/?#]+)", 1)
    rest = F.substr("url", F.length(scheme) + F.length(host) + 4)
    n = F.col("fixture") % 20
    want = F.create_map(F.lit("scheme"), scheme, F.lit("host"), F.when(n == 4, F.upper(host)).otherwise(host), F.lit("rest"), rest)
    return regress.capture_failures(parsed, pages.select("fixture", (n != 3).alias("matches"), want.alias("fields")))
