"""Registered queries: governed dataset export."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siftlog import vocab
from siftlog.operators import dataset as ds
from siftlog.plans import domain
from siftlog.plans.registry import query
from siftlog.session import shared_dir

FROM_NS, TO_NS = 1_704_499_200_000_000_000, 1_705_708_800_000_000_000
SPLIT = ds.Split("seed-1", 8000, 1000, 1000)
FEATURES = ds.FeatureSet("traffic", "1.0.0", (
    ds.Feature("action", "string", "event.action"), ds.Feature("class_uid", "integer", "event.class_uid", "required"),
    ds.Feature("dst_ip", "ip", "event.dst_endpoint.ip"), ds.Feature("event_time", "timestamp", "event.time"),
    ds.Feature("quality", "number", "quality.score"), ds.Feature("status", "string", "processing.status"),
))
STATUSES = ["ERROR", "PARSED", "PARTIALLY_PARSED"]


def light_envelopes(spark, sf_dir):
    """Envelope-shaped rows straight from the search columns, without interpretation."""
    f = domain.flat_events(spark, sf_dir)
    null = F.lit(None).cast("string")
    return f.select(
        F.lit(vocab.SCHEMA_VERSION).alias("schema_version"),
        F.struct(F.col("receipt_id").alias("id"), "tenant_id", "received_at_ns").alias("receipt"),
        F.struct(F.sha2("receipt_id", 256).alias("sha256")).alias("raw"),
        F.struct("revision_id", F.lit("1.0.0").alias("pipeline_version"), F.struct(F.lit("generic-kv").alias("id"), F.lit("1.0.0").alias("version")).alias("parser"),
                 F.lit("m/1.0.0").alias("mapping_version"), "status", F.lit(None).cast("double").alias("confidence"),
                 F.array(F.struct(F.lit("CODE_A").alias("code"), null.alias("stage"))).alias("issues")).alias("processing"),
        F.struct("class_uid", "action", F.col("received_at").alias("time"), F.struct(F.col("dst_ip").alias("ip")).alias("dst_endpoint"), F.lit(None).cast("variant").alias("extensions")).alias("event"),
        F.struct(F.col("quality_score").alias("score")).alias("quality"), "event_id", "k")


_SEL = f"(SELECT * FROM flat_events WHERE tenant_id = 't1' AND received_at_ns >= {FROM_NS} AND received_at_ns < {TO_NS} AND status IN ('ERROR', 'PARSED', 'PARTIALLY_PARSED'))"
_BUCKET = "CAST(('0x' || substr(sha256('seed-1' || chr(0) || revision_id), 1, 16))::UBIGINT % 10000 AS BIGINT)"
_SPLIT = f"CASE WHEN {_BUCKET} < 8000 THEN 'train' WHEN {_BUCKET} < 9000 THEN 'validation' ELSE 'test' END"


def selected(spark, sf_dir, partial="include"):
    return ds.select_envelopes(light_envelopes(spark, sf_dir), "t1", FROM_NS, TO_NS, STATUSES, partial)


query("dataset_selection", f"SELECT revision_id, status FROM {_SEL}")(lambda s, d: selected(s, d).select("processing.revision_id", "processing.status"))
query("dataset_partial_excluded", f"SELECT revision_id FROM {_SEL} WHERE status <> 'PARTIALLY_PARSED'")(lambda s, d: selected(s, d, "exclude").select("processing.revision_id"))
query("dataset_split", f"SELECT revision_id, {_SPLIT} AS split FROM revisions")(
    lambda s, d: domain.revisions(s, d).select("revision_id", ds.assign_split(F.col("revision_id"), SPLIT).alias("split")))
_STAMP = "strftime(make_timestamp(received_at_ns // 1000), '%Y-%m-%dT%H:%M:%S') || regexp_replace('.' || strftime(make_timestamp(received_at_ns // 1000), '%f'), '\\.?0*$', '') || 'Z'"
query(
    "dataset_rows",
    f"""SELECT revision_id, receipt_id, sha256(receipt_id) AS raw_sha256, 'm/1.0.0' AS mapping_version, 'CODE_A' AS codes, {_SPLIT} AS split, quality_score,
 '{{"action":' || coalesce('"' || action || '"', 'null') || ',"class_uid":' || class_uid || ',"dst_ip":"' || dst_ip || '","event_time":"' || {_STAMP} || '","quality":' || quality_score || ',"status":"' || status || '"}}' AS features_json
 FROM {_SEL}""",
)(lambda s, d: ds.dataset_rows(selected(s, d), FEATURES, SPLIT).select(
    "revision_id", "receipt_id", "raw_sha256", "mapping_version", F.array_join("issue_codes", ",").alias("codes"), "split", "quality_score", "features_json"))
query(
    "dataset_split_balance",
    f"""SELECT split, count(*) AS rows, CASE split WHEN 'train' THEN 8000 ELSE 1000 END AS expected_bp, CAST(round(count(*) * 10000.0 / sum(count(*)) OVER ()) AS BIGINT) AS actual_bp
 FROM (SELECT {_SPLIT} AS split FROM {_SEL}) GROUP BY 1""",
)(lambda s, d: ds.split_balance(ds.dataset_rows(selected(s, d), FEATURES, SPLIT), SPLIT))


def digest_sql(table: str, levels: int = 8) -> str:
    """The tree digest of the ids of `table`, level by level from `levels` bytes of their hash (which must tell all ids apart)."""
    steps = [f"n{levels} AS (SELECT substr(sha256(revision_id), 1, {2 * levels}) AS p, sha256(revision_id) AS dg, 0 AS depth, 1 AS ids FROM {table})"]
    for k in range(levels - 1, -1, -1):
        steps.append(
            f"n{k} AS (SELECT substr(p, 1, {2 * k}) AS p, CASE WHEN count(*) = 1 THEN min(dg) ELSE sha256(string_agg(substr(p, {2 * k + 1}, 2) || '=' || dg || chr(10), '' ORDER BY p)) END AS dg,"
            f" CASE WHEN count(*) = 1 THEN max(depth) ELSE greatest(max(depth), {k + 1}) END AS depth, CAST(sum(ids) AS BIGINT) AS ids FROM n{k + 1} GROUP BY 1)")
    return ", ".join(steps)


query("dataset_revision_digest", f"SELECT ids AS revisions, depth, dg AS revision_digest FROM (WITH {digest_sql('revisions')} SELECT * FROM n0)")(
    lambda s, d: ds.revision_digest(domain.revisions(s, d)))
query("dataset_duplicate_revisions", "SELECT revision_id, count(*) AS count FROM (SELECT revision_id FROM revisions UNION ALL SELECT revision_id FROM revisions WHERE k = 2) GROUP BY 1 HAVING count(*) > 1")(
    lambda s, d: ds.duplicate_revisions(domain.revisions(s, d).select("revision_id").unionByName(domain.revisions(s, d).filter("k = 2").select("revision_id"))))


SELECTION = {"received_from": FROM_NS, "received_to": TO_NS, "statuses": STATUSES}
_MARK = 9_876_543_210
_ID_PARTS = [p.replace("'", "''") for p in ds.identity_text("t1", FEATURES, SELECTION, _MARK, str(_MARK), SPLIT).split(str(_MARK))]
_ID = f"sha256('{_ID_PARTS[0]}' || ids || '{_ID_PARTS[1]}' || dg || '{_ID_PARTS[2]}')"


@query(
    "dataset_publish",
    f"""SELECT {_ID} AS dataset_id, ids AS rows, depth, dg AS revision_sha256, first_id, last_id, true AS files_match, 0 AS out_of_order
 FROM (WITH sel AS (SELECT revision_id FROM {_SEL}), {digest_sql('sel')} SELECT n0.*, (SELECT min(revision_id) FROM sel) AS first_id, (SELECT max(revision_id) FROM sel) AS last_id FROM n0)""",
)
def dataset_publish(spark, sf_dir):
    """Publish over what a dead run left, publish again (a check only), and hold the files against the manifest."""
    rows = ds.dataset_rows(selected(spark, sf_dir), FEATURES, SPLIT)
    root = shared_dir(spark, "dataset")
    digest = ds.revision_digest(rows).first()
    did = ds.dataset_identity("t1", FEATURES, SELECTION, digest["revisions"], digest["revision_digest"], SPLIT)
    rows.write.parquet(f"{root}/tenant=t1/dataset={did}/run=dead")
    for _ in range(2):
        manifest = ds.publish(rows, root, "t1", did, digest, file_bytes=1 << 20)
    back = ds.read_dataset(spark, root, "t1", did)
    file, at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")
    inside = back.select("revision_id", file, at).withColumn("before", F.lag("revision_id").over(Window.partitionBy("file").orderBy("at")))
    per_file = inside.groupBy("file").agg(
        F.min("revision_id").alias("lo"), F.max("revision_id").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("before") >= F.col("revision_id")).alias("bad"))
    # One row a file, as many as the manifest has: no file begins before the one ahead of it ends.
    ahead = F.lag("hi").over(Window.partitionBy(F.lit(1)).orderBy("lo"))
    found = per_file.withColumn("ahead", ahead).agg(
        F.sum("n").alias("rows"), F.min("lo").alias("first_id"), F.max("hi").alias("last_id"), (F.sum("bad") + F.count_if(F.col("ahead") >= F.col("lo"))).cast("int").alias("out_of_order"), F.count(F.lit(1)).alias("files"))
    held = manifest.groupBy("dataset_id", "digest_depth", "revision_sha256", "total_rows").agg(F.sum("rows").alias("listed"), F.count_if(F.col("rows") > 0).alias("named"))
    match = (F.col("listed") == F.col("rows")) & (F.col("total_rows") == F.col("rows")) & (F.col("named") == F.col("files"))
    return held.join(found).select(
        "dataset_id", "rows", F.col("digest_depth").alias("depth"), "revision_sha256", "first_id", "last_id", match.alias("files_match"), "out_of_order")


@query(
    "dataset_manifest_checks",
    """SELECT 'd-' || p_partkey AS dataset_id, 'BASIS_POINTS' AS problem FROM part WHERE p_partkey % 7 = 1 UNION ALL SELECT 'd-' || p_partkey, 'ROW_COUNT' FROM part WHERE p_partkey % 7 = 2
 UNION ALL SELECT 'd-' || p_partkey, 'ARTIFACT' FROM part WHERE p_partkey % 7 = 3 UNION ALL SELECT 'd-' || p_partkey, 'STATUSES' FROM part WHERE p_partkey % 7 = 4
 UNION ALL SELECT 'd-' || p_partkey, 'BOUNDS' FROM part WHERE p_partkey % 7 = 5""",
)
def dataset_manifest_checks(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    c = F.col("p_partkey") % 7
    return ds.manifest_violations(p.select(
        F.concat(F.lit("d-"), F.col("p_partkey").cast("string")).alias("dataset_id"), F.lit("t1").alias("tenant_id"),
        F.when(c == 5, 9).otherwise(1).alias("received_from_ns"), F.lit(5).alias("received_to_ns"),
        F.when(c == 4, F.array(F.lit("PARSED"), F.lit("ERROR"))).otherwise(F.array(F.lit("ERROR"), F.lit("PARSED"))).alias("statuses"), F.lit("include").alias("partial_policy"),
        F.lit(10).alias("revision_count"), F.sha2("p_name", 256).alias("revision_sha256"), F.lit("s").alias("seed"), F.when(c == 1, 9000).otherwise(8000).alias("train"),
        F.lit(1000).alias("validation"), F.lit(1000).alias("test"), F.lit("parquet").alias("artifact_format"), F.when(c == 3, "../x.parquet").otherwise("a/x.parquet").alias("artifact_path"),
        F.sha2("p_name", 256).alias("artifact_sha256"), F.when(c == 2, 9).otherwise(10).alias("artifact_rows")))


@query(
    "dataset_feature_checks",
    """SELECT 's-' || (c_custkey % 40) AS set_id, 'f' || c_custkey AS name, 'TYPE' AS problem FROM customer WHERE c_custkey % 6 = 1
 UNION ALL SELECT 's-' || (c_custkey % 40), 'f' || c_custkey, 'SOURCE_PATH' FROM customer WHERE c_custkey % 6 = 2
 UNION ALL SELECT set_id, name, 'NOT_ORDERED' FROM (SELECT 's-' || (c_custkey % 40) AS set_id, 'f' || c_custkey AS name, lag('f' || c_custkey) OVER (PARTITION BY c_custkey % 40 ORDER BY c_custkey) AS p FROM customer) WHERE p >= name
 UNION ALL SELECT 's-' || (c_custkey % 40), CASE WHEN c_custkey % 6 = 2 THEN 'raw.p' ELSE 'event.p' END || (c_custkey // 80), 'DUPLICATE_PATH' FROM customer GROUP BY 1, 2 HAVING count(*) > 1""",
)
def dataset_feature_checks(spark, sf_dir):
    c = domain.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return ds.feature_violations(c.select(
        F.concat(F.lit("s-"), (k % 40).cast("string")).alias("set_id"), k.alias("position"), F.concat(F.lit("f"), k.cast("string")).alias("name"),
        F.when(k % 6 == 1, "blob").otherwise("string").alias("type"), F.concat(F.when(k % 6 == 2, "raw.p").otherwise("event.p"), F.expr("c_custkey div 80").cast("string")).alias("source_path"),
        F.lit("nullable").alias("null_policy")))
