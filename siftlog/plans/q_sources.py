"""Registered queries: evidence scans, admission, framing, sinks."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siftlog.functions.ip import ip_key
from siftlog.plans import domain
from siftlog.plans.registry import query
from siftlog.session import shared_dir
from siftlog.sources import configs, evidence, sinks
from siftlog.sources.commits import MANY_FILES


_FILE = "s_name || ' ' || s_nationkey || chr(10)"


@query(
    "scan_evidence_files",
    f"""SELECT s_suppkey, CASE WHEN s_suppkey % 13 = 5 THEN 'missing' WHEN s_suppkey % 7 = 3 OR s_suppkey % 11 = 4 THEN 'corrupt' ELSE 'verified' END AS verdict,
 CASE WHEN s_suppkey % 13 <> 5 THEN sha256({_FILE}) END AS sha256, CASE WHEN s_suppkey % 13 <> 5 THEN strlen({_FILE}) END AS size_bytes FROM supplier""",
)
def scan_evidence_files(spark, sf_dir):
    """Write a file for every supplier but some, scan the files, and hold them against references of which some name another digest or size."""
    domain.ensure_utc(spark)
    k, path = F.col("s_suppkey"), shared_dir(spark, "evidence")
    rows = domain.table(spark, sf_dir, "supplier").withColumn("line", F.concat("s_name", F.lit(" "), F.col("s_nationkey").cast("string")))
    held = rows.filter(k % 13 != 5).select(k.alias("key"), "line")
    dealt = held.repartition(spark.sparkContext.defaultParallelism, "key")  # rows that repeat a key share its file
    dealt.write.partitionBy("key").option("lineSep", "\n").options(**MANY_FILES).text(path)
    files = evidence.scan_files(spark, path).select(F.regexp_extract("path", "/key=([0-9]+)/[^/]*$", 1).alias("ref"), "raw")
    whole = F.concat("line", F.lit("\n"))
    declared = rows.select(
        "s_suppkey", k.cast("string").alias("ref"), F.sha2(F.when(k % 7 == 3, F.upper(F.concat(whole, F.lit("x")))).otherwise(whole).cast("binary"), 256).alias("sha256"),
        (F.octet_length(whole) + F.when(k % 11 == 4, 1).otherwise(0)).alias("size_bytes"))
    return evidence.verify_files(declared, files).select("s_suppkey", "found.verdict", "found.sha256", "found.size_bytes")


def _frames(spark, sf_dir):
    e = F.col("event_id")
    return domain.payloads(spark, sf_dir).select(
        "event_id", domain.receipt_id(e).alias("receipt_id"), F.lit("t1").alias("tenant_id"), F.when(e % 19 == 3, " ").otherwise("listener-main").alias("listener_id"),
        domain.pick(["", "syslog_udp", "syslog_tcp", "smtp"], e % 4).alias("transport"), domain.pick(["", "datagram", "octet_counting"], e % 3).alias("framing_mode"),
        (e % 13 != 5).alias("frame_complete"), (F.col("us") * 1000).alias("received_at_ns"), "raw")


_LEGAL = """(e4 = 0 AND e3 = 0) OR (e4 = 1 AND e3 IN (0, 1)) OR (e4 = 2 AND e3 = 2)"""
_ADMIT = f"""(SELECT *, CASE WHEN event_id % 19 = 3 THEN 'INVALID_REQUEST' WHEN NOT ({_LEGAL}) THEN 'INVALID_FRAMING' WHEN event_id % 13 = 5 THEN 'FRAME_INCOMPLETE'
 WHEN strlen(payload) > 280 THEN 'PAYLOAD_TOO_LARGE' END AS reason FROM (SELECT *, event_id % 4 AS e4, event_id % 3 AS e3 FROM pl))"""
query(
    "admit_receipts",
    f"""SELECT '00000000-0000-7000-8000-' || printf('%012x', event_id) AS receipt_id, CASE e4 WHEN 0 THEN 'http' WHEN 1 THEN 'syslog_udp' ELSE 'syslog_tcp' END AS transport,
 CASE e4 WHEN 0 THEN 'http_octets' WHEN 1 THEN 'datagram' ELSE 'octet_counting' END AS framing_mode, sha256(payload) AS raw_sha256, strlen(payload) AS raw_size,
 strftime(ts, '%Y-%m-%d') AS day, 'ACCEPTED' AS state FROM {_ADMIT} WHERE reason IS NULL""",
)(lambda s, d: evidence.admit(_frames(s, d), 280)[0].select("receipt_id", "transport", "framing_mode", "raw_sha256", "raw_size", F.date_format("date", "yyyy-MM-dd").alias("day"), "state"))
query("admit_rejects", f"SELECT '00000000-0000-7000-8000-' || printf('%012x', event_id) AS receipt_id, reason FROM {_ADMIT} WHERE reason IS NOT NULL")(
    lambda s, d: evidence.admit(_frames(s, d), 280)[1].select("receipt_id", "reason"))


@query(
    "deframe_delimited",
    """SELECT conv_id || '-' || turn AS capture_id, frame_no, frame, CASE WHEN frame_no = n - 1 THEN 'FRAME_INCOMPLETE' WHEN frame = '' THEN 'EMPTY_FRAME' END AS error FROM
 (SELECT conv_id, turn, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS frame_no, unnest(parts) AS frame, len(parts) AS n FROM (SELECT *, string_split(text, chr(10)) AS parts FROM conversations))
 WHERE NOT (frame_no = n - 1 AND frame = '')""",
)
def deframe_delimited(spark, sf_dir):
    c = domain.table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("capture_id"), "text")
    return evidence.split_delimited(c)


@query(
    "deframe_octet_counted",
    """SELECT conv_id, turn, CASE WHEN l = 0 THEN 0 ELSE 2 END AS frames, CASE WHEN l > 0 THEN CAST(l + strlen(role) AS BIGINT) END AS bytes,
 CASE WHEN l = 0 OR conv_id % 3 = 0 THEN 'INVALID_OCTET_COUNT' WHEN conv_id % 3 = 1 THEN 'FRAME_INCOMPLETE' END AS error FROM (SELECT *, strlen(coalesce(text, '')) AS l FROM conversations)""",
)
def deframe_octet_counted(spark, sf_dir):
    """Two framed messages per capture, then a bad count or a cut-off frame; an empty message has a count of 0, which is no count."""
    c = domain.table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    n = lambda col: F.octet_length(col).cast("string")
    tail = domain.pick(["x9 abc", "99 short", ""], F.col("conv_id") % 3)
    data = F.concat(n("text"), F.lit(" "), "text", n("role"), F.lit(" "), "role", tail).cast("binary")
    frames = evidence.split_octet_counted(c.select(F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("capture_id"), data.alias("data")))
    per = frames.groupBy("capture_id").agg(F.count_if(F.col("error").isNull()).cast("int").alias("frames"), F.sum(F.octet_length("frame")).alias("bytes"), F.max("error").alias("error"))
    ids = F.split("capture_id", "-")
    return per.select(F.get(ids, F.lit(0)).cast("bigint").alias("conv_id"), F.get(ids, F.lit(1)).cast("bigint").alias("turn"), "frames", "bytes", "error")


@query(
    "source_profile_lookup",
    """SELECT event_id, CASE WHEN user_id % 250 = 7 THEN 'narrow' WHEN user_id % 250 < 16 THEN 'wide' WHEN user_id % 250 < 128 THEN 'half' ELSE '' END AS profile FROM events""",
)
def source_profile_lookup(spark, sf_dir):
    rows = domain.fields(domain.events(spark, sf_dir)).select("event_id", domain.receipt_id(F.col("event_id")).alias("receipt_id"), F.col("f_src").alias("peer_ip"))
    nets = spark.createDataFrame([("10.0.0.0/9", "half"), ("10.0.0.0/12", "wide"), ("10.7.0.0/16", "narrow"), ("2001:db8::/32", "v6")], "cidr string, profile string")
    return evidence.assign_profiles(rows, nets).select("event_id", "profile")


@query(
    "source_profile_per_customer",
    """SELECT e.event_id, coalesce(max('c' || c.c_custkey), '') AS profile FROM events e LEFT JOIN customer c
 ON c.c_custkey % 250 = e.user_id % 250 AND (c.c_custkey // 250) % 250 = e.event_id % 250 GROUP BY 1""",
)
def source_profile_per_customer(spark, sf_dir):
    """One /24 network per customer: the list grows with the table, the plan stays."""
    rows = domain.fields(domain.events(spark, sf_dir)).select("event_id", F.col("f_src").alias("peer_ip"))
    key = F.col("c_custkey")
    third = F.call_function("div", key, F.lit(250)) % 250
    nets = domain.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("10."), (key % 250).cast("string"), F.lit("."), third.cast("string"), F.lit(".0/24")).alias("cidr"), F.concat(F.lit("c"), key.cast("string")).alias("profile"))
    return evidence.assign_profiles(rows, nets).select("event_id", "profile")


@query("ip_sort_key", "SELECT event_id, printf('00000000000000000000ffff%02x%02x%02x%02x', 10, user_id % 250, event_id % 250, (event_id * 7) % 250) AS key FROM events")
def ip_sort_key(spark, sf_dir):
    rows = domain.fields(domain.events(spark, sf_dir))
    return rows.select("event_id", ip_key(F.col("f_src")).alias("key"))


def _flat(spark, sf_dir):
    f = domain.flat_events(spark, sf_dir)
    return f.withColumn("envelope_json", F.concat(F.lit('{"id":"'), "revision_id", F.lit('"}'))).drop("event_id", "k")


@query("sink_parquet_partitions", "SELECT tenant_id AS tenant, strftime(make_timestamp(received_at_ns // 1000), '%Y-%m-%d') AS day, count(*) AS rows, 0 AS unsorted FROM flat_events GROUP BY 1, 2")
def sink_parquet_partitions(spark, sf_dir):
    """Write tenant/date partitions, read them back, check the order inside each file."""
    path = shared_dir(spark, "lake")
    sinks.write_partitioned(_flat(spark, sf_dir), path)
    back = sinks.read_table(spark, path).withColumn("file", F.input_file_name()).withColumn("pos", F.monotonically_increasing_id())
    prev = F.lag("revision_id").over(Window.partitionBy("file").orderBy("pos"))
    return back.withColumn("p", prev).groupBy("tenant", F.date_format("date", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p") > F.col("revision_id")).cast("int").alias("unsorted"))


@query("sink_monthly_table", "SELECT strftime(make_timestamp(received_at_ns // 1000), '%Y%m') AS yyyymm, tenant_id, count(*) AS rows FROM flat_events GROUP BY 1, 2")
def sink_monthly_table(spark, sf_dir):
    path = shared_dir(spark, "monthly")
    sinks.write_monthly(_flat(spark, sf_dir), path)
    return sinks.read_table(spark, path).groupBy(F.col("yyyymm").cast("string").alias("yyyymm"), "tenant_id").agg(F.count(F.lit(1)).alias("rows"))


@query("sink_ndjson", "SELECT revision_id AS id, receipt_id AS receipt, tenant_id AS tenant, received_at_ns AS at, 'a \"b\" \\ é' || chr(10) || receipt_id AS note FROM flat_events")
def sink_ndjson(spark, sf_dir):
    """Documents of several fields, one with quotes, a backslash and a line break, written as lines and read strictly."""
    path = shared_dir(spark, "ndjson")
    document = F.to_json(F.struct(
        F.col("revision_id").alias("id"), F.col("receipt_id").alias("receipt"), F.col("tenant_id").alias("tenant"), F.col("received_at_ns").alias("at"),
        F.concat(F.lit('a "b" \\ é\n'), "receipt_id").alias("note")))
    sinks.write_envelopes_ndjson(_flat(spark, sf_dir).withColumn("envelope_json", document), path)
    return spark.read.schema("id string, receipt string, tenant string, at bigint, note string").option("mode", "FAILFAST").json(path)


VERSIONS = {"mapping": "mapping/1", "taxonomies": "taxonomies/1", "parser": "parser/1", "fingerprints": "fingerprints/1"}


def config_files(spark, sf_dir):
    """A bundle file for every customer; one in two has a fault of its own."""
    k = F.col("c_custkey")
    c = k % 16
    kind = F.when(c.isin(4, 5, 11), "taxonomies").when(c.isin(6, 7, 12), "fingerprints").when(c == 8, "parser").otherwise("mapping")

    def when(number, text):
        return F.when(c == number, text).otherwise("")

    body = (
        F.when(kind == "mapping", F.concat(
            F.lit('{"config_version":"'), F.when(c == 3, "mapping/2").otherwise("mapping/1"), F.lit('","id":"m'), k.cast("string"), F.lit('","version":"1.0.0"'),
            when(1, ',"guess":1'), when(9, ',"rules":{}'), F.when(c != 9, F.concat(
                F.lit(',"rules":[{"id":"a","from":"fields.a","to":"event.action","convert":"lowercase","lookup":"t"},{"id":"b","from":"fields.b","to":"event.time","convert":"timestamp","required":true'),
                when(2, ',"guess":true'), F.lit("}]"))).otherwise(""),
            F.lit(',"taxonomies":{"t":{"allow":["permit"],"deny":["drop"'), when(10, ',"permit"'), F.lit("]}}}")))
        .when(kind == "taxonomies", F.concat(
            F.lit('{"config_version":"taxonomies/1","taxonomies":{"u":{"low":[],"high":["severe"]}}'), when(4, ',"rules":[]'), F.when(c == 11, "").otherwise("}")))
        .when(kind == "fingerprints", F.concat(
            F.lit('{"config_version":"fingerprints/1","fingerprints":[{"parser_id":"p","required_literals":["x"],"score":900'), when(6, ',"regex":".*"'), F.lit("}]"), when(12, ',"id":"f"'), F.lit("}")))
        .otherwise(F.lit('{"config_version":"parser/1","id":"p","version":"1.0.0","format":"kv","command":"sh"}'))
    )
    return domain.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("file"), kind.alias("kind"), body.alias("body"))


query(
    "rule_scan_violations",
    """SELECT 'c' || c_custkey AS file, p AS place, v AS problem, q AS key FROM customer JOIN (VALUES (1, '$', 'UNKNOWN_KEY', 'guess'), (2, '$.rules[1]', 'UNKNOWN_KEY', 'guess'),
 (3, '$', 'CONFIG_VERSION', NULL), (4, '$', 'UNKNOWN_KEY', 'rules'), (6, '$.fingerprints[0]', 'UNKNOWN_KEY', 'regex'), (8, '$', 'UNKNOWN_KEY', 'command'), (9, '$.rules', 'NOT_A_LIST', NULL),
 (10, '$.taxonomies.t', 'REPEATED_ALIAS', 'permit'), (11, '$', 'NOT_JSON', NULL), (12, '$', 'UNKNOWN_KEY', 'id')) f(c, p, v, q) ON c_custkey % 16 = f.c""",
)(lambda s, d: configs.config_violations(config_files(s, d), VERSIONS))
query(
    "rule_scan",
    """SELECT 'c' || c_custkey AS file, 'm' || c_custkey AS mapping_id, '1.0.0' AS mapping_version, rule_ord, rule_id, source, target, convert, lookup, required FROM customer,
 (VALUES (0, 'a', 'fields.a', 'event.action', 'lowercase', 't', false), (1, 'b', 'fields.b', 'event.time', 'timestamp', '', true)) r(rule_ord, rule_id, source, target, convert, lookup, required)
 WHERE c_custkey % 16 IN (0, 13, 14, 15)""",
)(lambda s, d: configs.rule_rows(config_files(s, d), VERSIONS))
query(
    "rule_scan_aliases",
    """SELECT 'c' || c_custkey AS file, taxonomy, alias, canonical FROM customer, (VALUES ('t', 'allow', 'allow'), ('t', 'permit', 'allow'), ('t', 'deny', 'deny'), ('t', 'drop', 'deny'),
 ('u', 'low', 'low'), ('u', 'high', 'high'), ('u', 'severe', 'high'), ('x', 'permit', 'deny')) a(tx, alias, canonical), LATERAL (SELECT CASE tx WHEN 'x' THEN 't' ELSE tx END AS taxonomy)
 WHERE CASE tx WHEN 'u' THEN c_custkey % 16 IN (4, 5) WHEN 'x' THEN c_custkey % 16 = 10 ELSE c_custkey % 16 NOT IN (4, 5, 6, 7, 8, 11, 12) END""",
)(lambda s, d: configs.alias_rows(config_files(s, d)))
