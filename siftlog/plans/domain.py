"""Domain tables derived from the given Parquet tables.

The test tables hold no security logs, so receipts, raw payloads, revisions,
deliveries, holds and inventories are derived from `events` (and for small
dimensions from `supplier` and `nation`) with row-local expressions. Every row
of the source takes part. `oracle_views.py` states the same rules as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlog import vocab
from siftlog.session import ensure_utc, spread
from siftlog.sources import render

# One reference instant for every age, retention and dashboard query.
NOW_US = 1_706_659_200_000_000  # 2024-01-31T00:00:00Z
NOW_NS = NOW_US * 1000
MINUTE_US = 60_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(options: list[str], index: Column) -> Column:
    """options[index] as a literal array lookup."""
    return F.get(F.array(*[F.lit(o) for o in options]), index.cast("int"))


def receipt_id(event_id: Column) -> Column:
    return F.concat(F.lit("00000000-0000-7000-8000-"), F.format_string("%012x", event_id))


def revision_id(event_id: Column, k: Column) -> Column:
    return F.concat(F.lit("00000000-0000-7000-9"), F.format_string("%03x", k), F.lit("-"), F.format_string("%012x", event_id))


def events(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """`dealt`: for CPU-bound work, spread over tasks before anything is derived."""
    ev = table(spark, sf_dir, "events")
    ev = spread(ev) if dealt else ev
    return ev.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def fields(ev: DataFrame) -> DataFrame:
    """Columns a payload is rendered from."""
    e, u = F.col("event_id"), F.col("user_id")
    fmt = (
        F.when(e % 97 == 13, "malformed_json")
        .when(e % 101 == 7, "unknown")
        .when(e % 89 == 5, "duplicate_json")
        .otherwise(pick(render.FORMATS, e % 8))
    )
    raw_action = (
        F.when(F.col("event_type") == "view", "permit")
        .when(F.col("event_type") == "click", "ALLOW")
        .when(F.col("event_type") == "error", "blocked")
        .when(F.col("event_type") == "purchase", "allow")
        .otherwise("vendor-magic")
    )
    stamp = F.timestamp_micros(F.col("us"))
    note = (
        F.when(e % 5 == 0, F.concat(F.lit('say "hi" '), e.cast("string")))
        .when(e % 5 == 1, F.concat(F.lit("a=b\\c, "), e.cast("string")))
        .when(e % 5 == 2, F.concat(F.lit("line one\nline "), e.cast("string")))
        .when(e % 5 == 3, F.concat(F.lit("<tag> & ]"), e.cast("string")))
        .otherwise(F.concat(F.lit("plain note "), e.cast("string")))
    )
    return ev.select(
        "*",
        fmt.alias("fmt"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("f_time"),
        F.col("event_type").alias("f_kind"),
        F.concat_ws(".", F.lit("10"), u % 250, e % 250, (e * 7) % 250).alias("f_src"),
        F.when(e % 6 == 0, F.concat(F.lit("2001:db8::"), F.lower(F.hex(e % 65535 + 1))))
        .otherwise(F.concat(F.lit("198.51.100."), (e % 250).cast("string"))).alias("f_dst"),
        (F.lit(1024) + e % 60000).cast("string").alias("f_spt"),
        pick(["443", "53", "22", "99999"], e % 4).alias("f_dpt"),
        pick(["tcp", "UDP", "icmp"], e % 3).alias("f_proto"),
        raw_action.alias("f_action"),
        pick(["low", "warning", "HIGH"], u % 3).alias("f_severity"),
        F.concat(F.lit("user-"), u.cast("string")).alias("f_user"),
        note.alias("f_note"),
    )


def payloads(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Events with their rendered payload (`payload` text and `raw` bytes)."""
    ev = fields(events(spark, sf_dir, dealt))
    names = ["time", "kind", "src", "dst", "spt", "dpt", "proto", "action", "severity", "user", "note"]
    body = render.payload(F.col("fmt"), {n: F.col(f"f_{n}") for n in names})
    return ev.withColumn("payload", body).withColumn("raw", F.col("payload").cast("binary"))


def receipts(spark: SparkSession, sf_dir: str, with_raw: bool = False, dealt: bool = False) -> DataFrame:
    """One receipt per event; byte-identical payloads keep separate receipts."""
    ev = payloads(spark, sf_dir, dealt)
    e, u = F.col("event_id"), F.col("user_id")
    transport = pick(["http", "syslog_udp", "syslog_tcp", "syslog_tcp"], e % 4)
    framing = pick(["http_octets", "datagram", "octet_counting", "non_transparent"], e % 4)
    rid = receipt_id(e)
    state = pick(vocab.RECEIPT_STATES, (e + u) % 6)
    cols = [
        e.alias("event_id"),
        rid.alias("receipt_id"),
        F.concat(F.lit("t"), (u % 4).cast("string")).alias("tenant_id"),
        pick(["prod", "lab"], u % 2).alias("environment_id"),
        F.concat(F.lit("node-"), (u % 3).cast("string")).alias("instance_id"),
        F.timestamp_micros("us").alias("received_at"),
        (F.col("us") * 1000).alias("received_at_ns"),
        F.lit("listener-main").alias("listener_id"),
        transport.alias("transport"),
        F.concat(F.lit("p"), (e % 5).cast("string")).alias("source_profile_id"),
        F.col("f_src").alias("peer_ip"),
        (F.lit(1024) + e % 50000).cast("int").alias("peer_port"),
        framing.alias("framing_mode"),
        F.lit(True).alias("framing_complete"),
        F.octet_length("payload").cast("bigint").alias("observed_bytes"),
        F.concat(F.date_format(F.timestamp_micros("us"), "yyyy/MM/dd/"), rid, F.lit(".bin")).alias("raw_ref"),
        F.sha2(F.col("raw"), 256).alias("raw_sha256"),
        F.octet_length("payload").cast("bigint").alias("raw_size"),
        F.lit("none").alias("raw_compression"),
        (e % 11 != 0).alias("raw_available"),
        state.alias("state"),
        (e % 4).cast("int").alias("attempts"),
        F.when(state == "PROCESSING", (F.col("us") + 10 * MINUTE_US) * 1000).alias("lease_until_ns"),
        F.when(state == "DEAD_LETTER", F.lit("EVIDENCE_INTEGRITY")).alias("last_error_code"),
    ]
    if with_raw:
        cols += [F.col("raw"), F.col("fmt")] + [F.col(c) for c in ev.columns if c.startswith("f_")]
    return ev.select(*cols)


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three revisions per receipt; some share their creation time."""
    ev = events(spark, sf_dir)
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    rows = ev.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), e % 3)))
    # k = 2 repeats k = 1's creation time, so the id breaks the tie.
    created = (F.col("us") + F.least(k, F.lit(1)) * 7 * MINUTE_US + MINUTE_US) * 1000
    status = pick(vocab.STATUSES, (e + 2 * k + F.col("user_id")) % 5)
    return rows.select(
        revision_id(e, k).alias("revision_id"),
        receipt_id(e).alias("receipt_id"),
        F.concat(F.lit("t"), (u % 4).cast("string")).alias("tenant_id"),
        F.concat(F.lit("1.0."), k.cast("string")).alias("pipeline_version"),
        F.lit(vocab.SCHEMA_VERSION).alias("schema_version"),
        pick(["generic-json", "generic-kv", "generic-cef", "generic-syslog"], e % 4).alias("parser_id"),
        F.sha2(F.concat(F.lit("bundle-"), (k % 2).cast("string")), 256).alias("bundle_sha256"),
        status.alias("status"),
        created.alias("created_at_ns"),
        ((e * 37 + k * 11) % 1000 / 1000.0).alias("quality_score"),
        e.alias("event_id"),
        k.alias("k"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two connectors per revision: required `lake`, optional `siem`."""
    rev = revisions(spark, sf_dir)
    e, k = F.col("event_id"), F.col("k")
    target = F.explode(F.array(
        F.struct(F.lit("lake").alias("connector_id"), F.lit(True).alias("required"), F.lit(0).cast("bigint").alias("c")),
        F.struct(F.lit("siem").alias("connector_id"), F.lit(False).alias("required"), F.lit(1).cast("bigint").alias("c")),
    ))
    rows = rev.withColumn("t", target)
    c = F.col("t.c")
    state = pick(vocab.DELIVERY_STATES, (e * 3 + k + c * 2) % 5)
    return rows.select(
        F.col("t.connector_id").alias("connector_id"),
        "revision_id",
        "receipt_id",
        "tenant_id",
        F.col("t.required").alias("required"),
        state.alias("state"),
        ((e + k) % 6).cast("int").alias("attempts"),
        (F.col("created_at_ns") + (e % 30) * MINUTE_US * 1000).alias("available_at_ns"),
        F.when(state.isin("RETRY", "DEAD_LETTER"), F.lit("CONNECTOR_TIMEOUT")).alias("last_code"),
        (F.col("created_at_ns") + c * 1000 + (e % 60) * MINUTE_US * 1000).alias("updated_at_ns"),
        "event_id",
        "k",
    )


def holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forensic holds: one per supplier; every 40th is tenant-wide (t3 only)."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    tenant_wide = key % 40 == 0
    created = F.lit(NOW_NS - 86_400_000_000_000)
    return s.select(
        F.concat(F.lit("hold-"), key.cast("string")).alias("hold_id"),
        F.when(tenant_wide, F.lit("t3")).otherwise(F.concat(F.lit("t"), (key % 3).cast("string"))).alias("tenant_id"),
        F.when(~tenant_wide, receipt_id(key * 3)).alias("receipt_id"),
        F.lit("litigation").alias("reason"),
        F.col("s_name").alias("actor"),
        created.alias("created_at_ns"),
        F.when(key % 5 == 0, created + 3_600_000_000_000).alias("expires_at_ns"),
        F.when(key % 7 == 0, created + 60_000_000_000).alias("released_at_ns"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File inventory of the raw store: some files missing, some altered, some orphaned."""
    ev = payloads(spark, sf_dir)
    e = F.col("event_id")
    body = F.when(e % 23 == 4, F.concat(F.col("payload"), F.lit("x"))).otherwise(F.col("payload"))
    # Ids divisible by 41 lose their receipt name and become orphans.
    rid = F.when(e % 41 == 9, receipt_id(e + F.lit(1 << 40))).otherwise(receipt_id(e))
    day = F.date_format(F.timestamp_micros("us"), "yyyy/MM/dd/")
    return (
        ev.filter((e % 17 != 2) & (e % 11 != 0))
        .select(
            F.concat(day, rid, F.lit(".bin")).alias("ref"),
            F.sha2(body.cast("binary"), 256).alias("sha256"),
            F.octet_length(body).cast("bigint").alias("size_bytes"),
            F.col("us").alias("mtime_us"),
        )
        .unionByName(
            ev.filter(e % 59 == 3).select(
                F.concat(day, F.lit("."), receipt_id(e), F.lit(".part.tmp")).alias("ref"),
                F.sha2(F.col("raw"), 256).alias("sha256"),
                F.octet_length("payload").cast("bigint").alias("size_bytes"),
                F.col("us").alias("mtime_us"),
            )
        )
    )


def flat_events(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Flat search rows, one per revision, without running the interpreter."""
    ev = fields(events(spark, sf_dir, dealt))
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    rows = ev.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), e % 3)))
    return rows.select(
        receipt_id(e).alias("receipt_id"),
        revision_id(e, k).alias("revision_id"),
        F.concat(F.lit("t"), (u % 4).cast("string")).alias("tenant_id"),
        (F.col("us") * 1000).alias("received_at_ns"),
        F.timestamp_micros("us").alias("received_at"),
        F.concat(F.lit("p"), (e % 5).cast("string")).alias("source_profile_id"),
        F.when(F.col("event_type") == "error", 2004).otherwise(4001).cast("bigint").alias("class_uid"),
        F.when(F.col("event_type") == "error", "deny").when(F.col("event_type") != "signup", "allow").alias("action"),
        F.col("f_src").alias("src_ip"),
        F.col("f_dst").alias("dst_ip"),
        pick(vocab.STATUSES, (e + 2 * k + u) % 5).alias("status"),
        ((e * 37 + k * 11) % 1000 / 1000.0).alias("quality_score"),
        "event_id",
        "k",
    )
