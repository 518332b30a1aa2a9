"""Registered queries: workload mixes and measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.operators import measure as ms
from siftlog.plans import domain
from siftlog.plans.registry import query

MIX = [("syslog", 20), ("json", 20), ("cef", 15), ("leef", 10), ("kv", 10), ("xml", 10), ("router", 5), ("unknown", 5), ("malformed", 5)]
SIZES = [(256, 20), (1024, 20), (4096, 20)]


@query("workload_mix_counts", "SELECT 'total' AS part, count(*) AS rows FROM events UNION ALL SELECT 'cycles', count(*) // 100 FROM events WHERE event_id < (SELECT count(*) // 100 * 100 FROM events)")
def workload_mix_counts(spark, sf_dir):
    """Every whole cycle of 100 rows holds each fixture exactly by its weight."""
    ev = domain.events(spark, sf_dir)
    mixed = ms.weighted_mix(ev, F.col("event_id"), MIX, 20260929, "fixture")
    cycle = F.call_function("div", F.col("event_id"), F.lit(100))
    per = mixed.groupBy(cycle.alias("c"), "fixture").agg(F.count(F.lit(1)).alias("n"))
    weights = F.create_map(*[F.lit(x) for pair in MIX for x in pair])
    exact = per.groupBy("c").agg(F.sum("n").alias("rows"), F.count_if(F.col("n") != F.try_element_at(weights, "fixture")).alias("off"))
    whole = exact.filter("rows = 100 AND off = 0").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("cycles").alias("part"), "rows")
    return mixed.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("total").alias("part"), "rows").unionByName(whole)


@query("workload_padding", "SELECT event_id, greatest(strlen(payload), 300) AS bytes, CASE WHEN fmt = 'router' THEN 'synthetic=true' ELSE 'any' END AS ending FROM pl")
def workload_padding(spark, sf_dir):
    rows = domain.payloads(spark, sf_dir)
    out = ms.pad_payload(F.col("payload"), F.lit(300), "|synthetic=true")
    ending = F.when((F.col("fmt") == "router") & out.endswith("|synthetic=true"), "synthetic=true").otherwise("any")
    return rows.select("event_id", F.octet_length(out).cast("bigint").alias("bytes"), ending.alias("ending"))


@query(
    "workload_composition",
    """SELECT 'fmt' AS dimension, fmt AS value, count(*) AS rows, min(strlen(payload)) AS min_bytes, max(strlen(payload)) AS max_bytes FROM pl GROUP BY 2
 UNION ALL SELECT 'event_type', event_type, count(*), min(strlen(payload)), max(strlen(payload)) FROM pl GROUP BY 2""",
)
def workload_composition(spark, sf_dir):
    rows = domain.payloads(spark, sf_dir).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    return ms.composition(rows, ["fmt", "event_type"], "bytes")


@query(
    "latency_percentiles",
    """SELECT event_type, count(*) AS samples, min(v) AS min, max(v) AS max, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99
 FROM (SELECT event_type, CAST(round(value * 1000) AS BIGINT) AS v FROM events) GROUP BY 1""",
)
def latency_percentiles(spark, sf_dir):
    ev = domain.events(spark, sf_dir).select("event_type", F.round(F.col("value") * 1000).cast("bigint").alias("v"))
    return ms.latency_summary(ev, "event_type", "v")


@query(
    "throughput_ratios",
    """SELECT tenant_id, count(*) AS events, CAST(sum(raw_size) AS BIGINT) AS bytes, count(*) / ((max(received_at_ns) - min(received_at_ns)) / 1e9) AS events_per_s,
 sum(raw_size) / count(*) AS bytes_per_event FROM receipts GROUP BY 1""",
)
def throughput_ratios(spark, sf_dir):
    return ms.throughput(domain.receipts(spark, sf_dir), "tenant_id", "received_at_ns", "received_at_ns", "raw_size")


@query(
    "run_accounting",
    """SELECT 'raw_verified' AS metric, count(*) FILTER (i.sha256 = r.raw_sha256) AS value FROM receipts r LEFT JOIN inventory i ON i.ref = r.raw_ref
 UNION ALL SELECT 'hash_mismatches', count(*) FILTER (coalesce(i.sha256 <> r.raw_sha256, true)) FROM receipts r LEFT JOIN inventory i ON i.ref = r.raw_ref
 UNION ALL SELECT 'linkage_failures', count(*) FROM receipts r WHERE NOT EXISTS (SELECT 1 FROM revisions v WHERE v.receipt_id = r.receipt_id)
 UNION ALL SELECT 'status_' || status, count(*) FROM revisions GROUP BY status""",
)
def run_accounting(spark, sf_dir):
    return ms.accounting(domain.receipts(spark, sf_dir), domain.inventory(spark, sf_dir), domain.revisions(spark, sf_dir))
