"""Jobs whose faults no table of the registered queries shows."""

from pyspark.sql import functions as F

from siftlog.operators import governance, telemetry
from siftlog.sources import evidence, sinks


def test_only_verified_evidence_expires(spark):
    receipts = spark.createDataFrame(
        [("r1", "t", "f1", "aa", 3, True), ("r2", "t", "f2", "bb", 4, True), ("r3", "t", "f3", "cc", 5, True), ("r4", "t", "f4", "dd", 6, True)],
        "receipt_id string, tenant_id string, raw_ref string, raw_sha256 string, raw_size bigint, raw_available boolean")
    stored = spark.createDataFrame([("f1", "aa", 3), ("f2", "xx", 4), ("f4", "dd", 7)], "ref string, sha256 string, size_bytes bigint")
    rows = {r.receipt_id: r.raw_available for r in governance.expire_raw(receipts, receipts, stored).collect()}
    assert rows == {"r1": False, "r2": True, "r3": True, "r4": True}
    report = governance.retention_report(receipts, stored).first()
    assert (report.examined, report.expired, report.bytes_freed, report.unverified) == (4, 1, 3, 3)


def test_series_budget_is_exact_and_does_not_overflow(spark):
    small = [("m", f"l{k}", str(v)) for k in range(3) for v in range(7)]
    large = [("huge", f"l{k}", str(v)) for k in range(13) for v in range(40)]
    rows = {r.metric: (r.possible_series, r.over_budget) for r in telemetry.series_budget(spark.createDataFrame(small + large, "metric string, label string, value string")).collect()}
    assert rows == {"m": (343, False), "huge": (1 << 62, True)}


def test_profiles_come_from_the_most_specific_network_whatever_the_list(spark):
    receipts = spark.createDataFrame([(k, f"10.{k % 7}.{k % 250}.9" if k % 3 else "2001:db8::5") for k in range(2000)] + [(-1, None), (-2, "no address")], "n int, peer_ip string")
    few = [("10.0.0.0/8", "all"), ("10.3.0.0/16", "three"), ("2001:db8::/32", "six"), ("bad", "x")]
    many = few + [(f"10.3.{k}.0/24", f"n{k}") for k in range(250)] + [(f"11.{k % 250}.{k // 250}.0/24", "other") for k in range(2000)]
    for nets in (few, many, []):
        frame = spark.createDataFrame(nets, "cidr string, profile string")
        rows = {r.n: r.profile for r in evidence.assign_profiles(receipts, frame).collect()}
        assert len(rows) == receipts.count() and rows[-1] == rows[-2] == ""
        for k in range(2000):
            want = "" if not nets else "six" if not k % 3 else "all" if k % 7 != 3 else "three" if nets is few else f"n{k % 250}"
            assert rows[k] == want


def test_a_hot_tenant_day_is_written_sorted_and_whole(spark, tmp_path):
    ns = 1_700_000_000_000_000_000
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("tenant_id"), F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("revision_id"),
        F.lit(ns).alias("received_at_ns"), F.lit("p").alias("source_profile_id"), F.lit("c").alias("receipt_id"))
    for write, name in ((sinks.write_partitioned, "days"), (sinks.write_monthly, "months")):
        path = str(tmp_path / name)
        write(rows, path)
        back = spark.read.parquet(path)
        assert back.count() == 5000 and back.select("revision_id").distinct().count() == 5000
