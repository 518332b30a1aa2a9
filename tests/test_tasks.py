"""CPU-bound work is dealt over tasks by rows, and cursors are decoded once."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from siftlog import session
from siftlog.operators import activity, delivery, measure, search
from siftlog.plans import domain, q_detect, q_envelope, q_mapping, q_parse, q_sources
from siftlog.sources.commits import MANY_FILES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_row_group_in_many_splits_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1).write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100, raising=False)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = spark.read.parquet(f"{tmp_path}/t")
        assert rows.rdd.getNumPartitions() >= 10  # only one of them holds rows
        sizes = [r["n"] for r in session.spread(rows).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 1000 and max(sizes) <= 150


@pytest.fixture
def tables(spark, tmp_path):
    spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' AS ts, id % 7 AS user_id, 'view' AS event_type, 1.0D AS value, '{}' AS props FROM range(40)").write.parquet(
        f"{tmp_path}/events.parquet")
    spark.sql("SELECT id AS s_suppkey, 'x' AS s_name FROM range(47, 50)").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_rows_are_dealt_before_they_are_rendered(spark, tables):
    """What stands below the exchange in the plan runs in the tasks of the scan."""
    for df, made in (
        (q_parse.parse_limits(spark, tables), "array_join"), (q_parse.rendered(spark, tables, "xml"), "<event synthetic"),
        (q_detect._raw(spark, tables), "<event synthetic"), (domain.receipts(spark, tables, with_raw=True, dealt=True), "<event synthetic"),
    ):
        above, below = plan(df).split("Repartition ", 1)
        assert made in above and made not in below
    assert "Repartition " in plan(q_mapping.envelopes(spark, tables))
    assert {(r.s_suppkey, r.hit_limit) for r in q_parse.parse_limits(spark, tables).collect()} == {(47, None), (48, None), (49, "KV_FIELD_LIMIT_EXCEEDED")}


def test_a_cursor_is_decoded_once(spark):
    def text(**body):
        return base64.urlsafe_b64encode(json.dumps(body).encode()).decode().rstrip("=")

    good = {"v": 1, "received_at": "2024-01-02T03:04:05.000006007Z", "receipt_id": "r-1", "revision_id": "v-1"}
    given = [text(**good), text(**good | {"v": 2}), text(**good | {"received_at": "x"}), text(**good | {"receipt_id": "a b"}), "%%", "", "abc", None,
             base64.urlsafe_b64encode(b"\xff\xfe").decode().rstrip("="), text(v=1)]
    rows = spark.createDataFrame(list(enumerate(given)), "n int, c string").repartition(2)
    out = rows.select("n", search.decode_cursor(F.col("c")).alias("c")).select("n", "c.*")
    found = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert found[0] == (1_704_164_645_000_006_007, "r-1", "v-1")
    assert all(found[n] == (None, None, None) for n in range(1, len(given)))
    assert plan(out).count("from_json") == 1


def test_the_list_of_a_mix_is_sorted_once(spark):
    mixed = measure.weighted_mix(spark.range(500), F.col("id"), [("a", 3), ("b", 5), ("c", 2)], 7, "m")
    assert "sort" not in plan(mixed).lower()  # a literal, not a sort for each row
    per = {tuple(r)[0]: sorted(tuple(r)[1]) for r in mixed.groupBy(F.expr("id div 10")).agg(F.collect_list("m")).collect()}
    assert len(per) == 50 and all(v == list("aaabbbbbcc") for v in per.values())


def test_the_newest_rows_are_whole_with_ties_and_rows_without_a_time(spark):
    rows = spark.createDataFrame([(k, k // 3) for k in range(30)] + [(30, None), (31, None)], "n int, t bigint")
    got = lambda df, limit: sorted(r.n for r in activity.newest(df, "t", limit).collect())
    assert got(rows, 4) == [24, 25, 26, 27, 28, 29]  # the fourth newest shares its time with two more
    assert got(rows, 31) == list(range(32)) and got(rows.filter("n >= 30"), 1) == [30, 31] and got(rows.filter("n < 0"), 1) == []


def test_rejects_are_looked_for_in_written_envelopes(spark, tables, monkeypatch):
    written = []

    def stored(rows, purpose):
        written.append(rows.columns)
        return spark.createDataFrame([], rows.schema)

    monkeypatch.setattr(q_envelope, "stored", stored, raising=False)
    out = q_envelope.project_rejects(spark, tables)
    assert written == [delivery.PROJECTED] and out.columns == ["event_id", "field"] and "events.parquet" not in plan(out)


def test_many_files_are_moved_by_their_tasks(spark, tmp_path):
    rows = spark.range(40).select("id", F.col("id").cast("string").alias("value")).repartition(4)
    rows.write.partitionBy("id").options(**MANY_FILES).text(f"{tmp_path}/t")
    assert MANY_FILES == {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
    assert sorted((r["id"], r["value"]) for r in spark.read.text(f"{tmp_path}/t").collect()) == [(k, str(k)) for k in range(40)]
    assert (tmp_path / "t" / "_SUCCESS").exists() and not (tmp_path / "t" / "_temporary").exists()


def test_rows_that_repeat_a_key_share_its_file(spark, tmp_path):
    spark.sql("SELECT 1 + id % 20 AS s_suppkey, 'n' AS s_name, id % 20 AS s_nationkey FROM range(40)").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = [tuple(r)[:2] + (r.size_bytes,) for r in q_sources.scan_evidence_files(spark, str(tmp_path)).collect()]
    size = {k: 2 * len(f"n {k - 1}\n") for k in range(1, 21)}
    assert sorted(rows, key=str) == sorted([(k, "missing", None) if k % 13 == 5 else (k, "corrupt", size[k]) for k in range(1, 21) for _ in range(2)], key=str)
