"""State that outlives triggers and restarts, raw files that arrive, deep documents and unstable runs."""

import json

from pyspark.sql import functions as F

from siftlog.functions.variant import document_rows
from siftlog.operators import regress
from siftlog.streaming import arrivals, stateful

START, MINUTE = 1_700_000_000_000, 60_000


def run(spark, tmp_path, files, schema, build):
    own = stateful.with_store(spark)
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={k}")
        stream = own.readStream.schema(f"{schema}, n int").parquet(f"{tmp_path}/in").withColumn("event_time", F.timestamp_millis("at_ms"))
        out = build(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        out.trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())


def test_retries_count_over_restarts(spark, tmp_path):
    at = lambda m: START + m * MINUTE
    tick = lambda m: ("tick", at(m), True, True, None)
    files = [
        [("a", at(0), False, True, "x"), ("b", at(0), False, False, "y"), ("c", at(0), True, True, None), ("d", at(0), False, True, "x"), tick(5)],
        [("a", at(6), False, True, "x"), ("d", at(6), True, True, None), ("a", at(7), False, True, "z"), tick(12)],  # two failures in one trigger
        [("a", at(13), False, True, "x"), tick(30)],  # after its dead letter a receipt begins anew
    ]
    schema = "receipt_id string, at_ms bigint, ok boolean, retryable boolean, code string"
    rows = run(spark, tmp_path, files, schema, lambda s: stateful.retry_stream(s, 3, MINUTE, 10 * MINUTE))
    assert [r for r in rows if r[0] != "tick"] == sorted([
        ("a", "RETRY", 2, at(1), "x"), ("d", "RETRY", 2, at(1), "x"), ("b", "DEAD_LETTER", 1, at(0), "y"), ("c", "DONE", 1, at(0), None), ("d", "DONE", 2, at(6), None),
        ("a", "DEAD_LETTER", 3, at(7), "z"), ("a", "RETRY", 2, at(14), "x")])


def test_receipts_of_one_bucket_keep_their_own_attempts(spark, tmp_path):
    """State rows are shared by hash: all receipts in one bucket give what receipts in buckets of their own give."""
    at = lambda m: START + m * MINUTE
    names = [f"r{k}" for k in range(300)] + [None]
    files = [[(r, at(0), False, True, "x") for r in names] + [("tick", at(5), True, True, None)], [(r, at(6), k % 2 == 0, True, None) for k, r in enumerate(names)] + [("tick", at(12), True, True, None)]]
    schema = "receipt_id string, at_ms bigint, ok boolean, retryable boolean, code string"
    own = stateful.with_store(spark)
    for buckets in (1, 4096):
        place = tmp_path / str(buckets)
        for k, rows in enumerate(files):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{place}/in/n={k}")
            stream = own.readStream.schema(f"{schema}, n int").parquet(f"{place}/in").withColumn("event_time", F.timestamp_millis("at_ms"))
            dealt = stateful.retry_stream(stream, 3, MINUTE, 10 * MINUTE, buckets=buckets)
            out = dealt.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/cp")
            out.trigger(availableNow=True).start().awaitTermination()
        found = {tuple(r) for r in spark.read.parquet(f"{place}/out").collect() if r.receipt_id != "tick"}
        want = {(r, "RETRY", 2, at(1), "x") for r in names} | {(r, "DONE", 2, at(6), None) for r in names[::2]} | {(r, "RETRY", 3, at(8), None) for r in names[1::2]}
        assert found == want


def test_silent_origins_are_found_by_others_going_on(spark, tmp_path):
    at = lambda m: START + m * MINUTE
    files = [[("a", at(0)), ("b", at(1)), ("c", at(2))], [("a", at(20))], [("a", at(21)), ("b", at(21))], [("a", at(40))]]
    rows = run(spark, tmp_path, files, "peer_id string, at_ms bigint", lambda s: stateful.silent_origins(s, 10 * MINUTE))
    # `a` itself was silent from 0 to 20, but its next snapshot came before the watermark had passed
    assert rows == [("b", at(1), at(11)), ("b", at(21), at(31)), ("c", at(2), at(12))]


def test_files_become_receipts_and_rejects_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    bodies = {"one": b"5 hello3 a\xffb", "two": b"4 good9 cut", "three": b"x", "four": b"", "five": b"20 " + b"z" * 20 + b"2 ok"}
    for name, body in bodies.items():
        (tmp_path / "in" / f"{name}.bin").write_bytes(body)

    def go(name, checkpoint):
        arrivals.stream_admit(arrivals.capture_stream(spark, f"{tmp_path}/in", 2, "*.bin"), "t", "l", f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", name, max_bytes=10)
        rows = spark.read.parquet(f"{tmp_path}/out").collect()
        return sorted((bytes(r.raw) if r.raw is not None else b"", r.reason or "", r.verdict) for r in rows), {r.receipt_id for r in rows}

    want = sorted([(b"hello", "", "receipt"), (b"a\xffb", "", "receipt"), (b"good", "", "receipt"), (b"", "FRAME_INCOMPLETE", "reject"), (b"", "INVALID_OCTET_COUNT", "reject"), (b"", "FRAME_TOO_LARGE", "reject")])
    rows, ids = go("s", "cp")
    assert rows == want and len(ids) == 6
    (tmp_path / "in" / "six.bin").write_bytes(b"3 new")
    rows, ids = go("s", "cp")
    assert rows == sorted([*want, (b"new", "", "receipt")]) and len(ids) == 7


def test_a_trigger_reads_its_captures_once(spark, tmp_path):
    """Frames keep the time of their capture without a second scan, a join or a shuffle; the listing setting is put back."""
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.bin").write_bytes(b"2 ab" * k)
    captures = spark.read.format("binaryFile").load(f"{tmp_path}/in/*.bin")
    frames = arrivals.deframe(captures, "t", "l", 10)
    plan = frames._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and "Exchange" not in plan and "Join" not in plan
    times = {r.us * 1000 for r in captures.select(F.unix_micros("modificationTime").alias("us")).collect()}
    rows = frames.collect()
    assert len(rows) == 3 and {r.received_at_ns for r in rows} <= times
    before = spark.conf.get(arrivals.LISTING)
    arrivals.stream_admit(arrivals.capture_stream(spark, f"{tmp_path}/in", 2, "*.bin"), "t", "l", f"{tmp_path}/out", f"{tmp_path}/cp", "s", max_bytes=10)
    assert spark.conf.get(arrivals.LISTING) == before and spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_two_hundred_levels_lose_nothing(spark):
    deep = "leaf"
    for k in range(200):
        deep = {"k": deep, "n": k} if k % 2 else [deep, k]
    wide = {f"w{k}": {"x": [k]} for k in range(300)}
    flat, empty = {"a": 1}, {"e": {}, "f": []}
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate([deep, wide, flat, empty])], "id int, j string").withColumn("v", F.parse_json("j"))
    rows = document_rows(docs, ["id"], "v").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("path")).alias("longest")).collect()
    assert {r.id: r.n for r in rows} == {0: 201, 1: 300, 2: 1, 3: 2}
    assert max(r.longest for r in rows) == len("fields" + ".k.0" * 100)


def test_unstable_rows_are_found_whatever_the_order(spark):
    a = spark.createDataFrame([(k % 50, f"v{k}") for k in range(500)] + [(None, "n")], "k int, v string")
    b = a.repartition(5)
    assert regress.unstable_keys(a, b, ["k"]).count() == 0
    changed = b.withColumn("v", F.when((F.col("k") == 7) & (F.col("v") == "v57"), "v57 ").otherwise(F.col("v")))
    twice = b.unionByName(b.filter("v = 'v11'"))
    gone = b.filter("k IS NOT NULL")
    # two rows of a key that swap the parts of their values
    assert [[r.k for r in regress.unstable_keys(a, x, ["k"]).collect()] for x in (changed, twice, gone)] == [[7], [11], [None]]
