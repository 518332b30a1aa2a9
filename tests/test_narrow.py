"""Interpretation carries few columns from step to step, and its short ways give what the long ones give."""

import json

from pyspark.sql import functions as F

from siftlog.functions.ip import CANONICAL_V6, _v6_text, canonical_ip
from siftlog.functions.variant import resolve_paths
from siftlog.operators.detect import detect
from siftlog.operators.envelope import RECEIPT, safe_code, safe_message
from siftlog.plans.interpret import interpreted
from siftlog.sources import evidence
from siftlog.streaming import arrivals


def _widths(plan):
    own = [plan.output().size()] if plan.nodeName() == "Project" else []
    return own + [w for k in range(plan.children().size()) for w in _widths(plan.children().apply(k))]


def test_receipts_go_through_interpretation_as_one_column(spark):
    names = [c for c in RECEIPT if c != "received_at"]
    rows = spark.createDataFrame([("kv", b"time=2024-01-01T00:00:00Z type=view src=10.0.0.1 dst=10.0.0.2 action=permit severity=low")], "fmt string, raw binary")
    rows = rows.select("*", *[F.col("fmt").alias(c) for c in names])
    found = interpreted(rows, for_envelopes=True)
    assert found.columns == [*[c for c in rows.columns if c != "fmt"], "detection", "parsed", "mapped"]
    assert sum(_widths(found._jdf.queryExecution().optimizedPlan())) < 2500  # more than 3,500 before
    r = found.first()
    assert r.tenant_id == "kv" and r.parsed.status == "PARSED" and r.mapped.event.action == "allow" and r.mapped.event.dst_endpoint.ip == "10.0.0.2"
    # without a bundle a whole detection is kept for other callers
    assert set(interpreted(rows).schema["detection"].dataType.names) == set(detect(rows).schema["detection"].dataType.names)


def test_elements_are_chosen_by_name(spark):
    docs = [
        {"p": [{"name": "a", "value": 1}, {"name": "b", "value": 2}]}, {"p": [{"name": "a", "value": 1}, {"id": "a", "value": 2}]}, {"p": {"a": {"value": 3}}},
        {"p": [{"name": "a", "id": "b", "value": 4}]}, {"p": [{"value": 5}, {"name": "a", "value": 6}]}, {"p": []}, {"q": 1}, {"p": [{"name": "b", "value": 7}, 8]}]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").withColumn("v", F.parse_json("j"))
    df, found = resolve_paths(rows, "v", [["p", "a", "value"], ["p", "b", "value"], ["x"]], True)
    assert not [c for c in df.columns if c.startswith("_v1") and c[3:].lstrip("_0123456789") == "x"] and sum(c.endswith("v") for c in df.columns) == 4
    a, b = (found[("p", n, "value")] for n in "ab")
    got = df.select("i", F.to_json(a[0]).alias("a"), a[1].alias("at"), a[2].alias("am"), F.to_json(b[0]).alias("b"), b[2].alias("bm"), F.to_json(found[("x",)][0]).alias("x")).orderBy("i").collect()
    assert [(r.a, r.am, r.b, r.bm, r.x) for r in got] == [
        ("1", False, "2", False, None), (None, True, None, False, None), ("3", False, None, False, None), ("4", False, "4", False, None),
        ("6", False, None, False, None), (None, False, None, False, None), (None, False, None, False, None), (None, False, "7", False, None)]
    assert got[0].at == "fields.p.0.value" and got[4].at == "fields.p.1.value"


def test_short_ways_agree_with_the_long_ones(spark):
    plain = ["2001:db8::1f", "fe80::", "1:2:3::4:5:6", "1:2:3:4:5:6:7:8", "a::b"]
    other = ["::1", "::", "2001:DB8::1", "2001:0db8::1", "1:0:0:2::3", "1:2:3:4::5:6:7", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:0", "1::2::3", "g::1", "1:2:3", "fe80::1%eth0", "fe80::1\n", "x", "", None]
    ips = spark.createDataFrame([(t,) for t in plain + other], "t string")
    rows = ips.select("t", F.col("t").rlike(CANONICAL_V6).alias("short"), canonical_ip(F.col("t")).alias("c"), F.when(F.col("t").contains(":"), _v6_text(F.col("t"), True)).alias("long")).collect()
    assert [r.t for r in rows if r.short] == plain
    assert [r.c for r in rows] == [r.long for r in rows]
    codes = {"MAPPING_TAXONOMY_MISS": "MAPPING_TAXONOMY_MISS", "a b": "A_B", "A": "A_ISSUE", "": "UNKNOWN_ISSUE", "9A": "ISSUE_9A", "A__B": "A_B", "A_": "A_ISSUE", "B" * 70: "B" * 64, "AB\n": "AB"}
    texts = {" a b ": "a b", "a\nb": "a b", " ": "issue details unavailable", "": "issue details unavailable", "\t": "issue details unavailable"}
    got = spark.createDataFrame([(k,) for k in codes], "c string").select("c", safe_code(F.col("c")).alias("s")).collect()
    assert {r.c: r.s for r in got} == codes
    got = spark.createDataFrame([(k,) for k in texts], "c string").select("c", safe_message(F.col("c")).alias("s")).collect()
    assert {r.c: r.s for r in got} == texts


def test_the_list_of_seen_captures_is_not_written_anew_every_ten_triggers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(12):
        (tmp_path / "in" / f"{k}.bin").write_bytes(b"2 ab")
    before = spark.conf.get(arrivals.COMPACTION, None)
    arrivals.stream_admit(arrivals.capture_stream(spark, f"{tmp_path}/in", 1, "*.bin"), "t", "l", f"{tmp_path}/out", f"{tmp_path}/cp", "s", max_bytes=10)
    assert spark.conf.get(arrivals.COMPACTION, None) == before and spark.read.parquet(f"{tmp_path}/out").count() == 12
    assert not list((tmp_path / "cp").rglob("*.compact")) and len(list((tmp_path / "cp" / "commits").glob("[0-9]*"))) == 12


def test_frames_of_many_captures_are_handed_on_together(spark, monkeypatch):
    rows = [(f"c{k}", b"2 ab3 xyz" if k % 3 else b"", k) for k in range(30)]
    captures = spark.createDataFrame(rows, "capture_id string, data binary, us bigint").coalesce(1)
    sizes = []
    monkeypatch.setattr(evidence, "PIECE_BYTES", 40)
    frames = type(captures).mapInPandas
    monkeypatch.setattr(type(captures), "mapInPandas", lambda df, walk, schema: sizes.extend(len(p) for p in walk(iter([df.toPandas()]))) or frames(df, walk, schema))
    got = evidence.split_octet_counted(captures, 10, carry=("us",)).collect()
    assert sorted((r.capture_id, r.us, r.frame_no, bytes(r.frame)) for r in got) == sorted((c, u, i, f) for c, d, u in rows if d for i, f in enumerate((b"ab", b"xyz")))
    assert sizes == [10, 10, 10, 10]
