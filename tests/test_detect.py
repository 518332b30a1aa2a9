"""Detector outcomes on fixed payloads: signatures, structures, hard failures, limits."""

import pytest
from pyspark.sql import functions as F

from siftlog.operators.detect import Fingerprint, Routes, detect

CASES = [
    ("syslog", b'<134>1 2026-09-29T10:20:29Z h a - T [n s="1"] x\n', "generic-syslog", "DETECT_SELECTED"),
    ("old_syslog", b"<34>Oct 11 22:14:15 host su: hi", "generic-syslog", "DETECT_SELECTED"),
    ("json", b'{"a": 1, "b": [true, null]}', "generic-json", "DETECT_SELECTED"),
    ("repeated_member", b'{"a":1,"a":2}', "generic-json", "DETECT_SELECTED"),
    ("cut_json", b'{"a": 1, "b":\n', None, "DETECT_BELOW_THRESHOLD"),
    ("trailing", b'{"a":1} x', None, "DETECT_BELOW_THRESHOLD"),
    ("trailing_bracket", b"[1]] [[2]", None, "DETECT_BELOW_THRESHOLD"),
    ("trailing_element", b"[1],[2]", None, "DETECT_BELOW_THRESHOLD"),
    ("cef", b"\n CEF:0|a|b|c|d|e|5|k=v", "generic-cef", "DETECT_SELECTED"),
    ("leef", b"LEEF:1.0|a|b|c|d|k=v", "generic-leef", "DETECT_SELECTED"),
    ("kv", b"a=1 b=2 c=3", "generic-kv", "DETECT_SELECTED"),
    ("two_pairs", b"a=1 b=2 c", None, "DETECT_BELOW_THRESHOLD"),
    ("csv", b"a,b\n1,2\n", "generic-csv", "DETECT_SELECTED"),
    ("quoted_csv", b'"a",b\n1,"x, y"\n', "generic-csv", "DETECT_SELECTED"),
    ("ragged_csv", b"a,b\n1\n", None, "DETECT_BELOW_THRESHOLD"),
    ("xml", b"<a><b x='1'/></a>", "generic-xml", "DETECT_SELECTED"),
    ("open_xml", b"<a><b></a>", None, "DETECT_BELOW_THRESHOLD"),
    ("pipes", b"IF_DOWN|ts=1|dev=r1|why=x", "generic-router-text", "DETECT_SELECTED"),
    ("prose", b"Just a sentence.", None, "DETECT_BELOW_THRESHOLD"),
    ("bytes", b"\xc3\x28 abc", None, "DETECT_NO_CANDIDATE"),
    ("empty", b"", None, "DETECT_NO_CANDIDATE"),
    ("long_json", b'{"a":"' + b"x" * 70_000 + b'"}', None, "DETECT_BELOW_THRESHOLD"),
]


@pytest.fixture(scope="module")
def outcomes(spark):
    df = spark.createDataFrame([(n, raw) for n, raw, _, _ in CASES], "name string, raw binary")
    rows = detect(df, keep_read=False).select("name", "detection.parser_id", "detection.reason_code").collect()
    return {r["name"]: (r["parser_id"], r["reason_code"]) for r in rows}


@pytest.mark.parametrize("name,raw,parser,reason", CASES, ids=[c[0] for c in CASES])
def test_outcome(outcomes, name, raw, parser, reason):
    assert outcomes[name] == (parser, reason)


def test_ambiguous_and_margin(spark):
    def prints(second):
        return [Fingerprint("p1", "kv", ("a=",), 900, 10, bundle_sha256="b", format="x"), Fingerprint("p2", "kv", ("a=",), second, 10, bundle_sha256="b", format="y")]

    df = spark.createDataFrame([(b"a=1", "b")], "raw binary, bundle string")
    for score, reason in ((801, "DETECT_AMBIGUOUS"), (800, "DETECT_SELECTED")):
        out = detect(df, bundle="bundle", routes=Routes({"b": prints(score)}), keep_read=False)
        assert out.select("detection.reason_code").first()[0] == reason


def test_plan_has_no_shuffle(spark):
    df = spark.createDataFrame([(b"a=1",)], "raw binary")
    plan = detect(df, keep_read=False).select("detection.outcome")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") <= 1
