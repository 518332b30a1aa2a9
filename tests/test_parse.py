"""Parser edge cases: partial results, issues with byte offsets, kept bytes."""

import json

import pytest
from pyspark.sql import functions as F

from siftlog.operators.parse import compile_captures, parse, parse_captures

# implementation, payload, status, codes, offsets, unmatched
CASES = [
    ("kv", b"a=1 junk b=2", "PARTIALLY_PARSED", ["KV_TOKEN_MALFORMED"], [4], b"junk b=2"),
    ("kv", b'a="open b=2', "INVALID", ["KV_UNTERMINATED_QUOTE"], [11], b'a="open b=2'),
    ("kv", b'a="x"y', "INVALID", ["KV_TOKEN_MALFORMED"], [5], b'a="x"y'),
    ("kv", b'a="p\\q" a=2', "PARTIALLY_PARSED", ["KV_UNKNOWN_ESCAPE", "KV_DUPLICATE_KEY"], [4, 8], None),
    ("kv", b"  \n", "INVALID", ["KV_EMPTY_INPUT"], [0], None),
    ("cef", b"CEF:0|a||c|d|e|5|", "INVALID", ["CEF_REQUIRED_HEADER_EMPTY"], [8], None),
    ("cef", b"CEF:0|a|b", "INVALID", ["CEF_HEADER_FIELD_MISSING"], [9], None),
    ("cef", b"xCEF:0|a|b|c|d|e|5|", "INVALID", ["CEF_HEADER_MISSING"], [0], None),
    ("cef", b"CEF:0|a|b|c|d|e|5|k=v\\", "PARTIALLY_PARSED", ["CEF_ESCAPE_TRUNCATED"], [21], None),
    ("leef", b"LEEF:2.0|a|b|c|d|x5E|x=1^bad", "PARTIALLY_PARSED", ["LEEF_ATTRIBUTE_MALFORMED"], [25], b"bad"),
    ("leef", b"LEEF:2.0|a|b|c|d|^^|x=1", "INVALID", ["LEEF_DELIMITER_INVALID"], [17], None),
    ("syslog", b"<999>1 x", "INVALID", ["SYSLOG_INVALID_PRIORITY"], [1], b"<999>1 x"),
    ("syslog", b"<34>Feb 30 22:14:15 m su: x", "PARTIALLY_PARSED", ["SYSLOG_INVALID_TIMESTAMP"], [4], b"Feb 30 22:14:15 m su: x"),
    ("syslog", b'<13>1 - h a p m [x y="1"][bad', "PARTIALLY_PARSED", ["SYSLOG_INVALID_STRUCTURED_DATA"], None, b'[x y="1"][bad'),
    ("json", b'{"a":1,"a":2}', "INVALID", ["JSON_DUPLICATE_KEY"], [10], None),
    ("json", b'{"a":1} x', "INVALID", ["JSON_TRAILING_DATA"], [8], None),
    ("json", b"[" * 65 + b"]" * 65, "INVALID", ["JSON_DEPTH_LIMIT_EXCEEDED"], [65], None),
    ("xml", b"<!DOCTYPE a><a/>", "INVALID", ["XML_DTD_FORBIDDEN"], None, None),
    ("xml", b"<a/><b/>", "INVALID", ["XML_TRAILING_DATA"], None, None),
    ("csv", b"a,b\n1\n", "INVALID", ["CSV_SYNTAX_ERROR"], None, None),
    ("csv", b"a,a\n1,2", "INVALID", ["CSV_DUPLICATE_HEADER"], None, None),
]
FIELDS = [
    ("kv", b"a=1 b= c='z\\'' d=\"x\\n\\\\n\"", {"attributes": {"a": "1", "b": "", "c": "z'", "d": "x\n\\n"}}),
    ("leef", b"LEEF:1.0|a|b|c|d|x=1\ty=2\t\tz=a=b", None),
    ("xml", b"<a><b>007</b><b>2</b>t</a>", {"a": {"#text": "t", "b": ["007", "2"]}}),
    ("csv", b'a,"b"\n1,"x,\ny"\n', {"columns": ["a", "b"], "records": [{"a": "1", "b": "x,\ny"}]}),
    ("csv", b"a,b\r\n1,2\r\n\r\n3,4", {"columns": ["a", "b"], "records": [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]}),
    ("json", b"[1,2]", {"$": [1, 2]}),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(i, impl, raw) for i, (impl, raw) in enumerate([(c[0], c[1]) for c in CASES] + [(f[0], f[1]) for f in FIELDS])]
    df = spark.createDataFrame(rows, "i int, impl string, raw binary")
    out = parse(df, impl="impl").select("i", "parsed.*").withColumn("fields", F.to_json("fields"))
    return {r["i"]: r for r in out.collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_issue(results, i):
    _, _, status, codes, offsets, unmatched = CASES[i]
    row = results[i]
    assert (row["status"], [x["code"] for x in row["issues"]]) == (status, codes)
    if offsets is not None:
        assert [x["offset"] for x in row["issues"]] == offsets
    assert (bytes(row["unmatched"]) if row["unmatched"] is not None else None) == unmatched


@pytest.mark.parametrize("i", range(len(FIELDS)))
def test_fields(results, i):
    row = results[len(CASES) + i]
    assert row["status"] == "PARSED"
    if FIELDS[i][2] is not None:
        assert json.loads(row["fields"]) == FIELDS[i][2]


def test_captures(spark):
    java, names = compile_captures(r"^(?P<a>\w+)(?:-(?P<b>\w*))?$")
    assert names == [("a", 1), ("b", 2)] and "?P" not in java
    df = spark.createDataFrame([("x-y",), ("x-",), ("x",), ("?",)], "t string")
    out = parse_captures(df, "t", "o", r"^(?P<a>\w+)(?:-(?P<b>\w*))?$", "x", ("b",))
    got = [(r["status"], r["f"]) for r in out.select("o.status", F.to_json("o.fields").alias("f")).collect()]
    assert got == [("PARSED", '{"a":"x","b":"y"}'), ("PARSED", '{"a":"x","b":""}'), ("PARTIALLY_PARSED", '{"a":"x"}'), ("INVALID", None)]


def test_long_runs_stay_linear(spark):
    text = b"CEF:0|a|b|c|d|e|5|msg=" + b" " * 60_000 + b"x src=1"
    df = spark.createDataFrame([(text, "cef"), (b"k=" + b"v " * 20_000, "kv")], "raw binary, impl string")
    assert [r[0] for r in parse(df, impl="impl", only=("cef", "kv")).select("parsed.status").collect()] == ["PARSED", "PARTIALLY_PARSED"]
