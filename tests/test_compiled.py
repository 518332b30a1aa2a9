"""Interpretation is compiled, not interpreted row by row, and gives what the longer ways round give."""

import itertools
import re

from pyspark.sql import functions as F

from siftlog.functions.text import compact_set
from siftlog.operators.detect import Fingerprint, Routes, detect
from siftlog.operators.mapping import Mapping, Rule, apply_mapping, apply_mappings
from siftlog.operators.parse import parse
from siftlog.operators.parsed import nested, variant_map
from siftlog.plans import bundles

TEXTS = [
    'time=1 src=10.0.0.1 dst=10.0.0.2', 'a,b\n1,2\n', "CEF:0|v|p|1|2|n|3|src=1 act=x", "<13>1 2024-01-01T00:00:00Z h a - m - text", '{"a":1}', '{"a":', "<e><a>1</a></e>",
    "A|x=1|y=2|z=3", "LEEF:1.0|v|p|1|e|a=1", "plain words", "", "\u0001\u0002\u0003", '{"a":1,"a":2}', "a=1 b=2 c=3|d", "x,y\n1\n", "<broken", None]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_lambda_stands_above_probes_rules_or_parsers(spark):
    """Spark interprets a function with a lambda and all that lies below it: ranks, issues and members are put together without one."""
    own = spark.newSession()
    own.conf.set("spark.sql.debug.maxToStringFields", "100000")
    own.conf.set("spark.sql.maxPlanStringLength", str(1 << 26))
    rows = own.createDataFrame([(None if t is None else t.encode(),) for t in TEXTS], "raw binary")
    found = parse(detect(rows)).withColumn("key", F.col("detection.impl"))
    text = plan(apply_mappings(found, bundles.MAPPINGS, "key", "parsed.fields", bundles.SELECTOR_FORMATS).select("mapped", "detection"))
    assert "array_sort(" not in text
    lists = re.findall(r"filter\(array\((?:CASE WHEN|if |named_struct|struct)[^\n]{0,40}", text)
    # What is left chooses array elements by name, inside the lambda that goes through them.
    assert not [x for x in lists if "schemaofvariant" not in x.lower().replace("_", "")], lists


def test_best_probe_is_the_first_candidate(spark):
    pins = [None, "generic-csv", "generic-text", "generic-kv", "generic-json"]
    routes = Routes({"b": [Fingerprint("f1", "kv", ("=",), 900, 10), Fingerprint("f2", "kv", ("=",), 900, 10, 5), Fingerprint("f3", "json", ("src",), 850, 99)], "c": [Fingerprint("g", "csv", (",",), 900, 1)]})
    rows = spark.createDataFrame([(None if t is None else t.encode() + x, p, b) for t, p, b, x in itertools.product(TEXTS, pins, ["b", "c", "z", None], [b"", b"\xff"]) if t is not None], "raw binary, pin string, bundle string")
    for how in ({}, {"pinned": "pin"}, {"pinned": "pin", "routes": routes, "bundle": "bundle"}):
        for r in detect(rows, with_candidates=True, **how).collect():
            able = [c for c in r.candidates if not c.hard_failure and c.neg_score < 0]
            d = r.detection
            if not able:
                assert (d.outcome, d.reason_code) == ("UNKNOWN", "DETECT_NO_CANDIDATE")
                continue
            rival = next((c for c in able if c.format != able[0].format), None)
            close = rival is not None and -able[0].neg_score + rival.neg_score < 100
            want = "DETECT_BELOW_THRESHOLD" if -able[0].neg_score < 800 else "DETECT_AMBIGUOUS" if close else "DETECT_SELECTED"
            assert d.reason_code == want, r
            if want == "DETECT_SELECTED":
                best = able[0]
                assert (d.parser_id, d.parser_version, d.bundle_sha256, d.impl, d.format, d.reason_codes, d.risk_codes, d.score) == (
                    best.parser_id, best.parser_version, best.bundle_sha256, best.impl, best.format, best.reason_codes, best.risk_codes, -best.neg_score)


def test_members_without_a_value_are_left_out(spark):
    rows = spark.createDataFrame([(1, "x"), (None, None)], "a int, b string")
    got = rows.select(
        F.to_json(variant_map([("a", F.col("a")), ("b", F.col("b"), F.lit(True))])).alias("m"), F.to_json(nested([("b", F.col("b").cast("variant"))])).alias("n"),
        compact_set([F.col("b"), F.lit(None), F.lit("y")], "array<string>").alias("s")).collect()
    assert [tuple(r) for r in got] == [('{"a":1,"b":"x"}', '{"b":"x"}', ["x", "y"]), ('{"b":null}', "{}", ["y"])]


def test_issues_follow_the_order_of_the_rules(spark):
    """Two rule sets that name the same targets in opposite order."""
    one, two = Rule("a", "fields.x", "event.action", "lowercase", "t", True), Rule("b", "fields.y", "event.severity", "lowercase", "t", True)
    sets = {"p": Mapping("p", "1.0.0", (one, two), {"t": {"k": "allow"}}), "q": Mapping("q", "1.0.0", (two, one), {"t": {"k": "allow"}})}
    rows = spark.createDataFrame([("p",), ("q",), (None,)], "key string").withColumn("doc", F.parse_json(F.lit('{"x":"no","z":1}')))
    got = {r.key: r.mapped for r in apply_mappings(rows, sets, "key", "doc").collect()}
    assert [i.rule_id for i in got["p"].issues] == ["a", "b"] and [i.rule_id for i in got["q"].issues] == ["b", "a"] and got[None] is None
    assert [i.code for i in got["p"].issues] == ["MAPPING_TAXONOMY_MISS", "MAPPING_REQUIRED_SOURCE_MISSING"]
    alone = apply_mapping(rows.select("doc"), sets["q"], "doc").first().mapped
    assert [i.rule_id for i in alone.issues] == ["b", "a"]
