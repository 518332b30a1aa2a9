"""Small brute-force checks of helpers that queries rely on."""

import hashlib
import ipaddress
import json

import pytest
from pyspark.sql import functions as F

from siftlog.functions.hashing import split_bucket
from siftlog.functions.ip import canonical_ip, cidr_bounds, ip_key
from siftlog.functions.ordered import previous_values, running_totals
from siftlog.functions.structure import check_json, read_csv, read_xml
from siftlog.operators import mapping as mp
from siftlog.operators.dataset import Feature, FeatureSet
from siftlog.operators.envelope import safe_code, safe_message
from siftlog.sources import evidence

ADDRESSES = ["::", "::1", "1::", "2001:DB8::0:1", "2001:0db8:0:0:1:0:0:1", "::ffff:10.0.0.8", "::ffff:a00:8", "fe80::1%eth0", "1:2:3:4:5:6:7:8",
             "1:2:3:4:5:6:7::", "1::2::3", "12345::", "1:2:3", "64:ff9b::1.2.3.4", "1:0:0:2:0:0:0:3", "10.0.0.1", "256.1.1.1", "01.2.3.4", "abc", ":::", ""]


def test_addresses_match_the_standard_library(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "x string")
    for row in df.select("x", canonical_ip(F.col("x")).alias("c"), ip_key(F.col("x")).alias("k")).collect():
        try:
            address = ipaddress.ip_address(row["x"])
            mapped = address.ipv4_mapped if address.version == 6 else None
            number = int(address) if address.version == 6 else int(address) | 0xFFFF << 32
            expected = (str(mapped or address), f"{number:032x}")
        except ValueError:
            expected = (None, None)
        assert (row["c"], row["k"]) == expected, row["x"]


def test_network_bounds(spark):
    nets = ["10.0.0.0/8", "10.1.2.3/31", "0.0.0.0/0", "2001:db8::/33", "::/0", "1.2.3.4/32", "x/1", "1.2.3.4/33", "10.0.0.5"]
    rows = cidr_bounds(spark.createDataFrame([(n,) for n in nets], "cidr string")).collect()
    assert len(rows) == 6
    for row in rows:
        net = ipaddress.ip_network(row["cidr"], strict=False)
        shift = 0xFFFF << 32 if net.version == 4 else 0
        assert (row["lo"], row["hi"]) == (f"{int(net.network_address) | shift:032x}", f"{int(net.broadcast_address) | shift:032x}")


def test_profiles_of_short_and_long_network_lists_equal_brute_force(spark):
    peers = spark.createDataFrame([(f"r{i}", f"10.{i % 40}.{i}.1") for i in range(200)], "receipt_id string, peer_ip string")
    short = [("10.0.0.0/9", "half"), ("10.0.0.0/12", "wide"), ("10.7.0.0/16", "narrow")]
    long = short + [(f"10.{i // 200}.{i % 200}.0/24", f"n{i}") for i in range(1500)]
    for listed in (short, long):
        nets = sorted(((ipaddress.ip_network(cidr), name) for cidr, name in listed), key=lambda net: -net[0].prefixlen)
        for row in evidence.assign_profiles(peers, spark.createDataFrame(listed, "cidr string, profile string")).collect():
            peer = ipaddress.ip_address(row["peer_ip"])
            assert row["profile"] == next((name for net, name in nets if peer in net), "")


def test_split_bucket_matches_big_integers(spark):
    df = spark.range(300).select(F.concat(F.lit("rev-"), F.col("id").cast("string")).alias("r"))
    for row in df.select("r", split_bucket("s", F.col("r")).alias("b")).collect():
        digest = hashlib.sha256(b"s\x00" + row["r"].encode()).digest()
        assert row["b"] == int.from_bytes(digest[:8], "big") % 10000


def test_slotted_windows_equal_plain_ones(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 101).alias("t"), "id")
    order = [F.col("t"), F.col("id")]
    got = running_totals(df, ["k"], order, F.col("t") - F.col("t") % 10, {"total": F.col("id")})
    got = previous_values(got, ["k"], order, F.col("t") - F.col("t") % 10, ["id"]).collect()
    state: dict = {}
    for row in sorted(got, key=lambda r: (r["k"], r["t"], r["id"])):
        count, total, last = state.get(row["k"], (0, 0, None))
        assert (row["row_no"], row["total"], row["prev_id"]) == (count + 1, total + row["id"], last)
        state[row["k"]] = (count + 1, total + row["id"], row["id"])


@pytest.mark.parametrize("text,code", [
    (b'{"a":1}', None), (b"", "JSON_EMPTY_INPUT"), (b'{"a":01}', "JSON_SYNTAX_ERROR"), (b'{"a":1,}', "JSON_SYNTAX_ERROR"), (b"[1 2]", "JSON_SYNTAX_ERROR"),
    (b'{"\\u0061":1,"a":2}', "JSON_DUPLICATE_KEY"), (b'"\x01"', "JSON_SYNTAX_ERROR"), (b"nul", "JSON_SYNTAX_ERROR"), (b"[[]]]", "JSON_TRAILING_DATA"),
])
def test_json_check(text, code):
    assert check_json(text)[1] == code
    if code is None:
        json.loads(text)


def test_xml_and_csv_readers():
    assert read_xml('<a xmlns="u"><p:b xmlns:p="v">7</p:b></a>') == {"{u}a": {"@attributes": {"xmlns": "u"}, "{v}b": {"#text": "7", "@attributes": {"{xmlns}p": "v"}}}}
    assert read_csv('a,b\n1,x"y\n')[0] == "CSV_SYNTAX_ERROR"
    assert json.loads(read_csv('a,b\n"1 ""q""",2')[1])["records"] == [{"a": '1 "q"', "b": "2"}]


def test_octet_counted_frames(spark):
    df = spark.createDataFrame([(1, b"3 abc2 de"), (2, b"5 ab"), (3, b"0 x"), (4, b"12"), (5, b"")], "capture_id int, data binary")
    rows = [(r["capture_id"], r["frame_no"], bytes(r["frame"]) if r["frame"] is not None else None, r["error"]) for r in evidence.split_octet_counted(df).collect()]
    assert sorted(rows) == [(1, 0, b"abc", None), (1, 1, b"de", None), (2, 0, None, "FRAME_INCOMPLETE"), (3, 0, None, "INVALID_OCTET_COUNT"), (4, 0, None, "FRAME_INCOMPLETE")]


def _mapping(rules, taxonomies=None):
    return mp.Mapping("m", "1.0.0", tuple(rules), mp.reverse_taxonomies(taxonomies or {}))


def test_mapping_selectors_conflicts_and_conversions(spark):
    docs = [
        '{"items":[{"name":"source","value":"10.0.0.8"},{"name":"source","value":"10.0.0.9"}],"n":"7","x":"a","time":"2026-09-29 15:50:29"}',
        '{"items":[{"id":"other","value":"1.1.1.1"},{"key":"source","value":"::ffff:10.0.0.9"}],"n":1.0,"x":null}',
    ]
    rules = [
        mp.Rule("ip", "fields.items.source.value", "event.src_endpoint.ip", "ip", required=True),
        mp.Rule("n", "fields.n", "event.activity_id", "integer"),
        mp.Rule("e", "fields.x", "event.extensions.a", "string"), mp.Rule("f", "fields.x", "event.extensions.a.b", "string"),
        mp.Rule("t", "fields.time", "event.time", "timestamp", layouts=("2006-01-02 15:04:05",), timezone="+05:30"),
    ]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").select("i", F.struct(F.parse_json("d").alias("fields")).alias("parsed"))
    out = mp.apply_mapping(df, _mapping(rules), with_unmapped=True).orderBy("i").collect()
    first, second = out[0]["mapped"], out[1]["mapped"]
    assert [(i["rule_id"], i["code"]) for i in first["issues"]] == [("ip", "MAPPING_SOURCE_AMBIGUOUS"), ("f", "MAPPING_TARGET_CONFLICT")]
    assert first["event"]["activity_id"] == 7 and str(first["event"]["time"]) == "2026-09-29 10:20:29"
    assert second["event"]["src_endpoint"]["ip"] == "10.0.0.9"
    assert [(i["rule_id"], i["code"]) for i in second["issues"]] == [("n", "MAPPING_CONVERSION_FAILED"), ("e", "MAPPING_CONVERSION_FAILED"), ("f", "MAPPING_CONVERSION_FAILED")]
    assert "fields.items.1.value" not in second["unmapped"] and "fields.n" in second["unmapped"]


def test_mapping_configuration_is_strict():
    with pytest.raises(ValueError):
        mp.load_mapping('{"config_version":"mapping/1","id":"a","version":"1.0.0","rules":[{"id":"n","from":"fields.n","to":"event.class_name","convert":"string","guess":true}]}')
    with pytest.raises(ValueError):
        _mapping([], {"a": {"allow": ["same"], "deny": ["same"]}})
    assert mp.check_mapping(_mapping([mp.Rule("a", "fields.a", "receipt.peer", "ip")])) != []


def test_bundle_files_as_tables(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"config_version":"mapping/1","id":"m","version":"1.0.0","rules":[{"id":"a","from":"fields.a","to":"event.class_name","convert":"string","required":true}]}')
    (tmp_path / "t.json").write_text('{"config_version":"taxonomies/1","taxonomies":{"act":{"allow":["permit"],"deny":["block","drop"]}}}')
    assert [tuple(r)[3:6] for r in evidence.scan_rules(spark, str(tmp_path / "m.json")).collect()] == [("a", "fields.a", "event.class_name")]
    assert evidence.scan_aliases(spark, str(tmp_path / "t.json")).count() == 5


def test_issue_text(spark):
    row = spark.range(1).select(safe_code(F.lit("  bad-code!")), safe_code(F.lit("9x")), safe_code(F.lit("!")), safe_message(F.lit("a\u0001b")), safe_message(F.lit(" "))).first()
    assert tuple(row) == ("BAD_CODE", "ISSUE_9X", "UNKNOWN_ISSUE", "a b", "issue details unavailable")


def test_feature_set_contract():
    good = FeatureSet("f", "1.0.0", (Feature("a", "string", "event.action"), Feature("b", "number", "quality.score")))
    assert good.problems() == [] and len(good.digest()) == 64
    assert FeatureSet("f", "1.0.0", (Feature("b", "string", "event.action"), Feature("a", "string", "raw.sha256"))).problems()
