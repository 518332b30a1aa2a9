"""Render table columns into raw log payloads, one expression per format.

All renderers are plain string expressions, so a corpus of any size is produced
inside the scan stage. They are the basis of the round-trip checks: render,
interpret, compare with the columns the payload was rendered from.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FORMATS = ["json", "kv", "cef", "leef", "syslog", "csv", "xml", "router"]


def _replace(col: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def quote_json(col: Column) -> Column:
    return F.concat(F.lit('"'), _replace(col, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")]), F.lit('"'))


def quote_kv(col: Column) -> Column:
    return F.concat(F.lit('"'), _replace(col, [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")]), F.lit('"'))


def escape_cef(col: Column) -> Column:
    return _replace(col, [("\\", "\\\\"), ("=", "\\="), ("\n", "\\n")])


def quote_csv(col: Column) -> Column:
    return F.concat(F.lit('"'), _replace(col, [('"', '""')]), F.lit('"'))


def escape_xml(col: Column) -> Column:
    return _replace(col, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def escape_sd(col: Column) -> Column:
    return _replace(col, [("\\", "\\\\"), ('"', '\\"'), ("]", "\\]"), ("\n", " ")])


def payload(fmt: Column, f: dict[str, Column]) -> Column:
    """Payload text for the row's format.

    `f` supplies: time, kind, src, dst, spt, dpt, proto, action, severity, user, note.
    """
    c, lit = F.concat, F.lit
    json_text = c(
        lit('{"timestamp":'), quote_json(f["time"]), lit(',"event_type":'), quote_json(f["kind"]),
        lit(',"src_ip":'), quote_json(f["src"]), lit(',"src_port":'), f["spt"],
        lit(',"dst_ip":'), quote_json(f["dst"]), lit(',"dst_port":'), f["dpt"],
        lit(',"protocol":'), quote_json(f["proto"]), lit(',"action":'), quote_json(f["action"]),
        lit(',"severity":'), quote_json(f["severity"]), lit(',"actor":{"name":'), quote_json(f["user"]),
        lit('},"note":'), quote_json(f["note"]), lit(',"tags":["a","b"],"synthetic":true}'),
    )
    kv_text = c(
        lit("time="), f["time"], lit(" type="), f["kind"], lit(" src="), f["src"], lit(" dst="), f["dst"],
        lit(" sport="), f["spt"], lit(" dport="), f["dpt"], lit(" proto="), f["proto"], lit(" action="), f["action"],
        lit(" severity="), f["severity"], lit(" user="), f["user"], lit(" note="), quote_kv(f["note"]),
        lit(" synthetic=true"),
    )
    cef_text = c(
        lit("CEF:0|Example|Synthetic Firewall|1.0|100|"), f["kind"], lit("|"), f["severity"],
        lit("|rt="), f["time"], lit(" src="), f["src"], lit(" dst="), f["dst"], lit(" spt="), f["spt"],
        lit(" dpt="), f["dpt"], lit(" proto="), f["proto"], lit(" act="), f["action"], lit(" suser="), f["user"],
        lit(" msg="), escape_cef(f["note"]),
    )
    leef_text = c(
        lit("LEEF:2.0|Example|Synthetic Sensor|1.0|"), f["kind"], lit("|^|devTime="), f["time"],
        lit("^src="), f["src"], lit("^dst="), f["dst"], lit("^srcPort="), f["spt"], lit("^dstPort="), f["dpt"],
        lit("^proto="), f["proto"], lit("^action="), f["action"], lit("^sev="), f["severity"],
        lit("^usrName="), f["user"], lit("^msg="), F.replace(f["note"], lit("\n"), lit(" ")),
    )
    syslog_text = c(
        lit("<134>1 "), f["time"], lit(" edge-01 sensor - "), f["kind"], lit(' [net src="'), f["src"],
        lit('" dst="'), f["dst"], lit('" spt="'), f["spt"], lit('" dpt="'), f["dpt"], lit('" proto="'), f["proto"],
        lit('" action="'), f["action"], lit('" severity="'), f["severity"], lit('" user="'), f["user"],
        lit('" note="'), escape_sd(f["note"]), lit('"] synthetic event'),
    )
    csv_text = c(
        lit("timestamp,event_type,src_ip,src_port,dst_ip,dst_port,protocol,action,severity,user,note\n"),
        f["time"], lit(","), f["kind"], lit(","), f["src"], lit(","), f["spt"], lit(","), f["dst"], lit(","), f["dpt"],
        lit(","), f["proto"], lit(","), f["action"], lit(","), f["severity"], lit(","), f["user"], lit(","),
        F.when(f["note"].rlike('[",\n]'), quote_csv(f["note"])).otherwise(f["note"]), lit("\n"),
    )
    xml_text = c(
        lit('<?xml version="1.0" encoding="UTF-8"?>\n<event synthetic="true"><timestamp>'), f["time"],
        lit("</timestamp><type>"), f["kind"], lit('</type><source ip="'), f["src"], lit('" port="'), f["spt"],
        lit('"/><destination ip="'), f["dst"], lit('" port="'), f["dpt"], lit('"/><protocol>'), f["proto"],
        lit("</protocol><action>"), f["action"], lit("</action><severity>"), f["severity"],
        lit("</severity><user>"), f["user"], lit("</user><note>"), escape_xml(f["note"]), lit("</note></event>"),
    )
    router_text = c(
        F.upper(f["kind"]), lit("|ts="), f["time"], lit("|src="), f["src"], lit("|dst="), f["dst"],
        lit("|action="), f["action"], lit("|user="), f["user"], lit("|synthetic=true"),
    )
    bodies = dict(zip(FORMATS, [json_text, kv_text, cef_text, leef_text, syslog_text, csv_text, xml_text, router_text]))
    chosen = F.when(fmt == "malformed_json", c(lit('{"src_ip":'), quote_json(f["src"]), lit(', "action":')))
    chosen = chosen.when(
        fmt == "duplicate_json",
        c(lit('{"src_ip":'), quote_json(f["src"]), lit(',"action":"allow","action":'), quote_json(f["action"]), lit("}")),
    )
    chosen = chosen.when(fmt == "unknown", c(lit("VX9~a="), f["src"], lit("~z="), f["action"], lit("~opaque=17")))
    for name, body in bodies.items():
        chosen = chosen.when(fmt == name, body)
    return chosen
