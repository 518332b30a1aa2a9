"""Parsers as column stages over one scan.

Every parser reads a text column that is NULL on rows of other formats, so all
formats are handled in one pass: no filter and union per format, no second read
of the source. Expressions on NULL cost almost nothing. Patterns use possessive
quantifiers only, which keeps them linear and free of recursion.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from siftlog import vocab
from siftlog.functions.structure import strict_json, structure_check
from siftlog.functions.text import RFC3339_SHAPE, count_char, parse_rfc3339
from siftlog.operators.detect import READ_COLUMN
from siftlog.operators.parsed import (
    attribute_variant, first_bad_byte, invalid, issue, nested, no_issues, result, some_issues, variant_map,
)

WS = r"[ \t\r\n]"
LIMIT = vocab.MAX_INPUT_BYTES


def _guard(text: Column, fmt: str, large: str, broken: str, words: tuple[str, str]) -> tuple[Column, Column]:
    """(failure result or NULL, text that passed)."""
    too_large = F.octet_length(text) > LIMIT
    failure = F.when(too_large, invalid(fmt, issue(large, "ERROR", LIMIT, words[0]))).when(
        ~F.is_valid_utf8(text), invalid(fmt, issue(broken, "ERROR", first_bad_byte(text), words[1]))
    )
    return failure, F.when(~too_large & F.is_valid_utf8(text), text)


# --- key=value -----------------------------------------------------------------

_KEY = r"[A-Za-z0-9_.:\-]++"
_DQ = r'"(?:[^"\\]++|\\.)*+"'
_SQ = r"'(?:[^'\\]++|\\.)*+'"
_KV_PAIR = rf"{_KEY}=(?:(?:{_DQ}|{_SQ})(?={WS}|\z)|(?![\"'])[^ \t\r\n]*+)"
_KV_PREFIX = rf"(?s)^{WS}*+(?:{_KV_PAIR}(?:{WS}++|\z)){{0,{vocab.MAX_FIELDS}}}+"
_KV_TOKEN = rf"(?s){_KV_PAIR}{WS}*+"


def unescape(text: Column, simple: dict[str, str]) -> Column:
    """Resolve backslash escapes; unknown ones stay as they are.

    Cutting at escaped backslashes first leaves pieces without `\\\\`, in which
    the other escapes can be replaced one after the other.
    """
    def piece(p: Column) -> Column:
        for old, new in simple.items():
            p = F.replace(p, F.lit("\\" + old), F.lit(new))
        return p

    resolved = F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")
    return F.when(F.contains(text, F.lit("\\")), resolved).otherwise(text)


def _offsets(start: Column, tokens: Column) -> Column:
    """Byte offset of each token, given that of the first."""
    lengths = F.transform(tokens, F.octet_length)
    return F.transform(tokens, lambda _t, i: start + F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, n: a + n))


def parse_kv(df: DataFrame, text: str, out: str) -> DataFrame:
    failure, clean = _guard(
        F.col(text), "kv", "KV_PAYLOAD_TOO_LARGE", "KV_INVALID_UTF8",
        (f"key-value payload exceeds the {LIMIT}-byte limit", "key-value payload is not valid UTF-8"),
    )
    df = df.withColumn("_x", clean).withColumn("_pre", F.regexp_extract("_x", _KV_PREFIX, 0))
    x, pre = F.col("_x"), F.col("_pre")
    df = df.withColumn("_tok", F.regexp_extract_all(pre, F.lit(_KV_TOKEN), F.lit(0)))
    df = df.withColumn("_rest", F.substr(x, F.length(pre) + 1))
    tok, rest = F.col("_tok"), F.col("_rest")
    keys = F.transform(tok, lambda t: F.substring_index(t, "=", 1))
    body = F.transform(tok, lambda t: F.rtrim(F.substr(t, F.instr(t, "=") + 1), F.lit(" \t\r\n")))
    df = df.withColumn("_keys", keys).withColumn("_body", body)
    keys, body = F.col("_keys"), F.col("_body")

    def is_quoted(b: Column) -> Column:
        return b.startswith('"') | b.startswith("'")

    escapes = {"n": "\n", "r": "\r", "t": "\t", "'": "'", '"': '"'}
    values = F.transform(
        body, lambda b: F.when(is_quoted(b), unescape(F.substr(b, F.lit(2), F.length(b) - 2), escapes)).otherwise(b)
    )
    odd = r"(?s)^(?:[^\\]++|\\[nrt\\'\"])*+\\"
    start = F.octet_length(F.regexp_extract(x, rf"^{WS}*+", 0))
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    strange = F.exists(body, lambda b: is_quoted(b) & b.rlike(odd))

    def per_token(offset: Column, i: Column) -> Column:
        key, b = F.get(keys, i), F.get(body, i)
        unknown = issue(
            "KV_UNKNOWN_ESCAPE", "WARNING",
            offset + F.octet_length(key) + F.octet_length(F.regexp_extract(b, odd, 0)), "unknown key-value escape was preserved",
        )
        shown = F.when(F.length(key) > 64, F.concat(F.substring(key, 1, 64), F.lit("…"))).otherwise(key)
        twice = issue("KV_DUPLICATE_KEY", "WARNING", offset, F.concat(F.lit('duplicate key "'), shown, F.lit('" was preserved')))
        return some_issues(
            F.when(is_quoted(b) & b.rlike(odd), unknown), F.when(F.array_position(keys, key) <= i, twice)
        )

    # Offsets are only worked out on rows that have something to report.
    token_issues = F.when(repeated | strange, F.flatten(F.transform(_offsets(start, tok), per_token))).otherwise(no_issues())
    at = F.octet_length(pre)
    head = F.regexp_extract(rest, rf"^{_KEY}=", 0)
    quote_body = F.substr(rest, F.length(head) + 1)
    closed = F.regexp_extract(quote_body, rf"(?s)^(?:{_DQ}|{_SQ})", 0)
    full = F.size(tok) >= vocab.MAX_FIELDS
    # An escape that the end cuts off is reported where it begins.
    cut_escape = F.when(rest.rlike(r"(?s)^(?:[^\\]++|\\.)*+\\\z"), 1).otherwise(0)
    stop = (
        F.when(rest == "", F.lit(None))
        .when(head == "", issue("KV_TOKEN_MALFORMED", "WARNING", at, "expected key=value token"))
        .when(full, issue("KV_FIELD_LIMIT_EXCEEDED", "WARNING", at, f"key-value fields exceed the field limit of {vocab.MAX_FIELDS}"))
        .when(closed != "", issue("KV_TOKEN_MALFORMED", "WARNING", at + F.octet_length(head) + F.octet_length(closed),
                                  "key-value token has malformed data after a quoted value"))
        .otherwise(issue("KV_UNTERMINATED_QUOTE", "WARNING", at + F.octet_length(rest) - cut_escape, "key-value token has an unterminated quoted value"))
    )
    df = df.withColumn("_iss", F.concat(token_issues, some_issues(stop)))
    iss = F.col("_iss")
    status = F.when(F.size(iss) == 0, "PARSED").when(F.size(tok) == 0, "INVALID").otherwise("PARTIALLY_PARSED")
    blank = F.trim(x, F.lit(" \t\r\n")) == ""
    good = result(status, "kv", nested([("attributes", attribute_variant(keys, values), keys.isNotNull())]), F.when(rest != "", rest), iss)
    final = (
        F.when(F.col(text).isNull(), F.lit(None)).when(failure.isNotNull(), failure)
        .when(blank, invalid("kv", issue("KV_EMPTY_INPUT", "ERROR", 0, "key-value payload is empty"))).otherwise(good)
    )
    return df.withColumn(out, final).drop("_x", "_pre", "_tok", "_rest", "_keys", "_body", "_iss")


# --- CEF and LEEF ----------------------------------------------------------------

_CEF_FIELDS = ["version", "device_vendor", "device_product", "device_version", "event_class_id", "name", "severity"]
_CEF_KEY = r"[A-Za-z0-9_.\-]++="
_CEF_HEAD = r"(?s)^(?:(?:[^\\|]++|\\.)*+\|){7}+"
_CEF_VALUE = rf"(?:[^\\ \t\r\n]++|\\.|\\\z|{WS}++(?!{_CEF_KEY}))*+"
_CEF_PAIR = rf"{_CEF_KEY}{_CEF_VALUE}"
_CEF_PREFIX = rf"(?s)^{WS}*+(?:{_CEF_PAIR}(?:{WS}++|\z)){{0,{vocab.MAX_FIELDS}}}+"
_CEF_TOKEN = rf"(?s){_CEF_PAIR}(?:{WS}++|\z)"


def _utf8_guard(text: Column, fmt: str) -> tuple[Column, Column]:
    return _guard(text, fmt, "INPUT_TOO_LARGE", "INVALID_UTF8", ("input exceeds parser byte limit", "CEF and LEEF require UTF-8 input"))


def _marker(df: DataFrame, word: str) -> DataFrame:
    """Split at the marker that starts the text or follows a blank or tab."""
    x = F.col("_x")
    df = df.withColumn("_at", F.when(x.startswith(word), 1).otherwise(F.regexp_instr(x, F.lit(rf"(?<=[ \t]){word}"))))
    df = df.withColumn("_prefix", F.when(F.col("_at") > 1, F.substr(x, F.lit(1), F.col("_at") - 1)))
    return df.withColumn("_b", F.when(F.col("_at") > 0, F.substr(x, F.col("_at") + len(word))))


def _record_end(col: Column) -> Column:
    return F.regexp_replace(col, r"\r?\n\z", "")


def _escape_issues(raw: Column, allowed: str, base: Column) -> Column:
    """One issue per unknown or cut-off CEF escape, in order."""
    pieces = F.regexp_extract_all(raw, F.lit(r"(?s)[^\\]++|\\.|\\\z"), F.lit(0))

    def check(piece: Column, offset: Column) -> Column:
        return (
            F.when(piece == "\\", issue("CEF_ESCAPE_TRUNCATED", "WARNING", offset, "trailing CEF escape was preserved"))
            .when(piece.startswith("\\") & ~piece.rlike(rf"(?s)^\\[{allowed}]"),
                  issue("CEF_ESCAPE_UNKNOWN", "WARNING", offset, "unknown CEF escape was preserved"))
        )

    found = F.transform(_offsets(base, pieces), lambda o, i: check(F.get(pieces, i), o))
    return F.when(raw.contains("\\"), F.array_compact(found)).otherwise(no_issues())


def parse_cef(df: DataFrame, text: str, out: str) -> DataFrame:
    failure, clean = _utf8_guard(F.col(text), "cef")
    df = _marker(df.withColumn("_x", clean), "CEF:")
    df = df.withColumn("_h", F.regexp_extract("_b", _CEF_HEAD, 0))
    df = df.withColumn("_hf", F.regexp_extract_all("_h", F.lit(r"(?s)((?:[^\\|]++|\\.)*+)\|"), F.lit(1)))
    df = df.withColumn("_ext", F.substr("_b", F.length("_h") + 1))
    df = df.withColumn("_e", _record_end(F.col("_ext")))
    df = df.withColumn("_pre", F.regexp_extract("_e", _CEF_PREFIX, 0))
    df = df.withColumn("_tok", F.regexp_extract_all("_pre", F.lit(_CEF_TOKEN), F.lit(0)))
    df = df.withColumn("_rest", F.substr("_e", F.length("_pre") + 1))
    body, head, hf, tok, rest = (F.col(c) for c in ("_b", "_h", "_hf", "_tok", "_rest"))
    base = F.octet_length(F.coalesce("_prefix", F.lit(""))) + 4
    head_values = F.transform(hf, lambda h: unescape(h, {"|": "|"}))
    head_at = F.transform(_offsets(base, F.transform(hf, lambda h: F.concat(h, F.lit("|")))), lambda o: o)
    empty_at = F.array_position(head_values, "")
    head_issues = F.flatten(F.transform(hf, lambda h, i: _escape_issues(h, r"\\|", F.get(head_at, i))))
    keys = F.transform(tok, lambda t: F.substring_index(t, "=", 1))
    # White space that separates pairs is cut; white space at the end of the record belongs to the value.
    last = F.size(tok) - 1
    raws = F.transform(tok, lambda t, i: F.when(
        (i == last) & (rest == ""), F.substr(t, F.instr(t, "=") + 1)
    ).otherwise(F.regexp_replace(F.substr(t, F.instr(t, "=") + 1), rf"(?<!{WS}){WS}++\z", "")))
    df = df.withColumn("_keys", keys).withColumn("_raws", raws)
    keys, raws = F.col("_keys"), F.col("_raws")
    values = F.transform(raws, lambda r: unescape(r, {"=": "=", "n": "\n", "r": "\r"}))
    ext_at = base + F.octet_length(head)
    first_at = ext_at + F.octet_length(F.regexp_extract("_e", rf"^{WS}*+", 0))
    value_issues = F.when(
        F.contains("_e", F.lit("\\")),
        F.flatten(F.transform(_offsets(first_at, tok), lambda o, i: _escape_issues(F.get(raws, i), r"\\=nr", o + F.octet_length(F.get(keys, i)) + 1))),
    ).otherwise(no_issues())
    stop = F.when(rest != "", F.when(
        rest.rlike(rf"^{_CEF_KEY}"), issue("FIELD_LIMIT_EXCEEDED", "WARNING", ext_at + F.octet_length("_pre"), "CEF extension field limit reached")
    ).otherwise(issue("CEF_EXTENSION_MALFORMED", "WARNING", ext_at + F.octet_length("_pre"), "expected extension key=value")))
    df = df.withColumn("_iss", F.concat(F.when(head.contains("\\"), head_issues).otherwise(no_issues()), value_issues, some_issues(stop)))
    df = df.withColumn("_hv", head_values)
    header = F.to_variant_object(F.map_from_arrays(F.array(*[F.lit(n) for n in _CEF_FIELDS]), F.col("_hv")))
    fields = nested([
        ("header", header, F.col("_hv").isNotNull()), ("extension", attribute_variant(keys, values), keys.isNotNull()), ("raw_extension", F.col("_ext").cast("variant")),
        ("transport_prefix", F.col("_prefix").cast("variant")),
    ])
    iss = F.col("_iss")
    good = result(F.when((F.size(iss) == 0) & (rest == ""), "PARSED").otherwise("PARTIALLY_PARSED"), "cef", fields, F.when(rest != "", rest), iss)
    names = F.array(*[F.lit(n) for n in _CEF_FIELDS])
    final = (
        F.when(F.col(text).isNull(), F.lit(None)).when(failure.isNotNull(), failure)
        .when(F.col("_at") == 0, invalid("cef", issue("CEF_HEADER_MISSING", "ERROR", 0, "CEF: marker was not found at a valid boundary")))
        .when(head == "", invalid("cef", issue("CEF_HEADER_FIELD_MISSING", "ERROR", base + F.octet_length(body), "CEF header requires seven pipe-delimited fields")))
        .when(empty_at > 0, invalid("cef", issue("CEF_REQUIRED_HEADER_EMPTY", "ERROR", F.get(head_at, (empty_at - 1).cast("int")),
                                                 F.concat(F.get(names, (empty_at - 1).cast("int")), F.lit(" is required")))))
        .otherwise(good)
    )
    return df.withColumn(out, final).drop(
        "_x", "_at", "_prefix", "_b", "_h", "_hf", "_ext", "_e", "_pre", "_tok", "_rest", "_keys", "_raws", "_iss", "_hv")


_LEEF_FIELDS = ["version", "vendor", "product", "product_version", "event_id"]


def _literal_split(text: Column, delimiter: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), F.replace(delimiter, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    # Constant patterns are compiled once; only unusual delimiters pay per row.
    return F.when(delimiter == "\t", F.split(text, "\t")).when(delimiter == "^", F.split(text, r"\^")).otherwise(F.split(text, quoted))


def parse_leef(df: DataFrame, text: str, out: str) -> DataFrame:
    failure, clean = _utf8_guard(F.col(text), "leef")
    df = _marker(df.withColumn("_x", clean), "LEEF:")
    df = df.withColumn("_core", F.split("_b", r"\|", 6))
    core = F.col("_core")
    df = df.withColumn("_rem", F.get(core, F.lit(5))).withColumn("_ver", F.get(core, F.lit(0)))
    v2 = F.col("_ver") == "2.0"
    df = df.withColumn("_decl", F.when(v2 & F.contains("_rem", F.lit("|")), F.substring_index("_rem", "|", 1)))
    decl = F.col("_decl")
    digits = F.regexp_extract(decl, r"^0?[xX](.+)\z", 1)
    hex_ok = digits.rlike(r"^[0-9a-fA-F]{1,4}\z")
    even = F.when(F.length(digits) % 2 == 1, F.concat(F.lit("0"), digits)).otherwise(digits)
    decoded = F.unhex(F.when(hex_ok, even)).cast("string")
    single = (F.length(decl) == 1) & (decl != "|") & (decl != "\u0000")
    delimiter = F.when(digits != "", F.when(hex_ok & ~F.contains(decoded, F.lit("\u0000")), decoded)).when(single, decl)
    df = df.withColumn("_delim", F.when(v2, delimiter).otherwise(F.lit("\t")))
    df = df.withColumn("_attr", F.when(v2, F.substr("_rem", F.length("_decl") + 2)).otherwise(F.col("_rem")))
    attr, delim = F.col("_attr"), F.col("_delim")
    wide = F.concat(delim, F.lit("|"))
    only_wide = F.contains(attr, wide) & ~F.contains(F.replace(attr, wide, F.lit("")), delim)
    df = df.withColumn("_delim2", F.when(only_wide, wide).otherwise(delim)).withColumn("_a", _record_end(attr))
    df = df.withColumn("_tok", F.when(F.col("_a") != "", _literal_split(F.col("_a"), F.col("_delim2"))).otherwise(F.array().cast("array<string>")))
    tok, delim2 = F.col("_tok"), F.col("_delim2")

    def usable(t: Column) -> Column:
        key = F.substring_index(t, "=", 1)
        return (t == "") | (F.contains(t, F.lit("=")) & (key != "") & ~key.rlike(r"(?U)^\s|\s\z"))

    flags = F.transform(tok, usable)
    df = df.withColumn("_stop", F.array_position(flags, False))
    stop_at = F.col("_stop")
    kept = F.filter(F.when(stop_at > 0, F.slice(tok, F.lit(1), (stop_at - 1).cast("int"))).otherwise(tok), lambda t: t != "")
    df = df.withColumn("_kept", kept)
    over = F.size("_kept") > vocab.MAX_FIELDS
    kept = F.when(over, F.slice("_kept", 1, vocab.MAX_FIELDS)).otherwise(F.col("_kept"))
    # Bytes up to the token that stopped the parse.
    used = F.when(over, F.element_at(F.col("_kept"), F.lit(vocab.MAX_FIELDS + 1)))
    cut = F.when(over, F.array_position(tok, used)).when(stop_at > 0, stop_at)
    unmatched = F.when(cut > 0, F.call_function("array_join", F.slice(tok, cut.cast("int"), F.size(tok)), delim2))
    attr_at = F.octet_length("_x") - F.octet_length(attr)
    where = attr_at + F.octet_length("_a") - F.octet_length(unmatched)
    iss = some_issues(F.when(over, issue("FIELD_LIMIT_EXCEEDED", "WARNING", where, "LEEF attribute field limit reached")).when(
        stop_at > 0, issue("LEEF_ATTRIBUTE_MALFORMED", "WARNING", where, "expected attribute key=value")))
    keys = F.transform(kept, lambda t: F.substring_index(t, "=", 1))
    values = F.transform(kept, lambda t: F.substr(t, F.instr(t, "=") + 1))
    df = df.withColumn("_keys", keys).withColumn("_vals", values).withColumn("_un", unmatched).withColumn("_iss", iss)
    header = variant_map([*[(n, F.get(core, F.lit(i))) for i, n in enumerate(_LEEF_FIELDS)], ("delimiter", decl), ("attribute_delimiter", delim2)])
    fields = nested([
        ("header", header, F.lit(True)), ("attributes", attribute_variant(F.col("_keys"), F.col("_vals")), F.col("_keys").isNotNull()), ("raw_attributes", attr.cast("variant")),
        ("transport_prefix", F.col("_prefix").cast("variant")),
    ])
    good = result(F.when(F.size("_iss") == 0, "PARSED").otherwise("PARTIALLY_PARSED"), "leef", fields, F.col("_un"), F.col("_iss"))
    base = F.octet_length(F.coalesce("_prefix", F.lit(""))) + 5
    five = F.slice(core, 1, 5)
    empty = F.array_position(five, "")
    ahead = F.octet_length(F.array_join(F.slice(core, F.lit(1), (empty - 1).cast("int")), "|"))
    names = F.array(*[F.lit(n) for n in _LEEF_FIELDS])
    rem_at = base + F.octet_length("_b") - F.octet_length("_rem")
    final = (
        F.when(F.col(text).isNull(), F.lit(None)).when(failure.isNotNull(), failure)
        .when(F.col("_at") == 0, invalid("leef", issue("LEEF_HEADER_MISSING", "ERROR", 0, "LEEF: marker was not found at a valid boundary")))
        .when(F.size(core) < 6, invalid("leef", issue("LEEF_HEADER_FIELD_MISSING", "ERROR", base + F.octet_length("_b"),
                                                      "LEEF header requires version, vendor, product, product version, and event ID")))
        .when(empty > 0, invalid("leef", issue("LEEF_REQUIRED_HEADER_EMPTY", "ERROR", base + F.when(empty > 1, ahead + 1).otherwise(0),
                                               F.concat(F.get(names, (empty - 1).cast("int")), F.lit(" is required")))))
        .when(v2 & decl.isNull(), invalid("leef", issue("LEEF_DELIMITER_MISSING", "ERROR", rem_at, "LEEF 2.0 requires a delimiter declaration")))
        .when(v2 & delim.isNull(), invalid("leef", issue("LEEF_DELIMITER_INVALID", "ERROR", rem_at,
              "LEEF delimiter must be one character or x/0x followed by 1-4 hexadecimal digits")))
        .when(~F.col("_ver").isin("1.0", "2.0"), invalid("leef", issue("LEEF_VERSION_UNSUPPORTED", "ERROR", base, "only LEEF 1.0 and 2.0 are supported")))
        .otherwise(good)
    )
    return df.withColumn(out, final).drop(
        "_x", "_at", "_prefix", "_b", "_core", "_rem", "_ver", "_decl", "_delim", "_attr", "_delim2", "_a", "_tok", "_stop", "_kept",
        "_keys", "_vals", "_un", "_iss")


# --- syslog -------------------------------------------------------------------------

_SD_NAME = r"[!-~&&[^=\]\"]]{1,32}"
_SD_VALUE = r"(?:[^\"\\\]\x00-\x1f\x7f]++|\\[\"\\\]])*+"
_SD_PARAM = rf" {_SD_NAME}=\"{_SD_VALUE}\""
_SD_ELEMENT = rf"\[{_SD_NAME}(?:{_SD_PARAM})*+\]"
_SD = rf"^(?:-|(?:{_SD_ELEMENT})++)"
_HEADER_TOKEN = r"^[!-~]++\z"
_5424 = [("timestamp", 64), ("hostname", 255), ("app_name", 48), ("proc_id", 128), ("msg_id", 32)]
# fixed values: month names of the older format
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH_DAYS = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def parse_syslog(df: DataFrame, text: str, out: str) -> DataFrame:
    """RFC 5424 and RFC 3164; `text` may hold any bytes."""
    x = F.col(text)
    df = df.withColumn("_pri", F.regexp_extract(x, r"^<([0-9]{1,3})>", 1)).withColumn("_p", F.col("_pri").try_cast("int"))
    df = df.withColumn("_r", F.when(F.col("_p") <= 191, F.substr(x, F.length("_pri") + 3)))
    start = F.length("_pri") + 2
    df = df.withColumn("_new", F.col("_r").rlike("^[0-9]"))
    df = _stage_5424(df, F.col("_new"), start)
    df = _stage_3164(df, ~F.col("_new") & (F.col("_r") != ""), start)
    base = [("priority", F.col("_p")), ("facility", F.call_function("div", F.col("_p"), F.lit(8)).cast("int")), ("severity", F.col("_p") % 8)]
    whole = x.cast("binary")
    bad_pri = (
        F.when((F.octet_length(x) < 3) | ~x.startswith("<"), issue("SYSLOG_INVALID_PRIORITY", "ERROR", 0, "syslog priority must begin with '<'"))
        .when(~x.rlike(r"^<[^>]{1,3}>"), issue("SYSLOG_INVALID_PRIORITY", "ERROR", 0, "syslog priority must contain one to three digits"))
        .when(F.col("_pri") == "", issue("SYSLOG_INVALID_PRIORITY", "ERROR", 1, "syslog priority contains a non-digit"))
        .otherwise(issue("SYSLOG_INVALID_PRIORITY", "ERROR", 1, "syslog priority must be between 0 and 191"))
    )
    fields_new, fields_old = variant_map(base + _fields_5424()), variant_map(base + _fields_3164())
    final = (
        F.when(x.isNull(), F.lit(None))
        .when(F.octet_length(x) == 0, invalid("syslog", issue("SYSLOG_EMPTY_INPUT", "ERROR", 0, "syslog payload is empty")))
        .when(F.octet_length(x) > LIMIT, invalid("syslog", issue("SYSLOG_INPUT_TOO_LARGE", "ERROR", LIMIT, "syslog payload exceeds the configured byte limit")))
        .when((F.col("_pri") == "") | (F.col("_p") > 191), invalid("syslog", bad_pri, whole))
        .when(F.col("_r") == "", result("PARTIALLY_PARSED", "syslog", variant_map(base), None,
                                        F.array(issue("SYSLOG_MALFORMED_HEADER", "ERROR", start, "priority is not followed by a syslog header"))))
        .when(F.col("_new"), result(F.when(F.size("_n_iss") == 0, "PARSED").otherwise("PARTIALLY_PARSED"), "syslog_rfc5424", fields_new, F.col("_n_un"), F.col("_n_iss")))
        .otherwise(result("PARTIALLY_PARSED", "syslog_rfc3164", fields_old, F.col("_o_un"), F.col("_o_iss")))
    )
    df = df.withColumn(out, final)
    return df.drop("_pri", "_p", "_r", "_new", *[c for c in df.columns if c.startswith(("_n_", "_o_"))])


def _stage_5424(df: DataFrame, gate: Column, start: Column) -> DataFrame:
    r = F.when(gate, F.col("_r"))
    df = df.withColumn("_n_t", F.split(r, " ", 7))
    t = F.col("_n_t")
    df = df.withColumn("_n_v", (F.size(t) > 1) & (F.get(t, F.lit(0)) != ""))
    v_ok = F.col("_n_v") & F.get(t, F.lit(0)).rlike(r"^0*1\z")
    # Number of leading header tokens that are present and followed by a blank.
    count, good = F.lit(0), v_ok
    for i in range(1, 6):
        good = good & (F.size(t) > i + 1) & (F.get(t, F.lit(i)) != "")
        count = count + good.cast("int")
    df = df.withColumn("_n_ok", v_ok).withColumn("_n_c", count)
    df = df.withColumn("_n_sd0", F.when(F.col("_n_c") == 5, F.get(t, F.lit(6))))
    df = df.withColumn("_n_sd", F.regexp_extract("_n_sd0", _SD, 0))
    sd0, sd = F.col("_n_sd0"), F.col("_n_sd")
    df = df.withColumn("_n_after", F.when(sd != "", F.substr(sd0, F.length(sd) + 1)))
    after = F.col("_n_after")
    # An opening bracket right after the matched elements begins a broken one.
    df = df.withColumn("_n_sdok", F.coalesce((sd != "") & ~(sd.startswith("[") & after.startswith("[")), F.lit(False)))
    sd_ok = F.col("_n_sdok")
    lengths = F.transform(t, F.octet_length)
    offsets = [start + F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, n: a + n + 1) for i in range(7)]
    items: list[Column] = [
        F.when(~F.col("_n_v"), issue("SYSLOG_MALFORMED_HEADER", "ERROR", start, "RFC5424 version is not followed by a header")),
        F.when(F.col("_n_v") & ~F.col("_n_ok"), issue("SYSLOG_UNSUPPORTED_VERSION", "ERROR", start,
               F.concat(F.lit('unsupported RFC5424 version "'), F.get(t, F.lit(0)), F.lit('"')))),
    ]
    for i, (name, limit) in enumerate(_5424, start=1):
        token = F.get(t, F.lit(i))
        present = F.col("_n_c") >= i
        bad = (F.octet_length(token) > limit) | ~token.rlike(_HEADER_TOKEN)
        items.append(F.when(present & bad, issue("SYSLOG_INVALID_HEADER_FIELD", "WARNING", offsets[i], f"RFC5424 {name} contains invalid bytes or exceeds its length limit")))
        if name == "timestamp":
            wrong = (token != "-") & (parse_rfc3339(token).isNull() | ~token.rlike(RFC3339_SHAPE))
            items.append(F.when(present & wrong, issue("SYSLOG_INVALID_TIMESTAMP", "WARNING", offsets[i], "RFC5424 timestamp is not valid RFC3339")))
        items.append(F.when(F.col("_n_ok") & (F.col("_n_c") == i - 1), issue(
            "SYSLOG_MALFORMED_HEADER", "ERROR", offsets[i], f"RFC5424 {name} is missing or not followed by structured data")))
    reach = F.col("_n_c") == 5
    sd_text = (
        F.when(sd0 == "", F.lit("RFC5424 structured data is missing"))
        .when(~sd0.startswith("["), F.lit("RFC5424 structured data must be '-' or begin with '['"))
        .otherwise(F.lit("RFC5424 structured-data element is malformed"))
    )
    items.append(F.when(reach & ~sd_ok, issue("SYSLOG_INVALID_STRUCTURED_DATA", "ERROR", offsets[6] + F.octet_length(sd), sd_text)))
    loose = reach & sd_ok & (after != "") & ~after.startswith(" ")
    items.append(F.when(loose, issue("SYSLOG_INVALID_STRUCTURED_DATA", "ERROR", offsets[6] + F.octet_length(sd),
                                     "RFC5424 structured data must be followed by a space before the message")))
    df = df.withColumn("_n_iss", F.when(gate, some_issues(*items)))
    tail = F.array_join(F.slice(t, F.col("_n_c") + 2, 7), " ")
    un = (
        F.when(~F.col("_n_ok"), r).when(F.col("_n_c") < 5, tail).when(~sd_ok, sd0).when(loose, after)
    )
    return df.withColumn("_n_un", un.cast("binary"))


def _sd_elements() -> Column:
    sd = F.col("_n_sd")

    def element(text: Column) -> Column:
        names = F.regexp_extract_all(text, F.lit(rf" ({_SD_NAME})=\"({_SD_VALUE})\""), F.lit(1))
        values = F.regexp_extract_all(text, F.lit(rf" ({_SD_NAME})=\"({_SD_VALUE})\""), F.lit(2))
        params = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), unescape(v, {'"': '"', "]": "]"}).alias("value")))
        return F.struct(F.regexp_extract(text, rf"^\[({_SD_NAME})", 1).alias("id"), params.alias("parameters"))

    elements = F.transform(F.regexp_extract_all(sd, F.lit(_SD_ELEMENT), F.lit(0)), element)
    return F.to_variant_object(elements)


def _fields_5424() -> list[tuple[str, Column]]:
    t, c = F.col("_n_t"), F.col("_n_c")
    out = [("version", F.when(F.col("_n_ok"), 1))]
    for i, (name, _) in enumerate(_5424, start=1):
        token = F.get(t, F.lit(i))
        out.append((name, F.when((c >= i) & (token != "-"), token)))
    ok = F.col("_n_sdok")
    after = F.col("_n_after")
    out.append(("structured_data", F.when(ok, _sd_elements()), ok))
    out.append(("structured_data_raw", F.when(ok, F.col("_n_sd").cast("binary"))))
    out.append(("message", F.when(ok & after.startswith(" "), F.substr(after, F.lit(2)).cast("binary"))))
    return out


def _stage_3164(df: DataFrame, gate: Column, start: Column) -> DataFrame:
    r = F.when(gate, F.col("_r"))
    df = df.withColumn("_o_r", r)
    r = F.col("_o_r")
    long_enough = (F.octet_length(r) > 15) & (F.substring(r, 16, 1) == " ")
    df = df.withColumn("_o_len", F.coalesce(long_enough, F.lit(False)))
    df = df.withColumn("_o_ts", F.when(F.col("_o_len"), F.substring(r, 1, 15)))
    ts = F.col("_o_ts")
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(ts, 1, 3)))
    day = F.trim(F.substring(ts, 5, 2)).try_cast("int")
    limit = F.get(F.array(*[F.lit(d) for d in _MONTH_DAYS]), (month - 1).cast("int"))
    shaped = ts.rlike(r"^[A-Za-z]{3} [ 0-9][0-9] (?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z")
    df = df.withColumn("_o_mon", month.cast("int")).withColumn("_o_day", day)
    df = df.withColumn("_o_tok", F.coalesce(shaped & (month > 0) & (day >= 1) & (day <= limit), F.lit(False)))
    df = df.withColumn("_o_rest", F.when(F.col("_o_tok"), F.substr(r, F.lit(17))))
    rest = F.col("_o_rest")
    df = df.withColumn("_o_host", F.when(F.instr(rest, " ") > 1, F.substring_index(rest, " ", 1)))
    host = F.col("_o_host")
    df = df.withColumn("_o_body", F.when(host.isNotNull(), F.substr(rest, F.length(host) + 2)))
    body = F.col("_o_body")
    colon = F.instr(body, ":")
    df = df.withColumn("_o_pref", F.when(colon > 0, F.substr(body, F.lit(1), colon - 1)))
    pref = F.col("_o_pref")
    cut = F.regexp_extract(pref, r"(?s)^(.+)\[([^\[]*)\]\z", 1)
    df = df.withColumn("_o_tag", F.when((cut != "") & (F.octet_length(pref) > 2), cut).otherwise(pref))
    df = df.withColumn("_o_pid", F.when((cut != "") & (F.octet_length(pref) > 2), F.regexp_extract(pref, r"(?s)^(.+)\[([^\[]*)\]\z", 2)))
    tag, pid = F.col("_o_tag"), F.col("_o_pid")
    df = df.withColumn("_o_tagok", F.coalesce(tag.rlike(r"^[A-Za-z0-9_.\-]{1,48}\z"), F.lit(False)))
    host_at, body_at = start + 16, start + 17 + F.octet_length(host)
    bad_host = (F.octet_length(host) > 255) | ~host.rlike(_HEADER_TOKEN) | (host == "-")
    year = F.when(F.col("_o_tok"), issue("SYSLOG_RFC3164_YEAR_UNKNOWN", "WARNING", start, "RFC3164 timestamp has no year; no year was inferred"))
    items = [
        F.when(~F.col("_o_len"), issue("SYSLOG_MALFORMED_HEADER", "ERROR", start, "RFC3164 timestamp or hostname is missing")),
        F.when(F.col("_o_len") & ~F.col("_o_tok"), issue("SYSLOG_INVALID_TIMESTAMP", "ERROR", start, "RFC3164 timestamp is invalid")),
        year,
        F.when(F.col("_o_tok") & host.isNull(), issue("SYSLOG_MALFORMED_HEADER", "ERROR", host_at, "RFC3164 hostname is not followed by message content")),
        F.when(bad_host, issue("SYSLOG_INVALID_HEADER_FIELD", "WARNING", host_at, "RFC3164 hostname is invalid")),
        F.when(body.isNotNull() & pref.isNull(), issue("SYSLOG_RFC3164_TAG_MISSING", "WARNING", body_at,
               "RFC3164 tag delimiter is missing; remaining bytes were preserved as message")),
        F.when(pref.isNotNull() & ~F.col("_o_tagok"), issue("SYSLOG_INVALID_HEADER_FIELD", "WARNING", body_at, "RFC3164 tag is invalid")),
        F.when(F.col("_o_tagok") & pid.isNotNull() & ~pid.rlike(r"^[0-9]++\z"), issue(
            "SYSLOG_RFC3164_INVALID_PID", "WARNING", body_at + F.octet_length(tag) + 1, "RFC3164 process id is not numeric")),
    ]
    df = df.withColumn("_o_iss", F.when(gate, some_issues(*items)))
    un = F.when(~F.col("_o_len") | ~F.col("_o_tok"), r).when(host.isNull(), rest)
    return df.withColumn("_o_un", un.cast("binary"))


def _fields_3164() -> list[tuple[str, Column]]:
    ok, tag_ok, body = F.col("_o_tok"), F.col("_o_tagok"), F.col("_o_body")
    message = F.when(tag_ok, F.regexp_replace(F.substr(body, F.length("_o_pref") + 2), "^ ", "")).otherwise(body)
    return [
        ("timestamp", F.when(ok, F.col("_o_ts"))), ("timestamp_month", F.when(ok, F.col("_o_mon"))), ("timestamp_day", F.when(ok, F.col("_o_day"))),
        ("timestamp_clock", F.when(ok, F.substr("_o_ts", F.lit(8)))), ("hostname", F.col("_o_host")),
        ("tag", F.when(tag_ok, F.col("_o_tag"))), ("proc_id", F.when(tag_ok, F.col("_o_pid"))), ("message", message.cast("binary")),
    ]


# --- JSON, XML, CSV -------------------------------------------------------------------


def _prepare_json(df: DataFrame, text: str) -> DataFrame:
    """`_j` VARIANT when the text is fine, `_j_kind` when it needs the check."""
    x = F.col(text)
    df = df.withColumn("_j_u", F.is_valid_utf8(x) & (F.octet_length(x) <= LIMIT))
    df = df.withColumn("_j", strict_json(F.when(F.col("_j_u"), F.btrim(x, F.lit(" \t\r\n")))))
    # Limits can only be broken by long text or by very many opening brackets.
    suspect = (F.octet_length(x) > vocab.MAX_TOKENS) | (count_char(x, "{[") > vocab.MAX_DEPTH)
    return df.withColumn("_j_kind", F.when(F.col("_j_u") & (F.col("_j").isNull() | suspect), "json"))


def _prepare_csv(df: DataFrame, text: str) -> DataFrame:
    """`_c_rows` for unquoted text that is regular; `_c_kind` for quoted text."""
    x = F.col(text)
    fine = F.is_valid_utf8(x) & (F.octet_length(x) <= LIMIT)
    df = df.withColumn("_c_u", fine)
    quoted = F.contains(x, F.lit('"'))
    df = df.withColumn("_c_kind", F.when(fine & quoted, "csv"))
    lines = F.filter(F.split(F.when(fine & ~quoted, x), r"\r?\n|\r\z"), lambda line: line != "")
    return df.withColumn("_c_rows", lines)


def parse_structured(df: DataFrame, json_text: str, xml_text: str, csv_text: str, read: str | None = None) -> DataFrame:
    """Add `_p_json`, `_p_xml`, `_p_csv`; one shared Arrow call for hard rows.

    `read` names a column with the check detection has made already.
    """
    df = _prepare_csv(_prepare_json(df, json_text), csv_text)
    xt = F.col(xml_text)
    df = df.withColumn("_x_u", F.is_valid_utf8(xt) & (F.octet_length(xt) <= LIMIT))
    if read is None:
        kind = F.coalesce("_j_kind", F.when(F.col("_x_u"), "xml"), F.col("_c_kind"))
        data = F.coalesce(F.col(json_text), xt, F.col(csv_text)).cast("binary")
        df = df.withColumn("_k", kind).withColumn("_s", structure_check(F.col("_k"), data, vocab.SAMPLE_BYTES))
    else:
        df = df.withColumn("_k", F.lit(None)).withColumn("_s", F.col(read))
    s = F.col("_s")
    caught = F.array(issue(s["code"], "ERROR", s["offset"], s["message"]))

    j = F.col(json_text)
    json_fail, _ = _guard(j, "json", "JSON_PAYLOAD_TOO_LARGE", "JSON_INVALID_UTF8",
                          (f"JSON payload exceeds the {LIMIT}-byte limit", "JSON payload is not valid UTF-8"))
    is_object = F.try_variant_get("_j", "$", "map<string,variant>").isNotNull()
    fields = F.when(is_object, F.col("_j")).otherwise(nested([("$", F.col("_j"))]))
    broken = s["code"].isNotNull() | F.col("_j").isNull()
    # Only text that neither starts an object nor an array arrives here unchecked.
    unsure = F.array(
        F.when(F.btrim(j, F.lit(" \t\r\n")) == "", issue("JSON_EMPTY_INPUT", "ERROR", 0, "JSON payload is empty"))
        .otherwise(issue("JSON_SYNTAX_ERROR", "ERROR", 0, "JSON payload has invalid syntax"))
    )
    df = df.withColumn("_p_json", F.when(j.isNull(), F.lit(None)).when(json_fail.isNotNull(), json_fail).when(
        broken, result("INVALID", "json", None, None, F.when(s["code"].isNotNull(), caught).otherwise(unsure))
    ).otherwise(result("PARSED", "json", fields, None, no_issues())))

    xml_fail, _ = _guard(xt, "xml", "XML_PAYLOAD_TOO_LARGE", "XML_INVALID_UTF8",
                         (f"XML payload exceeds the {LIMIT}-byte limit", "XML payload is not valid UTF-8"))
    body = F.try_parse_json(s["body"])
    df = df.withColumn("_p_xml", F.when(xt.isNull(), F.lit(None)).when(xml_fail.isNotNull(), xml_fail).when(
        s["code"].isNotNull(), result("INVALID", "xml", None, None, caught)
    ).when(
        body.isNull(), invalid("xml", issue("XML_SYNTAX_ERROR", "ERROR", 0, "XML payload has invalid syntax"))
    ).otherwise(result("PARSED", "xml", body, None, no_issues())))

    c = F.col(csv_text)
    csv_fail, _ = _guard(c, "csv", "CSV_PAYLOAD_TOO_LARGE", "CSV_INVALID_UTF8",
                         (f"CSV payload exceeds the {LIMIT}-byte limit", "CSV payload is not valid UTF-8"))
    rows = F.col("_c_rows")
    df = df.withColumn("_c_h", F.split(F.get(rows, F.lit(0)), ",")).withColumn("_c_b", F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))))
    head, lines = F.col("_c_h"), F.col("_c_b")
    width = F.size(head)
    blank_at = F.array_position(F.transform(head, lambda h: F.regexp_replace(h, r"(?U)^\s++\z", "")), "")
    ragged = F.exists(lines, lambda line: count_char(line, ",") != width - 1)
    tokens = (F.size(lines) + 1) * (width + 1)
    plain = F.to_variant_object(F.transform(lines, lambda line: F.map_from_arrays(head, F.split(line, ","))))
    doc = nested([("columns", F.to_variant_object(head), head.isNotNull()), ("records", plain, lines.isNotNull())])

    def csv_issue(code: str, message: Column | str) -> Column:
        return invalid("csv", issue(code, "ERROR", 0, message))

    fast = (
        F.when(F.size(rows) == 0, csv_issue("CSV_EMPTY_INPUT", "CSV payload is empty"))
        .when(width > vocab.MAX_FIELDS, csv_issue("CSV_FIELD_LIMIT_EXCEEDED", f"CSV columns exceed the field limit of {vocab.MAX_FIELDS}"))
        .when(blank_at > 0, csv_issue("CSV_EMPTY_HEADER", F.concat(F.lit("CSV header column "), blank_at.cast("string"), F.lit(" is empty"))))
        .when(F.size(F.array_distinct(head)) < width, csv_issue("CSV_DUPLICATE_HEADER", "CSV header contains a duplicate column"))
        .when(ragged, csv_issue("CSV_SYNTAX_ERROR", "CSV payload has invalid syntax"))
        .when(tokens > vocab.MAX_TOKENS, csv_issue("CSV_TOKEN_LIMIT_EXCEEDED", f"CSV tokens exceed the token limit of {vocab.MAX_TOKENS}"))
        .otherwise(result("PARSED", "csv", doc, None, no_issues()))
    )
    slow = F.when(s["code"].isNotNull(), result("INVALID", "csv", None, None, caught)).otherwise(
        result("PARSED", "csv", F.try_parse_json(s["body"]), None, no_issues()))
    df = df.withColumn("_p_csv", F.when(c.isNull(), F.lit(None)).when(csv_fail.isNotNull(), csv_fail).when(F.col("_c_kind").isNotNull(), slow).otherwise(fast))
    return df.drop("_j_u", "_j", "_j_kind", "_c_u", "_c_kind", "_c_rows", "_c_h", "_c_b", "_x_u", "_k", "_s")


# --- named captures ---------------------------------------------------------------------

_GROUP = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\((\?P?<([A-Za-z_][A-Za-z0-9_]*)>|\?[:=!<>])?", re.S)


def compile_captures(pattern: str) -> tuple[str, list[tuple[str, int]]]:
    """(Java pattern without names, [(capture name, group number)]).

    The pattern must be anchored at both ends and name its captures.
    """
    if not (pattern.startswith("^") and pattern.endswith("$")) or len(pattern) > 32 << 10:
        raise ValueError("pattern must be anchored with ^ and $ and bounded")
    names, number, out, last = [], 0, [], 0
    for hit in _GROUP.finditer(pattern):
        if not hit[0].startswith("("):
            continue
        if hit[2]:
            number += 1
            names.append((hit[2], number))
            out += [pattern[last:hit.start()], "("]
            last = hit.end()
        elif hit[1] is None:
            number += 1
    out.append(pattern[last:])
    if not names or len({n for n, _ in names}) != len(names):
        raise ValueError("captures must be named and unique")
    return "".join(out)[:-1] + r"\z", names


def parse_captures(df: DataFrame, text: str, out: str, pattern: str, fmt: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Named captures of one vetted pattern as fields."""
    java, names = compile_captures(pattern)
    if set(required) - {n for n, _ in names}:
        raise ValueError("required capture is not defined by the pattern")
    failure, clean = _guard(F.col(text), fmt, "INPUT_TOO_LARGE", "INVALID_UTF8",
                            ("input exceeds parser byte limit", "declarative text parsers require UTF-8 input"))
    x = F.col("_x")
    df = df.withColumn("_x", clean).withColumn("_m", x.rlike(java))
    entries, items = [], []
    for name, number in names:
        value = F.regexp_extract(F.when(F.col("_m"), x), java, number)
        # An empty text is either an empty or an absent capture; a back reference tells which.
        absent = (value == "") & ~x.rlike(f"{java}(?=\\{number}(?:))")
        entries.append((name, F.when(~absent, value)))
        if name in required:
            items.append(F.when(absent, issue("RE2_REQUIRED_CAPTURE_MISSING", "WARNING", 0, f"required capture {name} did not participate")))
    iss = some_issues(*items) if items else no_issues()
    df = df.withColumn("_iss", iss)
    status = F.when(F.size("_iss") == 0, "PARSED").otherwise("PARTIALLY_PARSED")
    final = (
        F.when(F.col(text).isNull(), F.lit(None)).when(failure.isNotNull(), failure)
        .when(~F.col("_m"), invalid(fmt, issue("RE2_NO_MATCH", "ERROR", 0, "input does not match the configured pattern")))
        .otherwise(result(status, fmt, variant_map(entries), None, F.col("_iss")))
    )
    return df.withColumn(out, final).drop("_x", "_m", "_iss")


# --- dispatch ---------------------------------------------------------------------------

CATCH_ALL = r"^(?P<message>[\s\S]*)$"


IMPLEMENTATIONS = ("kv", "cef", "leef", "syslog", "json", "xml", "csv", "router")


def parse(
    df: DataFrame, raw: str = "raw", impl: str = "detection.impl", only: tuple[str, ...] = IMPLEMENTATIONS, read: str | None = None
) -> DataFrame:
    """Add `parsed`: each row goes to the parser its detection selected.

    `only` leaves out parsers a job cannot meet, which keeps its plan small.
    """
    if read is None and READ_COLUMN in df.columns:
        read = READ_COLUMN
    text = F.col(raw).cast("string")
    df = df.withColumn("_impl", F.col(impl))

    def given(name: str) -> Column:
        return F.when(F.col("_impl") == name, text) if name in only else F.lit(None).cast("string")

    # A parser's text and result are columns while they are needed: every projection copies all columns of a row.
    done = None
    if {"json", "xml", "csv"} & set(only):
        df = df.withColumns({f"_in_{n}": given(n) for n in ("json", "xml", "csv")})
        df = parse_structured(df, "_in_json", "_in_xml", "_in_csv", read)
        df = df.withColumn("_done", F.coalesce(*[F.col(f"_p_{n}") for n in ("json", "xml", "csv") if n in only]))
        df, done = df.drop("_in_json", "_in_xml", "_in_csv", "_p_json", "_p_xml", "_p_csv", read or ""), "_done"
    steps = {"kv": parse_kv, "cef": parse_cef, "leef": parse_leef, "syslog": parse_syslog}
    steps["router"] = lambda rows, name, out: parse_captures(rows, name, out, CATCH_ALL, "delimited_text")
    for name, step in steps.items():
        if name in only:
            df = step(df.withColumn(f"_in_{name}", given(name)), f"_in_{name}", f"_p_{name}")
            result_of = F.col(f"_p_{name}")
            df = df.withColumn("_done", F.coalesce(done, result_of) if done else result_of).drop(f"_in_{name}", f"_p_{name}")
            done = "_done"
    return df.withColumnRenamed("_done", "parsed").drop("_impl", READ_COLUMN)


def document_limits(parsed: str = "parsed") -> Column:
    """Which limit, if any, ended a parse."""
    codes = F.transform(F.col(parsed)["issues"], lambda i: i["code"])
    hit = F.filter(codes, lambda c: c.rlike("(?:FIELD|DEPTH|TOKEN)_LIMIT_EXCEEDED$|TOO_LARGE$"))
    return F.get(hit, F.lit(0))
