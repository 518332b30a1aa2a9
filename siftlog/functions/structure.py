"""Structure checks for the few payloads built-in expressions cannot settle.

JSON text that the VARIANT parser refuses (or that may break a limit), XML, and
CSV with quotes reach these Arrow functions; every other row passes NULL. The
helpers look at one payload at a time and keep no state.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from siftlog import vocab
from siftlog.functions.text import WHITESPACE

# --- JSON ----------------------------------------------------------------------

_JSON_TOKEN = re.compile(
    rb"[ \t\r\n]*(?:(?P<punct>[{}\[\],:])"
    rb'|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    rb"|(?P<atom>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))"
)
_JSON_SPACE = re.compile(rb"[ \t\r\n]*")


def check_json(data: bytes) -> tuple[bool, str | None, int, str]:
    """(syntax valid, first strict violation or None, byte offset, message).

    Syntax ignores repeated members and limits; the strict violation does not.
    """
    strict: tuple[str, int, str] | None = None

    def note(code: str, offset: int, message: str) -> None:
        nonlocal strict
        if strict is None:
            strict = (code, offset, message)

    pos, tokens, members = 0, 0, 0
    stack: list[set | None] = []  # a set of member names for an object, None for an array
    want = "value"
    while want != "end":
        hit = _JSON_TOKEN.match(data, pos)
        if hit is None:
            at = _JSON_SPACE.match(data, pos).end()
            if tokens == 0 and at == len(data):
                note("JSON_EMPTY_INPUT", at, "JSON payload is empty")
            note("JSON_SYNTAX_ERROR", at, "JSON payload has invalid syntax")
            return False, *strict
        pos = hit.end()
        punct, text = hit["punct"], hit["str"]
        if punct not in (b",", b":"):
            tokens += 1
            if tokens > vocab.MAX_TOKENS:
                note("JSON_TOKEN_LIMIT_EXCEEDED", pos, f"JSON tokens exceed the token limit of {vocab.MAX_TOKENS}")
        if want.startswith("value") and punct in (b"{", b"["):
            if len(stack) >= vocab.MAX_DEPTH:
                note("JSON_DEPTH_LIMIT_EXCEEDED", pos, f"JSON container nesting exceeds the depth limit of {vocab.MAX_DEPTH}")
            stack.append(set() if punct == b"{" else None)
            want = "key or end" if punct == b"{" else "value or end"
            continue
        if want.startswith("value") and punct is None:
            pass
        elif want.startswith("key") and text is not None:
            members += 1
            name = json.loads(text.decode("utf-8", "replace"), strict=False) if b"\\" in text else text
            if members > vocab.MAX_FIELDS:
                note("JSON_FIELD_LIMIT_EXCEEDED", pos, f"JSON object members exceed the field limit of {vocab.MAX_FIELDS}")
            plain = name if isinstance(name, str) else name[1:-1].decode("utf-8", "replace")
            if plain in stack[-1]:
                shown = plain if len(plain) <= 64 else plain[:64] + "…"
                note("JSON_DUPLICATE_KEY", pos, f"JSON object contains duplicate member {json.dumps(shown, ensure_ascii=False)}")
            stack[-1].add(plain)
            want = "colon"
            continue
        elif want == "colon" and punct == b":":
            want = "value"
            continue
        elif want == "comma or end" and punct == b",":
            want = "value" if stack[-1] is None else "key"
            continue
        elif want.endswith("end") and punct == (b"]" if stack and stack[-1] is None else b"}") and stack:
            stack.pop()
        else:
            note("JSON_SYNTAX_ERROR", hit.start() + len(hit[0]) - len(hit[0].lstrip(b" \t\r\n")), "JSON payload has invalid syntax")
            return False, *strict
        want = "comma or end" if stack else "end"
    rest = _JSON_SPACE.match(data, pos).end()
    if rest != len(data):
        note("JSON_TRAILING_DATA", rest, "JSON payload contains data after the first value")
        return False, *strict
    return (True, *strict) if strict else (True, None, 0, "")


# --- XML -----------------------------------------------------------------------

_NAME = r"[A-Za-z_:\u0080-\U0010ffff][\w.\-:\u0080-\U0010ffff]*"
_XML_TOKEN = re.compile(
    rf"(?P<text>[^<]+)|<!--(?P<comment>.*?)-->|<\?(?P<pi>.*?)\?>|<!\[CDATA\[(?P<cdata>.*?)\]\]>"
    rf"|</(?P<end>{_NAME})\s*>"
    rf"|<(?P<start>{_NAME})(?P<attrs>(?:\s*{_NAME}\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(?P<empty>/?)>"
    rf"|<!(?P<directive>(?:[^<>\"']|\"[^\"]*\"|'[^']*'|<(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>)*)>",
    re.S,
)
_XML_ATTR = re.compile(rf"({_NAME})\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
_XML_ENTITY = re.compile(r"&(?:(lt|gt|amp|apos|quot)|#([0-9]+)|#x([0-9a-fA-F]+));|(&)")
_XML_BAD_CHAR = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_XML_NAMED = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}
_XML_DECL = re.compile(r"^xml\s+(.*)$", re.S)


class _Refused(Exception):
    def __init__(self, code: str, offset: int, message: str):
        super().__init__(message)
        self.code, self.offset = code, offset


def _xml_text(text: str, at: int) -> str:
    def entity(hit: re.Match) -> str:
        if hit[4]:
            raise _Refused("XML_SYNTAX_ERROR", at, "XML payload has invalid syntax")
        if hit[1]:
            return _XML_NAMED[hit[1]]
        number = int(hit[2]) if hit[2] else int(hit[3], 16)
        if number > 0x10FFFF or 0xD800 <= number <= 0xDFFF:
            raise _Refused("XML_SYNTAX_ERROR", at, "XML payload has invalid syntax")
        return chr(number)

    out = _XML_ENTITY.sub(entity, text.replace("\r\n", "\n").replace("\r", "\n")) if "&" in text or "\r" in text else text
    if _XML_BAD_CHAR.search(out):
        raise _Refused("XML_SYNTAX_ERROR", at, "XML payload has invalid syntax")
    return out


def _xml_tokens(text: str):
    """Yield (kind, value, attributes, end position); raises on bad syntax."""
    pos, open_names = 0, []
    while pos < len(text):
        hit = _XML_TOKEN.match(text, pos)
        if hit is None:
            raise _Refused("XML_SYNTAX_ERROR", pos, "XML payload has invalid syntax")
        kind = hit.lastgroup if hit.lastgroup not in ("attrs", "empty") else "start"
        pos = hit.end()
        if kind == "text":
            if "]]>" in hit["text"]:
                raise _Refused("XML_SYNTAX_ERROR", pos, "XML payload has invalid syntax")
            yield "text", _xml_text(hit["text"], pos), None, pos
        elif kind == "cdata":
            yield "text", hit["cdata"], None, pos
        elif kind == "comment":
            if "--" in hit["comment"]:
                raise _Refused("XML_SYNTAX_ERROR", pos, "XML payload has invalid syntax")
            yield "skip", None, None, pos
        elif kind == "pi":
            decl = _XML_DECL.match(hit["pi"])
            values = dict((n, a or b) for n, a, b in _XML_ATTR.findall(decl[1])) if decl else {}
            if values.get("version", "1.0") != "1.0" or values.get("encoding", "utf-8").lower() != "utf-8":
                raise _Refused("XML_SYNTAX_ERROR", pos, "XML payload has invalid syntax")
            yield "skip", None, None, pos
        elif kind == "directive":
            yield "directive", hit["directive"].strip(), None, pos
        elif kind == "start":
            pairs = [(n, _xml_text(a or b, pos)) for n, a, b in _XML_ATTR.findall(hit["attrs"])]
            if any(n.count(":") > 1 for n in [hit["start"], *[n for n, _ in pairs]]):
                raise _Refused("XML_SYNTAX_ERROR", pos, "XML payload has invalid syntax")
            yield "start", hit["start"], pairs, pos
            if hit["empty"]:
                yield "end", hit["start"], None, pos
            else:
                open_names.append(hit["start"])
        else:
            if not open_names or open_names.pop() != hit["end"]:
                raise _Refused("XML_SYNTAX_ERROR", pos, "XML payload has invalid syntax")
            yield "end", hit["end"], None, pos
    if open_names:
        raise _Refused("XML_SYNTAX_ERROR", pos, "XML payload has invalid syntax")


def probe_xml(data: bytes) -> tuple[bool, bool, bool]:
    """(well formed, has an element, has a directive)."""
    element = directive = False
    try:
        for kind, _, _, _ in _xml_tokens(data.decode("utf-8")):
            element |= kind == "start"
            directive |= kind == "directive"
    except (_Refused, UnicodeDecodeError):
        return False, element, directive
    return True, element, directive


def _qualified(name: str, spaces: dict, element: bool) -> str:
    prefix, colon, local = name.partition(":")
    if not (colon and prefix and local):
        prefix, local = "", name
    if prefix == "xmlns" or (not prefix and (not element or local == "xmlns")):
        space = prefix
    elif prefix == "xml":
        space = "http://www.w3.org/XML/1998/namespace"
    else:
        space = spaces.get(prefix, prefix)
    return f"{{{space}}}{local}" if space else local


def read_xml(text: str) -> dict:
    """Root element as nested data; raises `_Refused` with an issue code."""
    tokens = fields = 0
    root: dict | None = None
    stack: list[tuple[str, dict, dict, list, dict]] = []
    for kind, value, pairs, end in _xml_tokens(text):
        tokens += 1
        if tokens > vocab.MAX_TOKENS:
            raise _Refused("XML_TOKEN_LIMIT_EXCEEDED", end, f"XML tokens exceed the token limit of {vocab.MAX_TOKENS}")
        if kind == "directive":
            for word, code, what in (("DOCTYPE", "XML_DTD_FORBIDDEN", "DTD"), ("ENTITY", "XML_ENTITY_FORBIDDEN", "entity")):
                if value[: len(word)].upper() == word:
                    raise _Refused(code, end, f"XML {what} declarations are forbidden")
        elif kind == "text":
            if stack:
                stack[-1][3].append(value)
            elif value.strip():
                if root is None:
                    raise _Refused("XML_SYNTAX_ERROR", end, "XML document contains text before the root element")
                raise _Refused("XML_TRAILING_DATA", end, "XML payload contains data after the root element")
        elif kind == "start":
            if root is not None:
                raise _Refused("XML_TRAILING_DATA", end, "XML payload contains data after the root element")
            if len(stack) >= vocab.MAX_DEPTH:
                raise _Refused("XML_DEPTH_LIMIT_EXCEEDED", end, f"XML element nesting exceeds the depth limit of {vocab.MAX_DEPTH}")
            fields += 1 + len(pairs)
            if fields > vocab.MAX_FIELDS:
                raise _Refused("XML_FIELD_LIMIT_EXCEEDED", end, f"XML elements and attributes exceed the field limit of {vocab.MAX_FIELDS}")
            spaces = stack[-1][4] if stack else {}
            declared = {n.partition(":")[2]: v for n, v in pairs if n == "xmlns" or n.startswith("xmlns:")}
            spaces = {**spaces, **declared} if declared else spaces
            attributes: dict = {}
            for name, text_value in pairs:
                full = _qualified(name, spaces, False)
                if full in attributes:
                    raise _Refused("XML_DUPLICATE_ATTRIBUTE", end, f"XML element contains duplicate attribute {json.dumps(full)}")
                attributes[full] = text_value
            stack.append((_qualified(value, spaces, True), attributes, {}, [], spaces))
        elif kind == "end":
            name, attributes, children, parts, _ = stack.pop()
            body = "".join(parts)
            node: object = body
            if attributes or children:
                node = children
                if attributes:
                    children["@attributes"] = attributes
                if body.strip():
                    children["#text"] = body
            if not stack:
                root = {name: node}
                continue
            siblings = stack[-1][2]
            if name not in siblings:
                siblings[name] = node
            elif isinstance(siblings[name], list):
                siblings[name].append(node)
            else:
                siblings[name] = [siblings[name], node]
    if root is None:
        if tokens == 0:
            raise _Refused("XML_EMPTY_INPUT", 0, "XML payload is empty")
        raise _Refused("XML_EMPTY_INPUT", len(text), "XML payload is empty")
    return root


# --- CSV with quotes --------------------------------------------------------------

_CSV_FIELD = re.compile(r'"((?:[^"]|"")*)"(?=,|\r?\n|\r?\Z)|([^",\n]*?)(?=,|\r?\n|\r?\Z)', re.S)


def csv_records(text: str, limit: int | None = None):
    """Records of quoted CSV text; None after the last one marks bad syntax."""
    pos, count = 0, 0
    while pos < len(text):
        blank = re.compile(r"\r?\n|\r\Z").match(text, pos)
        if blank:
            pos = blank.end()
            continue
        record = []
        while True:
            hit = _CSV_FIELD.match(text, pos)
            if hit is None:
                yield None
                return
            record.append(hit[1].replace('""', '"').replace("\r\n", "\n") if hit[1] is not None else hit[2])
            pos = hit.end()
            if text[pos:pos + 1] == ",":
                pos += 1
                continue
            newline = re.compile(r"\r?\n|\r?\Z").match(text, pos)
            pos = newline.end()
            break
        yield record
        count += 1
        if limit is not None and count >= limit:
            return


def read_csv(text: str) -> tuple[str | None, str]:
    """(issue code or None, message or JSON of columns and records)."""
    rows = csv_records(text)
    header = next(rows, "none")
    if header == "none":
        return "CSV_EMPTY_INPUT", "CSV payload is empty"
    if header is None:
        return "CSV_SYNTAX_ERROR", "CSV payload has invalid syntax"
    if len(header) > vocab.MAX_FIELDS:
        return "CSV_FIELD_LIMIT_EXCEEDED", f"CSV columns exceed the field limit of {vocab.MAX_FIELDS}"
    for index, name in enumerate(header):
        if not name.strip():
            return "CSV_EMPTY_HEADER", f"CSV header column {index + 1} is empty"
        if name in header[:index]:
            return "CSV_DUPLICATE_HEADER", f"CSV header contains duplicate column {json.dumps(name[:64], ensure_ascii=False)}"
    tokens, records = 1 + len(header), []
    for row in rows:
        if row is None or len(row) != len(header):
            return "CSV_SYNTAX_ERROR", "CSV payload has invalid syntax"
        tokens += 1 + len(row)
        if tokens > vocab.MAX_TOKENS:
            return "CSV_TOKEN_LIMIT_EXCEEDED", f"CSV tokens exceed the token limit of {vocab.MAX_TOKENS}"
        records.append(dict(zip(header, row)))
    return None, json.dumps({"columns": header, "records": records}, ensure_ascii=False)


_HEADER_CELL = re.compile(r"^[^\W_]+$|^(?:[^\W]|[_.\-])+$")


def probe_csv(text: str) -> bool:
    rows = list(csv_records(text, 2))
    if len(rows) < 2 or None in rows or len(rows[0]) < 2 or len(rows[0]) != len(rows[1]):
        return False
    return all(_HEADER_CELL.match(cell.strip()) for cell in rows[0])


# --- Arrow entry point ---------------------------------------------------------------

_FIELDS = [
    ("json_ok", T.BooleanType()), ("xml_ok", T.BooleanType()), ("xml_element", T.BooleanType()),
    ("xml_directive", T.BooleanType()), ("csv_ok", T.BooleanType()), ("code", T.StringType()),
    ("offset", T.IntegerType()), ("message", T.StringType()), ("body", T.StringType()),
]
CHECK_TYPE = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
CHECK_DDL = ", ".join(f"{n}: {t.simpleString()}" for n, t in _FIELDS)


def _check_one(kind: str, data: bytes, sample_size: int) -> list:
    row: list = [None] * len(_FIELDS)
    sample = data[:sample_size].decode("utf-8", "replace").strip(WHITESPACE).encode()
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = None
    if kind == "json":
        row[0] = check_json(sample)[0]
        if text is not None:
            row[5:8] = check_json(data)[1:]
    elif kind == "xml":
        row[1:4] = probe_xml(data[:sample_size].strip())
        if text is not None:
            try:
                row[8] = json.dumps(read_xml(text), ensure_ascii=False)
            except _Refused as refused:
                row[5:8] = [refused.code, len(text[: refused.offset].encode()), str(refused)]
    elif text is not None:
        row[4] = probe_csv(data[:sample_size].decode("utf-8", "replace"))
        code, body = read_csv(text)
        row[5:9] = [None, None, None, body] if code is None else [code, 0, body, None]
    return row


@F.pandas_udf(CHECK_TYPE)
def _check_udf(kind: pd.Series, data: pd.Series, sample_size: pd.Series) -> pd.DataFrame:
    empty = [None] * len(_FIELDS)
    rows = [
        _check_one(k, d, int(n)) if isinstance(k, str) and d is not None else empty
        for k, d, n in zip(kind, data, sample_size)
    ]
    out = pd.DataFrame(rows, columns=[n for n, _ in _FIELDS])
    out["offset"] = out["offset"].astype("Int32")
    return out


def structure_check(kind: Column, data: Column, sample_size: int) -> Column:
    """Probe and read results for rows with a kind; NULL fields for the others.

    One call serves detection and parsing. Two chained Python calls would cost a
    second Arrow pass, and the optimizer inlines chained calls into each other.
    """
    return _check_udf(kind, F.when(kind.isNotNull(), data), F.lit(sample_size))


def strict_json(text: Column) -> Column:
    """VARIANT of exactly one complete JSON value, NULL otherwise.

    The VARIANT parser stops after the first value, so trailing data would pass.
    Wrapping the text in an array together with a number taken from the text's
    own hash makes every early end visible: the number is then not element 1.
    """
    mark = F.xxhash64(text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    whole = F.try_variant_get(wrapped, "$[1]", "bigint") == mark
    return F.when(whole, F.try_variant_get(wrapped, "$[0]", "variant"))
