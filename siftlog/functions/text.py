"""Text helpers built from JVM-side column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: the Unicode White_Space characters
WHITESPACE = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_space(col: Column) -> Column:
    """Trim Unicode white space at both ends; linear, no regex."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return F.coalesce(trim_space(col) == "", F.lit(True))


def valid_utf8(text: Column) -> Column:
    return F.is_valid_utf8(text)


def count_char(text: Column, chars: str) -> Column:
    """Number of single-byte characters of `chars` found in `text`."""
    left = text
    for c in chars:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(left)


def drop_controls(col: Column, limit: int) -> Column:
    """Remove C0 controls and DEL, then keep at most `limit` bytes."""
    return byte_prefix(F.regexp_replace(col, "[\\x00-\\x1f\\x7f]", ""), limit)


def byte_prefix(col: Column, limit: int) -> Column:
    """Longest whole-character prefix of at most `limit` bytes."""
    cut = F.substring(col.cast("binary"), 1, limit)
    return F.when(F.octet_length(col) <= limit, col).otherwise(
        F.regexp_replace(F.make_valid_utf8(cut.cast("string")), "�+$", "")
    )


def rfc3339(ts: Column, sub_ns: Column | None = None) -> Column:
    """UTC RFC 3339 text with trailing zeros of the fraction removed."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    digits = F.date_format(ts, "SSSSSS")
    if sub_ns is not None:
        digits = F.concat(digits, F.lpad(F.coalesce(sub_ns, F.lit(0)).cast("string"), 3, "0"))
    fraction = F.regexp_replace(digits, "0+$", "")
    return F.concat(whole, F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction)), F.lit("Z"))


def int_div(col: Column, divisor: int) -> Column:
    """Exact integer division; `/` would go through DOUBLE and lose digits."""
    return F.call_function("div", col, F.lit(divisor))


def micros_of(ns: Column) -> Column:
    """TIMESTAMP of epoch nanoseconds, below-microsecond digits dropped."""
    return F.timestamp_micros(int_div(ns, 1000))


RFC3339_SHAPE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})\z"
)


def parse_rfc3339(text: Column) -> Column:
    """TIMESTAMP for strict RFC 3339 text, NULL otherwise."""
    shaped = F.when(text.rlike(RFC3339_SHAPE), F.translate(text, ",", "."))
    return shaped.try_cast("timestamp")


def sub_micro_ns(text: Column) -> Column:
    """Nanoseconds below the microsecond in a fractional-second text."""
    digits = F.regexp_extract(text, r"[.,][0-9]{6}([0-9]{1,3})", 1)
    return F.when(digits == "", F.lit(0)).otherwise(F.rpad(digits, 3, "0").try_cast("int"))


def json_escape_html(col: Column) -> Column:
    """Escape <, > and & in JSON text the way web-safe encoders do."""
    out = F.replace(col, F.lit("&"), F.lit("\\u0026"))
    out = F.replace(out, F.lit("<"), F.lit("\\u003c"))
    return F.replace(out, F.lit(">"), F.lit("\\u003e"))


def compact_set(cols: list[Column], kind: str) -> Column:
    """Distinct items that are not NULL, in order, as ARRAY `kind`; items must be comparable.

    array_compact would do for distinct items, but it is a filter with a lambda: Spark
    interprets such a function with all expressions below it instead of compiling them.
    """
    return F.array_except(F.array(*cols).cast(kind), F.array(F.lit(None)).cast(kind))


def code_set(cols: list[Column]) -> Column:
    """Sorted distinct non-null codes."""
    return F.sort_array(compact_set(cols, "array<string>"))
