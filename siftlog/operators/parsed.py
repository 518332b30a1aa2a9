"""The common result of every parser: a struct column with fixed fields.

STRUCT(status, format, fields VARIANT, unmatched BINARY,
       issues ARRAY<STRUCT(code, severity, offset, message)>)
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftlog.functions.text import compact_set

ISSUE = "struct<code:string,severity:string,offset:int,message:string>"
ISSUES = f"array<{ISSUE}>"


def issue(code: str | Column, severity: str, offset: Column | int, message: str | Column) -> Column:
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        lit(code).alias("code"), F.lit(severity).alias("severity"), lit(offset).cast("int").alias("offset"), lit(message).alias("message")
    )


def no_issues() -> Column:
    return F.array().cast(ISSUES)


def some_issues(*items: Column) -> Column:
    """Issues in the given order; NULL items are dropped. No two of them may be alike."""
    return compact_set(list(items), ISSUES)


def result(status: Column | str, fmt: Column | str, fields: Column | None, unmatched: Column | None, issues: Column) -> Column:
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        lit(status).alias("status"), lit(fmt).alias("format"),
        (fields if fields is not None else F.lit(None).cast("variant")).alias("fields"),
        (unmatched if unmatched is not None else F.lit(None)).cast("binary").alias("unmatched"),
        issues.cast(ISSUES).alias("issues"),
    )


def invalid(fmt: str, item: Column, unmatched: Column | None = None) -> Column:
    return result("INVALID", fmt, None, unmatched, F.array(item))


def first_bad_byte(text: Column) -> Column:
    """Byte offset of the first invalid UTF-8 sequence."""
    return F.octet_length(F.substring_index(F.make_valid_utf8(text), "�", 1))


def variant_map(entries: list[tuple]) -> Column:
    """VARIANT object of the entries that are not NULL; values become VARIANT.

    A third item tells whether the value is there, where that costs less than the value itself.
    """
    return nested([(k, v.cast("variant"), *(given or [v.isNotNull()])) for k, v, *given in entries])


def attribute_variant(keys: Column, values: Column) -> Column:
    """Attributes as a VARIANT object; a repeated key holds its values in order."""
    names = F.array_distinct(keys)
    plain = F.to_variant_object(F.map_from_arrays(keys, values))

    def gathered(name: Column) -> Column:
        own = F.filter(values, lambda _v, i: F.get(keys, i) == name)
        return F.when(F.size(own) > 1, own.cast("variant")).otherwise(F.get(own, F.lit(0)).cast("variant"))

    repeated = F.to_variant_object(F.map_from_arrays(names, F.transform(names, gathered)))
    return F.when(F.size(names) == F.size(keys), plain).otherwise(repeated)


_ENTRIES = "array<struct<k:string,v:variant>>"


def nested(entries: list[tuple]) -> Column:
    """VARIANT object whose values are VARIANTs already; entries as for `variant_map`.

    Joined arrays of one entry or none instead of a filter: what stands below a lambda is not compiled.
    """
    parts = [
        F.when(given[0] if given else v.isNotNull(), F.array(F.struct(F.lit(k).alias("k"), v.alias("v"))).cast(_ENTRIES)).otherwise(F.array().cast(_ENTRIES))
        for k, v, *given in entries
    ]
    return F.to_variant_object(F.map_from_entries(F.concat(*parts)))
