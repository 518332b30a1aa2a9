"""IP addresses as canonical text plus a sortable hexadecimal key.

Everything here is a built-in expression: no row leaves the JVM for an address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\z"


def is_v4(col: Column) -> Column:
    return col.rlike(V4)


def v4_number(col: Column) -> Column:
    parts = F.split(col, r"\.")
    number = F.lit(0).cast("bigint")
    for index in range(4):
        number = number * 256 + F.get(parts, F.lit(index)).try_cast("bigint")
    return F.when(is_v4(col), number)


def v4_key(col: Column) -> Column:
    """32 hex digits of the IPv4-mapped IPv6 address."""
    return F.concat(F.lit("0" * 20 + "ffff"), F.lower(F.lpad(F.hex(v4_number(col)), 8, "0")))


_HEX = r"[0-9a-f]{1,4}"
_RUN = rf"(?:{_HEX}(?::{_HEX})*+)?"
_FULL = rf"^(?:{_HEX}:){{7}}{_HEX}\z"
_SHORT = rf"^({_RUN})::({_RUN})\z"
_TAIL_V4 = r"^(.*:)((?:[0-9]{1,3}\.){3}[0-9]{1,3})\z"


def _let(value: Column, body) -> Column:
    """Bind `value` once inside `body` instead of repeating its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hex_tail(core: Column) -> Column:
    """Rewrite a dotted tail as two hex groups."""
    def mixed(tail: Column) -> Column:
        pair = _let(v4_number(tail), lambda n: F.concat(
            F.lower(F.hex(F.call_function("div", n, F.lit(65536)))), F.lit(":"), F.lower(F.hex(n % 65536))))
        return F.when(tail == "", core).otherwise(F.concat(F.regexp_extract(core, _TAIL_V4, 1), pair))

    return _let(F.regexp_extract(core, _TAIL_V4, 2), mixed)


def _expanded(left: Column, right: Column) -> Column:
    """Groups around :: with the missing zero groups between them."""
    def list_of(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    return _let(F.struct(list_of(left).alias("l"), list_of(right).alias("r")), lambda s: _let(
        F.lit(8) - F.size(s["l"]) - F.size(s["r"]),
        lambda missing: F.when(missing >= 1, F.concat(s["l"], F.array_repeat(F.lit("0"), missing), s["r"]))))


def _v6_groups(col: Column) -> Column:
    """Eight lower-case hex groups without leading zeros; NULL when not IPv6."""
    def groups(text: Column) -> Column:
        return F.when(text.rlike(_FULL), F.split(text, ":")).when(
            text.rlike(_SHORT), _expanded(F.regexp_extract(text, _SHORT, 1), F.regexp_extract(text, _SHORT, 2)))

    raw = _let(F.lower(F.substring_index(col, "%", 1)), lambda core: _let(_hex_tail(core), groups))
    return F.transform(raw, lambda g: F.regexp_replace(g, "^0+(?=.)", ""))


def _v6_joined(groups: Column) -> Column:
    """Canonical text: the longest run of zero groups (two or more) becomes ::."""
    def shorten(joined: Column) -> Column:
        out = None
        for length in range(8, 1, -1):
            run = ":" + "0:" * length
            short = F.concat(F.substring_index(joined, run, 1), F.lit("::"), F.substr(joined, F.instr(joined, run) + len(run)))
            hit = F.contains(joined, F.lit(run))
            out = F.when(hit, short) if out is None else out.when(hit, short)
        return F.regexp_replace(F.regexp_replace(out.otherwise(joined), "^:(?!:)", ""), "(?<!:):$", "")

    return _let(F.concat(F.lit(":"), F.array_join(groups, ":"), F.lit(":")), shorten)


def _v6_text(col: Column, unmap: bool) -> Column:
    zone = F.regexp_extract(col, r"%(.+)\z", 0)

    def render(groups: Column) -> Column:
        mapped = (F.array_join(F.slice(groups, 1, 5), "") == "00000") & (F.get(groups, F.lit(5)) == "ffff")
        octets = []
        for index in (6, 7):
            value = F.conv(F.get(groups, F.lit(index)), 16, 10).cast("bigint")
            octets += [F.call_function("div", value, F.lit(256)).cast("string"), (value % 256).cast("string")]
        dotted = F.concat_ws(".", *octets)
        return F.when(groups.isNotNull(), F.when(
            mapped, dotted if unmap else F.concat(F.lit("::ffff:"), dotted, zone)
        ).otherwise(F.concat(_v6_joined(groups), zone)))

    bad_zone = F.contains(col, F.lit("%")) & (zone == "")
    return F.when(~bad_zone, _let(_v6_groups(col), render))


_GROUP = r"[1-9a-f][0-9a-f]{0,3}+"
# Text that is canonical as it stands: no group shown is zero or begins with a zero, and :: stands for two groups or more.
# With a group in front of :: it is no mapped IPv4 address.
CANONICAL_V6 = rf"^(?:{_GROUP}(?::{_GROUP}){{0,2}}+::(?:{_GROUP}(?::{_GROUP}){{0,2}}+)?+|{_GROUP}(?::{_GROUP}){{7}}+)\z"


def canonical_ip(col: Column, unmap: bool = True) -> Column:
    """Canonical address text, NULL when the text is not an address.

    Most addresses arrive in canonical form; others are rewritten by functions with lambdas, which Spark interprets.
    """
    return F.when(is_v4(col) | col.rlike(CANONICAL_V6), col).when(F.contains(col, F.lit(":")), _v6_text(col, unmap))


def ip_key(col: Column) -> Column:
    """32 hex digits that sort and range-compare like the 16-byte address."""
    wide = F.array_join(F.transform(_v6_groups(col), lambda g: F.lpad(g, 4, "0")), "")
    return F.when(is_v4(col), v4_key(col)).when(F.contains(col, F.lit(":")), wide)


def cidr_bounds(networks: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Add `bits`, `lo`, `hi` (hex keys, inclusive) for each network text."""
    address = F.substring_index(F.col(cidr), "/", 1)
    length = F.substring_index(F.col(cidr), "/", -1).try_cast("int")
    v4 = is_v4(address)
    fixed = F.when(v4, length + 96).otherwise(length)
    key = ip_key(address)
    bit = fixed % 4
    whole = F.call_function("div", fixed, F.lit(4)).cast("int")
    digit = F.conv(F.substr(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    # The digit that holds the border keeps its leading bits.
    step = F.element_at(F.array(*[F.lit(n) for n in (16, 8, 4, 2)]), bit + 1)
    low_digit = digit - digit % step
    lo = F.rpad(F.concat(F.substr(key, F.lit(1), whole), F.when(bit > 0, F.lower(F.hex(low_digit))).otherwise("")), 32, "0")
    hi = F.rpad(F.concat(F.substr(key, F.lit(1), whole), F.when(bit > 0, F.lower(F.hex(low_digit + step - 1))).otherwise("")), 32, "f")
    fine = key.isNotNull() & F.col(cidr).rlike(r"^[^/]+/[0-9]{1,3}\z") & length.between(0, F.when(v4, 32).otherwise(128))
    return networks.select("*", length.alias("bits"), lo.alias("lo"), hi.alias("hi"), fine.alias("_f")).filter("_f").drop("_f")
