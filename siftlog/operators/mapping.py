"""Declarative mapping of parsed documents onto the canonical event.

A rule set is a small configuration. Its rules become column expressions of one
projection: no join with a rule table and no row explosion per rule.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlog import vocab
from siftlog.functions.ip import canonical_ip
from siftlog.functions.text import compact_set, parse_rfc3339
from siftlog.functions.variant import flatten_document, integer_of, resolve_paths, text_of


@dataclass(frozen=True)
class Rule:
    id: str
    source: str
    target: str
    convert: str
    lookup: str = ""
    required: bool = False
    layouts: tuple[str, ...] = ()
    timezone: str = ""


@dataclass(frozen=True)
class Mapping:
    id: str
    version: str
    rules: tuple[Rule, ...]
    # taxonomy -> alias -> canonical
    taxonomies: dict[str, dict[str, str]] = field(default_factory=dict)

    @property
    def identity(self) -> str:
        return f"{self.id}/{self.version}"


# --- configuration -------------------------------------------------------------

_RULE_KEYS = {"id", "from", "to", "convert", "lookup", "required", "timestamp_layouts", "timezone"}


def load_mapping(text: str, taxonomy_text: str | None = None) -> Mapping:
    """Strictly decode a mapping and an optional shared vocabulary."""
    config = json.loads(text)
    _only(config, {"config_version", "id", "version", "rules", "taxonomies"})
    declared = dict(config.get("taxonomies") or {})
    if taxonomy_text:
        extra = json.loads(taxonomy_text)
        _only(extra, {"config_version", "taxonomies"})
        if set(extra["taxonomies"]) & set(declared):
            raise ValueError("taxonomy is declared in both artifacts")
        declared |= extra["taxonomies"]
    rules = []
    for raw in config["rules"]:
        _only(raw, _RULE_KEYS)
        rules.append(Rule(
            raw["id"], raw["from"], raw["to"], raw["convert"], raw.get("lookup", ""), raw.get("required", False),
            tuple(raw.get("timestamp_layouts", ())), raw.get("timezone", ""),
        ))
    mapping = Mapping(config["id"], config["version"], tuple(rules), reverse_taxonomies(declared))
    problems = check_mapping(mapping)
    if problems:
        raise ValueError("; ".join(problems))
    return mapping


def _only(value: dict, allowed: set[str]) -> None:
    unknown = set(value) - allowed
    if unknown:
        raise ValueError(f"unknown configuration keys {sorted(unknown)}")


def reverse_taxonomies(declared: dict[str, dict[str, list[str]]]) -> dict[str, dict[str, str]]:
    """alias -> canonical per taxonomy; an alias with two meanings is an error."""
    out: dict[str, dict[str, str]] = {}
    total = 0
    for name, entries in declared.items():
        table = out.setdefault(name, {})
        for canonical, aliases in entries.items():
            for alias in [canonical, *aliases]:
                total += 1
                if not alias or table.setdefault(alias, canonical) != canonical:
                    raise ValueError(f"taxonomy {name} alias {alias!r} is empty or ambiguous")
    if total > vocab.MAX_ALIASES or len(declared) > vocab.MAX_TAXONOMIES:
        raise ValueError("taxonomies exceed their bounds")
    return out


def target_kind(target: str) -> str | None:
    if target in vocab.TARGETS:
        return vocab.TARGETS[target]
    if target.startswith(vocab.EXTENSION_PREFIX) and len(target) <= 512:
        parts = target[len(vocab.EXTENSION_PREFIX):].split(".")
        if len(parts) <= 64 and all(re.match(vocab.IDENTIFIER, p) for p in parts):
            return "extension"
    return None


def allowed_conversion(kind: str, rule: Rule) -> bool:
    looked_up = rule.lookup != ""
    if kind == "ip":
        return rule.convert == "ip" and not looked_up
    if kind == "port":
        return rule.convert in ("port", "uint16") and not looked_up
    if kind == "timestamp":
        return rule.convert == "timestamp" and not looked_up
    if kind in ("non_negative", "severity_id", "protocol_num"):
        return rule.convert == "integer" or looked_up
    if kind in ("action", "device", "severity"):
        return rule.convert == "lowercase" and looked_up
    if kind == "protocol":
        return rule.convert == "lowercase"
    return kind == "extension" or rule.convert in ("string", "lowercase") or looked_up


def check_mapping(mapping: Mapping) -> list[str]:
    problems = []
    if not re.match(vocab.IDENTIFIER, mapping.id) or not re.match(vocab.VERSION, mapping.version):
        problems.append("mapping id or version is invalid")
    if not 1 <= len(mapping.rules) <= vocab.MAX_RULES:
        problems.append("number of rules is out of bounds")
    seen_id, seen_target = set(), set()
    for rule in mapping.rules:
        kind = target_kind(rule.target)
        if not re.match(vocab.IDENTIFIER, rule.id) or rule.id in seen_id:
            problems.append(f"rule id {rule.id} is invalid or repeated")
        if rule.target in seen_target:
            problems.append(f"target {rule.target} is repeated")
        parts = rule.source.split(".")
        if parts[0] != "fields" or len(parts) < 2 or len(rule.source) > 512 or not all(
            p.isdigit() or re.match(vocab.IDENTIFIER, p) for p in parts[1:]
        ):
            problems.append(f"source path {rule.source} is invalid")
        if kind is None:
            problems.append(f"target {rule.target} is not allowed")
        elif rule.convert not in vocab.CONVERSIONS or not allowed_conversion(kind, rule):
            problems.append(f"conversion {rule.convert} does not fit {rule.target}")
        if rule.lookup and rule.lookup not in mapping.taxonomies:
            problems.append(f"taxonomy {rule.lookup} is unknown")
        if (rule.convert == "timestamp") != bool(rule.layouts):
            problems.append(f"timestamp layouts of rule {rule.id} are wrong")
        seen_id.add(rule.id)
        seen_target.add(rule.target)
    return problems


def rule_violations(rules: DataFrame, aliases: DataFrame) -> DataFrame:
    """Table form of the checks: one row per broken rule set or vocabulary.

    `rules`: mapping_id, rule_id, target, convert, lookup. `aliases`: mapping_id,
    taxonomy, alias, canonical.
    """
    def repeated(df: DataFrame, key: str, code: str) -> DataFrame:
        return df.groupBy("mapping_id", key).count().filter("count > 1").select("mapping_id", F.col(key).alias("subject"), F.lit(code).alias("problem"))

    known = F.col("target").isin(list(vocab.TARGETS)) | F.col("target").startswith(vocab.EXTENSION_PREFIX)
    kinds = F.create_map(*[F.lit(x) for pair in vocab.TARGETS.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, "target"), F.lit("extension"))
    looked = F.coalesce(F.col("lookup"), F.lit("")) != ""
    c = F.col("convert")
    fits = (
        F.when(kind == "ip", (c == "ip") & ~looked).when(kind == "port", c.isin("port", "uint16") & ~looked)
        .when(kind == "timestamp", (c == "timestamp") & ~looked)
        .when(kind.isin("non_negative", "severity_id", "protocol_num"), (c == "integer") | looked)
        .when(kind.isin("action", "device", "severity"), (c == "lowercase") & looked)
        .when(kind == "protocol", c == "lowercase").when(kind == "extension", F.lit(True))
        .otherwise(c.isin("string", "lowercase") | looked)
    )
    bad_target = rules.filter(~known).select("mapping_id", F.col("target").alias("subject"), F.lit("TARGET_NOT_ALLOWED").alias("problem"))
    misfit = rules.filter(known & ~fits).select("mapping_id", F.col("rule_id").alias("subject"), F.lit("CONVERSION_MISMATCH").alias("problem"))
    unclear = aliases.groupBy("mapping_id", "taxonomy", "alias").agg(F.count_distinct("canonical").alias("n")).filter("n > 1").select(
        "mapping_id", F.concat_ws("/", "taxonomy", "alias").alias("subject"), F.lit("ALIAS_AMBIGUOUS").alias("problem"))
    sizes = rules.groupBy("mapping_id").count().filter(F.col("count") > vocab.MAX_RULES).select(
        "mapping_id", F.lit("rules").alias("subject"), F.lit("TOO_MANY_RULES").alias("problem"))
    out = repeated(rules, "rule_id", "DUPLICATE_RULE")
    for part in (repeated(rules, "target", "DUPLICATE_TARGET"), bad_target, misfit, unclear, sizes):
        out = out.unionByName(part)
    return out


# --- conversion -------------------------------------------------------------------

_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# fixed values: reference-time layout elements, the part of a time each one names and the text it accepts
_LAYOUT = [
    ("January", "month_name", "|".join(_MONTHS)), ("Jan", "month_name", "|".join(m[:3] for m in _MONTHS)),
    ("Monday", "", "|".join(_DAYS)), ("Mon", "", "|".join(d[:3] for d in _DAYS)), ("MST", "", "[A-Z]{3,4}"),
    ("2006", "year", "[0-9]{4}"), ("-07:00", "zone", "[+-][0-9]{2}:[0-9]{2}"), ("-0700", "zone", "[+-][0-9]{4}"), ("-07", "zone", "[+-][0-9]{2}"),
    ("Z07:00", "zone", "Z|[+-][0-9]{2}:[0-9]{2}"), ("Z0700", "zone", "Z|[+-][0-9]{4}"),
    ("01", "month", "[0-9]{2}"), ("02", "day", "[0-9]{2}"), ("03", "hour12", "[0-9]{2}"), ("04", "minute", "[0-9]{2}"), ("05", "second", "[0-9]{2}"),
    ("06", "year2", "[0-9]{2}"), ("15", "hour", "[0-9]{2}"), ("_2", "day", "[ 0-9]?[0-9]"),
    ("1", "month", "[0-9]{1,2}"), ("2", "day", "[0-9]{1,2}"), ("3", "hour12", "[0-9]{1,2}"), ("4", "minute", "[0-9]{1,2}"), ("5", "second", "[0-9]{1,2}"),
    ("PM", "half", "AM|PM"), ("pm", "half", "am|pm"),
]
_FRACTION = re.compile(r"[.,](?:0+|9+)(?![0-9])")


def compile_layout(layout: str) -> tuple[str, list[str]]:
    """One anchored pattern for a layout, and the part of a time that each of its groups holds.

    A fraction may follow the seconds although the layout has none. A layout
    without a year, month and day, or with a part named twice, is refused.
    """
    pattern, parts, at = "", [], 0
    while at < len(layout):
        fraction = _FRACTION.match(layout, at)
        if fraction and parts and parts[-1] == "second":
            size = len(fraction[0]) - 1
            digits = f"[.,][0-9]{{{size}}}" if fraction[0][1] == "0" else "(?:[.,][0-9]{1,9})?"
            pattern, at = pattern[: -len(_ANY_FRACTION)] + f"({digits})", fraction.end()
            continue
        for text, part, accepted in _LAYOUT:
            if layout.startswith(text, at):
                pattern += f"({accepted})" if part else f"(?:{accepted})"
                parts += [part] if part else []
                if part == "second":
                    pattern += _ANY_FRACTION
                at += len(text)
                break
        else:
            pattern, at = pattern + re.escape(layout[at]), at + 1
    names = [p.removesuffix("_name").removesuffix("2") if p in ("month_name", "year2") else "hour" if p == "hour12" else p for p in parts]
    if len(set(names)) < len(names) or not {"year", "month", "day"} <= set(names):
        raise ValueError(f"timestamp layout {layout!r} names no date, or a part twice")
    # each group of seconds is followed by the group of their fraction
    return f"^{pattern}$", [x for p in parts for x in ([p, "fraction"] if p == "second" else [p])]


_ANY_FRACTION = "((?:[.,][0-9]{1,9})?)"


def parse_layout(text: Column, layout: str, timezone: str) -> Column:
    """TIMESTAMP of text in one layout, NULL when it does not match or names no real time."""
    pattern, names = compile_layout(layout)
    part = {name: F.regexp_extract(text, pattern, k + 1) for k, name in enumerate(names)}

    def number(name: str, default: int) -> Column:
        return F.trim(part[name]).try_cast("int") if name in part else F.lit(default)

    month = number("month", 1)
    if "month_name" in part:
        month = F.array_position(F.array(*[F.lit(m[:3]) for m in _MONTHS]), F.substring(part["month_name"], 1, 3)).cast("int")
    year = number("year", 1)
    if "year2" in part:
        short = number("year2", 0)
        year = F.when(short >= 69, short + 1900).otherwise(short + 2000)
    hour = number("hour", 0)
    if "hour12" in part:
        clock = F.when(number("hour12", 0).between(0, 12), number("hour12", 0))
        late = F.upper(part["half"]) == "PM" if "half" in part else F.lit(False)
        hour = F.when(late & (clock < 12), clock + 12).when(F.lit("half" in part) & ~late & (clock == 12), 0).otherwise(clock)
    fraction = F.rpad(F.substring(F.regexp_replace(part["fraction"], "^[.,]", ""), 1, 6), 6, "0").try_cast("int") if "fraction" in part else F.lit(0)
    seconds = number("second", 0)
    at = F.try_make_timestamp(year, month, number("day", 1), hour, number("minute", 0), F.when(seconds < 60, seconds).cast("decimal(16,6)"), F.lit("UTC"))
    micros = F.unix_micros(at) + F.coalesce(fraction, F.lit(0))
    if "zone" in part:
        digits = F.regexp_replace(part["zone"], "[^0-9]", "")
        offset = F.coalesce(F.substring(digits, 1, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
        micros = micros - F.when(part["zone"].startswith("-"), -offset).otherwise(offset).cast("bigint") * 60_000_000
    found = F.when(text.rlike(pattern), F.timestamp_micros(micros))
    zoned = "zone" in part or "MST" in layout
    return found if zoned or timezone in ("", "UTC") else F.to_utc_timestamp(found, timezone)


def parse_timestamp(text: Column, layouts: tuple[str, ...], timezone: str) -> Column:
    """First layout that matches; layouts without a zone use the fixed offset."""
    return F.coalesce(*[parse_rfc3339(text) if layout in ("RFC3339", "RFC3339Nano") else parse_layout(text, layout, timezone) for layout in layouts])


TEXT_CONVERSIONS = ("string", "lowercase", "ip", "timestamp")


def read_source(value: Column, rule: Rule) -> Column:
    """The source as the conversion wants it: text or a strict integer."""
    return text_of(value) if rule.convert in TEXT_CONVERSIONS else integer_of(value)


def convert(value: Column, rule: Rule) -> Column:
    if rule.convert in ("string", "integer"):
        return value
    if rule.convert == "lowercase":
        return F.lower(value)
    if rule.convert == "ip":
        return canonical_ip(value)
    if rule.convert in ("port", "uint16"):
        return F.when(value.between(0, 65535), value)
    return parse_timestamp(value, rule.layouts, rule.timezone)


def coerce(value: Column, kind: str, is_text: bool) -> Column:
    """Value as the target stores it; NULL when the target refuses it."""
    if kind in ("non_negative", "severity_id", "protocol_num"):
        number = F.when(value.rlike(r"^[+-]?[0-9]+\z"), value.try_cast("bigint")) if is_text else value
        top = {"non_negative": 2**63 - 1, "severity_id": 6, "protocol_num": 255}[kind]
        number = F.when(number.between(0, top), number)
        return number if kind == "non_negative" else number.cast("int")
    if kind == "port":
        return value.cast("int")
    if kind in ("action", "device", "severity"):
        words = {"action": vocab.ACTIONS, "device": vocab.DEVICE_TYPES, "severity": vocab.SEVERITIES}[kind]
        return F.when(value.isin(words), value)
    if kind == "protocol":
        return F.when(value.rlike(r"^[a-z][a-z0-9._\-]{0,31}\z"), value)
    if kind == "mac":
        return F.when(F.octet_length(value).between(11, 23), value)
    if kind.startswith("string"):
        limit = int(kind[6:] or 0) or 1 << 20
        return F.when((value != "") & (F.octet_length(value) <= limit), value)
    return value


EVENT_TYPE = """struct<class_uid:bigint,class_name:string,activity_id:bigint,activity:string,time:timestamp,action:string,
status:string,severity_id:int,severity:string,src_endpoint:struct<ip:string,port:int,hostname:string,mac:string>,
dst_endpoint:struct<ip:string,port:int,hostname:string,mac:string>,connection_info:struct<protocol_name:string,protocol_num:int>,
device:struct<type:string,hostname:string,vendor_name:string,product_name:string>,finding:struct<signature:string,signature_id:bigint>,
extensions:variant>""".replace("\n", "")
PROVENANCE_TYPE = "map<string,struct<kind:string,source_path:string,rule_id:string,mapping_version:string,taxonomy:string>>"
_PROVENANCE_ENTRIES = PROVENANCE_TYPE.replace("map<string,", "array<struct<k:string,v:") + ">"
ISSUE_TYPE = "array<struct<code:string,rule_id:string,source_path:string,target_path:string,message:string>>"

# fixed values: messages of the mapping issue codes
_MESSAGES = {
    "MAPPING_SOURCE_AMBIGUOUS": "source path selector is ambiguous",
    "MAPPING_REQUIRED_SOURCE_MISSING": "required source field is absent",
    "MAPPING_CONVERSION_FAILED": "value does not satisfy the conversion or the target",
    "MAPPING_TARGET_CONFLICT": "target parent already has a scalar value",
}


def _tree(values: dict[tuple, Column]) -> Column:
    """Nested struct; a node without any value is NULL."""
    groups: dict[str, dict[tuple, Column]] = {}
    for path, value in values.items():
        groups.setdefault(path[0], {})[path[1:]] = value
    parts, present = [], F.lit(False)
    for name, inner in groups.items():
        value = inner[()] if () in inner else _tree(inner)
        parts.append(value.alias(name))
        for leaf in inner.values():
            present = present | leaf.isNotNull()
    return F.when(present, F.struct(*parts))


def _event(values: dict[str, Column]) -> Column:
    full = {tuple(t.split(".")[1:]): values.get(t, F.lit(None)) for t in vocab.TARGETS}
    extra = {tuple(t.split(".")[2:]): v for t, v in values.items() if t.startswith(vocab.EXTENSION_PREFIX)}
    extensions = F.try_parse_json(F.to_json(_tree(extra))) if extra else F.lit(None).cast("variant")
    whole = {**full, ("extensions",): extensions}
    return _tree(whole).cast(EVENT_TYPE)


def _sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal_map(table: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"{_sql_literal(k)}, {_sql_literal(v)}" for k, v in table.items()) + ")")


@dataclass
class _Family:
    """Rules of several mappings that differ only in id, source and required."""

    rule: Rule
    table: dict[str, str] | None
    members: dict[str, Rule] = field(default_factory=dict)


def _families(mappings: dict[str, Mapping]) -> list[_Family]:
    found: dict[tuple, _Family] = {}
    for key, mapping in mappings.items():
        for rule in mapping.rules:
            table = mapping.taxonomies[rule.lookup] if rule.lookup else None
            shape = (rule.target, rule.convert, rule.layouts, rule.timezone, json.dumps(table, sort_keys=True))
            found.setdefault(shape, _Family(rule, table)).members[key] = rule
    return list(found.values())


def apply_mappings(
    df: DataFrame, mappings: dict[str, Mapping], key: str, document: str = "parsed.fields",
    selector_keys: set[str] | None = None, with_unmapped: bool = False,
) -> DataFrame:
    """Add `mapped`: every row is mapped by the rule set its `key` column names.

    STRUCT(mapping_version, event, provenance, issues, required_total,
    required_present, unmapped); NULL where no rule set applies. Rules of
    different sets that convert alike share one conversion, so the plan grows
    with distinct targets rather than with sets times rules.
    """
    before = df.columns
    key_of = F.col(key)
    active = key_of.isin(list(mappings))
    df = df.withColumn("_key", F.when(active, key_of)).withColumn("_doc", F.when(F.col("_key").isNotNull(), F.col(document)))
    key_of = F.col("_key")
    selector_keys = set(mappings) if selector_keys is None else selector_keys
    families = _families(mappings)

    def parts(rule: Rule) -> tuple[str, ...]:
        return tuple(rule.source.split(".")[1:])

    paths = sorted({parts(r) for m in mappings.values() for r in m.rules})
    chosen = {parts(r) for k, m in mappings.items() if k in selector_keys for r in m.rules}
    # Rule sets are told apart by number: texts would be compared dozens of times in each row.
    number = {k: i for i, k in enumerate(mappings)}
    df = df.withColumn("_kn", F.expr("CASE _key " + " ".join(f"WHEN {_sql_literal(k)} THEN {i}" for k, i in number.items()) + " END"))

    def has_key(keys) -> str:
        return f"_kn IN ({', '.join(str(number[k]) for k in keys)})"

    gates = {p[0]: F.expr(has_key([k for k, m in mappings.items() if any(parts(r)[0] == p[0] for r in m.rules)])) for p in paths}
    df, nodes = resolve_paths(df, "_doc", [list(p) for p in paths], bool(chosen), {p[:n] for p in chosen for n in range(1, len(p) + 1)}, gates)

    # Choices by key are written as SQL text: one call each instead of one per literal.
    def by_key(values: dict[str, object], default=None) -> Column:
        groups: dict = {}
        for k, v in values.items():
            groups.setdefault(v, []).append(k)
        if len(groups) == 1 and len(values) == len(mappings):
            return F.lit(next(iter(groups)))
        whens = " ".join(f"WHEN {has_key(keys)} THEN {_sql_literal(v)}" for v, keys in groups.items())
        return F.expr(f"CASE {whens} ELSE {_sql_literal(default)} END")

    def node(f: _Family, part: int) -> Column:
        groups: dict[tuple, list[str]] = {}
        for k, rule in f.members.items():
            groups.setdefault(parts(rule), []).append(k)
        out = None
        for path, keys in groups.items():
            here, found = F.expr(has_key(keys)), nodes[path][part]
            out = F.when(here, found) if out is None else out.when(here, found)
        return out

    n = range(len(families))
    # One column for each family, whatever the number of rule sets: their sources are read here.
    # What else follows from a path is kept as well, so that no document is carried on.
    unclear = [i for i in n if chosen & {parts(r) for r in families[i].members.values()}]
    read = {f"_n{i}": node(families[i], 0) for i in n} | {f"_a{i}": node(families[i], 2) for i in unclear}
    df = df.withColumns(read | ({f"_w{i}": node(families[i], 1) for i in n} if with_unmapped else {}))
    # Later steps only ask whether a source was found, so its VARIANT is not copied through them.
    df = df.withColumns({f"_s{i}": read_source(F.col(f"_n{i}"), families[i].rule) for i in n} | {f"_f{i}": F.col(f"_n{i}").isNotNull() for i in n})
    df = df.withColumns({f"_c{i}": convert(F.col(f"_s{i}"), families[i].rule) for i in n})
    looked = {}
    for i in n:
        f, value = families[i], F.col(f"_c{i}")
        if f.table is not None:
            value = F.try_element_at(_literal_map(f.table), value) if f.rule.convert in ("string", "lowercase") else F.lit(None).cast("string")
        looked[f"_l{i}"] = value
    df = df.withColumns(looked)
    df = df.withColumns({
        f"_t{i}": coerce(F.col(f"_l{i}"), target_kind(families[i].rule.target), families[i].table is not None or families[i].rule.convert in ("string", "lowercase"))
        for i in n
    })
    codes, ok = {}, []
    for i in n:
        f = families[i]
        found = F.col(f"_f{i}")
        ambiguous = F.col(f"_a{i}") if i in unclear else F.lit(False)
        needed = by_key({k: r.required for k, r in f.members.items()}, False)
        code = F.when(ambiguous, "MAPPING_SOURCE_AMBIGUOUS").when(~found & needed, "MAPPING_REQUIRED_SOURCE_MISSING")
        code = code.when(found & F.col(f"_c{i}").isNull(), "MAPPING_CONVERSION_FAILED")
        if f.table is not None:
            typed = f.rule.convert not in ("string", "lowercase")
            code = code.when(found & F.col(f"_l{i}").isNull(), "MAPPING_CONVERSION_FAILED" if typed else "MAPPING_TAXONOMY_MISS")
        code = code.when(found & F.col(f"_t{i}").isNull(), "MAPPING_CONVERSION_FAILED")
        for j in range(i):
            a, b = families[j].rule.target + ".", f.rule.target + "."
            if a != b and (a.startswith(b) or b.startswith(a)):
                code = code.when(found & ok[j], "MAPPING_TARGET_CONFLICT")
        codes[f"_i{i}"] = F.when(F.expr(has_key(f.members)), code)
        ok.append(F.expr(f"_t{i} IS NOT NULL AND _i{i} IS NULL"))
    df = df.withColumns(codes)
    df = df.withColumns({f"_k{i}": ok[i] for i in n})
    good = [F.col(f"_k{i}") for i in n]

    df = df.withColumn("_identity", by_key({k: m.identity for k, m in mappings.items()}))
    identity = F.col("_identity")
    issues, provenance = [], []
    values: dict[str, Column] = {}
    for i in n:
        f, code = families[i], F.col(f"_i{i}")
        rule_id, source = by_key({k: r.id for k, r in f.members.items()}), by_key({k: r.source for k, r in f.members.items()})
        tail = _sql_literal(f'" is absent from taxonomy "{f.rule.lookup}"')
        miss = "concat('value \"', coalesce(cast(_c%d AS STRING), ''), %s)" % (i, tail)
        texts = " ".join(f"WHEN '{known}' THEN {_sql_literal(text)}" for known, text in _MESSAGES.items())
        message = F.expr(f"CASE _i{i} WHEN 'MAPPING_TAXONOMY_MISS' THEN {miss} {texts} END")
        place = by_key({k: list(mappings[k].rules).index(r) for k, r in f.members.items()})
        issues.append((place.alias("ord"), code, code.alias("code"), rule_id.alias("rule_id"), source.alias("source_path"),
                       F.lit(f.rule.target).alias("target_path"), message.alias("message")))
        kind = "mapped" if f.rule.convert == "string" and not f.rule.lookup else "normalized"
        provenance.append(F.when(good[i], F.struct(F.lit(f.rule.target).alias("k"), F.struct(
            F.lit(kind).alias("kind"), source.alias("source_path"), rule_id.alias("rule_id"), F.col("_identity").alias("mapping_version"),
            F.lit(f.rule.lookup or None).cast("string").alias("taxonomy")).alias("v"))))
        value = F.when(good[i], F.col(f"_t{i}"))
        values[f.rule.target] = F.coalesce(values[f.rule.target], value) if f.rule.target in values else value
    total = by_key({k: sum(r.required for r in m.rules) for k, m in mappings.items()})
    present = F.lit(0)
    for i in n:
        needed = by_key({k: r.required for k, r in families[i].members.items()}, False)
        present = present + (good[i] & needed).cast("int")
    # Families mostly stand in the order of every rule set; only others need a sort by it.
    in_order = all(p == sorted(p) for p in ([m.rules.index(f.members[k]) for f in families if k in f.members] for k, m in mappings.items()))
    if in_order:
        ordered = compact_set([F.when(code.isNotNull(), F.struct(*fields)) for _, code, *fields in issues], ISSUE_TYPE)
    else:
        ranked = F.array_sort(F.array_compact(F.array(*[F.when(code.isNotNull(), F.struct(place, *fields)) for place, code, *fields in issues])))
        ordered = F.transform(ranked, lambda x: F.struct(*[x[c].alias(c) for c in ("code", "rule_id", "source_path", "target_path", "message")]))
    unmapped = F.lit(None).cast("map<string,variant>")
    if with_unmapped:
        used = F.array_compact(F.array(*[F.when(good[i], F.col(f"_w{i}")) for i in n]))
        failed = F.array_compact(F.array(*[F.when(F.col(f"_i{i}").isNotNull() & F.col(f"_f{i}"), F.col(f"_w{i}")) for i in n]))
        df = df.withColumns({"_used": F.array_except(used, failed), "_flat": flatten_document(F.col("_doc"))})
        left = F.filter(F.col("_flat"), lambda e: ~F.array_contains(F.col("_used"), e["p"]))
        unmapped = F.map_from_entries(F.transform(left, lambda e: F.struct(e["p"], e["v"])))
    df = df.withColumns({
        "_event": _event(values), "_prov": F.map_from_entries(compact_set(provenance, _PROVENANCE_ENTRIES)),
        "_iss": ordered.cast(ISSUE_TYPE), "_present": present,
    })
    mapped = F.struct(
        identity.alias("mapping_version"), F.col("_event").alias("event"), F.col("_prov").alias("provenance"), F.col("_iss").alias("issues"),
        total.alias("required_total"), F.col("_present").alias("required_present"), unmapped.alias("unmapped"),
    )
    return df.withColumn("mapped", F.when(key_of.isNotNull(), mapped)).select(*[F.col(c) for c in before], "mapped")


def apply_mapping(df: DataFrame, mapping: Mapping, document: str = "parsed.fields", with_unmapped: bool = False) -> DataFrame:
    """Map every row with one rule set."""
    one = df.withColumn("_one", F.lit(mapping.id))
    return apply_mappings(one, {mapping.id: mapping}, "_one", document, None, with_unmapped).drop("_one")


def rule_table(spark: SparkSession, mappings: list[Mapping]) -> DataFrame:
    """Configured rules as a table (a handful of rows per mapping)."""
    rows = [(m.id, m.version, i, r.id, r.source, r.target, r.convert, r.lookup, r.required) for m in mappings for i, r in enumerate(m.rules)]
    return spark.createDataFrame(rows, "mapping_id string, mapping_version string, rule_ord int, rule_id string, source string, target string, convert string, lookup string, required boolean")
