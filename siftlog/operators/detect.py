"""Format detection: probe scores, ranking, decision and routing.

All probes are expressions over one sampled text column. Rows that look like
XML, refuse to parse as JSON, or show quotes in a CSV-shaped header share one
Arrow check; for every other row that check sees NULL.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from siftlog import vocab
from siftlog.functions.structure import strict_json, structure_check
from siftlog.functions.text import code_set, count_char, trim_space

SYSLOG_HEAD = r"^<[0-9]{1,3}>(?:[1-9][0-9]* |[A-Z][a-z]{2} +[0-9]{1,2} )"
_WORD = r"[\p{L}_.\-][\p{L}\p{Nd}_.\-]*+"
KV_TOKEN = rf"(?U)(?<!\S){_WORD}=\S"
PIPE_TOKEN = rf"\|{_WORD}=[^|]"
CSV_HEADER = r"^[\p{L}\p{Nd}_.\-]++(?:,[\p{L}\p{Nd}_.\-]++)++$"
CSV_HEADER_CELLS = r"(?U)^\s*+[\p{L}\p{Nd}_.\-]++\s*+(?:,\s*+[\p{L}\p{Nd}_.\-]++\s*+)++$"
CSV_QUOTED_HEADER = r'(?U)^[\p{L}\p{Nd}_.\-",\s]++$'
NOT_PRINTABLE = r"(?U)[^\p{L}\p{M}\p{N}\p{P}\p{S}\s]+"


@dataclass(frozen=True)
class Fingerprint:
    """All literals contained in the sample give `score` to `parser_id`."""

    parser_id: str
    impl: str
    literals: tuple[str, ...]
    score: int
    specificity: int
    priority: int = 0
    version: str = vocab.PARSER_VERSION
    bundle_sha256: str = ""
    format: str = ""


@dataclass(frozen=True)
class Routes:
    """Activated bundles: digest -> fingerprints. Profiles come from a table."""

    bundles: dict[str, list[Fingerprint]] = field(default_factory=dict)


def sample(df: DataFrame, raw: str = "raw", maximum: int = vocab.SAMPLE_BYTES) -> DataFrame:
    """Add `_sample`, `_truncated`, its text, trimmed text and UTF-8 validity."""
    if not 1 <= maximum <= vocab.SAMPLE_HARD_MAX:
        raise ValueError("sample size is out of bounds")
    out = df.withColumn("_truncated", F.octet_length(raw) > maximum)
    out = out.withColumn("_sample", F.when(F.col("_truncated"), F.substring(raw, 1, maximum)).otherwise(F.col(raw)))
    out = out.withColumn("_x", F.col("_sample").cast("string"))
    out = out.withColumn("_u", F.is_valid_utf8("_x"))
    return out.withColumn("_t", trim_space(F.col("_x")))


def _first_char() -> Column:
    return F.substring("_t", 1, 1)


def with_structure(df: DataFrame, raw: str = "raw", maximum: int = vocab.SAMPLE_BYTES, forced: Column | None = None) -> DataFrame:
    """Add `_json` (valid in the JVM), `_csv` line facts and the shared `_p` check.

    `forced` is the implementation a bundle fingerprint has already settled on.
    """
    head = _first_char()
    looks_json = head.isin("{", "[")
    df = df.withColumn("_json", F.when(looks_json, strict_json(F.col("_t")).isNotNull()))
    # First two records of unquoted CSV; blank lines do not count.
    comma = F.col("_u") & F.col("_x").contains(",")
    pair = F.when(comma, F.regexp_extract("_x", r"^(?:\r?\n)*+([^\n]++)\n(?:\r?\n)*+([^\n]++)", 0))
    lines = F.regexp_extract_all(pair, F.lit(r"[^\n]+"), F.lit(0))
    rows = F.filter(F.transform(lines, lambda line: F.regexp_replace(line, r"\r$", "")), lambda line: line != "")
    df = df.withColumn("_csv", F.when(pair != "", rows))
    first, second = F.get("_csv", F.lit(0)), F.get("_csv", F.lit(1))
    quoted = (first.contains('"') | second.contains('"')) & first.rlike(CSV_QUOTED_HEADER)
    quoted = F.coalesce(quoted, F.lit(False)) | F.coalesce(comma & F.col("_csv").isNull() & F.col("_x").startswith('"'), F.lit(False))
    # A later record may hold quotes although the first two do not.
    later = F.coalesce(first.rlike(CSV_HEADER_CELLS), F.lit(False)) & F.contains(F.col(raw).cast("string"), F.lit('"'))
    # Limits can only be broken by long text or by very many opening brackets.
    suspect = (F.octet_length(raw) > vocab.MAX_TOKENS) | (count_char(F.col("_x"), "{[") > vocab.MAX_DEPTH)
    hard_json = ~F.coalesce(F.col("_json"), F.lit(False)) | suspect
    kind = (
        F.when(looks_json & hard_json, "json").when(head == "<", "xml").when(~looks_json & (quoted | later), "csv")
    )
    if forced is not None:
        has_quote = F.contains(F.col(raw).cast("string"), F.lit('"'))
        own = F.when((forced == "json") & hard_json, "json").when(forced == "xml", "xml").when((forced == "csv") & has_quote, "csv")
        kind = F.when(forced.isNotNull(), own).otherwise(kind)
    df = df.withColumn("_kind", kind)
    return df.withColumn("_p", structure_check(F.col("_kind"), F.col(raw), maximum))


@dataclass
class Probe:
    parser_id: str
    impl: str
    format: str
    specificity: int
    score: Column
    reason: Column
    risk: Column
    hard: Column
    priority: int = 0
    version: str = vocab.PARSER_VERSION
    digest: str = ""
    # greatest score of a costly probe, which is asked only where that could matter
    at_most: int | None = None


def builtin_probes(with_text: bool = True) -> list[Probe]:
    """Score, reason, risk and hard failure of every built-in format."""
    t, x, u = F.col("_t"), F.col("_x"), F.col("_u")
    no, null = F.lit(False), F.lit(None).cast("string")
    head = _first_char()
    json_like = head.isin("{", "[")
    json_ok = F.coalesce(F.col("_json"), no) | F.coalesce(F.col("_p.json_ok"), no)
    xml_like = head == "<"
    p_xml, p_el = F.coalesce(F.col("_p.xml_ok"), no), F.coalesce(F.col("_p.xml_element"), no)
    # Truncated text may stop in the middle of a value; it is then only a weak match.
    # A complete first line with more data behind it is no cut value but several.
    first_line = F.substring_index(t, "\n", 1)
    several = F.coalesce(F.when(json_like & F.col("_truncated") & t.contains("\n"), strict_json(first_line).isNotNull()), no)
    json_score = F.when(json_like & json_ok, 900).when(json_like & F.col("_truncated") & ~several, 300).otherwise(0)
    xml_score = F.when(xml_like & p_xml & p_el, 900).when(xml_like & ~p_xml & F.col("_truncated"), 300).otherwise(0)
    first, second = F.get("_csv", F.lit(0)), F.get("_csv", F.lit(1))
    plain = first.rlike(CSV_HEADER_CELLS) & ~second.contains('"') & (count_char(first, ",") == count_char(second, ","))
    csv_hit = F.coalesce(plain, no) | F.coalesce(F.col("_p.csv_ok"), no)
    kv_gate = u & (t != "") & ~t.contains("|") & ~head.isin("<", "{", "[") & ~t.startswith("CEF:") & ~t.startswith("LEEF:")
    kv_hit = F.when(kv_gate & x.contains("="), F.regexp_count(x, F.lit(KV_TOKEN)) >= 3).otherwise(no)
    pipe_gate = u & t.contains("|") & t.rlike(r"^[A-Z0-9_\-]++\|") & (count_char(t, "|") >= 3)
    pipe_hit = F.when(pipe_gate, F.regexp_count(t, F.lit(PIPE_TOKEN)) >= 3).otherwise(no)
    empty = F.octet_length("_sample") == 0
    total = F.length(x)
    shown = F.length(F.regexp_replace(x, NOT_PRINTABLE, ""))
    text_hit = F.when(u & ~empty, F.floor(shown * 100 / total) >= 85).otherwise(no)

    def simple(parser: str, hit: Column, score: int, reason: str, risk: Column = null) -> Probe:
        pid, fmt, spec = next(p for p in vocab.BUILTIN_PARSERS if p[0] == parser)
        impl = {"delimited_text": "router", "key_value": "kv"}.get(fmt, fmt)
        return Probe(pid, impl, fmt, spec, F.when(hit, score).otherwise(0), F.when(hit, F.lit(reason)), risk, no)

    bad_utf8 = F.when(~u, F.lit("RISK_INVALID_UTF8"))
    probes = [
        simple("generic-cef", t.startswith("CEF:"), 1000, "SIGNATURE_CEF"),
        simple("generic-leef", t.startswith("LEEF:"), 1000, "SIGNATURE_LEEF"),
        simple("generic-syslog", t.rlike(SYSLOG_HEAD), 950, "SIGNATURE_SYSLOG_HEADER"),
        Probe("generic-json", "json", "json", 80, json_score,
              F.when(json_score > 0, F.lit("STRUCTURE_JSON")).when(json_like, F.lit("HARD_SYNTAX_FAILURE")), null, json_like & (json_score == 0)),
        Probe("generic-xml", "xml", "xml", 80, xml_score,
              F.when(xml_score > 0, F.lit("STRUCTURE_XML")).when(xml_like, F.lit("HARD_SYNTAX_FAILURE")),
              F.when((xml_score == 900) & F.col("_p.xml_directive"), F.lit("RISK_XML_DIRECTIVE")), xml_like & (xml_score == 0)),
        simple("generic-router-text", pipe_hit, 850, "STRUCTURE_DELIMITED_TEXT", bad_utf8),
        simple("generic-csv", csv_hit, 850, "STRUCTURE_CSV"),
        simple("generic-kv", kv_hit, 850, "STRUCTURE_KEY_VALUE", bad_utf8),
    ]
    if with_text:
        text = simple("generic-text", text_hit, 200, "FALLBACK_TEXT", F.when(~empty & ~u, F.lit("RISK_INVALID_UTF8")))
        text.reason = F.when(empty, F.lit("SAMPLE_EMPTY")).otherwise(text.reason)
        text.at_most = 200
        probes.append(text)
    return probes


def _all_literals(f: Fingerprint) -> Column:
    hit = F.lit(True)
    for literal in f.literals:
        hit = hit & F.contains(F.col("_x"), F.lit(literal))
    return hit


def fingerprint_probes(fingerprints: list[Fingerprint]) -> list[Probe]:
    out = []
    for f in fingerprints:
        hit = _all_literals(f)
        out.append(Probe(
            f.parser_id, f.impl, f.format or f.impl, f.specificity, F.when(hit, f.score).otherwise(0),
            F.when(hit, F.lit("BUNDLE_FINGERPRINT_MATCH")), F.lit(None).cast("string"), F.lit(False),
            f.priority, f.version, f.bundle_sha256,
        ))
    return out


def candidate_array(probes: list[Probe], pinned: Column | None = None) -> Column:
    """Candidates in rank order.

    The leading struct fields are negated where higher is better, so the natural
    order of the struct is the rank and no comparator lambda is needed.
    """
    rows = []
    for p in probes:
        rows.append(F.struct(
            (-_score(p, pinned)).cast("int").alias("neg_score"), F.lit(-p.specificity).alias("neg_specificity"), F.lit(-p.priority).alias("neg_priority"),
            F.lit(p.parser_id).alias("parser_id"), F.lit(p.version).alias("parser_version"), F.lit(p.digest).alias("bundle_sha256"),
            F.lit(p.impl).alias("impl"), F.lit(p.format).alias("format"), p.hard.alias("hard_failure"),
            code_set(_reasons(p, pinned)).alias("reason_codes"), code_set(_risks(p)).alias("risk_codes"),
        ))
    return F.sort_array(F.array(*rows))  # unlike array_sort it has no lambda, so the probes are compiled


def _reasons(p: Probe, pinned: Column | None) -> list[Column]:
    return [p.reason] if pinned is None else [p.reason, F.when(_is_pinned(p, pinned), F.lit("HINT_PINNED_PARSER"))]


def _is_pinned(p: Probe, pinned: Column) -> Column:
    return (pinned == p.parser_id) & ~p.hard & (p.score > 0)


def _score(p: Probe, pinned: Column | None) -> Column:
    if pinned is None:
        return p.score
    return F.when(_is_pinned(p, pinned), F.least(F.lit(vocab.MAX_SCORE), p.score + vocab.PIN_BONUS)).otherwise(p.score)


def _risks(p: Probe) -> list[Column]:
    return [p.risk, F.when(F.col("_truncated"), F.lit("RISK_SAMPLE_TRUNCATED"))]


def decide(
    df: DataFrame, ranked: list[tuple[Column, list[Probe]]], pinned: Column | None = None,
    minimum: int = vocab.MINIMUM_SCORE, margin: int = vocab.AMBIGUITY_MARGIN,
) -> DataFrame:
    """Add `detection` by the first list of probes whose condition holds.

    The probes of a list stand in the order that settles equal scores, so the best one is
    the greatest of numbers made of score and place: no array of candidates is built, sorted
    and filtered for each row. Each step is its own column: nesting them in one expression
    would repeat the scores dozens of times in the optimized plan.
    """
    tops, rivals, chosen_of = [], [], []
    for k, (here, probes) in enumerate(ranked):
        probes = sorted(probes, key=lambda p: (-p.specificity, -p.priority, p.parser_id, p.version, p.digest, p.impl, p.format))
        places = len(probes) + 1

        def number(i: int, p: Probe, places: int = places, gate: Column = here) -> Column:
            score = _score(p, pinned)
            return F.when(gate & ~p.hard & (score > 0), score.cast("bigint") * places + (places - 1 - i))

        early = {f"_q{k}_{i}": number(i, p) for i, p in enumerate(probes) if p.at_most is None}
        df = df.withColumns(early)
        best = F.greatest(*[F.col(c) for c in early], F.lit(0), F.lit(0))
        # A probe that could neither win nor be a close rival is not asked.
        late = {
            f"_q{k}_{i}": F.when(best < (p.at_most + (0 if pinned is None else vocab.PIN_BONUS) + margin + 1) * places, number(i, p))
            for i, p in enumerate(probes) if p.at_most is not None
        }
        df = df.withColumns(late) if late else df
        null = F.lit(None).cast("bigint")
        df = df.withColumn(f"_qt{k}", F.greatest(*[F.col(f"_q{k}_{i}") for i in range(len(probes))], null, null))
        df = df.withColumn(f"_qp{k}", (places - 1 - F.col(f"_qt{k}") % places).cast("int"))
        at = F.col(f"_qp{k}")

        def of_place(values: list, at: Column = at) -> Column:
            return F.get(F.array(*[F.lit(v) for v in values]), at)

        df = df.withColumn(f"_qf{k}", of_place([p.format for p in probes]))
        rival = F.greatest(*[F.when(F.col(f"_qf{k}") != p.format, F.col(f"_q{k}_{i}")) for i, p in enumerate(probes)], null, null)
        tops.append(F.call_function("div", F.col(f"_qt{k}"), F.lit(places)).cast("int"))
        rivals.append(F.call_function("div", rival, F.lit(places)).cast("int"))

        def by_place(values: list[Column], at: Column = at) -> Column:
            out = F.when(at == 0, values[0])
            for i, v in enumerate(values[1:], start=1):
                out = out.when(at == i, v)
            return out

        chosen_of.append({
            "parser_id": of_place([p.parser_id for p in probes]), "parser_version": of_place([p.version for p in probes]),
            "bundle_sha256": of_place([p.digest for p in probes]), "impl": of_place([p.impl for p in probes]), "format": F.col(f"_qf{k}"),
            "reason_codes": by_place([code_set(_reasons(p, pinned)) for p in probes]), "risk_codes": by_place([code_set(_risks(p)) for p in probes]),
        })
    # The numbers of a list are NULL on the rows of others.
    df = df.withColumns({"_score": F.coalesce(*tops), "_rival": F.coalesce(*rivals)})
    score = F.col("_score")
    reason = (
        F.when(score.isNull(), "DETECT_NO_CANDIDATE").when(score < minimum, "DETECT_BELOW_THRESHOLD")
        .when(score - F.col("_rival") < margin, "DETECT_AMBIGUOUS").otherwise("DETECT_SELECTED")
    )
    df = df.withColumn("_reason", reason)
    reason = F.col("_reason")
    chosen = reason == "DETECT_SELECTED"
    df = df.withColumns({f"_d_{n}": F.when(chosen, F.coalesce(*[c[n] for c in chosen_of])) for n in _CHOSEN})
    outcome = F.when(chosen, "SELECTED").when(reason == "DETECT_AMBIGUOUS", "AMBIGUOUS").otherwise("UNKNOWN")
    df = df.withColumns({"_d_outcome": outcome, "_d_score": F.when(chosen, score)})
    detection = F.struct(
        F.col("_d_outcome").alias("outcome"), reason.alias("reason_code"), *[F.col(f"_d_{n}").alias(n) for n in _CHOSEN],
        F.col("_d_score").alias("score"), F.col("_bytes").alias("sampled_bytes"), F.col("_truncated").alias("sample_truncated"),
    )
    return df.withColumn("detection", detection).drop(*[c for c in df.columns if c.startswith(("_q", "_d_"))], "_score", "_rival", "_reason")


_CHOSEN = ["parser_id", "parser_version", "bundle_sha256", "impl", "format", "reason_codes", "risk_codes"]


def detect(
    df: DataFrame,
    raw: str = "raw",
    pinned: str | None = None,
    bundle: str | None = None,
    routes: Routes | None = None,
    with_candidates: bool = False,
    maximum: int = vocab.SAMPLE_BYTES,
    keep_read: bool = True,
) -> DataFrame:
    """Add `detection` (and `candidates`) for every row, in one narrow stage.

    `bundle` names a column with the activated bundle digest of the row's source
    profile; rows with a digest known to `routes` are scored by that bundle's
    fingerprints, all others by the built-in probes.
    """
    hint = F.col(pinned) if pinned else None
    routed = bool(routes and routes.bundles and bundle)
    out = sample(df, raw, maximum)
    forced = None
    if routed:
        for digest, prints in routes.bundles.items():
            impls = F.coalesce(*[F.when(_all_literals(f), F.lit(f.impl)) for f in prints])
            here = F.col(bundle) == digest
            forced = F.when(here, impls) if forced is None else forced.when(here, impls)
        out = out.withColumn("_forced", forced)
        forced = F.col("_forced")
    out = with_structure(out, raw, maximum, forced)
    builtin, ranked = F.lit(True), []
    if routed:
        ranked = [(F.coalesce(F.col(bundle) == digest, F.lit(False)), fingerprint_probes(prints)) for digest, prints in routes.bundles.items()]
        builtin = F.coalesce(~F.col(bundle).isin(list(routes.bundles)), F.lit(True))
    ranked.append((builtin, builtin_probes()))
    if with_candidates:
        found = F.coalesce(*[F.when(here, candidate_array(probes, hint)) for here, probes in ranked])
        out = out.withColumn("candidates", found)
    out = decide(out.withColumn("_bytes", F.octet_length("_sample")), ranked, hint)
    drop = ["_truncated", "_sample", "_x", "_u", "_t", "_json", "_csv", "_kind", "_bytes", "_forced"]
    kept = out.withColumnRenamed("_p", READ_COLUMN) if keep_read else out.drop("_p")
    return kept.drop(*drop)


# Column in which detection hands its structure check on to the parsers.
READ_COLUMN = "_structure"


def route_profiles(df: DataFrame, active: DataFrame) -> DataFrame:
    """Add `active_bundle`, the digest activated for the row's source profile."""
    table = active.select("source_profile_id", F.col("bundle_sha256").alias("active_bundle"))
    return df.join(table, "source_profile_id", "left")
