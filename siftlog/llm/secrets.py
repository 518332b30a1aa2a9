"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, hex keys) are reported as
they stand. Weak candidates (bare key-like tokens, endpoints) are reported only
when the other parts of a credential lie within the same scope: a key needs an
access identifier or account name, an endpoint needs both an identifier and a
secret. Scopes are `scope` code points to either side.

Offsets come from the pieces between matches: a running sum over the exploded
pieces of a text. Linking is an interval join on (row, bin) with bins as wide
as the scope. A candidate looks at its own bin and both neighbours; a bin keeps
only the first and the last start of each part, which decides exactly whether
some part lies in reach, so no pairs are made however dense a text is.

Defined results: null text is empty and has no spans. Rows that repeat an id
are scanned and reported each on its own. Extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlog.llm.common import stored, whole_text

#: Pattern, group whose length counts and least length of each strong kind, in order of report.
STRONG = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Weak kinds: pattern and the part of a credential that a match can be.
WEAK = {
    "account": (r"""(?i)(?:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""", "identifier"),
    "bare": (r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", "secret"),
    "endpoint": (r"""https?://[^\s"'<>]+""", "endpoint"),
}
PARTS = {"assign": "secret", "access": "identifier", "hex": "secret"} | {kind: part for kind, (_, part) in WEAK.items()}
#: Parts that must lie in scope of a weak candidate.
NEEDS = {"account": ("secret",), "bare": ("identifier",), "endpoint": ("identifier", "secret")}
KINDS = [*STRONG, *WEAK]


def _lengths(kind: str) -> Column:
    """Null without a match, else its (gap, len, counted) structs; the last one is the rest of the text."""
    pattern, group = (STRONG[kind][0], STRONG[kind][1]) if kind in STRONG else (WEAK[kind][0], 0)
    hits = F.regexp_extract_all("txt", F.lit(pattern), F.lit(0))

    def lengths(x: Column) -> Column:
        counted = F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]
        return F.struct(F.char_length(x["piece"]).alias("gap"), F.coalesce(F.char_length(x["hit"]), F.lit(0)).alias("len"), F.char_length(counted).alias("counted"))

    return F.when(F.size(hits) > 0, F.transform(F.arrays_zip(F.split("txt", pattern, -1).alias("piece"), hits.alias("hit")), lengths))


def match_lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, one array per kind): for each match the code points before it since the last, of itself, and of the counted group.

    One pass over the texts; only these numbers are kept. `row` names a row, also where ids repeat or are null.
    """
    frame = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("txt"))
    columns = [_lengths(kind).alias(kind) for kind in KINDS]
    return stored(frame.select(F.monotonically_increasing_id().alias("row"), "id", *columns), "matches")


def find_spans(matches: DataFrame) -> DataFrame:
    """(row, kind, start, stop) of every match that is long enough; offsets in code points, end exclusive."""
    pieces = None
    for kind in KINDS:
        one = matches.filter(F.col(kind).isNotNull()).select("row", F.lit(kind).alias("kind"), F.posexplode(kind).alias("n", "m"))
        pieces = one if pieces is None else pieces.unionByName(one)
    so_far = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    least = _lookup("kind", {kind: STRONG[kind][2] if kind in STRONG else 1 for kind in KINDS})
    return (
        pieces.withColumn("stop", F.sum(F.col("m.gap") + F.col("m.len")).over(so_far))
        .filter(F.col("m.counted") >= least)
        .select("row", "kind", (F.col("stop") - F.col("m.len")).alias("start"), "stop")
    )


def _lookup(column: str, table: dict[str, object]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.col(column))


def link_spans(spans: DataFrame, scope: int = 256) -> DataFrame:
    """Strong spans, and weak ones whose complementary parts lie within `scope`."""
    placed = spans.withColumn("bin", F.floor(F.col("start") / scope)).withColumn("part", _lookup("kind", PARTS))
    parts = placed.groupBy("row", "bin", "part").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    needs = F.create_map(*[x for kind, parts_ in NEEDS.items() for x in (F.lit(kind), F.array(*map(F.lit, parts_)))])
    weak = placed.filter(F.col("kind").isin(*WEAK)).select("row", "kind", "start", "stop", "bin", F.element_at(needs, F.col("kind")).alias("needs"))
    asked = weak.withColumn("part", F.explode("needs")).withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    reach = (F.abs(F.col("first") - F.col("start")) <= scope) | (F.abs(F.col("last") - F.col("start")) <= scope)
    linked = (
        asked.join(parts, ["row", "bin", "part"]).filter(reach)
        .groupBy("row", "kind", "start", "stop").agg(F.countDistinct("part").alias("found"), F.max(F.size("needs")).alias("wanted"))
        .filter(F.col("found") == F.col("wanted"))
    )
    return spans.filter(F.col("kind").isin(*STRONG)).unionByName(linked.select("row", "kind", "start", "stop"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 256) -> DataFrame:
    """(id, spans) of every row: spans are structs (kind, start, stop) by start, then kind as listed in KINDS."""
    rows = match_lengths(docs, id_col, text_col)
    spans = stored(find_spans(rows), "spans")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    ordered = link_spans(spans, scope).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "stop", "kind"))).alias("s"))
    empty = F.expr("cast(array() as array<struct<kind:string,start:bigint,stop:bigint>>)")
    listed = F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return rows.select("row", "id").join(ordered, "row", "left").select(F.col("id").alias(id_col), F.coalesce(listed, empty).alias("spans"))
