"""Dashboard aggregates: counts, totals, activity, recents, sources, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlog import vocab
from siftlog.operators.revisions import latest_revisions

BUCKET_NS = vocab.ACTIVITY_BUCKET_SECONDS * 10**9


def dense_counts(df: DataFrame, column: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Count per allowed value, zeros included: (by..., name, count).

    Conditional counts in one aggregate row, then unpivoted: there is no group
    per value, so a value that holds most rows costs no more than a rare one.
    """
    by = by or []
    counted = df.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    return counted.unpivot(by, values, "name", "count")


def receipt_state_counts(receipts: DataFrame, by: list[str] | None = None) -> DataFrame:
    return dense_counts(receipts, "state", vocab.RECEIPT_STATES, by)


def latest_status_counts(revisions: DataFrame, by: list[str] | None = None) -> DataFrame:
    latest = latest_revisions(revisions, ["revision_id", "created_at_ns", "status", *(by or [])])
    return dense_counts(latest, "status", vocab.STATUSES, by)


def revision_status_counts(revisions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Counts over every revision of known receipts, per tenant; only known statuses."""
    owned = revisions.drop("tenant_id").join(receipts.select("receipt_id", "tenant_id"), "receipt_id")
    return owned.filter(F.col("status").isin(vocab.STATUSES)).groupBy("tenant_id", "status").count()


def receipt_totals(receipts: DataFrame) -> DataFrame:
    available = F.sum(F.when(F.col("raw_available"), F.col("raw_size")).otherwise(0))
    return receipts.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("receipts"), F.coalesce(available, F.lit(0)).alias("raw_bytes")
    )


def revision_totals(revisions: DataFrame, receipts: DataFrame) -> DataFrame:
    owned = revisions.select("receipt_id").join(receipts.select("receipt_id", "tenant_id"), "receipt_id")
    return owned.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("revisions"))


def delivery_totals(deliveries: DataFrame, revisions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Pending, failed and delivered counts through the revision to its receipt."""
    rev = revisions.select("revision_id", "receipt_id")
    owner = receipts.select("receipt_id", "tenant_id")
    # Pre-aggregate per revision: the joins then carry one row per revision.
    per_revision = deliveries.groupBy("revision_id").agg(
        F.count_if(F.col("state").isin(vocab.DELIVERY_OPEN)).alias("p"),
        F.count_if(F.col("state") == "DEAD_LETTER").alias("f"),
        F.count_if(F.col("state") == "DELIVERED").alias("d"),
    )
    owned = per_revision.join(rev, "revision_id").join(owner, "receipt_id")
    return owned.groupBy("tenant_id").agg(F.sum("p").alias("pending"), F.sum("f").alias("failed"), F.sum("d").alias("delivered"))


def composite_totals(receipts: DataFrame, revisions: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Pending and failed over receipts and deliveries; a committed revision is not pending."""
    states = receipts.groupBy("tenant_id").agg(
        F.count_if(F.col("state").isin("ACCEPTED", "PROCESSING", "DELIVERY_PENDING")).alias("pending"),
        F.count_if(F.col("state") == "DEAD_LETTER").alias("failed"),
        F.lit(0).cast("bigint").alias("delivered"),
    )
    both = states.unionByName(delivery_totals(deliveries, revisions, receipts))
    return both.groupBy("tenant_id").agg(*[F.sum(c).alias(c) for c in ("pending", "failed", "delivered")])


def activity(receipts: DataFrame, revisions: DataFrame, now_ns: int, by: list[str] | None = None) -> DataFrame:
    """Twelve dense five-minute buckets ending with the current one."""
    by = by or []
    end = now_ns - now_ns % BUCKET_NS
    start = end - (vocab.ACTIVITY_BUCKETS - 1) * BUCKET_NS
    upper = end + BUCKET_NS

    def inside(df: DataFrame, column: str, accepted: int) -> DataFrame:
        rows = df.filter((F.col(column) >= start) & (F.col(column) < upper))
        return rows.select(
            *by, (F.col(column) - F.col(column) % BUCKET_NS).alias("bucket_ns"),
            F.lit(accepted).cast("bigint").alias("a"), F.lit(1 - accepted).cast("bigint").alias("c"),
        )

    seen = inside(receipts, "received_at_ns", 1).unionByName(inside(revisions, "created_at_ns", 0))
    counts = seen.groupBy(*by, "bucket_ns").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    owners = receipts.select(*by).distinct() if by else receipts.sparkSession.range(1)
    spine = owners.select(*by, F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(end).cast("bigint"), F.lit(BUCKET_NS).cast("bigint"))).alias("bucket_ns"))
    return spine.join(counts, [*by, "bucket_ns"], "left").select(
        *by, "bucket_ns", F.coalesce("a", F.lit(0)).alias("accepted"), F.coalesce("c", F.lit(0)).alias("committed")
    )


def pipeline_stages(receipts: DataFrame, revisions: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Stage counts per tenant with their attention / active / idle status."""
    facts = (
        receipts.groupBy("tenant_id").agg(
            F.count(F.lit(1)).alias("receipts"), F.count_if(F.col("state") == "PROCESSING").alias("processing")
        )
        .join(revision_totals(revisions, receipts), "tenant_id", "left")
        .join(composite_totals(receipts, revisions, deliveries), "tenant_id", "left")
        .na.fill(0)
    )
    stages = [("frame", "Frame", "receipts"), ("admit", "Admit", "receipts"), ("interpret", "Interpret", "revisions"),
              ("commit", "Commit", "revisions"), ("deliver", "Deliver", "delivered")]
    stage_rows = F.array(*[
        F.struct(F.lit(s).alias("stage"), F.lit(label).alias("label"), F.col(c).alias("count"), F.lit(i).alias("ord"))
        for i, (s, label, c) in enumerate(stages)
    ])
    rows = facts.select("tenant_id", "processing", "failed", F.explode(stage_rows).alias("s")).select("*", "s.*").drop("s")
    status = (
        F.when((F.col("stage") == "deliver") & (F.col("failed") > 0), "attention")
        .when((F.col("stage") == "interpret") & (F.col("processing") > 0), "active")
        .when(F.col("count") > 0, "active")
        .otherwise("idle")
    )
    return rows.select("tenant_id", "stage", "label", "count", status.alias("status"), "ord")


def queue_depth(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("tenant_id").agg(F.count_if(~F.col("state").isin(vocab.TERMINAL_STATES)).alias("depth"))


def oldest_active_age(receipts: DataFrame, now_ns: int) -> DataFrame:
    """Age of the oldest active receipt in ns: never negative, 0 when none is active."""
    oldest = F.min(F.when(F.col("state").isin(vocab.ACTIVE_STATES), F.col("received_at_ns")))
    return receipts.groupBy("tenant_id").agg(oldest.alias("o")).select(
        "tenant_id", F.coalesce(F.greatest(F.lit(0).cast("bigint"), F.lit(now_ns) - F.col("o")), F.lit(0)).alias("age_ns")
    )


# --- sources -----------------------------------------------------------------

# fixed values: first matching keyword pattern names the family
FAMILY_PATTERNS = [
    (r"palo|cisco|asa|firewall|network|qradar|\bips\b|\bids\b", "Network"),
    (r"okta|identity|auth|entra", "Identity"),
    (r"aws|cloudtrail|azure|gcp|cloud", "Cloud"),
    (r"windows|crowdstrike|endpoint|edr", "Endpoint"),
    (r"nginx|payment|application|app", "Application"),
    (r"kubernetes|linux|syslog|infra|oracle", "Infrastructure"),
]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _pretty(name: str) -> Column:
    """Identifier as a title: words split at - and _, first letters raised."""
    spaced = F.regexp_replace(F.regexp_replace(_text(name), "^generic-", ""), "[-_]+", " ")
    # A word also begins after punctuation, so cut at every word boundary.
    pieces = F.split(spaced, r"\b")
    raised = F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))
    return F.array_join(raised, "")


def source_identity(events: DataFrame) -> DataFrame:
    """Add source `family`, `display_name` and `display_format`.

    Needs source_name, source_family, source_profile_id, parser_id, format.
    """
    parts = [F.when(_text(c) != "", F.col(c)) for c in ("source_name", "source_profile_id", "parser_id")]
    hint = F.lower(F.concat_ws(" ", *parts))
    guess = None
    for pattern, family in FAMILY_PATTERNS:
        guess = F.when(hint.rlike(pattern), family) if guess is None else guess.when(hint.rlike(pattern), family)
    stated = F.trim(_text("source_family"))
    names = [F.nullif(_pretty(c), F.lit("")) for c in ("source_name", "source_profile_id", "parser_id")]
    shown = F.coalesce(
        F.nullif(F.trim(_text("format")), F.lit("")),
        F.nullif(F.regexp_replace(_text("parser_id"), "^generic-", ""), F.lit("")),
        F.lit("unknown"),
    )
    return events.select(
        "*",
        F.when(stated != "", stated).otherwise(guess.otherwise("Other")).alias("family"),
        F.coalesce(*names, F.lit("Unprofiled source")).alias("display_name"),
        F.upper(shown).alias("display_format"),
    )


def source_coverage(identified: DataFrame) -> DataFrame:
    """Events and share per family; ordering is count down, family up."""
    counts = identified.groupBy("family").agg(F.count(F.lit(1)).alias("events"))
    # One row per family is left, so the total over them is a small window.
    total = F.sum("events").over(Window.partitionBy(F.lit(1)))
    percent = F.floor(F.col("events") / total * 100 + 0.5).cast("bigint")
    return counts.select("family", "events", percent.alias("percent"))


def distinct_sources(identified: DataFrame) -> DataFrame:
    return identified.agg(F.count_distinct("display_name").alias("sources"), F.count_distinct("family").alias("families"))


def status_groups(counts: DataFrame) -> DataFrame:
    """Fold (name, count) into parsed / partial / failed / other with rounded percentages."""
    name = F.upper(F.col("name"))
    group = (
        F.when(name.isin("PARSED", "PROCESSED"), "parsed")
        .when(name.isin("PARTIALLY_PARSED", "PARTIAL"), "partial")
        .when(name.contains("FAIL") | name.contains("ERROR"), "failed")
        .otherwise("other")
    )
    sums = {g: F.coalesce(F.sum(F.when(group == g, F.col("count"))), F.lit(0)).alias(g) for g in ("parsed", "partial", "failed", "other")}
    row = counts.agg(*sums.values(), F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    wide = row.unpivot(["total"], list(sums), "status_group", "events")
    percent = F.when(F.col("total") > 0, F.floor(F.col("events") / F.col("total") * 100 + 0.5).cast("bigint"))
    return wide.select("status_group", "events", percent.alias("percent"))


def facets(identified: DataFrame) -> DataFrame:
    """Distinct values offered by each filter."""
    pairs = F.array(
        F.struct(F.lit("family").alias("facet"), F.col("family").alias("value")),
        F.struct(F.lit("format").alias("facet"), F.col("display_format").alias("value")),
        F.struct(F.lit("status").alias("facet"), F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("Unknown")).alias("value")),
    )
    return identified.select(F.explode(pairs).alias("p")).select("p.facet", "p.value").distinct()


SEARCH_FIELDS = ["display_name", "family", "display_format", "transport", "action", "status", "listener_id"]


def text_search(identified: DataFrame, text: str, family: str = "", fmt: str = "", status: str = "") -> DataFrame:
    """Case-insensitive containment over seven fields plus exact facet filters."""
    rows = identified
    if family:
        rows = rows.filter(F.col("family") == family)
    if fmt:
        rows = rows.filter(F.col("display_format") == fmt)
    if status:
        rows = rows.filter(F.coalesce("status", F.lit("Unknown")) == status)
    if text:
        present = [F.nullif(F.col(c), F.lit("")) for c in SEARCH_FIELDS]
        rows = rows.filter(F.lower(F.concat_ws(" ", *present)).contains(text.lower()))
    return rows


# --- recents -----------------------------------------------------------------


def _path(*paths: str) -> list[Column]:
    return [F.try_variant_get("parsed_fields", f"$.{p}", "string") for p in paths]


def newest(rows: DataFrame, time: str, limit: int = vocab.RECENT_LIMIT) -> DataFrame:
    """All rows that can be among the `limit` newest: not older than the last of those, with everything of the same time.

    What orders rows of one time need not be known yet, so rows can be ranked before the work that tells it.
    Rows without a time are the oldest.
    """
    top = rows.select(time).orderBy(F.desc(time)).limit(limit)
    last = top.agg(F.count(time).alias("n"), F.min(time).alias("time")).first()
    return rows.filter(F.col(time) >= last["time"]) if last["n"] == limit else rows


def recent_events(latest: DataFrame, limit: int = vocab.RECENT_LIMIT) -> DataFrame:
    """Newest revisions with names and actions found along fixed fallback paths.

    `latest`: latest revision rows with receipt columns, `parsed_fields` VARIANT,
    `format`, `event_action`, `quality_score`.
    """
    # Rank first: only `limit` rows reach the path lookups.
    top = latest.orderBy(F.desc("created_at_ns"), F.desc("revision_id")).limit(limit)

    def pair(a: str, b: str) -> Column:
        left, right = (F.coalesce(c, F.lit("")) for c in _path(f"header.{a}", f"header.{b}"))
        return F.nullif(F.trim(F.concat(left, F.lit(" "), right)), F.lit(""))

    name = F.coalesce(
        *_path("source_name", "source.name"), pair("device_vendor", "device_product"), pair("vendor", "product"),
        *_path("header.device_product", "header.product", "attributes.source_name", "event.source_name",
               "records[0].source_name", "app_name"),
        F.col("source_profile_id"), F.lit(""),
    )
    family = F.coalesce(
        *_path("source_family", "source.family", "attributes.source_family", "event.source_family", "records[0].source_family"),
        F.lit(""),
    )
    action = F.coalesce(
        F.col("event_action"),
        *_path("action", "attributes.action", "attributes.act", "event.action", "records[0].action"), F.lit(""),
    )
    return top.select(
        "receipt_id", "revision_id", "tenant_id", "received_at_ns", "created_at_ns", "status", "parser_id", "raw_sha256",
        F.coalesce("source_profile_id", F.lit("")).alias("source_profile_id"),
        F.substring(name, 1, 160).alias("source_name"),
        F.substring(family, 1, 80).alias("source_family"),
        F.substring(F.coalesce("format", F.lit("")), 1, 64).alias("format"),
        F.substring(action, 1, 80).alias("action"),
        "quality_score",
    )
