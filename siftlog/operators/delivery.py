"""Delivery-state jobs: queue, due work, outcomes, roll-up, replay, projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlog import vocab
from siftlog.functions.ip import canonical_ip
from siftlog.functions.text import drop_controls

DELIVERY_KEY = ["connector_id", "revision_id"]


def target_array(targets: list[tuple[str, bool]]) -> Column:
    """Configured connectors as a literal array; ids must be unique."""
    ids = [t for t, _ in targets]
    if not ids or any(not t.strip() for t in ids) or len(set(ids)) != len(ids):
        raise ValueError("connector ids must be present and unique")
    return F.array(*[F.struct(F.lit(t).alias("connector_id"), F.lit(r).alias("required")) for t, r in targets])


def fan_out(records: DataFrame, targets: list[tuple[str, bool]]) -> DataFrame:
    """One row per record and connector; narrow, no join with the target list."""
    return records.select(
        F.explode(target_array(targets)).alias("t"), "revision_id", "receipt_id", "tenant_id"
    ).select("t.connector_id", "revision_id", "receipt_id", "tenant_id", "t.required")


def enqueue(records: DataFrame, deliveries: DataFrame, targets: list[tuple[str, bool]], now_ns: int) -> DataFrame:
    """PENDING rows for every record and connector that is not queued yet."""
    wanted = fan_out(records, targets).dropDuplicates(DELIVERY_KEY)
    fresh = wanted.join(deliveries.select(*DELIVERY_KEY), DELIVERY_KEY, "left_anti")
    return fresh.select(
        "connector_id", "revision_id", "receipt_id", "tenant_id", "required",
        F.lit("PENDING").alias("state"), F.lit(0).alias("attempts"),
        F.lit(now_ns).cast("bigint").alias("available_at_ns"), F.lit(None).cast("string").alias("last_code"),
        F.lit(now_ns).cast("bigint").alias("updated_at_ns"),
    )


def policy_conflicts(records: DataFrame, deliveries: DataFrame, targets: list[tuple[str, bool]]) -> DataFrame:
    """Queued rows whose stored tenant or required flag differs from the request."""
    stored = deliveries.select(*DELIVERY_KEY, F.col("tenant_id").alias("stored_tenant"), F.col("required").alias("stored_required"))
    joined = fan_out(records, targets).join(stored, DELIVERY_KEY)
    return joined.filter((F.col("stored_tenant") != F.col("tenant_id")) | (F.col("stored_required") != F.col("required")))


def due_work(deliveries: DataFrame, now_ns: int, per_connector: int) -> DataFrame:
    """First due rows of each connector by (available_at, revision)."""
    due = deliveries.filter(F.col("state").isin("PENDING", "RETRY") & (F.col("available_at_ns") <= now_ns))
    order = Window.partitionBy("connector_id").orderBy("available_at_ns", "revision_id")
    # The rank filter becomes a group limit below the shuffle: a connector that
    # owns most rows sends at most `per_connector` rows per map task.
    return due.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_connector)


def backoff_ms(attempts: Column, base_ms: int, cap_ms: int) -> Column:
    """base * 2^(attempt - 1), capped; attempts below one wait the base time."""
    steps = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(40))
    return F.least(F.lit(cap_ms).cast("double"), F.lit(base_ms).cast("double") * F.pow(F.lit(2.0), steps)).cast("bigint")


def apply_outcomes(
    claimed: DataFrame, outcomes: DataFrame, now_ns: int, max_attempts: int, base_ms: int, cap_ms: int
) -> DataFrame:
    """Next state of each claimed row. The first outcome of a revision wins.

    `outcomes`: connector_id, revision_id, position, outcome, code, message.
    """
    first = outcomes.filter("revision_id <> ''").groupBy(*DELIVERY_KEY).agg(
        F.min_by(F.struct("outcome", "code", "message"), "position").alias("o")
    )
    joined = claimed.join(first, DELIVERY_KEY, "left")
    missing = F.col("o").isNull()
    status = F.when(missing, "RETRYABLE").otherwise(F.col("o.outcome"))
    code = F.when(missing, "CONNECTOR_PROTOCOL").otherwise(drop_controls(F.coalesce("o.code", F.lit("")), 128))
    message = F.when(missing, "connector omitted a claimed revision").otherwise(
        drop_controls(F.coalesce("o.message", F.lit("")), 512)
    )
    known = status.isin("SUCCEEDED", "PERMANENT_FAILURE", "RETRYABLE")
    spent = F.col("attempts") >= max_attempts
    retry = (status == "RETRYABLE") & ~spent
    state = F.when(status == "SUCCEEDED", "DELIVERED").when(retry, "RETRY").otherwise("DEAD_LETTER")
    final_code = (
        F.when(status == "SUCCEEDED", F.lit(""))
        .when((status == "RETRYABLE") & spent, "RETRY_EXHAUSTED")
        .when(known, code)
        .otherwise("CONNECTOR_PROTOCOL")
    )
    final_message = (
        F.when(status == "SUCCEEDED", F.lit("")).when(known, message).otherwise("connector returned an invalid delivery status")
    )
    wait_ns = backoff_ms(F.col("attempts"), base_ms, cap_ms) * 1_000_000
    return joined.select(
        "connector_id", "revision_id", "receipt_id", "tenant_id", "required", state.alias("state"), "attempts",
        F.when(retry, F.lit(now_ns) + wait_ns).otherwise(F.col("available_at_ns")).alias("available_at_ns"),
        final_code.alias("last_code"), final_message.alias("last_message"), F.lit(now_ns).cast("bigint").alias("updated_at_ns"),
    )


def receipt_rollup(deliveries: DataFrame) -> DataFrame:
    """Target state per receipt from its required deliveries."""
    counted = deliveries.groupBy("receipt_id").agg(
        F.count_if(F.col("required")).alias("required_total"),
        F.count_if(F.col("required") & (F.col("state") != "DELIVERED")).alias("required_open"),
        F.count_if(F.col("required") & (F.col("state") == "DEAD_LETTER")).alias("required_dead"),
    )
    target = (
        F.when(F.col("required_dead") > 0, "DEAD_LETTER")
        .when((F.col("required_total") > 0) & (F.col("required_open") > 0), "DELIVERY_PENDING")
        .otherwise("DELIVERED")
    )
    return counted.select("receipt_id", target.alias("target_state"))


def refreshed_states(receipts: DataFrame, deliveries: DataFrame, recover_dead_letters: bool = False) -> DataFrame:
    """Receipt state after the roll-up, with the verdict of the move."""
    joined = receipts.select("receipt_id", "state").join(receipt_rollup(deliveries), "receipt_id")
    state, target = F.col("state"), F.col("target_state")
    frozen = (state == "DEAD_LETTER") & F.lit(not recover_dead_letters)
    allowed = (
        ((state == "REVISION_COMMITTED") & target.isin("DELIVERY_PENDING", "DELIVERED"))
        | ((state == "DELIVERED") & (target == "DELIVERY_PENDING"))
        | ((state == "DELIVERY_PENDING") & target.isin("DELIVERED", "DEAD_LETTER"))
        | ((state == "DEAD_LETTER") & F.lit(recover_dead_letters) & (target == "DELIVERY_PENDING"))
    )
    verdict = F.when(frozen | (state == target), "unchanged").when(allowed, "moved").otherwise("not_allowed")
    return joined.select(
        "receipt_id", "state", "target_state", verdict.alias("verdict"),
        F.when(verdict == "moved", target).otherwise(state).alias("new_state"),
        F.when((verdict == "moved") & (target == "DEAD_LETTER"), "CONNECTOR_DELIVERY_FAILED").alias("last_error_code"),
    )


def connector_summary(deliveries: DataFrame, tenant_id: str) -> DataFrame:
    """Counts per connector and state; mixed `required` flags raise an error."""
    rows = deliveries.filter(F.col("tenant_id") == tenant_id)
    counted = rows.groupBy("connector_id").agg(
        F.max("required").alias("required"), F.min("required").alias("_min"),
        *[F.count_if(F.col("state") == s).alias(s.lower()) for s in vocab.DELIVERY_STATES],
    )
    guard = F.when(F.col("required") != F.col("_min"), F.raise_error(F.concat(F.lit("inconsistent required policy for connector "), F.col("connector_id"))))
    return counted.filter(F.coalesce(guard.cast("boolean"), F.lit(True))).drop("_min")


def list_deliveries(
    deliveries: DataFrame, tenant_id: str, connector_id: str | None = None, state: str | None = None, limit: int = vocab.PAGE_DEFAULT
) -> DataFrame:
    """Newest deliveries of a tenant."""
    if not tenant_id.strip() or not 1 <= limit <= vocab.PAGE_MAX:
        raise ValueError("tenant and a limit between 1 and 200 are required")
    if state is not None and state not in vocab.DELIVERY_STATES:
        raise ValueError("delivery state is invalid")
    rows = deliveries.filter(F.col("tenant_id") == tenant_id)
    if connector_id:
        rows = rows.filter(F.col("connector_id") == connector_id)
    if state:
        rows = rows.filter(F.col("state") == state)
    return rows.orderBy(F.desc("updated_at_ns"), "connector_id", "revision_id").limit(limit)


def replay(deliveries: DataFrame, requests: DataFrame, now_ns: int) -> DataFrame:
    """Deliveries table with the requested DEAD_LETTER rows back to PENDING.

    `requests`: connector_id, revision_id, tenant_id.
    """
    asked = requests.select(*DELIVERY_KEY, F.col("tenant_id").alias("_tenant")).distinct()
    joined = deliveries.join(asked, DELIVERY_KEY, "left")
    hit = F.coalesce((F.col("_tenant") == F.col("tenant_id")) & (F.col("state") == "DEAD_LETTER"), F.lit(False))
    changed = {
        "state": F.when(hit, "PENDING").otherwise(F.col("state")),
        "attempts": F.when(hit, 0).otherwise(F.col("attempts")),
        "available_at_ns": F.when(hit, F.lit(now_ns)).otherwise(F.col("available_at_ns")),
        "last_code": F.when(~hit, F.col("last_code")),
        "updated_at_ns": F.when(hit, F.lit(now_ns)).otherwise(F.col("updated_at_ns")),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in deliveries.columns], hit.alias("replayed"))


# --- flat projection -----------------------------------------------------------


def _unsigned(col: Column, maximum: int) -> Column:
    return col.between(0, maximum)


#: Columns of an envelope that the projection reads, beside its text.
PROJECTED = ["schema_version", "receipt", "raw", "processing", "event", "quality"]


def project_envelopes(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat 25-column rows and the envelopes that do not fit (with the field).

    `envelopes` holds the nested envelope columns plus `envelope_json`.
    """
    event = F.col("event")
    # column -> (value, guard that must hold when the value is present)
    guarded = {
        "class_uid": (event["class_uid"], _unsigned(event["class_uid"], 2**32 - 1)),
        "activity_id": (event["activity_id"], _unsigned(event["activity_id"], 2**16 - 1)),
        "severity_id": (event["severity_id"].cast("bigint"), _unsigned(event["severity_id"], 2**8 - 1)),
        "src_port": (event["src_endpoint"]["port"].cast("bigint"), _unsigned(event["src_endpoint"]["port"], 2**16 - 1)),
        "dst_port": (event["dst_endpoint"]["port"].cast("bigint"), _unsigned(event["dst_endpoint"]["port"], 2**16 - 1)),
    }
    addresses = {name: event[end]["ip"] for name, end in (("src_ip", "src_endpoint"), ("dst_ip", "dst_endpoint"))}
    # An address column is typed in most sinks: one that is no address would fail the whole batch there.
    guarded |= {name: (ip, canonical_ip(ip).isNotNull()) for name, ip in addresses.items()}
    bad = F.coalesce(*[F.when(v.isNotNull() & ~g, F.lit(name)) for name, (v, g) in guarded.items()])
    flat = envelopes.select(
        F.col("receipt.id").alias("receipt_id"),
        F.col("processing.revision_id").alias("revision_id"),
        F.col("receipt.tenant_id").alias("tenant_id"),
        F.col("receipt.environment_id").alias("environment_id"),
        F.col("receipt.instance_id").alias("instance_id"),
        F.col("receipt.received_at").alias("received_at"),
        F.col("receipt.received_at_ns").alias("received_at_ns"),
        event["time"].alias("event_time"),
        F.col("receipt.source_profile_id").alias("source_profile_id"),
        *[v.alias(name) for name, (v, _) in guarded.items() if name not in addresses],
        F.coalesce(event["action"], F.lit("")).alias("action"),
        *[ip.alias(name) for name, ip in addresses.items()],
        F.coalesce(event["connection_info"]["protocol_name"], F.lit("")).alias("protocol"),
        F.col("processing.status").alias("status"),
        F.coalesce(F.col("processing.parser.id"), F.lit("")).alias("parser_id"),
        F.coalesce(F.col("processing.parser.version"), F.lit("")).alias("parser_version"),
        F.col("schema_version"),
        F.col("raw.sha256").alias("raw_sha256"),
        F.col("quality.score").cast("float").alias("quality_score"),
        F.transform("processing.issues", lambda i: i["code"]).alias("issue_codes"),
        F.col("envelope_json"),
        # As generator output the verdict is a plain column: the two filters below
        # are not pushed into (and copied over) the interpretation projections.
        F.explode_outer(F.array(bad)).alias("_bad"),
    )
    good = flat.filter("_bad IS NULL").drop("_bad")
    rejects = flat.filter("_bad IS NOT NULL").select("receipt_id", "revision_id", F.concat(F.lit("event."), "_bad").alias("field"))
    return good, rejects
