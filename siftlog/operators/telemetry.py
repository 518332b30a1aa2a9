"""Counter history: rates with reset detection, alert rules, label budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlog.functions.ordered import previous_values, running_totals

COUNTERS = ["receipts", "revisions", "delivered"]
GAUGES = ["pending", "failed"]
MAX_GAP_NS = 15 * 10**9
KEEP_NS = 120 * 10**9
KEEP_POINTS = 60
HOUR_NS = 3_600_000_000_000
MAX_SERIES = 10_000


def counter_rates(samples: DataFrame) -> DataFrame:
    """Per-second rates between neighbouring samples of an origin.

    `samples`: origin, time_ns and the five totals. A gap above 15 s, a
    decreasing counter or an invalid sample starts a new segment. The result has
    every rate point with its segment; `live_points` trims it.
    """
    bad = F.lit(False)
    for c in COUNTERS + GAUGES:
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(True))
    checked = samples.withColumn("_bad", bad)
    slot = F.col("time_ns") - F.col("time_ns") % HOUR_NS
    rows = previous_values(checked, ["origin"], [F.col("time_ns")], slot, ["time_ns", "_bad", *COUNTERS])
    known = F.col("prev_time_ns").isNotNull() & ~F.col("prev__bad") & ~F.col("_bad")
    gap = F.col("time_ns") - F.col("prev_time_ns")
    fell = F.lit(False)
    for c in COUNTERS:
        fell = fell | (F.col(c) < F.col(f"prev_{c}"))
    is_point = F.coalesce(known & (gap > 0) & (gap <= MAX_GAP_NS) & ~fell, F.lit(False))
    # An equal timestamp neither adds a point nor breaks the segment.
    breaks = F.coalesce(~known | (gap > MAX_GAP_NS) | fell, F.lit(True))
    rows = rows.withColumn("_point", is_point).withColumn("_break", breaks.cast("int"))
    rows = running_totals(rows, ["origin"], [F.col("time_ns")], slot, {"segment": F.col("_break")}, "_row")
    seconds = gap / F.lit(1e9)
    rates = [((F.col(c) - F.col(f"prev_{c}")) / seconds).alias(f"{c}_per_s") for c in COUNTERS]
    return rows.filter("_point").select("origin", "time_ns", "segment", *rates, *GAUGES)


def live_points(points: DataFrame, samples: DataFrame) -> DataFrame:
    """The points an origin shows now: last segment, 120 s, at most 60."""
    last = points.groupBy("origin").agg(F.max(F.struct("time_ns", "segment")).alias("l"))
    near = points.join(last, "origin").filter(
        (F.col("segment") == F.col("l.segment")) & (F.col("l.time_ns") - F.col("time_ns") <= KEEP_NS)
    )
    recent = Window.partitionBy("origin").orderBy(F.desc("time_ns"))
    # 120 s of samples per origin; the rank limit is applied before the shuffle.
    return near.withColumn("_n", F.row_number().over(recent)).filter(F.col("_n") <= KEEP_POINTS).drop("_n", "l")


# fixed values: alert name, severity, metric, label filter, test, threshold, window / hold seconds
ALERT_RULES = [
    ("DiskAdmissionBlocked", "critical", "storage_admission_blocked", None, "eq", 1.0, 0, 60),
    ("DiskApproachingWatermark", "warning", "storage_used_ratio", None, "gt", 0.80, 0, 900),
    ("RawEvidenceIntegrityFailure", "critical", "reconciliation_findings_total", "missing|corrupt", "increase", 0.0, 600, 0),
    ("ReconciliationStale", "warning", "maintenance_last_success_timestamp_seconds", "reconcile", "age", 900.0, 0, 300),
    ("RequiredConnectorDeadLetter", "critical", "connector_deliveries", "required:DEAD_LETTER", "gt", 0.0, 0, 120),
    ("ProcessingBacklog", "warning", "receipts", "ACCEPTED|PROCESSING|DELIVERY_PENDING", "gt", 1000.0, 0, 600),
    ("OldestQueueItemStale", "warning", "queue_oldest_age_seconds", None, "gt", 300.0, 0, 300),
    ("RequiredDependencyUnavailable", "critical", "dependency_healthy", "required", "eq", 0.0, 0, 120),
    ("CapacityRejections", "critical", "admission_requests_total", "rejected_capacity", "increase", 0.0, 300, 0),
]


def _time_window(seconds: int) -> Window:
    return Window.partitionBy("alert", "series", "_slot").orderBy("time_s").rangeBetween(-seconds, 0)


def alert_evaluations(history: DataFrame) -> DataFrame:
    """State of every alert rule at every sample: inactive, pending or firing.

    `history`: metric, series, label, time_s BIGINT, value DOUBLE. `for` means the
    test has held at every sample for the whole hold time.
    """
    rules = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(
            ["alert", "severity", "metric", "label_filter", "test", "threshold", "window_s", "hold_s"],
            [r[0], r[1], r[2], r[3] or ".*", r[4], r[5], r[6], r[7]])])
        for r in ALERT_RULES
    ])
    # Rules live in the plan as literals: each sample meets only its metric's rules.
    rows = history.withColumn("r", F.explode(F.filter(rules, lambda r: (r["metric"] == F.col("metric"))))).select("*", "r.*").drop("r")
    rows = rows.filter(F.concat(F.lit("|"), F.col("label_filter"), F.lit("|")).contains(F.concat(F.lit("|"), F.col("label"), F.lit("|"))) | (F.col("label_filter") == ".*"))
    return _evaluate(rows)


LOOKBACK_S = 900 + 600
SLOT_S = 6 * 3600


def _evaluate(rows: DataFrame) -> DataFrame:
    """Windows run per six-hour slot; each slot also carries its look-back rows."""
    slot = (F.col("time_s") - F.col("time_s") % SLOT_S)
    # A row near the end of a slot is copied to the next slot as history only.
    slots = F.when(
        F.col("time_s") + LOOKBACK_S >= slot + SLOT_S, F.array(slot, slot + SLOT_S)
    ).otherwise(F.array(slot))
    rows = rows.withColumn("_own", slot).withColumn("_slot", F.explode(slots))
    prev = F.lag("value").over(Window.partitionBy("alert", "series", "_slot").orderBy("time_s"))
    rows = rows.withColumn("_step", F.when(prev.isNull(), 0.0).when(F.col("value") < prev, F.col("value")).otherwise(F.col("value") - prev))

    def increase(seconds: int) -> Column:
        # The first sample inside the window only sets the base line.
        inside = _time_window(seconds)
        return F.sum("_step").over(inside) - F.first("_step").over(inside)

    grown = F.when(F.col("window_s") == 600, increase(600)).otherwise(increase(300))
    raw = (
        F.when(F.col("test") == "eq", F.col("value") == F.col("threshold"))
        .when(F.col("test") == "gt", F.col("value") > F.col("threshold"))
        .when(F.col("test") == "age", F.col("time_s") - F.col("value") > F.col("threshold"))
        .otherwise(grown > F.col("threshold"))
    )
    rows = rows.withColumn("active", raw)
    holds = sorted({r[7] for r in ALERT_RULES if r[7]})
    held = F.col("hold_s") == 0
    for seconds in holds:
        span = _time_window(seconds)
        # Held only if no sample failed and the history is at least that long.
        long_enough = F.col("time_s") - F.min("time_s").over(span) >= seconds
        held = held | ((F.col("hold_s") == seconds) & F.min(F.col("active").cast("int")).over(span).cast("boolean") & long_enough)
    state = F.when(~F.col("active"), "inactive").when(held, "firing").otherwise("pending")
    return rows.withColumn("state", state).filter(F.col("_own") == F.col("_slot")).select("alert", "severity", "series", "time_s", "value", "state")


def label_violations(series: DataFrame, allowed: DataFrame) -> DataFrame:
    """Series labels outside the allowed values.

    `series`: metric, label, value. `allowed`: metric, label, value.
    """
    return series.distinct().join(allowed, ["metric", "label", "value"], "left_anti")


def series_budget(allowed: DataFrame) -> DataFrame:
    """Possible series per metric and whether they exceed the budget; past 2^62 the count stays there."""
    sizes = allowed.groupBy("metric", "label").agg(F.count_distinct("value").alias("n"))
    most = F.lit(1 << 62).cast("bigint")
    # A metric has a handful of labels, so the list is short.
    product = F.aggregate(
        F.collect_list("n"), F.lit(1).cast("bigint"), lambda total, n: F.when(total > F.call_function("div", most, n), most).otherwise(total * n))
    return sizes.groupBy("metric").agg(product.alias("possible_series")).withColumn("over_budget", F.col("possible_series") > MAX_SERIES)


def maintenance_counters(findings: DataFrame) -> DataFrame:
    """Counters by kind from reconcile and retention reports (kind, amount)."""
    return findings.groupBy("kind").agg(F.sum("amount").alias("total"))
