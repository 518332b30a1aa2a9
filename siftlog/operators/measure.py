"""Workload mixes and measurement reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlog.functions.ordered import running_totals
from siftlog.sources.commits import stored


def expand_weights(weights: list[tuple[object, int]]) -> list[object]:
    """Each choice repeated by its weight (bounded configuration)."""
    out = [value for value, weight in weights for _ in range(weight)]
    if not 1 <= len(out) <= 100_000:
        raise ValueError("total weight is out of bounds")
    return out


def weighted_mix(rows: DataFrame, index: Column, choices: list[tuple[object, int]], seed: int, name: str) -> DataFrame:
    """Add a seeded, cyclic choice per row: position `index mod total` of a shuffled list."""
    options = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(i)).alias("h"), F.lit(v).alias("v")) for i, v in enumerate(expand_weights(choices))])
    shuffled = F.sort_array(options)  # folded into one literal; array_sort would sort the list for every row
    return rows.withColumn(name, F.get(shuffled, F.pmod(index, F.size(shuffled)).cast("int"))["v"])


def pad_payload(payload: Column, size: Column, marker: str | None = None) -> Column:
    """Pad to `size` bytes before a trailing newline, or before the last marker; never truncate."""
    missing = F.greatest(size - F.octet_length(payload), F.lit(0)).cast("int")
    newline = payload.endswith("\n")
    body = F.when(newline, F.substr(payload, F.lit(1), F.length(payload) - 1)).otherwise(payload)
    blanks = F.concat(body, F.repeat(F.lit(" "), missing), F.when(newline, F.lit("\n")).otherwise(""))
    if marker is None:
        return blanks
    head = F.substring_index(payload, marker, -1)
    kept = F.substr(payload, F.lit(1), F.length(payload) - F.length(head) - len(marker))
    marked = F.concat(kept, F.repeat(F.lit("x"), missing), F.lit(marker), head)
    return F.when(payload.contains(marker), marked).otherwise(blanks)


def composition(rows: DataFrame, columns: list[str], size: str) -> DataFrame:
    """Counts per value of each column in one pass, with the byte range of all rows."""
    names = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("d"), F.col(size).alias("_s"))
    return names.groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("rows"), F.min("_s").alias("min_bytes"), F.max("_s").alias("max_bytes"))


def latency_summary(rows: DataFrame, by: str, value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Samples, min, exact nearest-rank percentiles and max per group, by distributed rank selection.

    Equal values of a group are counted first. The counts are dealt into ranges of
    (group, value), so a group with most of the rows spreads over tasks; running
    counts inside a range and the counts of the ranges before it give each value
    the ranks it covers, and the value that covers a wanted rank is the percentile.
    Null values are no samples, and rows of a null group belong to none.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = stored(counted.repartitionByRange(by, value).withColumn("_range", F.spark_partition_id()), "value-counts")
    ranks = running_totals(ranged, [by], [F.col(value)], F.col("_range"), {"_upto": F.col("_n")}, "_nth").drop("_nth")
    ends = ranged.groupBy(by).agg(F.sum("_n").alias("samples"), F.min(value).alias("min"), F.max(value).alias("max"))
    covers = [F.min(F.when(F.col("_upto") * 100 >= F.col("samples") * p, F.col(value))).alias(f"p{p}") for p in percents]
    return ends.join(ranks.join(ends.select(by, "samples"), by).groupBy(by).agg(*covers), by)


def throughput(rows: DataFrame, by: str, start_ns: str, end_ns: str, size: str) -> DataFrame:
    """Events per second and bytes per event over the observed span."""
    span = (F.max(end_ns) - F.min(start_ns)) / F.lit(1e9)
    per = rows.groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.sum(size).alias("bytes"), span.alias("seconds"))
    return per.select(by, "events", "bytes", F.when(F.col("seconds") > 0, F.col("events") / F.col("seconds")).otherwise(0.0).alias("events_per_s"),
                      (F.col("bytes") / F.col("events")).alias("bytes_per_event"))


def accounting(receipts: DataFrame, raw: DataFrame, revisions: DataFrame) -> DataFrame:
    """Raw bytes verified, hash mismatches, receipts without revision, status counts."""
    held = raw.select(F.col("ref").alias("raw_ref"), F.col("sha256").alias("_sha"))
    checked = receipts.join(held, "raw_ref", "left").agg(
        F.count_if(F.col("_sha") == F.col("raw_sha256")).alias("raw_verified"), F.count_if(F.coalesce(F.col("_sha") != F.col("raw_sha256"), F.lit(True))).alias("hash_mismatches"))
    unlinked = receipts.select("receipt_id").join(revisions.select("receipt_id"), "receipt_id", "left_anti").agg(F.count(F.lit(1)).alias("linkage_failures"))
    statuses = revisions.groupBy(F.concat(F.lit("status_"), F.col("status")).alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    first = checked.unpivot([], ["raw_verified", "hash_mismatches"], "metric", "value")
    return first.unionByName(unlinked.unpivot([], ["linkage_failures"], "metric", "value")).unionByName(statuses)
