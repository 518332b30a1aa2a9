"""Order-dependent operators that do not put a hot key into one task.

A plain window over a key keeps all rows of that key in one task. These helpers
take a `slot`: an expression that never decreases along the ordering (a time
bucket, an id prefix). The window then runs per (key, slot), and what a slot
must know about earlier slots comes from a small per-slot aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_totals(
    df: DataFrame, keys: list[str], order: list[Column], slot: Column, sums: dict[str, Column], rank: str = "row_no"
) -> DataFrame:
    """Add `rank` (1-based, per key) and running sums, all inclusive of the row."""
    rows = df.withColumn("_slot", slot)
    for name, value in sums.items():
        rows = rows.withColumn(f"_v_{name}", value.cast("bigint"))
    inner = Window.partitionBy(*keys, "_slot").orderBy(*order)
    ahead = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    per_slot = rows.groupBy(*keys, "_slot").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums]
    )
    before = per_slot.select(
        *keys,
        "_slot",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_s_{n}").over(ahead), F.lit(0)).alias(f"_s0_{n}") for n in sums],
    )
    local = rows.withColumn("_r", F.row_number().over(inner))
    span = inner.rowsBetween(Window.unboundedPreceding, 0)
    for name in sums:
        local = local.withColumn(f"_l_{name}", F.sum(f"_v_{name}").over(span))
    joined = local.join(before, [*keys, "_slot"])
    out = joined.withColumn(rank, F.col("_n0") + F.col("_r"))
    for name in sums:
        out = out.withColumn(name, F.col(f"_s0_{name}") + F.col(f"_l_{name}"))
    return out.select(*df.columns, rank, *sums)


def previous_values(df: DataFrame, keys: list[str], order: list[Column], slot: Column, columns: list[str]) -> DataFrame:
    """Add `prev_<c>`: the value of each column in the preceding row of the key."""
    rows = df.withColumn("_slot", slot)
    packed = F.struct(*columns)
    inner = Window.partitionBy(*keys, "_slot").orderBy(*order)
    last = rows.groupBy(*keys, "_slot").agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    before = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slot"))).drop("_last")
    local = rows.withColumn("_lag", F.lag(packed).over(inner)).join(before, [*keys, "_slot"])
    prev = F.coalesce("_lag", "_carry")
    return local.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in columns])
