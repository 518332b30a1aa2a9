"""Sharding by minimax contiguous partition of ordered atomic groups.

Equal texts form one atomic group. Groups are ordered by the hash of their
text, which spreads them evenly over hash slots; a group's position is its
inclusive prefix sum of bytes. The smallest feasible shard capacity is found
by binary search with a greedy check, and shards are cut there.

The search runs on a bounded skeleton of the prefix sums: cells with their
smallest and largest sum and their count. A greedy check on it gives a lower
and an upper bound of the capacity; cells that still matter are refined with
one filtered scan per round until both bounds meet, so the result is exact
while the driver holds at most some ten thousand numbers.

A group above the average of what is left gets a shard of its own, or it
would set the capacity for all and leave other shards empty. Shards are read
off a document's own hash with at most shards - 1 literals: no join and no
shuffle by text. Slots number a shard's documents through per-bucket counts.

Defined results: null text counts as empty (size 1). An empty table gives no
rows. Rows that repeat an id are separate rows with separate slots.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlog.llm.common import stored, whole_text

ORDER_SLOTS = 4096
CELLS = 4096
REFINE = 64


def _above(left: tuple[Column, Column], right: tuple[int, int]) -> Column:
    """left > right for a pair of hashes."""
    return (left[0] > right[0]) | ((left[0] == right[0]) & (left[1] > right[1]))


def group_sizes(docs: DataFrame, text_col: str) -> DataFrame:
    """One row per distinct text: two hashes and the bytes of all its rows, one extra byte each."""
    text = whole_text(text_col)
    return docs.select(
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), (F.octet_length(text).cast("long") + 1).alias("size")
    ).groupBy("k1", "k2").agg(F.sum("size").alias("size"))


def prefix_sums(groups: DataFrame) -> DataFrame:
    """Add `upto`: bytes of all groups up to and with this one, in hash order."""
    slot = F.shiftright("k1", 52)
    slotted = groups.withColumn("order_slot", slot)
    totals = slotted.groupBy("order_slot").agg(F.sum("size").alias("slot_size"))
    ahead = Window.orderBy("order_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("order_slot", F.coalesce(F.sum("slot_size").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("order_slot").orderBy("k1", "k2").rowsBetween(Window.unboundedPreceding, 0)
    local = slotted.withColumn("local", F.sum("size").over(inside))
    return local.join(offsets, "order_slot").select("k1", "k2", "size", (F.col("before") + F.col("local")).alias("upto"))


class Skeleton:
    """Cells of the prefix sums: (smallest, largest, number of sums), ordered."""

    def __init__(self, sums: DataFrame, total: int):
        self.sums, self.total = sums, total
        self.cells = self._scan([(0, total)], CELLS)

    def _scan(self, ranges: list[tuple[int, int]], parts: int) -> list[tuple[int, int, int]]:
        """Cells of `parts` equal pieces of each range (low, high], one scan for all."""
        cell, inside = F.lit(None), F.lit(False)
        for k, (low, high) in enumerate(ranges):
            width = -(-(high - low) // parts)
            here = (F.col("upto") > low) & (F.col("upto") <= high)
            cell = F.when(here, F.lit(k * parts) + F.floor((F.col("upto") - 1 - low) / width)).otherwise(cell)
            inside = inside | here
        rows = (
            self.sums.filter(inside).groupBy(cell.cast("long").alias("cell"))
            .agg(F.min("upto").alias("first"), F.max("upto").alias("last"), F.count(F.lit(1)).alias("n"))
        )
        return sorted((r["first"], r["last"], r["n"]) for r in rows.collect())

    def find(self, limit: int, upper: bool) -> tuple[int, int]:
        """The largest sum not above `limit`, as far as known from below or above; and its cell if unknown."""
        k = bisect_right(self.cells, (limit, self.total + 1, 0)) - 1
        if k < 0:
            return 0, -1
        first, last, n = self.cells[k]
        if last <= limit:
            return last, -1
        if n <= 2:
            return first, -1
        return (limit if upper else first), k

    def cuts(self, capacity: int, shards: int, upper: bool) -> tuple[list[int], bool]:
        """Greedy cuts, and whether `shards` of that capacity take all."""
        at, cuts = 0, []
        for _ in range(shards):
            at = max(at, self.find(at + capacity, upper)[0])
            cuts.append(at)
        return cuts, at >= self.total

    def smallest(self, shards: int, upper: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.cuts(middle, shards, upper)[1] else (middle + 1, high)
        return low

    def solve(self, shards: int) -> list[int]:
        """Prefix sums at which the shards end, for the smallest feasible capacity."""
        while True:
            low, high = self.smallest(shards, True), self.smallest(shards, False)
            early, late = self.cuts(low, shards, False)[0], self.cuts(high, shards, True)[0]
            wanted = [
                k for a, b in zip(early, late, strict=True)
                for k in range(max(0, bisect_right(self.cells, (a,)) - 1), bisect_right(self.cells, (b, self.total + 1, 0)))
                if self.cells[k][2] > 2
            ]
            if low == high and early == late or not wanted:
                return self.cuts(high, shards, False)[0]
            chosen = sorted(set(wanted))
            finer = self._scan_cells([self.cells[k] for k in chosen])
            rest = [c for k, c in enumerate(self.cells) if k not in set(chosen)]
            self.cells = sorted(rest + finer)

    def _scan_cells(self, cells: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Refine cells; neighbours become one range with pieces in proportion, to keep the filter short."""
        ranges: list[list[int]] = []
        for first, last, _ in cells:
            if ranges and first - 1 - ranges[-1][1] <= 0:
                ranges[-1][1] = last
            else:
                ranges.append([first - 1, last])
        while len(ranges) > 32:
            gap = min(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1])
            ranges[gap - 1][1] = ranges.pop(gap)[1]
        known = [c for c in self.cells if any(low < c[0] <= high for low, high in ranges)]
        finer = self._scan([(low, high) for low, high in ranges], REFINE * max(1, len(known) // len(ranges)))
        covered = {c[0] for c in known}
        self.cells = [c for c in self.cells if c[0] not in covered or c in cells]
        return finer


def shard_cuts(docs: DataFrame, text_col: str = "text", shards: int = 16) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Hash pairs of the groups with a shard of their own, and of the last group of each further shard but the last."""
    groups = stored(group_sizes(docs, text_col), "groups")
    left = groups.agg(F.sum("size").alias("t")).first()["t"] or 0
    alone: list[tuple[int, int]] = []
    for row in groups.orderBy(F.desc("size"), "k1", "k2").limit(shards - 1).collect():
        if row["size"] * (shards - len(alone)) <= left:
            break
        alone.append((row["k1"], row["k2"]))
        left -= row["size"]
    if left == 0 or len(alone) == shards - 1:
        return alone, []
    for k1, k2 in alone:
        groups = groups.filter(~((F.col("k1") == k1) & (F.col("k2") == k2)))
    sums = stored(prefix_sums(groups), "prefix")
    ends = Skeleton(sums, left).solve(shards - len(alone))
    ends = sorted({e for e in ends if e < left})
    keys = sums.filter(F.col("upto").isin(ends)).orderBy("upto").select("k1", "k2").collect() if ends else []
    return alone, [(r["k1"], r["k2"]) for r in keys]


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, slot_buckets: int = 1024) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row; equal texts share a shard, slots have no gaps."""
    alone, ends = shard_cuts(docs, text_col, shards)
    text = whole_text(text_col)
    key = (F.col("k1"), F.col("k2"))
    shard = F.lit(len(alone))
    for end in ends:
        shard = shard + _above(key, end).cast("int")
    for n, (k1, k2) in enumerate(alone):
        shard = F.when((key[0] == k1) & (key[1] == k2), n).otherwise(shard)
    rows = (
        docs.select(
            F.col(id_col).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"),
            (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        )
        .withColumn("shard", shard.cast("int"))
        .withColumn("bucket", F.pmod(F.xxhash64("id", "k1"), F.lit(slot_buckets)))
        .select("id", "size", "text_crc32", "shard", "bucket")
    )
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")))
    return numbered.join(offsets, ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 16) -> None:
    """Write the documents below `path`, one folder per shard."""
    alone, ends = shard_cuts(docs, text_col, shards)
    text = whole_text(text_col)
    key = (F.xxhash64(text), F.xxhash64(F.lit("second"), text))
    shard = F.lit(len(alone))
    for end in ends:
        shard = shard + _above(key, end).cast("int")
    for n, (k1, k2) in enumerate(alone):
        shard = F.when((key[0] == k1) & (key[1] == k2), n).otherwise(shard)
    docs.withColumn("shard", shard).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
