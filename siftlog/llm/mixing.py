"""Mixing sources to target weights by pivotal dependent rounding.

Sources share `share` times all words by weight; none gets more than `most` times
its own, and the excess is shared again by weight among the others. A document of
a source with rate r (target by size) is taken floor(r) times, and once more with
probability r - floor(r). These fractions are rounded together: two documents
meet, a random one of them gains as many words as the other can give, until one of
them is taken wholly or not at all; the other, still fractional, meets the next.
The words expected of the source stay the same at each step, and so does the
probability of each document.

Distribution: documents are dealt into buckets of about BUCKET by a hash; each
bucket leaves one fractional document, and these residuals are dealt and combined
again, level by level. The last one of a source has no partner and is rounded to
the nearer side, so that a source is off its target by at most half of one
document. All of it is DataFrame functions.

Scale: equal rows (id, source, size) are counted first and only as many as their
sum of fractions leaves open is paired; buckets follow the documents of a source,
so a hot source has more of them. The driver reads a few numbers a level.

Defined results: null text has size 0 and is taken 0 times. A null source is a
source and comes last. Rows that are equal in id, source and size are separate
documents. The draw depends on ids, sizes and `seed` only, not on partitions.
Empty tables give no rows; a source of size 0 has target 0. Long texts only lend
their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftlog.llm.common import SPACES, stored, whole_text

BUCKET = 64
RANGE_ROWS = 1 << 20


def word_count(text: str) -> Column:
    """Runs of other characters than white space: each is replaced by one character."""
    rest = F.ltrim(whole_text(text), F.lit(SPACES))
    return F.char_length(F.regexp_replace(rest, "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "x")).cast("bigint")


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once; inside higher-order functions nothing else shares work."""
    return F.transform(F.array(value), use)[0]


def order_sources(units: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(source, place, source_size, weight): places from 0 by code point, null last; weights repeat."""
    sizes = stored(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), "source-sizes")
    ranges = max(1, -(-sizes.count() // RANGE_ROWS))
    order = F.asc_nulls_last("source")
    placed = stored(
        sizes.repartitionByRange(ranges, order).sortWithinPartitions(order)
        .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "source-order")
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # one row for every RANGE_ROWS sources
    shifts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"))
    place = F.col("at") + F.col("shift")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    return placed.join(shifts, "part").select("source", place.alias("place"), "source_size", weight.alias("weight"))


def share_out(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Add `target`: the words of each source."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    cap = F.col("source_size") * F.lit(float(most))
    while True:
        above = cap < F.col("weight") * F.lit(level)
        row = sources.agg(F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if row[0] == full or not row[2]:
            break
        full, level = row[0], (share * total - (row[1] or 0.0)) / row[2]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap) if total else F.lit(0.0))


def _meet(held: Column, new: Column, seed: Column) -> Column:
    """One step: the fractional document `held` meets `new`; (id, size, mass, taken) of the one that stays fractional."""
    draw = (F.shiftrightunsigned(F.xxhash64(new["id"], new["size"], seed), 11)).cast("double") / F.lit(float(1 << 53))
    gain, give = F.least(held["size"] - held["mass"], new["mass"]), F.least(held["mass"], new["size"] - new["mass"])
    moved = F.struct(gain.alias("gain"), give.alias("give"), (draw * (gain + give) < give).alias("up"))

    def masses(m: Column) -> Column:
        both = held["mass"] + new["mass"]
        filled, emptied = m["gain"] == held["size"] - held["mass"], m["give"] == held["mass"]
        a = F.when(m["up"], F.when(filled, held["size"].cast("double")).otherwise(both)).otherwise(F.when(emptied, 0.0).otherwise(held["mass"] - m["give"]))
        b = F.when(m["up"], F.when(filled, new["mass"] - m["gain"]).otherwise(0.0)).otherwise(F.when(emptied, both).otherwise(new["size"].cast("double")))
        return F.struct(a.alias("a"), b.alias("b"))

    def result(m: Column) -> Column:
        decided = (m["a"] <= 0) | (m["a"] >= held["size"])
        stays = lambda x, y: F.when(decided, y).otherwise(x)
        size, mass = stays(held["size"], new["size"]), stays(m["a"], m["b"])
        won = F.filter(
            F.array(
                F.struct(held["id"].alias("id"), held["size"].alias("size"), (m["a"] >= held["size"]).alias("won")),
                F.struct(new["id"].alias("id"), new["size"].alias("size"), (m["b"] >= new["size"]).alias("won"))),
            lambda x: x["won"])
        return F.struct(
            stays(held["id"], new["id"]).alias("id"), size.alias("size"), F.when((mass <= 0) | (mass >= size), 0.0).otherwise(mass).alias("mass"),
            F.concat(held["taken"], F.transform(won, lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size")))).alias("taken"))

    first = F.struct(new["id"].alias("id"), new["size"].alias("size"), new["mass"].alias("mass"), held["taken"].alias("taken"))
    return F.when(held["mass"] <= 0, first).otherwise(let(moved, lambda m: let(masses(m), result)))


def round_together(open_rows: DataFrame, seed: int, bucket: int = BUCKET) -> DataFrame:
    """(place, id, size) of the rows that are taken, of (place, id, size, mass) with 0 < mass < size."""
    kind = open_rows.schema["id"].dataType.simpleString()
    left, taken, level = stored(open_rows, "open"), [], 0
    while True:
        counts = stored(left.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / bucket).alias("buckets")), "buckets")
        most = counts.agg(F.max("buckets")).first()[0] or 0
        salt = F.lit(seed + 1000 * level)
        dealt = left.join(counts, "place").withColumn("bucket", F.pmod(F.xxhash64("id", "size", salt), F.col("buckets")))
        entry = F.struct(F.xxhash64("size", "id", salt).alias("h"), "id", "size", "mass")
        none = F.struct(F.lit(None).cast(kind).alias("id"), F.lit(0).cast("bigint").alias("size"), F.lit(0.0).alias("mass"), F.array().cast(f"array<struct<id: {kind}, size: bigint>>").alias("taken"))
        folded = stored(
            dealt.groupBy("place", "bucket").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
            .select("place", F.aggregate("rows", none, lambda held, new: _meet(held, new, F.lit(seed + 1000 * level + 1))).alias("f")), f"folded-{level}")
        taken.append(folded.select("place", F.explode("f.taken").alias("t")).select("place", "t.id", "t.size"))
        left = folded.filter("f.mass > 0").select("place", "f.id", "f.size", "f.mass")
        level += 1
        if most <= 1:
            break
    taken.append(left.filter(F.col("mass") * 2 >= F.col("size")).select("place", "id", "size"))
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5, most: float = 2.0, seed: int = 13, bucket: int = BUCKET,
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every document: how often the mix takes it, and the words that makes."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    units = stored(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    sources = stored(share_out(stored(order_sources(units, weights), "sources"), share, most).withColumnRenamed("source", "s"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(rate)
    rated = units.join(sources, F.col("source").eqNullSafe(F.col("s"))).select(
        "id", "source", "size", "rows", "place", "source_size", "target", base.alias("base"),
        F.when(F.col("size") > 0, (rate - base) * F.col("rows")).otherwise(F.lit(0.0)).alias("open"))
    rated = stored(rated.withColumn("more", F.floor("open")).withColumn("mass", (F.col("open") - F.col("more")) * F.col("size")).drop("open"), "rated")
    chosen = stored(round_together(rated.filter((F.col("mass") > 0) & (F.col("mass") < F.col("size"))).select("place", "id", "size", "mass"), seed, bucket)
                    .select(F.col("place").alias("p"), F.col("id").alias("i"), F.col("size").alias("n")), "chosen")
    won = (F.col("place") == F.col("p")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("size") == F.col("n"))
    copies = F.col("base") + (F.col("nth") <= F.col("more") + F.col("p").isNotNull().cast("int")).cast("int")
    return (
        rated.join(chosen, won, "left").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
        .withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("int"))
        .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))
    )
