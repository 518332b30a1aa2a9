"""SimHash near-duplicates with pigeonring filtering.

A document's fingerprint is the bitwise majority of the hashes of its word
shingles. Fingerprints link when at most `max_bits` bits differ.

Search: the 64 bits form a ring of max_bits + 1 segments. If two fingerprints
differ in at most max_bits bits, then from some segment on every chain of l
consecutive segments differs in at most l * max_bits / (max_bits + 1) bits.
The first segment must thus be equal and the first two differ in at most one
bit, so a fingerprint is dealt out under (rotation, both segments) and under
every key with one more bit set in the second segment; two that share a key
are compared chain by chain before the full Hamming check.

Scale: exact copies collapse to one fingerprint first. A key held by more
fingerprints than `block` is split into blocks, and all others come to each
block. A block emits links that connect what it linked, never all its pairs:
at most one per probe plus one per held fingerprint. Components come from
large-star / small-star rounds whose joins read written tables, so that
adaptive execution can split hubs. Nothing is collected.

Defined results: null or empty text has fingerprint zero and links as any
other. Rows with a null id take part, but do not name a component; the id of a
component with null ids only is null. Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from siftlog.llm.common import stored

CHECKS_AT_ONCE = 1 << 21


def fingerprint(text: str | None, words: int, seeds: tuple[int, ...]) -> list[int]:
    """One signed 64-bit fingerprint per seed."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return [0] * len(seeds)
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        line = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        shingles = [line[a:b] for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    out = []
    for seed in seeds:
        count = np.zeros(64, np.int64)
        for k in range(0, len(shingles), 65536):
            part = shingles[k : k + 65536]
            hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in part), np.uint64, len(part))
            count += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * count > len(shingles), bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(id, fp, check) of every row; `check` is the fingerprint of a second seed, or 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words, seeds) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] if len(p) > 1 else 0 for p in prints], pa.int64())],
                names=["id", "fp", "check"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt")).mapInArrow(run, f"id {kind}, fp bigint, check bigint")


def ring(max_bits: int) -> list[list[int]]:
    """For each rotation the masks of its chains: the first segment, the first two, and so on."""
    parts = max_bits + 1
    edges = [64 * k // parts for k in range(parts + 1)]
    segment = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(parts)]
    chains = []
    for r in range(parts):
        masks, mask = [], 0
        for k in range(parts):
            mask |= segment[(r + k) % parts]
            masks.append(mask)
        chains.append(masks)
    return chains


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def candidate_keys(prints: DataFrame, max_bits: int) -> DataFrame:
    """(r, key, probe, fp, check): each fingerprint under its own keys, and as a probe under keys with one more bit in the second segment."""
    options = []
    for r, masks in enumerate(ring(max_bits)):
        both, second = (masks[1], masks[1] ^ masks[0]) if max_bits else (masks[0], 0)
        bits = [0, *(1 << b for b in range(64) if second >> b & 1)]
        options += [(r, signed(both), signed(bit)) for bit in bits]
    table = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(both).alias("both"), F.lit(bit).cast("bigint").alias("bit")) for r, both, bit in options])
    return (
        prints.select("fp", "check", F.explode(table).alias("o"))
        .filter(F.col("fp").bitwiseAND(F.col("o.bit")) == 0)
        .select(F.col("o.r").alias("r"), F.col("fp").bitwiseAND(F.col("o.both")).bitwiseOR(F.col("o.bit")).alias("key"), (F.col("o.bit") != 0).alias("probe"), "fp", "check")
    )


def _links_of_block(held: np.ndarray, held_check: np.ndarray, probes: np.ndarray, probes_check: np.ndarray, chains: list[int], max_bits: int, max_total: int, group: np.ndarray):
    """Links (probe fp, check, held fp, check) that connect all that is linked; `group` keeps which held ones are connected already."""
    step = max(1, CHECKS_AT_ONCE // max(1, len(held)))
    for k in range(0, len(probes), step):
        p, pc = probes[k : k + step], probes_check[k : k + step]
        cross = p[:, None] ^ held[None, :]
        near = np.ones(cross.shape, bool)
        for length, mask in enumerate(chains[2:], 3):
            near &= np.bitwise_count(cross & np.uint64(mask)) <= length * max_bits // (max_bits + 1)
        total = np.bitwise_count(cross).astype(np.int64)
        near &= total <= max_bits
        if max_total:
            near &= total + np.bitwise_count(pc[:, None] ^ held_check[None, :]) <= max_total
        near &= (cross != 0) | (pc[:, None] != held_check[None, :])
        hit = np.flatnonzero(near.any(axis=1))
        if not len(hit):
            continue
        # any linked one will do; spread over them, so that no fingerprint becomes a hub
        order = (np.arange(len(held)) + int(p[0] % np.uint64(1009))) % len(held)
        first = order[np.argmax(near[hit][:, order], axis=1)]
        for row, one in zip(hit.tolist(), first.tolist(), strict=True):
            yield p[row], pc[row], held[one], held_check[one]
        labels = np.where(near[hit], group[None, :], group[first][:, None])
        for at in np.flatnonzero((labels != group[first][:, None]).any(axis=1)).tolist():
            one = first[at]
            for other in np.flatnonzero(near[hit[at]] & (group != group[one])).tolist():
                if group[other] != group[one]:
                    group[group == group[other]] = group[one]
                    yield p[hit[at]], pc[hit[at]], held[other], held_check[other]


def link_fingerprints(prints: DataFrame, max_bits: int = 4, max_total: int = 0, block: int = 4096) -> DataFrame:
    """(a, check_a, b, check_b): links that connect distinct fingerprints exactly as all links would."""
    keys = candidate_keys(prints, max_bits)
    hot = stored(
        keys.filter(~F.col("probe")).groupBy("r", "key").count().filter(F.col("count") > block)
        .select("r", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot-keys")
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = (
        keys.join(hot, ["r", "key"], "left")
        .withColumn("own", F.pmod(F.xxhash64("fp", "check"), blocks).cast("int"))
        .withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("r", "key", "b", (F.col("probe") | (F.col("b") != F.col("own"))).alias("probe"), "fp", "check")
        .repartition("r", "key", "b").sortWithinPartitions("r", "key", "b", "probe")
    )
    chains = ring(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, held_check, group = None, None, None, None
        for batch in batches:
            r, key, b, probe, fp, check = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            if not len(r):
                continue
            cut = np.flatnonzero((r[1:] != r[:-1]) | (key[1:] != key[:-1]) | (b[1:] != b[:-1])) + 1
            starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(r)]))
            fp, check = fp.view(np.uint64), check.view(np.uint64)
            found = []
            # a group of one row inside a batch has nothing to compare
            worth = (stops - starts > 1) | (starts == 0) | (stops == len(r))
            for start, stop in zip(starts[worth].tolist(), stops[worth].tolist(), strict=True):
                name = (r[start], key[start], b[start])
                if name != now:
                    now, held, held_check, group = name, fp[:0], check[:0], np.zeros(0, np.int64)
                own = slice(start, start + int(np.count_nonzero(~probe[start:stop])))
                if own.stop > own.start:  # held ones come first, at most `block` of them, maybe in several batches
                    held, held_check = np.concatenate((held, fp[own])), np.concatenate((held_check, check[own]))
                    group = np.concatenate((group, len(group) + np.arange(own.stop - own.start)))
                if len(held):
                    found += _links_of_block(held, held_check, fp[start:stop], check[start:stop], chains[now[0]], max_bits, max_total, group)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(column, np.uint64).view(np.int64)) for column in zip(*found, strict=True)], names=["a", "check_a", "b", "check_b"])

    return dealt.mapInArrow(run, "a bigint, check_a bigint, b bigint, check_b bigint").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of `links` (u, v) but the roots; a root is the smallest node of its component."""
    edges = stored(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.join(least, "u").filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, seeds: tuple[int, ...] = (42,), max_total: int = 0
) -> DataFrame:
    """(id, fingerprint, component_id) of every row: 16 hex digits, and the smallest id of all that links reach.

    With two seeds, linked fingerprints must also differ in at most `max_total` bits of both together.
    """
    rows = stored(fingerprints(docs, id_col, text_col, words, seeds), "fingerprints")
    prints = stored(rows.groupBy("fp", "check").agg(F.min("id").alias("least")).withColumn("node", F.xxhash64("fp", "check")), "distinct-fingerprints")
    links = link_fingerprints(prints.select("fp", "check"), max_bits, max_total)
    roots = components(links.select(F.xxhash64("a", "check_a").alias("u"), F.xxhash64("b", "check_b").alias("v")))
    rooted = stored(
        prints.join(roots, "node", "left").select("fp", "check", "least", F.coalesce("root", "node").alias("root")), "rooted")
    named = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    names = stored(rooted.join(named, "root").select("fp", "check", "component_id"), "names")
    return rows.join(names, ["fp", "check"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
