"""Language-model scoring with a backoff automaton whose weights are Spark tables.

Smoothed n-grams are states. A state has an arc for each word that follows it
at least `least` times, and a failure arc whose weight is the mass left for all
other words; the start state has additive-smoothed word probabilities. `least`
is a fixed count, so a text's model does not change with the corpus around it.

A token is reached from its longest kept history by failure arcs and one arc.
Every failure passed and every arc taken belongs to an n-gram that ends in the
text, so the log-probability of a text is a sum over its n-grams, of one number
per kept n-gram: what its arc has more than failing and taking the arc one
order below, plus its own failure weight. N-grams that are not kept add zero.

Counts and weights of all words and all kept n-grams stay in Spark and grow with
the corpus. Texts are cut into words once, as blocks of word numbers. N-grams are
dealt out by hash to buckets of bounded size, as packed arrays of each block; a
bucket counts, or adds up weights per text. This and the joins go in rounds, each
over its share of all hashes, so that shuffles take a part of the disk: those of a
round end with it, and tables go when the next ones are written. Only a copy
of the weights of what has `share` of all tokens is broadcast, at most 1 / share
per order: those are added up at once, all others by bucket, with the same result.

A word is known by its 64-bit hash, an n-gram by that of its two parts. Ends of texts are a token of their own.

Defined results: null text is empty, with the end as its only token. Rows that
repeat an id are trained on and scored each. Without training texts every
token has probability one (one type, V = 0).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from siftlog.llm.bpe import pack, unpack
from siftlog.llm.words import filled, slices, word_table
from siftlog.session import shared_dir
from siftlog.sources import commits

ORDER = 3
#: N-grams counted so often are kept, at every size of the corpus.
LEAST = 2
#: Share of all tokens from which a weight is also broadcast.
SHARE = 4e-6
DISCOUNT = 0.75
ADDED = 0.1
SLICE_BYTES = 8 << 20
#: Buckets: at least so many, and one for so many tokens.
BUCKETS, BUCKET_TOKENS = 64, 2_000_000
#: Shares of all hashes that are worked on one after another: 2 to these powers, in counting and scoring, and in joins.
SHARE_BITS, JOIN_BITS = 2, 1
#: Spark removes the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def word_hash(word: str) -> int:
    """Signed 64-bit hash of a word."""
    value = xxhash.xxh64_intdigest(word.encode())
    return value - (1 << 64) if value >> 63 else value


#: The end of a text: no word holds white space.
END = word_hash("\n")


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each token in the list of distinct ones, where texts begin (with their ends), and the distinct hashes; the end is the last."""
    codes, begins, words = word_table(texts, lower=True)
    hashes = np.fromiter(map(word_hash, words), np.int64, len(words))
    n = len(begins) - 1
    out = np.full(len(codes) + n, len(words), np.int64)
    starts = begins + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[starts[1:] - 1] = False
    out[keep] = codes
    return out, starts, np.append(hashes, END)


def saved(parts: Iterable[DataFrame], path: str) -> DataFrame:
    """Write the parts below `path` one after another, each without leaving shuffle files, and read all that is there."""
    for part in parts:
        spark, before = part.sparkSession, part.sparkSession.conf.get(CLEANUP)
        spark.conf.set(CLEANUP, "true")
        try:
            part.write.mode("append").parquet(path)
        finally:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(part.schema).parquet(path)


def make_blocks(docs: DataFrame) -> DataFrame:
    """One row per slice of `docs` (id, txt): number of its first text, ids, tokens of each text, their numbers, and the hashes these stand for."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = filled(batch.column(1))
            for start, stop in slices(column, SLICE_BYTES):
                tokens, starts, hashes = token_hashes(column.slice(start, stop - start))
                yield pa.RecordBatch.from_arrays([
                    pa.array([row], pa.int64()), pa.array([batch.column(0).slice(start, stop - start).to_pylist()], pa.list_(batch.column(0).type)),
                    pa.array([pack(np.diff(starts), "<u4")]), pa.array([pack(tokens, "<u4")]), pa.array([hashes.astype("<i8").tobytes()])], names=["row", "ids", "sizes", "numbers", "hashes"])
                row += stop - start
                pa.default_memory_pool().release_unused()

    return docs.select("id", "txt").mapInArrow(run, f"row bigint, ids array<{kind}>, sizes binary, numbers binary, hashes binary")


def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Number of the first text, ids, numbers of all tokens, where texts begin, and hashes, of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            row, ids, sizes, numbers, hashes = (column[k] for column in batch.columns)
            starts = np.concatenate(([0], np.cumsum(unpack(sizes.as_py(), "<u4").astype(np.int64))))
            yield row.as_py(), ids.values, unpack(numbers.as_py(), "<u4"), starts, np.frombuffer(hashes.as_py(), "<i8")


def count_words(blocks: DataFrame) -> DataFrame:
    """(h, n): counts of all tokens, combined per block before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, tokens, _, hashes in read_blocks(batches):
            n = np.bincount(tokens, minlength=len(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[n > 0]), pa.array(n[n > 0].astype(np.int64))], names=["h", "n"])

    return blocks.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of an n-gram, of those of it without its last and without its first word."""
    h = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (second.view(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(32)).view(np.int64)


def grams(words: np.ndarray, starts: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order from 2 on: place of the last word, hash, and hashes of both parts, of each n-gram within a text."""
    at = np.arange(len(words)) - np.repeat(starts[:-1], np.diff(starts))
    level = words
    for k in range(1, order):
        last = np.flatnonzero(at >= k)
        first, second = level[last - 1], level[last]
        h = joined(first, second)
        yield last, h, first, second
        level = level.copy()
        level[last] = h


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h.view(np.uint64) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def bucket_column(h: str, buckets: int) -> Column:
    return (F.shiftrightunsigned(h, 40) % buckets).cast("int")


def turn_of(h: np.ndarray) -> np.ndarray:
    """The round in which a hash is counted or scored: its first bits."""
    return np.ascontiguousarray(h, "<i8").view(np.uint8)[7::8] >> np.uint8(8 - SHARE_BITS)


def turn_column(h: str, bits: int = SHARE_BITS) -> Column:
    return F.shiftrightunsigned(h, 64 - bits)


def packed(b: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """The columns' bytes of each bucket."""
    order = np.argsort(b, kind="stable")
    names, begins = np.unique(b[order], return_index=True)
    columns = [c[order] for c in columns]
    for name, start, stop in zip(names.tolist(), begins.tolist(), np.append(begins[1:], len(b))[: len(begins)].tolist(), strict=True):
        yield name, [c[start:stop].tobytes() for c in columns]


def unpacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def count_grams(blocks: DataFrame, order: int, buckets: int, least: int, turn: int) -> DataFrame:
    """(k, h, first, second, n): the n-grams of orders k from 2 on of a round that all texts hold at least `least` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, tokens, starts, hashes in read_blocks(batches):
            for k, (_, h, first, second) in enumerate(grams(hashes[tokens], starts, order), 2):
                now = np.flatnonzero(turn_of(h) == turn)
                h, one, n = np.unique(h[now], return_index=True, return_counts=True)
                one = now[one]
                rows = [(k, name, *parts) for name, parts in packed(bucket_of(h, buckets), first[one], second[one], n.astype("<i4"))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["k", "b", "first", "second", "n"])

    def count(group: pa.Table) -> pa.Table:
        first, second, n = unpacked(group["first"], "<i8"), unpacked(group["second"], "<i8"), unpacked(group["n"], "<i4")
        h = joined(first, second)
        order = np.argsort(h, kind="stable")
        begins = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        total = np.add.reduceat(n[order].astype(np.int64), begins)
        kept = total >= least
        one = order[begins[kept]]
        return pa.table({"k": pa.array(np.full(len(one), group["k"][0].as_py(), np.int32)), "h": h[one], "first": first[one], "second": second[one], "n": total[kept]})

    parts = blocks.mapInArrow(run, "k int, b int, first binary, second binary, n binary")
    return parts.groupBy("k", "b").applyInArrow(count, "k int, h bigint, first bigint, second bigint, n bigint")


@dataclass
class Automaton:
    """What the weights of all n-grams share, and those of the frequent ones, sorted by hash."""

    tokens: int
    types: int
    order: int
    buckets: int
    words: tuple[np.ndarray, np.ndarray, np.ndarray]  # hash, log10 probability, weight
    grams: tuple[np.ndarray, np.ndarray]  # hash, weight

    def word_probability(self, count):
        return (count + ADDED) / (self.tokens + ADDED * (self.types + 1))


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def train(texts: DataFrame, order: int = ORDER, share: float = SHARE, least: int = LEAST) -> tuple[DataFrame, Automaton]:
    """(h, n, base, weight) of all words and kept n-grams, with `base` null for the latter, and what all tasks need."""
    spark, turns = texts.sparkSession, range(1 << JOIN_BITS)
    paths = {name: shared_dir(spark, f"llm-{name}") for name in ("blocks", "words", "grams", "weights")}
    blocks = saved([make_blocks(texts.select(F.lit(None).cast("int").alias("id"), F.col(texts.columns[0]).alias("txt")))], paths["blocks"])
    words = saved([count_words(blocks)], paths["words"])
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    automaton = Automaton(total["n"], total["v"], order, max(BUCKETS, total["n"] // BUCKET_TOKENS), None, None)
    chance = automaton.word_probability(F.col("n"))
    # `part`: probability after the longest history; `gain`: its log10 less that of failing and taking the arc one order below
    level, held = words.select("h", "n", chance.alias("part"), F.log10(chance).alias("gain")), paths["words"]
    base = F.log10("part")
    counted = saved([count_grams(blocks, order, automaton.buckets, least, t) for t in range(1 << SHARE_BITS)], paths["grams"]) if order > 1 else None
    commits.remove(spark, paths["blocks"])
    mine = lambda frame, h, t: frame.filter(turn_column(h, JOIN_BITS) == t)
    for k in range(2, order + 1):
        new = {name: shared_dir(spark, f"llm-{name}") for name in ("arcs", "states", "level")}
        own = counted.filter(F.col("k") == k).select("h", "first", "second", "n")
        below = level.select(F.col("h").alias("second"), F.col("part").alias("lower"))
        arcs = saved([mine(own, "second", t).join(mine(below, "second", t), "second").select("h", "first", "n", "lower") for t in turns], new["arcs"])
        sums = arcs.groupBy(F.col("first").alias("h")).agg(F.sum("n").alias("after"), F.count(F.lit(1)).alias("kinds"), F.sum("lower").alias("covered"))
        left = 1 - (F.col("after") - DISCOUNT * F.col("kinds")) / F.col("n")
        fail = F.log10(F.greatest(left, F.lit(1e-12)) / F.greatest(1 - F.col("covered"), F.lit(1e-12)))
        states = saved([mine(sums, "h", t).join(mine(level, "h", t), "h").select("h", F.col("n").alias("times"), fail.alias("fail")) for t in turns], new["states"])
        gained = (F.col("gain") + F.coalesce("fail", F.lit(0.0))).alias("weight")
        saved([mine(level, "h", t).join(mine(states, "h", t), "h", "left").select("h", "n", base.alias("base"), gained) for t in turns], paths["weights"])
        commits.remove(spark, held)
        part = (F.col("n") - DISCOUNT) / F.col("times")
        origin = states.withColumnRenamed("h", "first")
        level, held = saved([
            mine(arcs, "first", t).join(mine(origin, "first", t), "first")
            .select("h", "n", part.alias("part"), (F.log10(part) - F.log10("lower") - F.col("fail")).alias("gain")) for t in turns], new["level"]), new["level"]
        for done in (new["arcs"], new["states"], *([paths["grams"]] if k == order else [])):
            commits.remove(spark, done)
        base = F.lit(None).cast("double")
    table = saved([level.select("h", "n", base.alias("base"), F.col("gain").alias("weight"))], paths["weights"])
    commits.remove(spark, held)
    common = table.filter(F.col("n") >= _frequent(automaton, share)).toArrow().sort_by("h")
    h, first, weight = (common[c].to_numpy() for c in ("h", "base", "weight"))
    word = ~np.isnan(first.astype(np.float64))
    automaton.words, automaton.grams = (h[word], first[word], weight[word]), (h[~word], weight[~word])
    return table.withColumn("frequent", F.col("n") >= _frequent(automaton, share)), automaton


def _frequent(automaton: Automaton, share: float) -> int:
    return max(2, int(np.ceil(share * automaton.tokens)))


def score_texts(docs: DataFrame, table: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row; scores are log10 probabilities."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    kind = docs.schema[id_col].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What frequent words and n-grams give each text."""
        known = shared.value
        for row, ids, tokens, starts, hashes in read_blocks(batches):
            sums = lambda values, at=starts[:-1]: np.add.reduceat(values, at)
            place = find(known.words[0], hashes)[tokens]
            frequent = place >= 0
            base, score = (np.where(frequent, c[place], 0.0) if len(c) else np.zeros(len(tokens)) for c in known.words[1:])
            for last, gram, _, _ in grams(hashes[tokens], starts, known.order):
                place = find(known.grams[0], gram)
                hit = place >= 0
                score[last[hit]] += known.grams[1][place[hit]]
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(row + np.arange(len(ids))), pa.array(np.diff(starts)), pa.array(sums(frequent.astype(np.int64))), pa.array(sums(base)), pa.array(sums(score))], names=names)

    def ask(turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other words and n-grams of a round, with their texts."""
        known = shared.value
        for row, ids, tokens, starts, hashes in read_blocks(batches):
            text = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(starts))
            rare = (find(known.words[0], hashes) < 0) & (turn_of(hashes) == turn)
            now = rare[tokens]
            h, where = [hashes[tokens[now]]], [text[now]]
            for last, gram, _, _ in grams(hashes[tokens], starts, known.order):
                now = np.flatnonzero(turn_of(gram) == turn)
                now = now[find(known.grams[0], gram[now]) < 0]
                h.append(gram[now])
                where.append(text[last[now]])
            h, where = np.concatenate(h), np.concatenate(where)
            asked = [(b, row, *parts) for b, parts in packed(bucket_of(h, known.buckets), h, where)]
            if asked:
                columns = [pa.array(c, t) for c, t in zip(zip(*asked, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["b", "slice", "h", "text"])

    def add_up(asked: pa.Table, weights: pa.Table) -> pa.Table:
        """Per row what the bucket's n-grams weigh."""
        weights = weights.sort_by("h")
        keys, base, weight = (weights[c].to_numpy() for c in ("h", "base", "weight"))
        h = unpacked(asked["h"], "<i8")
        rows = np.repeat(asked["slice"].to_numpy(), np.array([len(t) // 4 for t in asked["text"].to_pylist()], np.int64)) + unpacked(asked["text"], "<i4")
        place = find(keys, h)
        hit = place >= 0
        place, (row, at) = place[hit], np.unique(rows[hit], return_inverse=True)
        base = base.astype(np.float64)[place]
        return pa.table({
            "row": row, "base": np.bincount(at, np.nan_to_num(base), len(row)).astype(np.float64), "weight": np.bincount(at, weight[place], len(row)).astype(np.float64),
            "known": np.bincount(at, ~np.isnan(base), len(row)).astype(np.int64)})

    names = ["id", "row", "n_tokens", "n_frequent", "base", "walked"]
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "llm-blocks")
    blocks = saved([make_blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt")))], path)
    walked = saved([blocks.mapInArrow(walk, f"id {kind}, row bigint, n_tokens bigint, n_frequent bigint, base double, walked double")], shared_dir(spark, "llm-walked"))
    rare = table.filter(~F.col("frequent")).select(bucket_column("h", automaton.buckets).alias("b"), turn_column("h").alias("turn"), "h", "base", "weight")

    def found_in(turn: int) -> DataFrame:
        asked = blocks.mapInArrow(partial(ask, turn), "b int, slice bigint, h binary, text binary")
        found = asked.groupBy("b").cogroup(rare.filter(F.col("turn") == turn).drop("turn").groupBy("b")).applyInArrow(add_up, "row bigint, base double, weight double, known bigint")
        return found.groupBy("row").agg(*[F.sum(c).alias(f"rare_{c}") for c in ("base", "weight", "known")])

    sums = ("rare_base", "rare_weight", "rare_known")
    found = saved([found_in(t) for t in range(1 << SHARE_BITS)], shared_dir(spark, "llm-found")).groupBy("row").agg(*[F.sum(c).alias(c) for c in sums])
    commits.remove(spark, path)
    n_known = F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))
    unseen = (F.col("n_tokens") - n_known) * F.lit(float(np.log10(automaton.word_probability(0))))
    return walked.join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_tokens", n_known.alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + unseen).alias("base_score"),
        (F.col("walked") + F.coalesce("rare_weight", F.lit(0.0)) + unseen).alias("score"))
