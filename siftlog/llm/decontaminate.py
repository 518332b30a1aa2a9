"""Benchmark decontamination by spaced seeds.

Words of items and documents are hashed under fixed masks that look at some
positions of a window and ignore the others, so that a window matches although
ignored words were replaced. Windows of documents that match a window of an
item give alignments (document, item, offset); along each alignment the words
are compared one by one, and the best segment decides: equal words add one,
others subtract two. A document is contaminated by an item when a segment has
at least `min_equal` equal words and `min_score` points.

Scale: the item windows also fill a bit sketch of fixed size (2^20 bits, two
bits per window), a scalar subquery that every task tests its windows against,
so only a sliver of all windows is shuffled. The sketch only saves work: with
more windows than it can tell apart more rows are shuffled, the join is exact.
Join sides are plain exchanges, which adaptive execution splits when a passage
is in a third of all documents. Only the words around an alignment leave a
document.

Defined results: words are runs of letters and digits, lower-cased; null text
has none. Items shorter than the masks (11 words) are no evidence and never
match. Rows that repeat an id are one document; rows with a null id are
compared too. Repeated items are reported once per item id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlog.llm.common import stored, whole_text

#: The masks: windows of eleven words of which seven count.
MASKS = ("11101001011", "11010110011", "10110011101")
SPAN = len(MASKS[0])
SKETCH_WORDS = 1 << 14


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hash(words: str, at: Column, mask: int) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(F.col(words), at + k) for k, bit in enumerate(MASKS[mask]) if bit == "1"])


def sketch_bits(h: Column) -> list[tuple[Column, Column]]:
    """The two bits of a window: place in the sketch, and mask."""
    one = F.lit(1).cast("bigint")
    return [
        (F.shiftrightunsigned(h, 50).cast("int"), F.call_function("shiftleft", one, F.shiftrightunsigned(h, 44).bitwiseAND(F.lit(63)).cast("int"))),
        (h.bitwiseAND(F.lit(SKETCH_WORDS - 1)).cast("int"), F.call_function("shiftleft", one, F.shiftrightunsigned(h, 14).bitwiseAND(F.lit(63)).cast("int"))),
    ]


def item_windows(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Items (item, item_words), and their windows (h, item, at, n_item)."""
    words = stored(items.select(F.col(id_col).alias("item"), word_hashes(whole_text(text_col)).alias("item_words")).distinct(), "items")
    windows = (
        words.filter(F.size("item_words") >= SPAN)
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.size("item_words") - SPAN)))
        .withColumn("h", F.explode(F.array(*[window_hash("item_words", F.col("at"), m) for m in range(len(MASKS))])))
        .select("h", "item", "at", F.size("item_words").alias("n_item"))
    )
    return words, stored(windows, "item-windows")


def sketch_of(windows: DataFrame) -> DataFrame:
    """One row with one array of 2^14 numbers: the bits of all windows."""
    bits = windows.select(F.explode(F.array(*[F.struct(w.alias("w"), b.alias("b")) for w, b in sketch_bits(F.col("h"))])).alias("s")).select("s.w", "s.b")
    blank = windows.sparkSession.range(SKETCH_WORDS).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("bigint").alias("b"))
    rows = bits.unionByName(blank).groupBy("w").agg(F.bit_or("b").alias("b"))
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("sketch"))


def find_overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    min_equal: int = 10, min_score: int = 8,
) -> DataFrame:
    """(id, key1, key2, item, start_word, n_words, n_equal): the best segment of each document row and item that shares one.

    `key1` and `key2` name the row: hashes of its id and text.
    """
    items_words, windows = item_windows(items, item_col, item_text_col)
    sketch = stored(sketch_of(windows), "sketch").scalar()
    text = whole_text(text_col)
    # the words are written once: Spark would otherwise split and hash the texts again for each use of them
    base = stored(
        docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col, 1).alias("key1"), row_key(id_col, text_col, 2).alias("key2"), word_hashes(text).alias("words")),
        "words")
    hashes = F.array(*[window_hash("words", F.col("pos"), m) for m in range(len(MASKS))])
    probed = (
        base.filter(F.size("words") >= SPAN)
        .withColumn("pos", F.explode(F.sequence(F.lit(0), F.size("words") - SPAN)))
        .select("key1", "key2", "pos", F.explode(hashes).alias("h"))
    )
    for place, bit in sketch_bits(F.col("h")):  # no column: rows between operators would each carry the whole sketch
        probed = probed.filter(F.get(sketch, place).bitwiseAND(bit) != 0)
    lines = stored(
        probed.join(windows, "h").select("key1", "key2", "item", "n_item", (F.col("pos") - F.col("at")).alias("offset")).distinct(), "alignments")
    first = F.greatest(F.lit(0), -F.col("offset"))
    length = F.least(F.col("n_item"), F.size("words") - F.col("offset")) - first
    around = base.join(lines, ["key1", "key2"]).select(
        "id", "key1", "key2", "item", "offset", first.alias("first"), length.alias("length"), F.slice("words", F.col("offset") + first + 1, length).alias("part"))
    equal = F.zip_with("part", F.slice("item_words", F.col("first") + 1, F.col("length")), lambda a, b: a == b)
    state = lambda begin, score, n: F.struct(begin.alias("begin"), score.alias("score"), n.alias("n"))
    zero = F.lit(0)
    start = F.struct(
        zero.alias("at"), state(zero, zero, zero).alias("now"),
        F.struct(zero.alias("score"), zero.alias("n"), zero.alias("begin"), zero.alias("stop")).alias("best"))

    def step(acc: Column, same: Column) -> Column:
        now = acc["now"]
        fresh = now["score"] <= 0
        begin, n = F.when(fresh, acc["at"]).otherwise(now["begin"]), F.when(fresh, 0).otherwise(now["n"]) + same.cast("int")
        score = F.when(fresh, 0).otherwise(now["score"]) + F.when(same, 1).otherwise(-2)
        better = F.struct(score.alias("score"), n.alias("n"), begin.alias("begin"), (acc["at"] + 1).alias("stop"))
        return F.struct((acc["at"] + 1).alias("at"), state(begin, score, n).alias("now"), F.when(score > acc["best"]["score"], better).otherwise(acc["best"]).alias("best"))

    best = F.aggregate(equal, start, step, lambda acc: acc["best"])
    return (
        around.join(items_words, "item").withColumn("best", best)
        .filter((F.col("best.n") >= min_equal) & (F.col("best.score") >= min_score))
        .groupBy("key1", "key2", "item")
        .agg(F.first("id").alias("id"), F.max(F.struct(
            "best.score", "best.n", (F.col("offset") + F.col("first") + F.col("best.begin")).alias("start_word"), (F.col("best.stop") - F.col("best.begin")).alias("n_words"))).alias("b"))
        .select("id", "key1", "key2", "item", "b.start_word", "b.n_words", F.col("b.n").alias("n_equal"))
    )


def row_key(id_col: str, text_col: str, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col(id_col), whole_text(text_col))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the rows that overlap an item."""
    found = find_overlaps(docs, items, id_col, text_col, **options)
    gone = stored(found.select(F.col("key1").alias("_gone1"), F.col("key2").alias("_gone2")).distinct(), "contaminated")
    same = (row_key(id_col, text_col, 1) == gone["_gone1"]) & (row_key(id_col, text_col, 2) == gone["_gone2"])
    return docs.join(gone, same, "left_anti")
