"""Byte-level BPE by a global shuffle of distinct words.

Texts are split into pre-tokens. A block of texts keeps its distinct
pre-tokens once, and every pre-token of a text as a number of that list; this
is the explosion with positions, packed. The blocks' distinct pre-tokens are
shuffled by word bucket, so that each distinct one of the corpus meets in one
task and is encoded once there; the ids go back to the blocks, and the texts
are put together by position. Decoding joins the table of token bytes, which
the rank file bounds.

Scale: a pre-token has one entry per block however often it occurs, so no
word is hot. A block holds at most `block_bytes` of text, or one longer text.
Blocks are written bucketed by block, and the join with the ids shuffles the
ids only. Texts are never shuffled.

Defined results: null text is empty and has no ids. Rows that repeat an id are
encoded each. Ids that the table lacks are an error when decoding.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from siftlog.llm.words import chunk_table, filled, ragged, slices
from siftlog.session import shared_dir

BLOCK_BYTES = 8 << 20
#: Text of a block that is split at once; its pre-tokens are numbered for the whole block.
PART_BYTES = 2 << 20
BUCKETS = 256
LATIN_END = "ɐ"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: one base64 token and its id per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pack(values: np.ndarray, kind: str) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T)
    return zstandard.compress(planes.tobytes(), 3)


def unpack(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), "<u4", len(words))
    return zstandard.compress(len(words).to_bytes(4, "little") + lengths.tobytes() + b"".join(words), 3)


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = (np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1]], ends, strict=True)] if n else []


def split_piece(text: str, pattern) -> list[str]:
    """Pre-tokens of a piece; words of Latin letters, alone or before a stop or comma, need no pattern."""
    word = text[1:] if text[:1] == " " else text
    if word and max(text) < LATIN_END:
        if word.isalpha():
            return [text]
        if word[-1] in ".," and word[:-1].isalpha():
            return [text[:-1], text[-1]]
    return pattern.findall(text)


def number_words(texts: pa.Array, pattern, known: dict[str, int], split: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pre-tokens of the texts in `known`, and how many each text has; `known` and `split`, the numbers of each piece, are added to."""
    codes, begins, pieces = chunk_table(texts, pattern)
    for piece in pieces:
        if piece not in split:
            split[piece] = [known.setdefault(t, len(known)) for t in split_piece(piece, pattern)]
    parts = [split[piece] for piece in pieces]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.fromiter((c for part in parts for c in part), np.uint32, int(sizes.sum()))
    numbers = ragged(flat, (np.cumsum(sizes) - sizes)[codes], sizes[codes])
    return numbers, np.diff(np.concatenate(([0], np.cumsum(sizes[codes])))[begins])


def make_blocks(docs: DataFrame, pattern: str, id_col: str, text_col: str, block_bytes: int, buckets: int) -> DataFrame:
    """One row per block: its ids, pre-tokens per text, their numbers, the bucket of each number, and the words of each bucket."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, block = regex.compile(pattern), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = filled(batch.column(1))
            for start, stop in slices(texts, block_bytes):
                known: dict[str, int] = {}
                split: dict[str, list[int]] = {}
                cut = [number_words(texts.slice(start + a, b - a), match, known, split) for a, b in slices(texts.slice(start, stop - start), PART_BYTES)]
                numbers, per_text = (np.concatenate(c) for c in zip(*cut, strict=True))
                del cut, split
                words = [w.encode() for w in known]
                count = np.bincount(numbers, minlength=len(words))
                rank = np.argsort(-count, kind="stable")  # frequent words get small numbers, which pack well
                place = np.empty(len(rank), np.uint32)
                place[rank] = np.arange(len(rank), dtype=np.uint32)
                bucket = np.fromiter((xxhash.xxh32_intdigest(words[k]) % buckets for k in rank), np.int64, len(rank))
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                asked = [(b, pack_words([words[rank[k]] for k in order[cuts[b] : cuts[b + 1]]])) for b in range(buckets) if cuts[b] < cuts[b + 1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int64()), pa.array([batch.column(0).slice(start, stop - start).to_pylist()], pa.list_(batch.column(0).type)),
                    pa.array([pack(per_text, "<u4")]), pa.array([pack(place[numbers], "<u4")]), pa.array([pack(bucket, "<u2")]),
                    pa.array([[{"bucket": b, "words": w} for b, w in asked]], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])))],
                    names=["block", "ids", "per_text", "numbers", "buckets", "asked"])
                block += 1
                pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt")).mapInArrow(
        run, f"block bigint, ids array<{kind}>, per_text binary, numbers binary, buckets binary, asked array<struct<bucket:int,words:binary>>")


def encode_words(asked: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(block, bucket, tokens): the ids of each block's words of one bucket. Each distinct word of a bucket is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={}).encode_ordinary
        now, known = None, {}
        for batch in batches:
            out = []
            for bucket, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != now:
                    now, known = bucket, {}
                tokens = []
                for word in unpack_words(words):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
                    tokens.append(ids)
                sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4
                out.append({"sizes": pack(sizes, "<u4"), "flat": pack(np.frombuffer(b"".join(tokens), "<u4"), "<u4")})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.struct([("sizes", pa.binary()), ("flat", pa.binary())]))], names=["block", "bucket", "tokens"])

    ordered = asked.repartition("bucket").sortWithinPartitions("bucket").select("block", "bucket", "words")
    return ordered.mapInArrow(run, "block bigint, bucket int, tokens struct<sizes:binary,flat:binary>")


def reassemble(blocks: DataFrame, kind: str) -> DataFrame:
    """(id, tokens) of every text of blocks joined with `answers`, the ids of their words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                answers = sorted(batch.column(4)[k].as_py() or [], key=lambda a: a["bucket"])
                sizes = np.concatenate([unpack(a["tokens"]["sizes"], "<u4") for a in answers] or [np.zeros(0, "<u4")]).astype(np.int64)
                flat = np.concatenate([unpack(a["tokens"]["flat"], "<u4") for a in answers] or [np.zeros(0, "<u4")])
                order = np.argsort(unpack(batch.column(3)[k].as_py(), "<u2"), kind="stable")
                size, start = np.empty_like(sizes), np.empty_like(sizes)
                size[order], start[order] = sizes, np.cumsum(sizes) - sizes
                numbers = unpack(batch.column(2)[k].as_py(), "<u4")
                per_text = np.concatenate(([0], np.cumsum(unpack(batch.column(1)[k].as_py(), "<u4").astype(np.int64))))
                for a in range(0, len(per_text) - 1, 256):
                    texts = per_text[a : a + 257]
                    part = numbers[texts[0] : texts[-1]]
                    begins = np.concatenate(([0], np.cumsum(size[part])))[texts - texts[0]]
                    tokens = ragged(flat, start[part], size[part]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0)[k].values.slice(a, len(texts) - 1), pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(tokens))], names=["id", "tokens"])
                pa.default_memory_pool().release_unused()

    return blocks.select("ids", "per_text", "numbers", "buckets", "answers").mapInArrow(run, f"id {kind}, tokens array<int>")


def encode_texts(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS
) -> DataFrame:
    """(id, tokens) of every row: the ids of its text by the rank file, each match of `pattern` alone."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = make_blocks(docs, pattern, id_col, text_col, block_bytes, buckets)
    made.write.bucketBy(parts, "block").option("path", shared_dir(spark, "llm-bpe-blocks")).saveAsTable(name)
    blocks = spark.table(name)
    asked = blocks.select("block", F.explode("asked").alias("a")).select("block", "a.bucket", "a.words")
    answers = encode_words(asked, ranks, pattern).groupBy("block").agg(F.collect_list(F.struct("bucket", "tokens")).alias("answers"))
    joined = blocks.drop("asked").join(answers.hint("shuffle_hash"), "block", "left")
    return reassemble(joined, kind).withColumnRenamed("id", id_col)


def decode_tokens(encoded: DataFrame, ranks: str, tokens_col: str = "tokens") -> DataFrame:
    """`encoded` with `decoded`, the bytes of its tokens. A column `decoded` of the input is replaced."""
    columns = [c for c in encoded.columns if c != "decoded"]
    schema = encoded.select(*columns).schema.add("decoded", "binary")
    at = columns.index(tokens_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted((rank, token) for token, rank in read_ranks(ranks).items())
        size, start = np.full(table[-1][0] + 1, -1, np.int64), np.zeros(table[-1][0] + 1, np.int64)
        known = np.array([rank for rank, _ in table])
        size[known] = [len(token) for _, token in table]
        start[known] = np.cumsum(size[known]) - size[known]
        letters = np.frombuffer(b"".join(token for _, token in table), np.uint8)
        for batch in batches:
            lists = batch.column(at)
            for a in range(0, batch.num_rows, 256):
                part = lists.slice(a, 256)
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and (ids.max() >= len(size) or ids.min() < 0 or size[ids].min() < 0):
                    raise ValueError("a token id is not in the table")
                counts = np.array([len(x) if x is not None else 0 for x in part.to_numpy(zero_copy_only=False)], np.int64)
                ends = np.concatenate(([0], np.cumsum(size[ids])))[np.concatenate(([0], np.cumsum(counts)))]
                data = ragged(letters, start[ids], size[ids]).tobytes()
                decoded = [data[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, 256) for c in batch.columns), pa.array(decoded, pa.binary())], names=[*columns, "decoded"])

    return encoded.select(*columns).mapInArrow(run, schema)
