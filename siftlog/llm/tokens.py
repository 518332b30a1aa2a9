"""Token ids as binary files with a shared zstandard dictionary.

Documents are sorted by id over range partitions. Each partition encodes its
texts, closes each document with the end id, compresses each document's ids
alone with the shared dictionary and appends the frame to a file of its own.
The index, a Parquet table written by Spark, has file, offset, length and
counts of every document, so one document is read with one range read. A data
file starts with a magic, the hash of the dictionary and the width of an id.

A task that is run again writes a file of another name, and only the rows
of the attempt that Spark commits name its file; nothing else is ever read.
The dictionary is learned from the id arrays of at most `sample` documents of
at most `sample_bytes` bytes, those of lowest id hash; it changes sizes only.

The tokenizer splits a text at each single space and encodes each distinct
piece of a slice once, with the same result as the whole text: byte-level
pre-tokens never cross those places. Texts that hold the content of an added
token, which the library matches first, and other tokenizers encode whole texts.

Defined results: null text is empty and has only the end id. Rows of null id
come first; rows that repeat an id follow each other by the hash of their text.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from siftlog.llm.common import once_per_process
from siftlog.llm.words import chunk_table, filled, ragged, slices

MAGIC = b"TOKZ0001"
HEADER = "<8s32sB"
HEADER_BYTES = struct.calcsize(HEADER)
DICTIONARY_BYTES = 64 << 10
SLICE_BYTES = 16 << 20
#: Letters before this one are letters in every version of Unicode's tables.
LATIN_END = "\u0250"
#: Fixed value: the pattern that byte-level tokenizers split a text with.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next one from 256 on."""
    letters, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return "".join(letters)


class Encoder:
    """Ids of texts by a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        setup = json.loads(self.tokenizer.to_str())
        before = setup.get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not setup.get("normalizer")
        self.added = [t["content"] for t in setup.get("added_tokens") or [] if t["content"]]
        self.pattern, self.letters, self.known = regex.compile(BYTE_LEVEL), byte_letters(), {}

    def pre_token(self, text: str) -> bytes:
        """Ids of one pre-token, four bytes each."""
        ids = self.known.get(text)
        if ids is None:
            if len(self.known) > 400_000:  # bounded: rare pre-tokens seldom come back
                self.known.clear()
            tokens = self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(self.letters))
            ids = self.known[text] = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return ids

    def piece(self, text: str) -> bytes:
        ids = self.known.get(text)
        if ids is not None:
            return ids
        word = text[1:] if text[0] == " " else text
        if max(text) < LATIN_END:
            if word.isalpha():
                return self.pre_token(text)
            if word[-1:] in (".", ",") and word[:-1].isalpha():
                return self.pre_token(text[:-1]) + self.pre_token(text[-1])
        return b"".join([self.pre_token(t) for t in self.pattern.findall(text)])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, slice by slice."""
        texts = filled(texts)
        for start, stop in slices(texts, SLICE_BYTES):
            part = texts.slice(start, stop - start)
            if not self.by_piece:
                for t in part.to_pylist():
                    yield self.whole(t)
                continue
            cut = np.zeros(len(part), bool)
            for content in self.added:
                cut |= pc.match_substring(part, content).to_numpy(zero_copy_only=False)
            if cut.any():
                texts_cut = {k: part[k].as_py() for k in np.flatnonzero(cut).tolist()}
                part = pc.if_else(pa.array(cut), "", part)
            codes, begins, pieces = chunk_table(part, self.pattern)
            ids = [self.piece(p) if p else b"" for p in pieces]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            all_ids = ragged(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(lengths) - lengths)[codes], lengths[codes])
            ends = np.concatenate(([0], np.cumsum(lengths[codes])))[begins]
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                yield self.whole(texts_cut[k]) if cut[k] else all_ids[a:b]


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def open_store(root: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(root)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, sample: int, sample_bytes: int) -> bytes:
    """A dictionary of at most 64 KiB from the sample; raw ids where there are too few to train on."""
    chosen = docs.filter(F.octet_length(text_col) <= sample_bytes).select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt")).filter(F.octet_length("txt") <= sample_bytes).join(chosen, "id").select("id", "txt")
    named = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once_per_process(("encoder", tokenizer), lambda: Encoder(tokenizer))
        kind = id_type(encode.size)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.append(ids, end_id).astype(kind).tobytes() for ids in encode(batch.column(1))], pa.binary())], names=["id", "ids"])

    # an id may stand at many rows: the bound holds for rows
    encoded = texts.mapInArrow(run, f"id {named}, ids binary").orderBy(F.xxhash64("id"), "id", F.xxhash64("ids"), "ids").limit(sample)
    samples = sorted(r["ids"] for r in encoded.select("ids").toLocalIterator())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(s) for s in samples]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(map(bytes, samples))[-DICTIONARY_BYTES:]


def dictionary_of(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(
    docs: DataFrame, root: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", sample: int = 1000, sample_bytes: int = 64 << 10
) -> None:
    """Write dictionary, data files and index below `root`, a folder that driver and executors share."""
    dictionary = train_dictionary(docs, tokenizer, end_id, id_col, text_col, sample, sample_bytes)
    digest = hashlib.sha256(dictionary).digest()
    store, top = open_store(root)
    store.create_dir(f"{top}/data", recursive=True)
    with store.open_output_stream(f"{top}/dictionary-{digest.hex()}") as out:
        out.write(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once_per_process(("encoder", tokenizer), lambda: Encoder(tokenizer))
        kind = id_type(encode.size)
        press = zstandard.ZstdCompressor(dict_data=dictionary_of(dictionary), level=3)
        name, part = f"{uuid.uuid4().hex}.bin", TaskContext.get().partitionId()
        store, top = open_store(root)
        out, at, before = None, HEADER_BYTES, 0
        for batch in batches:
            if out is None:
                out = store.open_output_stream(f"{top}/data/{name}")
                out.write(struct.pack(HEADER, MAGIC, digest, kind.itemsize))
            offsets, lengths, counts, starts = [], [], [], []
            for ids in encode(batch.column(1)):
                frame = press.compress(np.append(ids, end_id).astype(kind).tobytes())
                out.write(frame)
                for column, value in ((offsets, at), (lengths, len(frame)), (counts, len(ids) + 1), (starts, before)):
                    column.append(value)
                at, before = at + len(frame), before + len(ids) + 1
            n = len(offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * n, pa.int32()), pa.array([name] * n, pa.string()), *(pa.array(c, pa.int64()) for c in (offsets, lengths, counts, starts))],
                names=["id", "part", "file", "offset", "length", "n_tokens", "start_in_file"])
        if out is not None:
            out.close()

    kind = docs.schema[id_col].dataType.simpleString()
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("txt")).repartitionByRange(F.col("id"), F.xxhash64("txt")).sortWithinPartitions("id", F.xxhash64("txt"))
    ordered.mapInArrow(run, f"id {kind}, part int, file string, offset bigint, length bigint, n_tokens bigint, start_in_file bigint").write.parquet(f"{root}/index")


def read_index(spark, root: str) -> DataFrame:
    """The index with `start`: the ids of all documents before this one."""
    index = spark.read.parquet(f"{root}/index")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return index.join(starts, "part").select("id", "file", "offset", "length", "n_tokens", (F.col("before") + F.col("start_in_file")).alias("start"))


class Reader:
    """Ids of single documents, by file, offset and length."""

    def __init__(self, root: str):
        self.store, self.top = open_store(root)
        self.name, self.file, self.unpress, self.kind = None, None, None, None

    def __call__(self, name: str, offset: int, length: int) -> np.ndarray:
        if name != self.name:
            self.name, self.file = name, self.store.open_input_file(f"{self.top}/data/{name}")
            magic, digest, width = struct.unpack(HEADER, self.file.read_at(HEADER_BYTES, 0))
            with self.store.open_input_file(f"{self.top}/dictionary-{digest.hex()}") as f:
                data = f.read()
            if magic != MAGIC or hashlib.sha256(data).digest() != digest:
                raise ValueError(f"{name} is no token file, or its dictionary was changed")
            self.kind, self.unpress = np.dtype(f"<u{width}"), zstandard.ZstdDecompressor(dict_data=dictionary_of(data))
        return np.frombuffer(self.unpress.decompress(self.file.read_at(length, offset)), self.kind)


def read_tokens(spark, root: str, crc_only: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids, ids_crc32) of every document, read from the files; `ids` is left away with `crc_only`."""
    index = read_index(spark, root)
    kind = index.schema["id"].dataType.simpleString()
    ids_column = "" if crc_only else ", ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(root)
        for batch in batches:
            names = batch.column(1).to_pylist()
            counts, crcs, kept = [], [], []
            for name, offset, length in zip(names, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                ids = read(name, offset, length)
                counts.append(len(ids))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                if not crc_only:
                    kept.append(ids.astype(np.int64))
            more = [] if crc_only else [pa.array(kept, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(5), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), *more],
                names=["id", "start", "n_tokens", "ids_crc32", *([] if crc_only else ["ids"])])

    return index.mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint{ids_column}")


def read_document(spark, root: str, doc_id) -> list[list[int]]:
    """The ids of the rows of one id: one index lookup and one range read each."""
    read = Reader(root)
    rows = spark.read.parquet(f"{root}/index").filter(F.col("id") == doc_id).select("file", "offset", "length").collect()
    return [read(r["file"], r["offset"], r["length"]).tolist() for r in rows]
