"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character
n-grams; a softmax layer on that average gives the label. Training is numpy
stochastic gradient descent over a bounded sample of labelled rows (the
`max_rows` rows of lowest id hash; both the sample and the `buckets` features
a document can have are bounded, so the driver holds a bounded bag of numbers).
All other documents are only scored, in one narrow pass.

With two labels the softmax of an average is the logistic of the average of
one number per bucket, so scoring needs a table of `buckets` numbers.

A text's features are found at once: some 100 bytes of memory per character of
the longest text.

Defined results: null or empty text has no features and gets the score of the
output bias. Labels that are null are not learned; rows that repeat an id are
scored each; of several labels of an id the largest counts. Without any
labelled rows the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlog.llm.words import filled, slices

BUCKETS = 1 << 16
DIMENSIONS = 16
NGRAMS = (2, 3, 4)
MAX_ROWS = 2500
EPOCHS = 6
SLICE_BYTES = 1 << 20

#: Odd multiplier of the rolling hash, its inverse modulo 2^64, and the multiplier that spreads hashes over buckets.
_STEP = 0x5851F42D4C957F2D
_BACK = pow(_STEP, -1, 1 << 64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every word, pair of neighbouring words and character n-gram (code points) of the text, and of its end; one entry per occurrence.

    A pair hashes to the difference of its words, so that all words said twice share a bucket. The end's share shrinks with the length.
    """
    raw = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    up, down = powers(_STEP, n + 1), powers(_BACK, n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * up[:n], dtype=np.uint64)))
    out = []
    for size in NGRAMS:
        if n >= size:
            h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
            out.append((h * _SPREAD + np.uint64(size)) * _SPREAD >> shift)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, stops = edge[::2], edge[1::2]
    h = (sums[stops] - sums[starts]) * down[starts]
    out.append((h * _SPREAD + np.uint64(99)) * _SPREAD >> shift)
    out.append(((h[1:] - h[:-1]) * _SPREAD + np.uint64(98)) * _SPREAD >> shift)
    out.append(np.array([97], np.uint64) * _SPREAD >> shift)
    return np.concatenate(out).astype(np.int64)


def bags(rows: DataFrame, buckets: int) -> DataFrame:
    """(id, label, bucket, n): distinct features of each row of (id, label, txt) and their counts, as packed numbers of four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.unique(features(t, buckets), return_counts=True) for t in filled(batch.column(2)).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([b.astype("<u4").tobytes() for b, _ in got], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in got], pa.binary())],
                names=["id", "label", "bucket", "n"])

    return rows.mapInArrow(run, "id string, label int, bucket binary, n binary")


class Subwords:
    """Embeddings, output layer and their training."""

    def __init__(self, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.vectors = ((draw.random((buckets, dimensions)) - 0.5) / dimensions).astype(np.float32)
        self.weights, self.bias = np.zeros((2, dimensions), np.float32), np.zeros(2, np.float32)

    def train(self, examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.5, seed: int = 2) -> None:
        draw = np.random.default_rng(seed)
        steps, done = max(1, epochs * len(examples)), 0
        for _ in range(epochs):
            for k in draw.permutation(len(examples)):
                bucket, n, label = examples[k]
                speed = np.float32(rate * (1 - done / steps))
                done += 1
                share = (n / max(1, n.sum())).astype(np.float32)
                mean = share @ self.vectors[bucket] if len(bucket) else np.zeros(self.weights.shape[1], np.float32)
                logits = self.weights @ mean + self.bias
                odds = np.exp(logits - logits.max())
                error = odds / odds.sum()
                error[label] -= 1
                down = error @ self.weights
                self.weights -= speed * np.outer(error, mean)
                self.bias -= speed * 0.1 * error
                # as many steps for each feature as it occurs on average: the mean's gradient times the bag's size
                self.vectors[bucket] -= speed * np.minimum(share * len(bucket), 4.0)[:, None] * down[None, :]

    def table(self) -> tuple[np.ndarray, float]:
        """One number per bucket, and the bias: their average plus the bias is the log-odds of label 1."""
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, buckets: int = BUCKETS) -> Subwords:
    """Learn from the labelled rows of lowest id hash, at most `max_rows`. The caller leaves held-out labels away."""
    name = F.col(id_col).cast("string")
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(name.alias("id")).agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    texts = docs.select(name.alias("id"), F.col(text_col).alias("txt")).join(chosen, "id").select("id", "label", "txt")
    # an id may stand at many rows: the bound holds for rows, those of lowest id hash and then of lowest hash of their bag
    found = bags(texts, buckets).withColumn("t", F.xxhash64("bucket", "n")).orderBy(F.xxhash64("id"), "id", "t").limit(max_rows)
    rows = found.toArrow().sort_by([("id", "ascending"), ("t", "ascending")])
    examples = [
        (np.frombuffer(b.as_buffer(), "<u4"), np.frombuffer(n.as_buffer(), "<u4"), label)
        for b, n, label in zip(rows["bucket"], rows["n"], rows["label"].to_pylist(), strict=True)]
    model = Subwords(buckets)
    model.train(examples)
    return model


def score_documents(docs: DataFrame, model: Subwords, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with `score`, the probability of label 1. A column `score` of the input is replaced."""
    table, bias = model.table()
    shared, buckets = docs.sparkSession.sparkContext.broadcast(table), len(table)
    columns = [c for c in (keep or docs.columns) if c != "score"]
    schema = docs.select(*columns).schema.add("score", "double")
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, scores = filled(batch.column(width)), []
            for start, stop in slices(texts, SLICE_BYTES):
                for text in texts.slice(start, stop - start).to_pylist():
                    got = features(text, buckets)
                    scores.append(bias + (shared.value[got].mean() if len(got) else 0.0))
            score = 1 / (1 + np.exp(-np.clip(np.array(scores, np.float64), -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(score, pa.float64())], names=[*columns, "score"])

    return docs.select(*columns, F.col(text_col).alias("_text_to_score")).mapInArrow(run, schema)
