"""Quality rules with n-gram perplexity bands.

A character trigram model with modified Kneser-Ney smoothing is counted by
Spark for each language and kept as sorted arrays of n-gram codes. Each
document gets its perplexity per character; a language's lower and upper band
follow from the quartiles of all its documents, and documents outside a band
are rejected. Counts of words, symbols, repeated lines and repeated word
windows come from the same pass.

Characters are whole code points, but for control characters, which count as
one, and every language has a model and a band of its own, however rare. The
driver holds the distinct trigrams of all languages and broadcasts them, which
is not bounded; texts, scores and quartiles stay in Spark.

Defined results: null text is empty and has no words; it fails the base
rules, its perplexity is null. Rows of null language share a model and a band.
Repeated rows are rated alike. A struct column `quality` of the input is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from siftlog.llm.common import SPACES, stored
from siftlog.llm.words import filled, slices

#: Three code points fit a signed 64-bit code.
CLASSES = 1 << 21
#: Class of control characters, and of what stands before a text.
CONTROL = 95
#: The symbols counted as such.
SYMBOLS = b"#*$%&|<>"
#: How far the bands lie from the median of log perplexity: in quartile distances, and at least so much;
#: and how much further for a text of n characters, times 1 / sqrt(n), as the mean of few characters scatters more.
BAND_WIDTH, LEAST_BAND, SHORT_TEXT = 6.0, 0.12, 1.5
#: Quartiles of log perplexity are found to this step.
STEP = 1e-4
SLICE_BYTES = 2 << 20

RATING = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()),
    T.StructField("n_scored", T.LongType()), T.StructField("log_perplexity", T.DoubleType()),
])


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, lines equal to an earlier one, words in repeated three-word windows."""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    repeated = 0
    if len(words) >= 3:
        _, pair = np.unique(codes[:-1] * len(known) + codes[1:], return_inverse=True)
        _, window, count = np.unique(pair[:-1] * len(known) + codes[2:], return_inverse=True, return_counts=True)
        again = count[window] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        repeated = int(covered.sum())
    return (
        len(words), len(text) - (len(raw) - len(raw.translate(None, SPACES.encode()))),
        len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated,
    )


def char_classes(text: str) -> np.ndarray:
    """Control characters together, printable ASCII from zero on, the rest by code point."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < 127, np.where(points < 32, CONTROL, points - 32), points)


def trigram_codes(text: str) -> np.ndarray:
    """One code per character, with two line breaks before the text."""
    c = np.concatenate(([CONTROL, CONTROL], char_classes(text)))
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def count_trigrams(docs: DataFrame, text_col: str, lang: F.Column) -> DataFrame:
    """(lang, code, n): trigrams of all texts, one partial row per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = filled(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            for start, stop in slices(texts, SLICE_BYTES):
                own: dict[str, list[np.ndarray]] = {}
                for text, name in zip(texts.slice(start, stop - start).to_pylist(), langs[start:stop], strict=True):
                    if text:
                        own.setdefault(name, []).append(trigram_codes(text))
                for name, codes in own.items():
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    parts = docs.select(lang.alias("lang"), F.col(text_col).alias("txt")).mapInArrow(run, "lang string, code bigint, n bigint")
    return parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more."""
    n = [int(np.count_nonzero(counts == k)) for k in range(1, 5)]
    if min(n[:3]) == 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.array([0.0] + [min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)])


class KneserNey:
    """Sorted code arrays of one language: trigrams, their contexts, bigrams, their contexts; and unigrams."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        order = np.argsort(code)
        self.tri, n = code[order].astype(np.int64), n[order].astype(np.float64)
        low, first = self.tri % CLASSES**2, self.tri // CLASSES
        self.bi, bi_n = np.unique(low, return_counts=True)  # continuation counts: characters seen before the pair
        self.uni, uni_n = np.unique(self.bi % CLASSES, return_counts=True)
        part, left = self._mix(uni_n.astype(np.float64), np.full(len(uni_n), float(uni_n.sum())), np.zeros(len(uni_n), np.int64), 1)
        self.p0 = left[0] / CLASSES
        self.p1 = part + self.p0
        context2, at2 = np.unique(self.bi // CLASSES, return_inverse=True)
        total2 = np.bincount(at2, weights=bi_n)
        part, self.gamma2 = self._mix(bi_n.astype(np.float64), total2[at2], at2, len(context2))
        self.context2 = context2
        self.p2 = part + self.gamma2[at2] * self.lowest(self.bi % CLASSES)
        self.context3, at3 = np.unique(first, return_inverse=True)
        total3 = np.bincount(at3, weights=n)
        part, self.gamma3 = self._mix(n, total3[at3], at3, len(self.context3))
        self.p3 = part + self.gamma3[at3] * self.lower(low)

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> KneserNey:
        model = cls.__new__(cls)
        vars(model).update(arrays)
        return model

    @staticmethod
    def _mix(n: np.ndarray, total: np.ndarray, at: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
        """Discounted probabilities, and what each context leaves to the lower order."""
        d = discounts(n)[np.minimum(n, 3).astype(np.int64)]
        part = np.where(total > 0, np.maximum(n - d, 0) / np.maximum(total, 1), 0.0)
        return part, 1 - np.bincount(at, weights=part, minlength=contexts)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def lowest(self, one: np.ndarray) -> np.ndarray:
        at, known = self._find(self.uni, one)
        return np.where(known, self.p1[at], self.p0)

    def lower(self, pair: np.ndarray) -> np.ndarray:
        at, known = self._find(self.bi, pair)
        above, seen = self._find(self.context2, pair // CLASSES)
        return np.where(known, self.p2[at], np.where(seen, self.gamma2[above], 1.0) * self.lowest(pair % CLASSES))

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        at, known = self._find(self.tri, code)
        above, seen = self._find(self.context3, code // CLASSES)
        return np.log(np.where(known, self.p3[at], np.where(seen, self.gamma3[above], 1.0) * self.lower(code % CLASSES**2)))


def fit(docs: DataFrame, text_col: str, lang: F.Column) -> dict[str, KneserNey]:
    """One model per language; the driver holds all distinct trigrams."""
    table = count_trigrams(docs, text_col, lang).toPandas()
    return {name: KneserNey(part["code"].to_numpy(), part["n"].to_numpy()) for name, part in table.groupby("lang")}


def languages(docs: DataFrame, lang_col: str) -> F.Column:
    """The language of a row behind a mark, which no language equals that rows of null language have."""
    if lang_col not in docs.columns:
        return F.lit("none")
    return F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("none"))


def rate_documents(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None,
    min_words: int = 50, max_repeat_percent: int = 50, band_width: float = BAND_WIDTH,
) -> DataFrame:
    """`docs` (or its columns `keep`) with a struct `quality`: the counts, log_perplexity, base_failed and kept."""
    lang = languages(docs, lang_col)
    models = docs.sparkSession.sparkContext.broadcast({name: vars(model) for name, model in fit(docs, text_col, lang).items()})

    @F.pandas_udf(RATING)
    def rating(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        ready = {name: KneserNey.of(arrays) for name, arrays in models.value.items()}
        for text, name in zip(texts, langs, strict=True):
            text = text or ""
            model, codes, score = ready.get(name), (), None
            if text and model is not None:
                codes = trigram_codes(text)
                score = -float(_scored(codes, model)) / len(codes)
            rows.append((*text_counts(text), len(codes), score))
        return pd.DataFrame(rows, columns=RATING.names)

    columns = [c for c in (keep or docs.columns) if c != "quality"]
    rated = stored(docs.select(F.struct(*columns).alias("doc"), lang.alias("lang"), rating(F.col(text_col), lang).alias("quality")), "rated")
    limits = stored(bands(rated.select("lang", F.col("quality.log_perplexity").alias("score")), band_width), "bands")
    score = F.col("quality.log_perplexity")
    short = F.lit(SHORT_TEXT) / F.sqrt(F.greatest("quality.n_scored", F.lit(1)))
    inside = score.between(F.col("low") - short, F.col("high") + short)
    n, repeated = F.col("quality.n_words"), F.col("quality.n_repeat_words")
    failed = (n < min_words) | (100 * repeated > max_repeat_percent * n)
    verdict = F.struct("quality.*", failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(True))).alias("kept"))
    return rated.join(limits, "lang", "left").select("doc.*", verdict.alias("quality"))


def bands(scores: DataFrame, band_width: float = BAND_WIDTH) -> DataFrame:
    """(lang, low, high) from (lang, score): the median less and plus `band_width` distances to the quartiles.

    Scores are counted in steps of STEP, so a language has a bounded number of
    counts, whose running sums name the quartiles. Sums of counts do not depend
    on the order of rows or partitions, so every run gives the same bands.
    """
    steps = scores.filter("score is not null").groupBy("lang", F.round(F.col("score") / STEP).cast("long").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("lang")
    ranked = steps.withColumn("upto", F.sum("n").over(own.orderBy("step"))).withColumn("all", F.sum("n").over(own))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("step"))) * STEP
    found = ranked.groupBy("lang").agg(quartile(1).alias("q1"), quartile(2).alias("q2"), quartile(3).alias("q3"))
    distance = lambda far, near: F.greatest(F.lit(band_width) * (F.col(far) - F.col(near)), F.lit(LEAST_BAND))
    return found.select("lang", (F.col("q2") - distance("q2", "q1")).alias("low"), (F.col("q2") + distance("q3", "q2")).alias("high"))


def _scored(codes: np.ndarray, model: KneserNey) -> float:
    distinct, n = np.unique(codes, return_counts=True)
    return model.log_probability(distinct) @ n
