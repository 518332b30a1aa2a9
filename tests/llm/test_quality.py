import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siftlog.llm import quality
from tests.llm.cases import no_documents, odd_documents, some_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def check(docs):
    rows = quality.rate_documents(docs).select("doc_id", "text", F.col("quality").alias("r")).collect()
    for row in rows:
        r = row.r
        counts = plain_counts(row.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)
    return rows


def test_counts_equal_brute_force(spark):
    rows = check(some_documents(spark))
    assert len(rows) == some_documents(spark).count()
    assert len(check(odd_documents(spark))) == odd_documents(spark).count()
    assert quality.rate_documents(no_documents(spark)).count() == 0


def plain_kneser_ney(texts, text):
    """Interpolated modified Kneser-Ney over character classes, from its definition, with plain dictionaries."""
    def grams(t, n):
        c = [95, 95, *quality.char_classes(t).tolist()]
        return [tuple(c[i + 2 - n + 1 : i + 3]) for i in range(len(c) - 2)]

    tri = Counter(g for t in texts if t for g in grams(t, 3))
    bi = Counter(g[1:] for g in tri)
    uni = Counter(g[1] for g in bi)

    def d(counts):
        return quality.discounts(np.array(list(counts.values()), float))

    d3, d2, d1 = d(tri), d(bi), quality.discounts(np.array([uni.get(k, 0) for k in range(quality.CLASSES)], float))

    def mixed(counts, dis, gram, lower):
        follow = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        total = sum(follow.values())
        if not total:
            return lower
        left = sum(min(n, dis[min(n, 3)]) for n in follow.values()) / total
        return max(counts.get(gram, 0) - dis[min(counts.get(gram, 0), 3)], 0) / total + left * lower

    uni = {(k,): n for k, n in uni.items()}
    logs = [math.log(mixed(tri, d3, g, mixed(bi, d2, g[1:], mixed(uni, d1, g[2:], 1 / quality.CLASSES)))) for g in grams(text, 3)]
    return -sum(logs) / len(logs)


def test_perplexity_is_modified_kneser_ney(spark):
    texts = ["banana bandana ananas", "Bond, bond and a ban", "", None, "nab a banana; ¿qué? ##"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = quality.rate_documents(docs).select("text", "quality.log_perplexity").collect()
    for row in rows:
        if row.text:
            assert abs(row.log_perplexity - plain_kneser_ney(texts, row.text)) < 1e-9
        else:
            assert row.log_perplexity is None


def test_model_sums_to_one(spark):
    texts = ["banana bandana ananas", "Bond, bond and a ban", "nab a banana; ¿qué? ##"]
    codes, n = np.unique(np.concatenate([quality.trigram_codes(t) for t in texts]), return_counts=True)
    model = quality.KneserNey(codes, n)
    for a, b in ((0, 0), (95, 95), (66, 65), (77, 1)):
        all_codes = (a * quality.CLASSES + b) * quality.CLASSES + np.arange(quality.CLASSES)
        assert abs(np.exp(model.log_probability(all_codes)).sum() - 1) < 1e-9


def plain_band(scores, width):
    """Quartiles by nearest rank among all scores, rounded to steps."""
    steps = sorted(round(x / quality.STEP) for x in scores)
    q1, q2, q3 = (steps[math.ceil(k * len(steps) / 4) - 1] * quality.STEP for k in (1, 2, 3))
    return q2 - max(width * (q2 - q1), quality.LEAST_BAND), q2 + max(width * (q3 - q2), quality.LEAST_BAND)


def test_verdicts_equal_brute_force(spark):
    docs = some_documents(spark).withColumn("lang", F.when(F.col("doc_id") % 7 != 3, F.col("lang")))
    for width in (quality.BAND_WIDTH, 0.7):
        rows = quality.rate_documents(docs, band_width=width).select("text", "lang", "quality.*").collect()
        again = quality.rate_documents(docs.repartition(5), band_width=width).select("text", "lang", "quality.*").collect()
        assert sorted(rows, key=str) == sorted(again, key=str)
        own = {}
        for r in rows:
            own.setdefault(r.lang, []).append(r)
        rejected = 0
        for of_lang in own.values():
            low, high = plain_band([r.log_perplexity for r in of_lang if r.log_perplexity is not None], width)
            for r in of_lang:
                short = quality.SHORT_TEXT / math.sqrt(len(r.text)) if r.text else 0
                outside = r.log_perplexity is not None and not low - short <= r.log_perplexity <= high + short
                assert r.kept == (not r.base_failed and not outside)
                rejected += outside and not r.base_failed
        assert rejected and len(own) > 2


def test_bands_of_ties_empty_tables_and_clashing_names(spark):
    scores = spark.createDataFrame([("a", 1.0)] * 5 + [("b", 1.0), ("b", 2.0), ("c", None), (None, 3.0)], "lang string, score double")
    got = {r.lang: (r.low, r.high) for r in quality.bands(scores).collect()}
    assert set(got) == {"a", "b", None} and got["a"] == (1 - quality.LEAST_BAND, 1 + quality.LEAST_BAND)
    assert quality.bands(scores.limit(0)).count() == 0
    docs = some_documents(spark).withColumns({c: F.lit(1) for c in ("low", "high", "doc", "_quality_lang")}).withColumn("quality", F.lit("x"))
    out = quality.rate_documents(docs)
    assert out.columns == [*(c for c in docs.columns if c != "quality"), "quality"] and out.filter("low = 1 and doc = 1").count() == docs.count()


def test_bands_reject_noise_and_keep_prose(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.rate_documents(docs, keep=["doc_id"]).withColumnRenamed("quality", "rating").join(labels, "doc_id").filter("not rating.base_failed").collect()
    share = lambda label: np.mean([r.rating.kept for r in rows if r.quality == label])
    assert share(1) > 0.97 and share(0) < share(1) - 0.05


def test_rare_languages_and_other_letters_have_a_model_of_their_own(spark):
    russian, greek = "мама мыла раму, рама мыла маму", "η μαμα εχει μια μηλια και μια ελια"
    moved = "".join(chr(ord(c) + 32 * 64) if ord(c) > 127 else c for c in russian)
    texts = [(f"a plain text number {k}", "en") for k in range(300)] + [(russian, "ru"), (greek, "el"), (moved, "zz"), ("no language here", None), ("nor here", None)]
    docs = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string").repartition(3)
    rows = {r.text: r.p for r in quality.rate_documents(docs).select("text", F.col("quality.log_perplexity").alias("p")).collect()}
    for text, lang in texts[300:]:
        assert abs(rows[text] - plain_kneser_ney([t for t, x in texts if x == lang], text)) < 1e-9
    assert not set(quality.char_classes(russian).tolist()) & set(quality.char_classes(moved.replace(" ", "").replace(",", "")).tolist())
