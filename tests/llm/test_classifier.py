import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlog.llm import classifier
from siftlog.llm.common import fold
from tests.llm.cases import no_documents, odd_documents


def learned(spark, folder="/root/testdata/sf0.01"):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    return docs, labels, classifier.fit(docs, labels.filter(fold("doc_id", 5) != 0))


def test_held_out_accuracy(spark):
    docs, labels, model = learned(spark, "/root/testdata/sf0.1")
    rows = classifier.score_documents(docs, model, keep=["doc_id"]).join(labels.filter(fold("doc_id", 5) == 0), "doc_id").collect()
    score, label = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert len(rows) > 500 and ((score >= 0.3) == (label == 1)).mean() > 0.98
    rank = np.argsort(np.argsort(score))
    ones = label == 1
    auc = (rank[ones].sum() - ones.sum() * (ones.sum() - 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > 0.99


def test_features_equal_their_definition():
    def one(data, salt):
        h = sum((ord(c) + 1) * pow(classifier._STEP, k, 1 << 64) for k, c in enumerate(data)) % (1 << 64)
        return ((h * int(classifier._SPREAD) + salt) * int(classifier._SPREAD) % (1 << 64)) >> 48, h

    text = "Ab  é\tcd 語 cd\n😀x\x0bд"
    want = [one(text[i : i + n], n)[0] for n in classifier.NGRAMS for i in range(len(text) - n + 1)]
    words = [one(w, 99) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    pairs = [((((b - a) % (1 << 64)) * int(classifier._SPREAD) + 98) * int(classifier._SPREAD) % (1 << 64)) >> 48 for (_, a), (_, b) in zip(words, words[1:])]
    end = (97 * int(classifier._SPREAD) % (1 << 64)) >> 48
    assert classifier.features(text).tolist() == [*want, *(w for w, _ in words), *pairs, end]
    assert len(classifier.features("")) == 0 and classifier.features(" ").tolist() == [end]


def plain_scores(examples, texts, buckets, dimensions, epochs, rate=0.5):
    """Softmax over averaged vectors, trained one example at a time with plain lists."""
    draw = np.random.default_rng(1)
    vectors = ((draw.random((buckets, dimensions)) - 0.5) / dimensions).tolist()
    weights, bias = [[0.0] * dimensions, [0.0] * dimensions], [0.0, 0.0]
    axes, draw, done = range(dimensions), np.random.default_rng(2), 0

    def forward(text):
        bag = Counter(classifier.features(text, buckets).tolist())
        total = max(1, sum(bag.values()))
        mean = [sum(n / total * vectors[b][d] for b, n in bag.items()) for d in axes]
        logits = [sum(w * m for w, m in zip(weights[c], mean)) + bias[c] for c in (0, 1)]
        top = max(logits)
        odds = [math.exp(x - top) for x in logits]
        return bag, total, mean, [x / sum(odds) for x in odds]

    for _ in range(epochs):
        for k in draw.permutation(len(examples)):
            text, label = examples[k]
            speed = rate * (1 - done / (epochs * len(examples)))
            done += 1
            bag, total, mean, odds = forward(text)
            error = [p - (c == label) for c, p in enumerate(odds)]
            down = [sum(error[c] * weights[c][d] for c in (0, 1)) for d in axes]
            for c in (0, 1):
                weights[c] = [w - speed * error[c] * m for w, m in zip(weights[c], mean)]
                bias[c] -= speed * 0.1 * error[c]
            for b, n in bag.items():
                step = min(n / total * len(bag), 4.0)
                vectors[b] = [v - speed * step * x for v, x in zip(vectors[b], down)]
    return [forward(t)[3][1] for t in texts]


def test_training_and_scores_equal_plain_descent(spark):
    good, bad = "the quiet river runs past old stone walls", "buy buy buy!!! 語語 click $$$ now now"
    texts = [f"{good} {k} {'é' * k}" for k in range(6)] + [f"{bad} {k} " * (1 + k) for k in range(6)] + ["", "river 語 click"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k < 6)) for k in range(12)], "doc_id bigint, quality int")
    model = classifier.fit(docs, labels, buckets=1 << 9)
    got = {r.doc_id: r.score for r in classifier.score_documents(docs, model).collect()}
    order = sorted(range(12), key=str)  # the sample is ordered by id as text
    want = plain_scores([(texts[k], int(k < 6)) for k in order], texts, 1 << 9, classifier.DIMENSIONS, classifier.EPOCHS)
    assert [got[k] for k in range(len(texts))] == pytest.approx(want, abs=1e-4)
    assert min(want[:6]) > max(want[6:12])


def test_scores_do_not_depend_on_other_columns_or_rows(spark):
    docs, labels, model = learned(spark)
    rows = {r.doc_id: r.score for r in classifier.score_documents(docs, model).collect()}
    other = docs.select("doc_id", "text", F.lit("zz").alias("lang"), F.lit(1).alias("score")).filter("doc_id < 50")
    again = classifier.score_documents(other, model)
    assert again.columns == ["doc_id", "text", "lang", "score"]
    assert all(abs(r.score - rows[r.doc_id]) < 1e-12 for r in again.collect())
    second = classifier.fit(docs, labels.filter(fold("doc_id", 5) != 0))
    assert np.array_equal(second.table()[0], model.table()[0])


def test_odd_documents(spark):
    docs, labels, model = learned(spark)
    rows = classifier.score_documents(odd_documents(spark), model).collect()
    assert len(rows) == odd_documents(spark).count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert classifier.score_documents(no_documents(spark), model).count() == 0
    blank = classifier.fit(docs, labels.limit(0))
    assert {r.score for r in classifier.score_documents(docs, blank, keep=["doc_id"]).collect()} == {0.5}


def test_the_bound_holds_for_rows_of_a_repeated_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier.Subwords, "train", lambda self, examples: seen.append(len(examples)))
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other")], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    classifier.fit(docs, labels, max_rows=10, buckets=1 << 10)
    classifier.fit(docs, labels, buckets=1 << 10)
    assert seen == [10, 51]
