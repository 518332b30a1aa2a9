import math
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlog.llm import lm, queries
from tests.llm.cases import DATA, no_documents, odd_documents, some_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [*WORD.findall((text or "").translate(LOWER)), "\n"]


class PlainModel:
    """The same model from its definition, with dictionaries and recursion."""

    def __init__(self, texts, order, share):
        lists = [tokens_of(t) for t in texts]
        self.grams = [Counter(tuple(x[i : i + k]) for x in lists for i in range(len(x) - k + 1)) for k in range(1, order + 1)]
        self.n = sum(map(len, lists))
        self.v = len(self.grams[0])
        least = max(2, math.ceil(share * self.n))
        self.kept = [{g for g, c in grams.items() if c >= least} for grams in self.grams]
        self.after = {}
        for grams in self.kept[1:]:
            for g in grams:
                self.after.setdefault(g[:-1], []).append(g[-1])

    def word(self, w):
        return (self.grams[0][(w,)] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def chance(self, history, w):
        while history and history not in self.kept[len(history) - 1]:
            history = history[1:]
        if not history:
            return self.word(w)
        k = len(history)
        if w in self.after.get(history, ()):
            return (self.grams[k][history + (w,)] - lm.DISCOUNT) / self.grams[k - 1][history]
        left = 1 - sum(self.chance(history, x) for x in self.after.get(history, ()))
        other = 1 - sum(self.chance(history[1:], x) for x in self.after.get(history, ()))
        return max(left, 1e-12) / max(other, 1e-12) * self.chance(history[1:], w)

    def score(self, text, order):
        x = tokens_of(text)
        return sum(math.log10(self.chance(tuple(x[max(0, i - order + 1) : i]), w)) for i, w in enumerate(x))


@pytest.mark.parametrize("order,share", [(3, 1e-3), (2, 1e-9), (3, 1e-9), (1, 1e-4)])
def test_scores_equal_brute_force(spark, order, share):
    texts = ["a b c a b d", "A b c\ta\x0bb c", "", None, "c c c c", "x y z é É", "a b c a b d e f", "the the a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    table, automaton = lm.train(docs.filter("doc_id < 6").select("text"), order, share)
    plain = PlainModel(texts[:6], order, share)
    for r in lm.score_texts(docs, table, automaton).collect():
        x = tokens_of(texts[r.doc_id])
        assert (r.n_tokens, r.n_known) == (len(x), sum(plain.grams[0][(w,)] > 0 for w in x))
        assert r.base_score == pytest.approx(sum(math.log10(plain.word(w)) for w in x), abs=1e-9)
        assert r.score == pytest.approx(plain.score(texts[r.doc_id], order), abs=1e-9)


def test_query_equals_its_base_and_gains_on_held_out_texts(spark):
    rows = queries.op8_lm_scoring(spark, DATA).collect()
    docs = {r.doc_id: r.text for r in some_documents(spark).collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    count = Counter(w for i, t in docs.items() if i not in held for w in tokens_of(t))
    n, v = sum(count.values()), len(count)
    for r in rows:
        x = tokens_of(docs[r.doc_id])
        assert r.held_out == (r.doc_id in held) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(x), sum(count[w] > 0 for w in x))
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), rel=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_automaton_sums_to_one(spark):
    texts = ["a b c a b d", "a b c a b c", "c c c c", "x y z", "a b c a b d e f"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = PlainModel(texts, 3, 1e-9)
    vocabulary = [g[0] for g in plain.grams[0]] + ["never seen"]
    for history in [(), ("a",), ("a", "b"), ("b", "c"), ("c", "c"), ("x", "y")]:
        assert sum(plain.chance(history, w) for w in vocabulary) == pytest.approx(1, abs=1e-9)
    assert lm.train(docs)[1].tokens == plain.n


def test_odd_documents(spark):
    docs = odd_documents(spark)
    table, automaton = lm.train(docs.select("text"))
    rows = lm.score_texts(docs, table, automaton).collect()
    assert len(rows) == docs.count() and all(r.n_tokens == 1 for r in rows if r.doc_id in (0, 1, 2, 3))
    table, automaton = lm.train(no_documents(spark).select("text"))
    rows = lm.score_texts(docs, table, automaton).collect()
    assert len(rows) == docs.count() and all(r.n_known == 0 and abs(r.score) < 1e-9 for r in rows)
    assert lm.score_texts(no_documents(spark), table, automaton).count() == 0


def test_rare_n_grams_count_at_every_size(spark):
    texts = ["a b c a b d", "x y z x y z", *["q r s t u v w"] * 40, "a b d x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    plain = PlainModel(texts, 3, 1e-9)
    for share in (0.05, 1e-9, 1.0):
        table, automaton = lm.train(docs.select("text"), 3, share)
        for r in lm.score_texts(docs, table, automaton).collect():
            assert r.score == pytest.approx(plain.score(texts[r.doc_id], 3), abs=1e-9)


def test_rounds_share_all_hashes_and_leave_only_what_is_read_later(spark, tmp_path, monkeypatch):
    """Shuffles and tables of a round go with it, so disk follows the input."""
    hashes = [lm.word_hash(f"w{k}") for k in range(4000)]
    shares = {r.h: r.t for r in spark.createDataFrame([(h,) for h in hashes], "h bigint").select("h", lm.turn_column("h").alias("t")).collect()}
    turns = lm.turn_of(np.array(hashes))
    assert [shares[h] for h in hashes] == turns.tolist() and set(turns.tolist()) == set(range(1 << lm.SHARE_BITS))
    monkeypatch.setattr(lm, "shared_dir", lambda _, purpose: f"{tmp_path}/{purpose}-{uuid.uuid4().hex}")
    docs = spark.createDataFrame(list(enumerate(["a b c a b d", "a b c", None, "c c c"] * 5)), "doc_id bigint, text string").repartition(3)
    before = spark.conf.get(lm.CLEANUP)
    table, automaton = lm.train(docs.select("text"))
    assert lm.score_texts(docs, table, automaton).count() == 20
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["llm-found", "llm-walked", "llm-weights"]
    assert spark.conf.get(lm.CLEANUP) == before
