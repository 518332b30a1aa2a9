import re
from collections import defaultdict
from math import floor

import pytest

from siftlog.llm import mixing, queries
from tests.llm.cases import DATA, no_documents, odd_documents

WEIGHTS = (5, 2, 1)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, share=1.5, most=2.0):
    """Targets by sharing out round by round; sizes by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(order)}
    got, left, full = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set()
    while left > 1e-9 and len(full) < len(order):
        whole, over = sum(weight[s] for s in order if s not in full), 0.0
        for s in order:
            if s not in full:
                got[s] += left * weight[s] / whole
        for s in order:
            if s not in full and got[s] > most * sizes[s]:
                over += got[s] - most * sizes[s]
                got[s] = most * sizes[s]
                full.add(s)
        left = over
    return got


def check(rows, docs):
    """rows: results; docs: (doc_id, text, source)."""
    size = defaultdict(int)
    for _, text, source in docs:
        size[source] += words(text)
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in rows) == sorted((str(d), str(s), words(t)) for d, t, s in docs)
    want, taken, largest = targets(size), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        rate = r.target / r.source_size if r.source_size else 0
        assert r.taken == r.copies * r.size and (r.size == 0 and r.copies == 0 or floor(rate) <= r.copies <= min(2, floor(rate) + 1))
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def of(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]


def key(rows):
    return sorted(map(str, rows))


def test_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.mix_sources(docs).collect()
    check(rows, of(docs))
    again = queries.op13_source_mixing(spark, DATA)
    assert again.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again.collect())


def test_odd_documents(spark):
    docs = odd_documents(spark)
    check(mixing.mix_sources(docs).collect(), of(docs))
    assert mixing.mix_sources(no_documents(spark)).count() == 0


def test_levels_hot_source_and_equal_rows(spark):
    texts = ["w " * n for n in (1, 2, 3, 5, 8, 40, 300)]
    rows = [(k, texts[k % 7], "hot" if k % 3 else f"s{k % 4}") for k in range(1500)] + [(3, "same row", "hot")] * 700 + [(None, "no id at all", None)] * 31 + [(1, " \n", "blank")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    few = mixing.mix_sources(docs.repartition(2), bucket=4).collect()
    check(few, rows)
    assert key(few) == key(mixing.mix_sources(docs.repartition(5, "text"), bucket=4).collect())
    check(mixing.mix_sources(docs).collect(), rows)


def test_rounding_keeps_probabilities(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 9), f"s{k % 3}") for k in range(6000)], "doc_id bigint, text string, source string")
    rows = mixing.mix_sources(docs, seed=4).collect()
    assert key(rows) != key(mixing.mix_sources(docs, seed=5).collect())
    mean = defaultdict(list)
    for r in rows:
        mean[r.source, r.size].append(r.copies)
    rate = {r.source: r.target / r.source_size for r in rows}
    for (source, _), copies in mean.items():
        assert abs(sum(copies) / len(copies) - rate[source]) < 0.12
