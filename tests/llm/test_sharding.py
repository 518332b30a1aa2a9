import random
import zlib
from collections import defaultdict

import pytest

from siftlog.llm import queries, sharding
from tests.llm.cases import DATA, no_documents, odd_documents, some_documents


def smallest_capacity(sizes, shards):
    low, high = 0, sum(sizes)
    while low < high:
        middle, used, fill = (low + high) // 2, 1, 0
        for s in sizes:
            if s > middle:
                used = shards + 1
                break
            if fill + s > middle:
                used, fill = used + 1, 0
            fill += s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


def check(rows, texts, groups, shards):
    """rows: (id, size, crc, shard, slot); groups: ordered (key, size) of all texts."""
    by_text, fill, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in rows:
        text = texts[r.doc_id]
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        by_text[text].add(r.shard)
        fill[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    left, alone, rest = sum(s for _, s in groups), 0, list(groups)
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0]))[: shards - 1]:
        if size * (shards - alone) <= left:
            break
        alone, left = alone + 1, left - size
        rest.remove((key, size))
    if rest and alone < shards:
        assert max((fill[s] for s in range(alone, shards)), default=0) == smallest_capacity([s for _, s in rest], shards - alone)
    return fill


def run(spark, docs, shards):
    groups = sorted(((r.k1, r.k2), r.size) for r in sharding.group_sizes(docs, "text").collect())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    return check(sharding.assign_shards(docs, shards=shards).collect(), texts, groups, shards)


def test_all_documents_reach_the_smallest_capacity(spark):
    assert len(run(spark, some_documents(spark), 16)) == 16
    rows = queries.op10_sharding(spark, DATA).collect()
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None} and {r.shard for r in rows} == set(range(16))


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_random_sizes_and_a_hot_group(spark, shards):
    draw = random.Random(shards)
    texts = ["hot " * 50] * 120 + ["".join(draw.choices("ab é", k=draw.choice((0, 3, 40, 900)))) for _ in range(240)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    fill = run(spark, docs, shards)
    assert len(fill) == shards


def test_refinement_is_exact(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 4)
    monkeypatch.setattr(sharding, "REFINE", 3)
    draw = random.Random(9)
    docs = spark.createDataFrame([(k, "x" * draw.randrange(1, 60)) for k in range(200)] + [(k, f"{k} " * draw.randrange(1, 30)) for k in range(200, 400)], "doc_id bigint, text string")
    run(spark, docs, 5)


def test_odd_documents(spark):
    rows = sharding.assign_shards(odd_documents(spark), shards=4).collect()
    assert len(rows) == odd_documents(spark).count()
    assert {r.size for r in rows if r.doc_id in (0, 1, 19)} == {1}
    assert sharding.assign_shards(no_documents(spark)).count() == 0
