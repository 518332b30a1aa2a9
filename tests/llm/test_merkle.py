import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from siftlog.llm import merkle, queries
from tests.llm.cases import DATA, no_documents, odd_documents

NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if row[n] is None else f"{len(str(row[n]).encode())}:{row[n]}" for n in NAMES])


def tree(nodes):
    """(root, the levels of each node's proof as (left, right) siblings)."""
    proofs, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        for k in range(len(nodes)):
            start = k - k % 3
            for leaf in groups[k]:
                proofs[leaf].append((nodes[start:k], nodes[k + 1 : start + 3]))
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        groups = [sum(groups[k : k + 3], []) for k in range(0, len(groups), 3)]
    return nodes[0], proofs


def expected(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for s in order:
        leaves = sorted((((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)), r) for r in sources[s]), key=lambda x: x[0])
        parts.append((leaves, *tree([key[2] for key, _ in leaves])))
    root, upper = tree([p[1] for p in parts])
    out = []
    for (leaves, top, proofs), above in zip(parts, upper):
        for (key, r), proof in zip(leaves, proofs):
            name = "" if r["doc_id"] is None else str(r["doc_id"])
            node = leaf_of(r | {"text": r["text"].replace("\n", "")}) if zlib.crc32(name.encode()) % 2 == 0 and r["text"] is not None else key[2]
            for left, right in proof + above:
                node = h(*left, node, *right)
            out.append((r["doc_id"], key[2], top, root, h(*[d for left, right in proof + above for d in (*left, *right)]), node, node == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def as_query(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "documents", lambda *_: docs)
    return got(queries.op12_merkle_manifest(spark, ""))


def test_query_against_a_plain_tree(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert got(queries.op12_merkle_manifest(spark, DATA)) == expected(rows)


def test_odd_documents(spark, monkeypatch):
    docs = odd_documents(spark).withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.col("source")))
    assert as_query(spark, docs, monkeypatch) == expected([r.asDict() for r in docs.collect()])
    assert as_query(spark, no_documents(spark), monkeypatch) == []


@pytest.mark.parametrize("levels", [1, 2])
def test_blocks_of_several_rounds_and_a_hot_source(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle.Appender.__init__, "__defaults__", (levels,))
    sizes = {None: 1, "a": 3, "b": 4, "é": 9, "hot": 95, "z": 27}
    rows = [(k, f"text {k}\n", "en", s, k) for s, n in sizes.items() for k in range(n)] + [(5, "twice", "en", "hot", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    assert as_query(spark, docs, monkeypatch) == expected([r.asDict() for r in docs.collect()])


def test_witnesses_grow_with_later_siblings():
    block = merkle.Appender(2)
    first = block.append("a")
    assert first == ["."]
    block.append("b")
    assert first == [".b"]
    block.append("c")
    assert first == [".bc", "."]
    block.append("d")
    assert block.finish(alone=True) == h(h("a", "b", "c"), h("d")) and first == [".bc", "." + h("d")]
