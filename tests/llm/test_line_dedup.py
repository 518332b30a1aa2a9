import hashlib
from collections import defaultdict

from siftlog.llm import line_dedup, queries
from tests.llm.cases import DATA, LINE, no_documents, odd_documents, some_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_line_dedup(texts, min_chars=40, min_docs=5):
    """id -> (lines, dropped, kept text), for distinct ids."""
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for name, text in texts.items():
        for line in (text or "").split("\n"):
            holders[key(line)].add(name)
    gone = lambda name, line: len(key(line)) >= min_chars and len(holders[key(line)]) >= min_docs and name != max(holders[key(line)])
    out = {}
    for name, text in texts.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if not gone(name, x)]
        out[name] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_query_equals_brute_force(spark):
    want = plain_line_dedup({r.doc_id: r.text for r in some_documents(spark).collect()})
    rows = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op2_line_dedup(spark, DATA).collect()}
    assert rows == {k: (n, d, hashlib.sha256(t.encode()).hexdigest()) for k, (n, d, t) in want.items()}


def test_odd_documents(spark):
    docs = odd_documents(spark)
    kept = line_dedup.dedup_lines(docs, result="lines")
    rows = kept.collect()
    assert len(rows) == docs.count() and kept.columns == [*docs.columns, "lines"]
    first = {}
    for r in docs.collect():
        first.setdefault(r.doc_id, r.text) if r.doc_id != 7 or LINE in (r.text or "") else None
    want = plain_line_dedup({k: t for k, t in first.items() if k is not None})
    for r in rows:
        if r.doc_id is None:
            assert r.text == f"{LINE}\nno id"
        elif r.text != "another text of an id":
            assert (r.lines.n_lines, r.lines.n_dropped, r.text) == want[r.doc_id]
    assert line_dedup.dedup_lines(no_documents(spark)).count() == 0
