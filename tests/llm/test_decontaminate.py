import random
import re

from siftlog.llm import decontaminate, queries
from tests.llm.cases import DATA, no_documents, odd_documents, some_documents

WORD = re.compile(r"[^\W_]+")


def words_of(text):
    return WORD.findall((text or "").lower())


def plain_overlaps(docs, items, min_equal=10, min_score=8):
    """All alignments of all documents and items that some mask hits, compared word by word."""
    out = {}
    for name, text in docs:
        w = words_of(text)
        for item, item_text in items:
            x = words_of(item_text)
            if len(x) < decontaminate.SPAN:
                continue
            offsets = set()
            for mask in decontaminate.MASKS:
                keep = [k for k, bit in enumerate(mask) if bit == "1"]
                seeds = {}
                for i in range(len(x) - decontaminate.SPAN + 1):
                    seeds.setdefault(tuple(x[i + k] for k in keep), []).append(i)
                for p in range(len(w) - decontaminate.SPAN + 1):
                    offsets |= {p - i for i in seeds.get(tuple(w[p + k] for k in keep), ())}
            for offset in offsets:
                score = n = 0
                best = (0, 0)
                for k in range(max(0, -offset), min(len(x), len(w) - offset)):
                    if score <= 0:
                        score = n = 0
                    same = x[k] == w[k + offset]
                    score, n = score + (1 if same else -2), n + same
                    if score > best[0]:
                        best = (score, n)
                if best[1] >= min_equal and best[0] >= min_score:
                    out[name, item] = max(out.get((name, item), 0), best[1])
    return out


def test_query_equals_brute_force_and_finds_every_passage(spark):
    docs = [(r.doc_id, r.text) for r in some_documents(spark).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = {(r.doc_id, r.item_id): r.n_equal for r in queries.op3_benchmark_decontamination(spark, DATA).collect()}
    assert rows == plain_overlaps(docs, items)
    whole = {(d, i) for d, t in docs for i, x in items if x in t}
    assert whole and whole <= set(rows)


def planted(seed=3):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(draw.choices(vocabulary, k=n))) for k, n in enumerate((40, 25, 14, 60, 10, 11, 5))]
    docs = []
    for k in range(60):
        text = draw.choices(vocabulary, k=draw.randrange(0, 200))
        if k % 3 == 0:
            passage = words_of(items[draw.randrange(len(items))][1])
            for at in range(len(passage)):
                if draw.random() < (k % 4) * 0.06:
                    passage[at] = "changed"
            at = draw.randrange(len(text) + 1)
            text[at:at] = passage
        docs.append((k, ("  ".join(text)).upper().replace("  ", ", " if k % 2 else "\n")))
    return docs, items


def test_replaced_words_equal_brute_force(spark):
    docs, items = planted()
    found = decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"))
    rows = {(r.id, r.item): r for r in found.collect()}
    assert {k: r.n_equal for k, r in rows.items()} == plain_overlaps(docs, items) and len(rows) > 8
    texts = dict(docs)
    for (name, item), r in rows.items():
        part = words_of(texts[name])[r.start_word : r.start_word + r.n_words]
        assert sum(w in words_of(dict(items)[item]) for w in part) >= r.n_equal


def test_contaminated_rows_go_and_odd_ones_stay(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "The same license line that quite a few documents carry. own line 5"), (2, None), (2, "")], "item_id bigint, text string")
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    left = sorted(str(r.doc_id) for r in kept.collect())
    gone = {k for k, _ in plain_overlaps(list(enumerate(r.text for r in docs.collect())), [(1, "The same license line that quite a few documents carry. own line 5")])}
    assert len(left) == docs.count() - len(gone) and len(gone) >= 3
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.drop_contaminated(no_documents(spark), items).count() == 0
