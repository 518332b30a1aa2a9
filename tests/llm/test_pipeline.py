import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from siftlog.llm import bpe, quality
from siftlog.llm.common import stored
from tests.llm.cases import DATA, no_documents, odd_documents, some_documents
from tests.llm.test_decontaminate import plain_overlaps
from tests.llm.test_line_dedup import plain_line_dedup
from tests.llm.test_quality import plain_counts
from tests.llm.test_simhash import plain_fingerprint


def rows_of(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def plain_keepers(texts):
    """Smallest id of each group, over all pairs of fingerprints."""
    prints = {k: [plain_fingerprint(t, pipeline.NEAR_WORDS, s) for s in pipeline.NEAR_SEEDS] for k, t in texts.items()}
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in prints:
        for b in prints:
            bits = [(x ^ y).bit_count() for x, y in zip(prints[a], prints[b])]
            if a < b and bits[0] <= pipeline.NEAR_BITS and sum(bits) <= pipeline.NEAR_TOTAL:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k for k in prints if find(k) == k}


def test_each_stage_equals_brute_force_on_its_own_input(spark):
    docs = some_documents(spark)
    before, columns = rows_of(docs), docs.columns
    out = []
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), "test-stage")
        out.append((name, rows_of(docs)))
        assert name == "byte_level_bpe" or docs.columns == columns
    (_, good), (_, lines), (_, single), (_, clean), (_, decoded) = out
    verdict = {r.doc_id: r.quality for r in quality.rate_documents(some_documents(spark)).select("doc_id", F.col("quality")).collect()}
    assert set(good) == {k for k, q in verdict.items() if q.kept}
    assert all(not (plain_counts(before[k])[0] < 50) for k in good) and len(good) > 0.7 * len(before)
    assert lines == {k: text for k, (_, _, text) in plain_line_dedup(good).items()}
    assert set(single) == plain_keepers(lines) and len(single) < len(lines)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaked = {k for k, _ in plain_overlaps(list(single.items()), items)}
    assert set(clean) == set(single) - leaked
    assert decoded == clean
    ranks = bpe.read_ranks(public_tokenizers.path(pipeline.RANKS))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: list(r.tokens) for r in docs.collect()} == {k: plain.encode_ordinary(t) for k, t in clean.items()}
    assert rows_of(pipeline.run(spark, DATA)) == clean


def test_odd_documents_pass_every_stage(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert name == "byte_level_bpe" or out.columns == docs.columns
            assert out.count() <= docs.count()
        assert pipeline.encode_and_decode(spark, docs, DATA).count() == docs.count()


def test_rows_of_one_id_with_other_texts_are_all_kept(spark):
    words = [" ".join(f"{name}{k}" for k in range(60)) for name in "abc"]
    rows = [(1, words[0], "z"), (1, words[0], "y"), (1, words[1], "x"), (2, words[1], "w"), (3, words[2], "v"), (None, words[2], "u")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    kept = pipeline.keep_one_of_near_duplicates(spark, docs, DATA).collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


def test_null_ids_do_not_bridge_documents_and_names_may_clash(spark):
    words = [f"w{k}" for k in range(400)]
    changed = lambda places: " ".join("x" * (3 + k % 5) if k in places else w for k, w in enumerate(words))
    texts = [changed(range(0, 24, 3)), changed(()), changed(range(200, 224, 3))]
    prints = [[plain_fingerprint(t, pipeline.NEAR_WORDS, s) for s in pipeline.NEAR_SEEDS] for t in texts]
    near = lambda a, b: (a[0] ^ b[0]).bit_count() <= pipeline.NEAR_BITS and sum((x ^ y).bit_count() for x, y in zip(a, b)) <= pipeline.NEAR_TOTAL
    rows = [(1, texts[0], 5, "a"), (None, texts[1], 6, "b"), (2, texts[2], 7, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _text_hash int, _lines string")
    kept = {r.doc_id for r in pipeline.keep_one_of_near_duplicates(spark, docs, DATA).collect()}
    assert kept == ({1, None} if near(prints[0], prints[2]) else {1, 2, None})
    assert near(prints[0], prints[1]) and near(prints[1], prints[2])
    out = pipeline.drop_shared_lines(spark, docs, DATA)
    assert sorted(out.collect(), key=str) == sorted(docs.collect(), key=str) and out.columns == docs.columns
