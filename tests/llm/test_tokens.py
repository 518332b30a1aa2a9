import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftlog.llm import tokens
from siftlog.session import shared_dir
from tests.llm.cases import no_documents, odd_documents, some_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def written(spark, docs, path=PATH):
    root = shared_dir(spark, "test-tokens")
    tokens.write_tokens(docs, root, path)
    return root


def expected(docs, path=PATH):
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, [*plain.encode(t, add_special_tokens=False).ids, 0]) for i, t in rows]


@pytest.mark.parametrize("source", [some_documents, odd_documents])
def test_files_hold_what_the_library_encodes(spark, source):
    docs = source(spark)
    root, want = written(spark, docs), expected(docs)
    rows = sorted(tokens.read_tokens(spark, root).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == [i for i, _ in want]
    starts = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (starts, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        starts += len(r.ids)
    assert sorted((str(r.id), list(r.ids)) for r in rows) == sorted((str(i), x) for i, x in want)


def test_one_document_is_read_alone(spark):
    docs = some_documents(spark)
    root = written(spark, docs)
    want = dict(expected(docs))
    assert tokens.read_document(spark, root, 11) == [want[11]]
    assert tokens.read_document(spark, root, -1) == []


def test_a_changed_dictionary_is_refused(spark):
    root = written(spark, some_documents(spark))
    store, top = tokens.open_store(root)
    name = next(f.path for f in store.get_file_info(tokens.files.FileSelector(top)) if "dictionary" in f.path)
    with store.open_output_stream(name) as out:
        out.write(b"other")
    with pytest.raises(Exception, match="dictionary was changed"):
        tokens.read_document(spark, root, 11)


def test_no_documents_and_other_tokenizers(spark):
    assert tokens.read_tokens(spark, written(spark, no_documents(spark))).count() == 0
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = some_documents(spark).limit(20)
    rows = tokens.read_tokens(spark, written(spark, docs, path)).collect()
    assert sorted((r.id, list(r.ids)) for r in rows) == sorted(expected(docs, path))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_matched_as_the_library_does(spark, name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    added = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert added
    texts = [f"text {added[0]} more", f"{added[0]}{added[-1]}", f"x{added[0]}", "no such token", f"{added[0]}\n a  b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.id: list(r.ids) for r in tokens.read_tokens(spark, written(spark, docs, path)).collect()}
    assert rows == {k: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}


def test_the_dictionary_sample_is_bounded_in_rows(spark, monkeypatch):
    seen = []
    real = tokens.zstandard.train_dictionary
    monkeypatch.setattr(tokens.zstandard, "train_dictionary", lambda size, samples: seen.append(len(samples)) or real(size, samples))
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(40)], "doc_id bigint, text string").repartition(3)
    tokens.train_dictionary(docs, PATH, 0, "doc_id", "text", 5, 1 << 16)
    assert seen == [5]
