import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from siftlog.llm import bpe, queries
from siftlog.llm.words import chunk_table
from tests.llm.cases import DATA, no_documents, odd_documents, some_documents

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [
    "  a  b\n\n c", " x", "x ", "a b c\x01 d", "tab\t\tx 's it's don't  ", "\n \n", "", "é  ü 12  34!!", "a\x1cb c", "a   b", "汉字 かな 🙂 x", "no break   space", "x  y",
    "I'll I've 'S  '", "\r\n\r\n  end", " ", "a \x00 b",
]


def library():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_pieces_split_as_whole_texts():
    match = regex.compile(PATTERN)
    codes, begins, pieces = chunk_table(pa.array([*ODD, None]), match)
    for k, text in enumerate([*ODD, ""]):
        got = [t for c in codes[begins[k] : begins[k + 1]] for t in bpe.split_piece(pieces[c], match)]
        assert got == match.findall(text)


@pytest.mark.parametrize("block_bytes", [1, 20000, bpe.BLOCK_BYTES])
def test_ids_equal_the_library_and_decode_back(spark, block_bytes):
    docs = odd_documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(ODD, 100)), "doc_id bigint, text string"))
    plain = library()
    rows = bpe.decode_tokens(bpe.encode_texts(docs, RANKS, PATTERN, block_bytes=block_bytes, buckets=7), RANKS).collect()
    want = sorted((str(r.doc_id), plain.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert sorted((str(r.doc_id), list(r.tokens), bytes(r.decoded)) for r in rows) == want


def test_query_equals_the_library(spark):
    plain = library()
    rows = {r.doc_id: r for r in queries.op6_byte_level_bpe(spark, DATA).collect()}
    docs = some_documents(spark).collect()
    assert len(rows) == len(docs)
    for doc in docs:
        ids, r = plain.encode_ordinary(doc.text), rows[doc.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(doc.text.encode()).hexdigest()


def test_no_documents_and_unknown_ids(spark):
    assert bpe.encode_texts(no_documents(spark), RANKS, PATTERN).count() == 0
    with pytest.raises(Exception, match="not in the table"):
        bpe.decode_tokens(spark.createDataFrame([(1, [99_999_999])], "doc_id bigint, tokens array<int>"), RANKS).collect()


def test_blocks_are_split_in_parts_with_the_same_numbers(spark, monkeypatch):
    """A block's texts are split a part at a time; words have one number in all of them."""
    match, texts, known, split = regex.compile(PATTERN), pa.array([*ODD, None, *ODD]), {}, {}
    whole, sizes = bpe.number_words(texts, match, {}, {})
    parts = [bpe.number_words(texts.slice(k, 5), match, known, split) for k in range(0, len(texts), 5)]
    assert [n for numbers, _ in parts for n in numbers] == whole.tolist() and [n for _, per_text in parts for n in per_text] == sizes.tolist()
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string").coalesce(1)
    made = lambda: [(r.per_text, r.numbers, r.buckets, r.asked) for r in bpe.make_blocks(docs, PATTERN, "doc_id", "text", bpe.BLOCK_BYTES, 7).collect()]
    large = made()
    monkeypatch.setattr(bpe, "PART_BYTES", 8)
    assert made() == large
