"""Corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of `documents`, the last one token ids. `run` writes
each stage below the shared folder and reads it again, so a lost executor
costs one stage at most.

Defined results, beside those of the operators: a stage passes extra columns
through unchanged, `n_chars` follows a changed text. Rows with a null id are
never near-duplicates of others; they take part in all other stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from siftlog.llm import bpe, decontaminate, line_dedup, quality, simhash
from siftlog.llm.common import documents, stored

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Near-duplicates share most of their five-word shingles: at least 0.8 of the bits of two 64-bit fingerprints agree
#: in both together, and at most NEAR_BITS differ in the one that is searched.
NEAR_WORDS, NEAR_BITS, NEAR_TOTAL, NEAR_SEEDS = 5, 10, 25, (42, 7)


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), "text", *(["lang"] if "lang" in docs.columns else []))
    return quality.rate_documents(packed, keep=["doc"]).filter("quality.kept").select("doc.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without long lines that at least five share, but for the largest doc_id."""
    result = max(docs.columns, key=len) + "_lines"  # no column has this name
    out = line_dedup.dedup_lines(docs, result=result).drop(result)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each group of near-duplicates, and of those of smallest text hash; of rows equal in both the smallest by its columns."""
    named = docs.filter(F.col("doc_id").isNotNull())
    key = F.struct("doc_id", F.xxhash64("text").alias("_text_hash"))
    found = simhash.near_duplicates(named.select(key.alias("_near"), "text"), "_near", words=NEAR_WORDS, max_bits=NEAR_BITS, seeds=NEAR_SEEDS, max_total=NEAR_TOTAL)
    keepers = stored(found.filter(F.col("_near") == F.col("component_id")).select("_near.*").distinct(), "keepers")
    order = F.struct(*[F.col("_doc")[c.name] for c in docs.schema if not isinstance(c.dataType, (T.MapType, T.VariantType))])
    kept = (
        named.select("doc_id", F.xxhash64("text").alias("_text_hash"), F.struct(*docs.columns).alias("_doc"))
        .join(keepers, ["doc_id", "_text_hash"], "left_semi").groupBy("doc_id", "_text_hash").agg(F.min_by("_doc", order).alias("_doc")).select("_doc.*")
    )
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


def drop_leaked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, tokens, text): the ids of every document, and the text they decode to."""
    ranks = public_tokenizers.path(RANKS)
    encoded = bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN)
    return bpe.decode_tokens(encoded, ranks).select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality_rules", keep_good_documents),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_leaked_documents),
    ("byte_level_bpe", encode_and_decode),
]

#: No SQL: the quality model, fingerprints and merges have none. tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
