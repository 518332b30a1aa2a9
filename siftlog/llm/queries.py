"""One query per operator, over all of `documents`, with the digests its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlog.llm import bpe, classifier, conversations, decontaminate, line_dedup, lm, merkle, mixing, quality, secrets, sharding, simhash, tokens
from siftlog.llm.common import documents, fold
from siftlog.llm.registry import query
from siftlog.session import shared_dir


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_dir(spark, "llm-token-files")
    tokens.write_tokens(documents(spark, sf_dir), root, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.read_tokens(spark, root, crc_only=True).withColumnRenamed("id", "doc_id")


@query("op2_line_dedup", oracle="""
WITH l AS (
  SELECT doc_id, i, part, translate(trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
f AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE coalesce(l.doc_id <> f.keeper, false))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(l.doc_id <> f.keeper, false)), '')) AS kept_sha256
FROM l LEFT JOIN f USING (key) GROUP BY l.doc_id
""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_benchmark_decontamination")
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.groupBy(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).agg(
        F.max(F.struct("n_equal", "n_words", "start_word")).alias("b")).select("doc_id", "item_id", "b.*")


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = classifier.fit(docs, labels.filter(fold("doc_id", 5) != 0))
    return classifier.score_documents(docs, model, keep=["doc_id"]).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op5_secret_scans")
def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.STRONG))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    return found.select("doc_id", *[count(kind) for kind in secrets.STRONG], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op6_byte_level_bpe")
def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_texts(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return bpe.decode_tokens(encoded, ranks).select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("tokens", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op8_lm_scoring")
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    table, automaton = lm.train(docs.filter(fold("doc_id", 10) != 0).select("text"))
    return lm.score_texts(docs, table, automaton).select(
        "doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(automaton.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_documents(documents(spark, sf_dir), keep=["doc_id"]).select("doc_id", "quality.*")


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged, copies = conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.summarise(conversations.repair_conversations(damaged, copies=copies)).withColumnRenamed("conv", "conv_id")


@query("op12_merkle_manifest")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "source", "lang", "n_chars"]
    leaf = lambda text: merkle.leaf_digest([*map(F.col, names), text])
    tampered = F.when(fold("doc_id", 2) == 0, leaf(F.translate("text", "\n", ""))).otherwise(leaf(F.col("text")))
    leaves = documents(spark, sf_dir).select(
        F.col("source").alias("tree"), F.col("doc_id").alias("key"), leaf(F.col("text")).alias("digest"), F.struct("doc_id", tampered.alias("tampered")).alias("payload"))
    folded = merkle.fold_witness(F.col("payload.tampered"), F.col("witness"))
    return merkle.build_manifest(leaves).withColumn("folded_root", folded).select(
        "payload.doc_id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root",
        F.sha2(merkle.siblings(F.col("witness")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_source_mixing")
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
