"""Queries of the training-data operators over the test tables, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hunkwise.llm import (
    bpe,
    conversations,
    decontaminate,
    hard_negatives,
    jaccard_join,
    licenses,
    line_dedup,
    quality_ranking,
    quality_rules,
    sharding,
    simhash,
    suffix_dedup,
    url_rules,
)
from hunkwise.llm.common import read

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_ranking.rank(docs, quality_ranking.fit(docs, read(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = decontaminate.check(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return checked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), listed.alias("items_sha256"), "contaminated"
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = simhash.cluster(read(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return clustered.select("doc_id", digits.alias("fingerprint"), "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_rules.judge(pages, url_rules.labelled_by_documents(pages, read(spark, sf_dir, "labels")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return bpe.digests(bpe.decode(encoded, RANKS))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.ALL_TEMPLATES, licenses.NEAR_NOTICES, licenses.TELLING)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup(read(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return cut.select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = sharding.assign(read(spark, sf_dir, "documents"))
    return assigned.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels"))).drop("text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(read(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.cluster(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_ranking, op2_decontamination, op3_simhash, op4_url_filter, op5_bpe,
        op6_licenses, op7_line_dedup, op8_sharding, op9_suffix_dedup, op10_quality_rules,
        op11_conversation_repair, op12_jaccard_join, op13_hard_negatives,
    )
}
ORACLES = {
    "op2_decontamination": decontaminate.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op12_jaccard_join": jaccard_join.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
