"""Corpus pipeline: documents through five stages, each written before the next one reads it.

A NULL or empty text has no words and goes with the quality rules, so later stages
see texts only. Repeated rows are judged alike; the near-duplicate stage leaves one
row of them. Ties go to the smallest doc_id; a NULL id is never a component's id and
its row stays where no other does. An empty table gives no rows. Extra columns,
whatever their names, pass through all stages but the last, which returns its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hunkwise.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from hunkwise.llm.catalog import RANKS
from hunkwise.llm.common import K1, K2, KEYS, materialize, read


_REST = "_rest_of_the_row"


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source, all other columns as one struct): operators' own columns cannot clash with them."""
    used = ("doc_id", "text", "source")
    rest = F.struct(F.lit(0).alias("_never_empty"), *(F.col(f"`{c}`") for c in docs.columns if c not in used))
    return docs.select(*used, rest.alias(_REST))


def _unpacked(packed: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order, from a packed table."""
    whole = ("doc_id", "text", "source")
    return packed.select(*(F.col(c) if c in whole else F.col(_REST).getField(c).alias(c) for c in like.columns))


def _rejoin(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose (doc_id, text) key is among ``judged``; a repeated row stays repeated."""
    k1, k2 = (F.xxhash64(F.lit(seed), "doc_id", "text") for seed in (1, 2))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(row, k1.alias(K1), k2.alias(K2)).join(judged.select(*KEYS), KEYS, "left_semi").select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the classifier keep."""
    model = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    packed = _packed(docs)
    return _unpacked(quality_rules.judge(packed, model, carry=packed.columns).filter("kept"), docs)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines; long passages are boilerplate on fewer sites."""
    packed = _packed(docs)
    return _unpacked(line_dedup.dedup(packed, carry=packed.columns, long_min_sites=line_dedup.LONG_MIN_SITES), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.survivors(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    checked = decontaminate.check(docs, read(spark, sf_dir, "benchmark"))
    return _rejoin(docs, checked.filter(~F.col("contaminated")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents that are left."""
    # Written in between: a task then has one Python worker, and decoding does not depend on what encoded.
    encoded = materialize(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), "encoded")
    return bpe.digests(bpe.decode(encoded, RANKS))


STAGES = [
    ("quality rules", quality),
    ("line dedup", boilerplate),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", contamination),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


# Near-duplicates and the fitted classifier are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None
