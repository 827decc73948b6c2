"""Corpus pipeline: quality rules, exact dedup, near dedup, source mixing, tokenisation.

``run`` applies STAGES to ``documents``; each stage's rows are written to the shared folder and
reread as the next one's input. All but the last return the columns of their input.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kandle.llm import block_naming, minhash, mixing, quality_bands, sp_scan
from kandle.llm.common import documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the base rule or a compression band rejects go."""
    return quality_bands.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of equal texts the row with the smallest id stays."""
    return block_naming.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each component stays."""
    return minhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document as often as the mix takes it (not at all to three times)."""
    return mixing.mix_rows(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token ids of every document, checked by decoding them again."""
    return sp_scan.tokenised(docs)


STAGES = [("quality_bands", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("fair_queue_mix", mixing_stage), ("sentencepiece", tokenise)]

#: The near-dedup stage is not expressible in SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)


Q = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
