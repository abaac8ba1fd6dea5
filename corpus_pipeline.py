"""Corpus pipeline: quality, near copies, benchmark leaks, mixing, sharding.

Each stage works on all rows that its predecessor kept. All but the last return the columns
of ``documents``; the last returns the shard, slot and digest of every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyworks.llm import decontaminate, mixing, ngram_jaccard, quality, sharding
from tallyworks.llm.store import read_table, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rule ensemble scores at 0.3 or more."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked at 0.8 on five-word shingles."""
    return ngram_jaccard.keep_one(docs, ngram_jaccard.Threshold(width=5, num=80, den=100))


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without passages of the benchmark: those that op8 does not mark as contaminated."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows sampled so that languages have their tempered shares (power 0.7) of the tokens."""
    return mixing.mix_documents(docs, docs.select("doc_id", "lang"), "lang", power=0.7)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard, slot, size and CRC of every row."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near copies", near_copies_stage),
    ("benchmark leaks", leaks_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Fitted models and hash draws are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
