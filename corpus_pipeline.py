"""Corpus pipeline: quality, near copies, contamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valueflow.llm import decontaminate, jaccard_join, mixing, quality, sharding
from valueflow.llm.common import discard, table, written

SHARDS = 8


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("_quality.predicted") == 1).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.join(docs).filter("_near.first").select(*docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    found = decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~decontaminate.is_contaminated(F.col("_bench"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy: sources come near their target weights."""
    return mixing.emit(mixing.mix(docs)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot``."""
    placed = sharding.shard(docs, SHARDS)
    return placed.select(*docs.columns, "_shard.shard", "_shard.slot")


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_each),
    ("decontamination", keep_clean),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Learned models and random orders have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
