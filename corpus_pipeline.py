"""From raw documents to shards of a training mix: five stages, each the work of one operator.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hybridrank.llm import contamination, mixing, near_join, quality, sharding
from hybridrank.llm.common import table, written
from hybridrank.llm.queries import CURVE, MIX, SHARDS


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled documents vote for; the others go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_join.one_of_each(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold benchmark passages beyond the limit."""
    return contamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: dropped, once or more."""
    return mixing.repeat_documents(docs, mixing.mix(docs, **MIX))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix."""
    return sharding.shard(docs, SHARDS, CURVE)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("decontamination", no_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The vote of neighbours and the mix's chance can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
