"""Logical tables over the generated parquet test data (``{sf_dir}/{table}.parquet``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a corpus ``(doc_id, text)``; the title is empty."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` passages as queries ``(query_id, text)`` — whole passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as vectors ``(id, embedding, label)``."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
