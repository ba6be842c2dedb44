"""Writers: score tables, qrels, router results, run configs, benchmark results."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import DEFAULT_KS, to_named
from ..operators.ranking import with_position


def write_score_table(df: DataFrame, path: str, mode: str = "overwrite", positions: bool = False) -> None:
    """CSV with header and every field quoted (quotes doubled), first column ``query_idx``.

    ``query_idx`` carries the query id, or with ``positions`` the row's place, from 0, in order of the id.
    """
    cols = [c for c in df.columns if c not in ("query_id", "query_idx")]
    out = with_position(df, ["query_id"], "query_idx") if positions else df.withColumn("query_idx", F.col("query_id"))
    out.select("query_idx", *cols).write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_qrels(qrels: DataFrame, path: str, mode: str = "overwrite", partition_by_split: bool = False) -> None:
    """Long-form JSON lines ``{"query_id", "doc_id", "relevance"[, "split"]}``."""
    w = qrels.write.mode(mode)
    if partition_by_split and "split" in qrels.columns:
        w = w.partitionBy("split")
    w.json(path)


def write_router_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-query router test results (array columns) as Parquet."""
    results.write.mode(mode).parquet(path)


def write_run_config(spark: SparkSession, config: dict, path: str, mode: str = "overwrite") -> None:
    """One-row JSON document of the run configuration."""
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(path)


def write_benchmark(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Benchmark summary ``(corpus, model, k, precision, recall, ...)`` as JSON, one folder per corpus."""
    w = metrics.write.mode(mode)
    if "corpus" in metrics.columns:
        w = w.partitionBy("corpus")
    w.json(path)


def write_report(metrics: DataFrame, path: str, ks: Sequence[int] = DEFAULT_KS, mode: str = "overwrite") -> None:
    """Benchmark summary as JSON lines, one for each corpus and model, with ``precision@k`` and ``recall@k``."""
    to_named(metrics, ks).write.mode(mode).json(path)
