"""Precision / recall at k per query and their means per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import require
from .labels import experts_per_query

DEFAULT_KS = (1, 5, 10, 25)


def per_query(
    runs: DataFrame,
    qrels: DataFrame,
    models: Sequence[str],
    ks: Sequence[int] = DEFAULT_KS,
    graded: bool = True,
) -> DataFrame:
    """``(model, query_id, k, precision, recall)`` for every judged query, model and k.

    ``runs(query_id, model, doc_id, rank)``. With ``graded`` (the reference behaviour) the retrieved
    relevance is summed, so precision can exceed 1; recall divides by the number of judged documents.
    Queries without any retrieved relevant document get zeros (they are not dropped).
    """
    require(runs, ("query_id", "model", "doc_id", "rank"), "runs")
    ks = sorted(set(int(k) for k in ks))
    rel = F.col("relevance") if graded else F.when(F.col("relevance") > 0, F.lit(1)).otherwise(F.lit(0))
    hits = (
        runs.filter(F.col("rank") <= ks[-1])
        .join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"])
        .select("query_id", "model", "rank", rel.alias("rel"))
    )
    at_k = (
        hits.select(
            "query_id", "model", "rel", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))).alias("k")
        )
        .groupBy("query_id", "model", "k")
        .agg(F.sum("rel").alias("rel_at_k"))
    )
    judged = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_judged"))
    base = (
        experts_per_query(judged.select("query_id"), models)
        .withColumnRenamed("expert", "model")
        .drop("expert_pos")
        .join(judged, "query_id")
        .withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    )
    got = F.coalesce(F.col("rel_at_k"), F.lit(0)).cast("double")
    return base.join(at_k, ["query_id", "model", "k"], "left").select(
        "model",
        "query_id",
        "k",
        (got / F.col("k")).alias("precision"),
        F.when(F.col("n_judged") > 0, got / F.col("n_judged")).otherwise(F.lit(0.0)).alias("recall"),
    )


def summary(per_query_metrics: DataFrame, by: Sequence[str] = ("model", "k")) -> DataFrame:
    """``(model, k, precision, recall, n_queries)``: means over all judged queries (of each value of ``by``)."""
    return per_query_metrics.groupBy(*by).agg(
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.count(F.lit(1)).alias("n_queries"),
    )


def to_named(summary_df: DataFrame, ks: Sequence[int] = DEFAULT_KS) -> DataFrame:
    """Wide ``precision@k`` / ``recall@k`` columns, a row per model (and corpus, where there is such a column)."""
    keys = [c for c in ("corpus", "model") if c in summary_df.columns]
    wide = summary_df.groupBy(*keys).pivot("k", list(ks)).agg(F.first("precision").alias("p"), F.first("recall").alias("r"))
    cols = [F.col(c) for c in keys]
    for k in ks:
        cols += [F.col(f"{k}_p").alias(f"precision@{k}"), F.col(f"{k}_r").alias(f"recall@{k}")]
    return wide.select(*cols)
