"""Weighted reciprocal-rank fusion of several experts' ranked lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import require
from .labels import experts_per_query
from .ranking import top_k


def fixed_weights(queries: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """``(query_id, expert, weight)`` with the same weights for every query."""
    w = F.create_map(*[x for e, v in weights.items() for x in (F.lit(e), F.lit(float(v)))])
    return experts_per_query(queries, list(weights)).select("query_id", "expert", w[F.col("expert")].alias("weight"))


def fuse(runs: DataFrame, weights: DataFrame, experts: Sequence[str], k: int) -> DataFrame:
    """Fused top-k ``(query_id, doc_id, rank, score)`` with score = Σ_experts weight / rank.

    Equal scores keep the order in which documents are first met when walking the experts in the
    given order and each list from the top: the earliest (expert position, rank) wins.
    """
    require(runs, ("query_id", "expert", "doc_id", "rank"), "runs")
    require(weights, ("query_id", "expert", "weight"), "weights")
    pos = F.create_map(*[x for i, e in enumerate(experts) for x in (F.lit(e), F.lit(i))])
    # Queries without any weight aren't fused; an expert without one counts 0, its documents stay in the list.
    weighted = runs.join(weights.select("query_id").distinct(), "query_id", "left_semi")
    scored = weighted.join(weights.select("query_id", "expert", "weight"), ["query_id", "expert"], "left").select(
        "query_id",
        "doc_id",
        (F.coalesce(F.col("weight"), F.lit(0.0)) / F.col("rank")).alias("contrib"),
        F.struct(pos[F.col("expert")].alias("pos"), F.col("rank").alias("rank")).alias("seen"),
    )
    agg = scored.groupBy("query_id", "doc_id").agg(F.sum("contrib").alias("score"), F.min("seen").alias("first_seen"))
    ranked = top_k(agg, k, tie_break=(F.col("first_seen.pos"), F.col("first_seen.rank"), F.col("doc_id")))
    return ranked.select("query_id", "doc_id", "rank", "score")
