"""Per-query expert scores (router training labels) from ranked runs and judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import require


def experts_per_query(queries: DataFrame, experts: Sequence[str]) -> DataFrame:
    """``(query_id, expert, expert_pos)`` for every query and expert (explode, not a cross join)."""
    tags = F.array(*[F.struct(F.lit(e).alias("expert"), F.lit(i).alias("expert_pos")) for i, e in enumerate(experts)])
    return queries.select("query_id", F.explode(tags).alias("_e")).select("query_id", "_e.expert", "_e.expert_pos")


def expert_scores(
    runs: DataFrame,
    qrels: DataFrame,
    judged: DataFrame,
    experts: Sequence[str],
    k: int,
) -> DataFrame:
    """``(query_id, expert, score)`` with score = Σ over the expert's top-k of
    ``1/rank · relevance · 1/(number of experts that also have the doc in their top-k)``.

    Every judged query gets a row per expert; no hit gives 0.0.
    """
    require(runs, ("query_id", "expert", "doc_id", "rank"), "runs")
    top = runs.filter((F.col("rank") > 0) & (F.col("rank") <= k)).select("query_id", "expert", "doc_id", "rank")
    rel = top.join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "left").withColumn(
        "rel", F.coalesce(F.col("relevance"), F.lit(0))
    )
    shared = Window.partitionBy("query_id", "doc_id")  # at most one row per expert
    term = F.lit(1.0) / F.col("rank") * F.col("rel") / F.count(F.lit(1)).over(shared)
    per = rel.withColumn("t", term).groupBy("query_id", "expert").agg(F.sum("t").alias("score"))
    base = experts_per_query(judged.select("query_id"), experts)
    return base.join(per, ["query_id", "expert"], "left").select(
        "query_id", "expert", "expert_pos", F.coalesce(F.col("score"), F.lit(0.0)).alias("score")
    )


def normalize_scores(scores: DataFrame) -> DataFrame:
    """Add ``l1`` (x / Σx when Σx > 0, else x unchanged) and ``softmax`` (exp(x) / Σexp(x)) per query."""
    q = Window.partitionBy("query_id")  # one row per expert
    total = F.sum("score").over(q)
    return scores.withColumn("l1", F.when(total > 0, F.col("score") / total).otherwise(F.col("score"))).withColumn(
        "softmax", F.exp("score") / F.sum(F.exp("score")).over(q)
    )


def to_wide(normalized: DataFrame, experts: Sequence[str]) -> DataFrame:
    """One row per query: ``{e}``, ``{e}_l1``, ``{e}_softmax`` for every expert ``e``."""
    wide = normalized.groupBy("query_id").pivot("expert", list(experts)).agg(
        F.first("score").alias("raw"), F.first("l1").alias("l1"), F.first("softmax").alias("softmax")
    )
    cols = [F.col("query_id")]
    cols += [F.col(f"{e}_raw").alias(e) for e in experts]
    for norm in ("l1", "softmax"):
        cols += [F.col(f"{e}_{norm}").alias(f"{e}_{norm}") for e in experts]
    return wide.select(*cols)


def score_table(runs: DataFrame, qrels: DataFrame, queries: DataFrame, experts: Sequence[str], k: int) -> DataFrame:
    """The label-generation table: ``query_id, query, {e}, {e}_l1, {e}_softmax`` for judged queries."""
    judged = queries.join(qrels.select("query_id"), "query_id", "left_semi")
    wide = to_wide(normalize_scores(expert_scores(runs, qrels, judged, experts, k)), experts)
    return wide.join(judged.select("query_id", F.col("text").alias("query")), "query_id").select(
        "query_id", "query", *[c for c in wide.columns if c != "query_id"]
    )
