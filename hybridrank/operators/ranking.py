"""Ranking primitives: deterministic per-group top-k and the rank matrix of several experts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Scores are compared after rounding so that float sums taken in a different order
# (different partitioning, different engine) rank identically.
RANK_DIGITS = 9


def rank_key(score: str = "score"):
    return F.round(F.col(score), RANK_DIGITS)


def top_k(
    df: DataFrame,
    k: int,
    partition_by: Sequence[str] = ("query_id",),
    score: str = "score",
    tie_break: Sequence = ("doc_id",),
    rank_col: str = "rank",
) -> DataFrame:
    """Keep the ``k`` best rows per group, numbered 1..k.

    Total order: rounded score descending, then ``tie_break`` ascending. ``row_number() <= k``
    lets Spark insert a partial ``WindowGroupLimit`` before the exchange, so at most ``k`` rows per
    group and input partition cross the shuffle.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    order = [rank_key(score).desc()] + [F.col(c).asc() if isinstance(c, str) else c for c in tie_break]
    w = Window.partitionBy(*partition_by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def rank_matrix(runs: DataFrame, experts: Sequence[str], k: int | None = None, sort: bool = False) -> DataFrame:
    """Wide form of several experts' ranked lists: one row per (query, doc) in the union of lists,
    one ``{expert}_rank`` column per expert, 0 where that expert did not retrieve the doc.
    ``sort=True`` orders the rows by (query_id, doc_id) (a range-partitioned global sort)."""
    r = runs if k is None else runs.filter(F.col("rank") <= k)
    wide = (
        r.groupBy("query_id", "doc_id")
        .pivot("expert", list(experts))
        .agg(F.first("rank"))
    )
    for e in experts:
        wide = wide.withColumnRenamed(e, f"{e}_rank")
    wide = wide.fillna(0, subset=[f"{e}_rank" for e in experts])
    return wide.orderBy("query_id", "doc_id") if sort else wide


def with_position(df: DataFrame, order: Sequence[str], position: str = "position") -> DataFrame:
    """``df`` with each row's place, from 0, in the order of ``order`` columns (which should tell rows apart).

    A range exchange deals the rows to tasks in order and each task numbers its own; the rows before a
    task's first come from a count per task, the only thing that is put in one place.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("_at"), F.struct(*df.columns).alias("_row"))
    part, own = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_own")
    placed = materialize(at.select(part, own, "_row"))
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_own")).alias(position), "_row.*")  # a row per task
