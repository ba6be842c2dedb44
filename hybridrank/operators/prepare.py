"""Preparing the expert-score table for router training: clean, de-leak, split, balance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import TWO_32, md5_u32

COARSE_BITS = 16  # exact selection first narrows by the top 16 hash bits (65,536 buckets)


def clean(df: DataFrame, experts: Sequence[str] = ("sparse", "dense")) -> DataFrame:
    """Drop rows with a NULL/NaN expert score and rows where every expert scored 0."""
    valid = reduce(lambda a, b: a & b, [F.col(e).isNotNull() & ~F.isnan(F.col(e)) for e in experts])
    nonzero = reduce(lambda a, b: a | b, [F.col(e) != 0 for e in experts])
    return df.filter(valid & nonzero)


def deleak(train: DataFrame, test: DataFrame, key: str = "query") -> DataFrame:
    """Remove from ``train`` every row whose ``key`` (exact query text) also occurs in ``test``."""
    return train.join(test.select(key).distinct(), key, "left_anti")


def split_hash(seed: int | str, *keys: str) -> Column:
    """Deterministic 32-bit hash of ``seed ‖ keys`` (equal in Spark and DuckDB); a NULL key raises."""
    known = [F.when(F.col(k).isNull(), F.raise_error(F.lit(f"{k} is NULL"))).otherwise(F.col(k).cast("string")) for k in keys]
    return md5_u32(F.lit(str(seed)), *known)


def split(df: DataFrame, fraction: float = 0.8, seed: int = 42, key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """Disjoint, deterministic (train, test): a row is in train when its hash < fraction · 2³².

    Scales without any global step; the train share is ``fraction`` in expectation. Use
    :func:`split_exact` for an exact row count.
    """
    h = split_hash(seed, key)
    cut = F.lit(int(fraction * TWO_32))
    return df.filter(h < cut), df.filter(h >= cut)


def smallest_by_hash(df: DataFrame, n: Column | int, h: Column, tie: str, group: Sequence[str] = ()) -> DataFrame:
    """Rows of ``df`` whose ``(h, tie)`` is among the ``n`` smallest within each ``group`` — exact.

    No window spans a whole group: counts per (group, top-16-bit bucket) give, per bucket, how many
    rows lie in earlier buckets; only the one bucket that straddles ``n`` is ranked row by row.
    ``n`` may be a literal or a scalar-subquery column.
    """
    g = list(group)
    x = df.withColumn("_h", h).withColumn("_b", F.shiftright(F.col("_h"), 32 - COARSE_BITS))
    per_bucket = x.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    # at most 65,536 buckets per group are ordered here
    before = per_bucket.withColumn(
        "_before",
        F.coalesce(
            F.sum("_cnt").over(Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    )
    limit = F.lit(n) if isinstance(n, int) else n
    x = x.join(before.select(*g, "_b", "_before", "_cnt"), [*g, "_b"])
    whole = x.filter(F.col("_before") + F.col("_cnt") <= limit)
    edge = x.filter((F.col("_before") < limit) & (F.col("_before") + F.col("_cnt") > limit))
    edge = edge.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*g, "_b").orderBy("_h", tie))
    ).filter(F.col("_before") + F.col("_r") <= limit).drop("_r")
    return whole.unionByName(edge).drop("_h", "_b", "_before", "_cnt")


def split_exact(df: DataFrame, fraction: float = 0.8, seed: int = 42, key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ``round(fraction · n)`` train rows, chosen by hash order."""
    n = df.agg(F.count(F.lit(1))).scalar()
    return _split_at(df, F.round(n * F.lit(fraction)).cast("long"), seed, key)


def split_validation(df: DataFrame, fraction: float = 0.1, seed: int = 42, key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(train, validation) with exactly ``fraction · n``, cut to a whole number, validation rows."""
    n = df.agg(F.count(F.lit(1))).scalar()
    return _split_at(df, n - F.floor(n * F.lit(fraction)).cast("long"), seed, key)


def _split_at(df: DataFrame, n_train: Column, seed: int, key: str) -> tuple[DataFrame, DataFrame]:
    train = smallest_by_hash(df, n_train, split_hash(seed, key), key)
    test = df.join(train.select(key), key, "left_anti")
    return train, test


def winner(experts: Sequence[str] = ("sparse", "dense")) -> Column:
    """The expert with the strictly highest score; NULL on a tie for the top."""
    top = F.greatest(*[F.col(e) for e in experts])
    n_top = reduce(lambda a, b: a + b, [F.when(F.col(e) == top, 1).otherwise(0) for e in experts])
    pick = F.coalesce(*[F.when(F.col(e) == top, F.lit(e)) for e in experts])
    return F.when(n_top == 1, pick)


def balance(df: DataFrame, experts: Sequence[str] = ("sparse", "dense"), seed: int = 42, key: str = "query_id") -> DataFrame:
    """Under-sample so every expert wins equally often; rows where the top is tied are dropped.

    When some expert never wins the input is returned unchanged (reference behaviour).
    """
    w = df.withColumn("_winner", winner(experts))
    counts = w.filter(F.col("_winner").isNotNull()).groupBy("_winner").agg(F.count(F.lit(1)).alias("c"))
    n_classes = counts.agg(F.count(F.lit(1))).scalar()
    min_count = counts.agg(F.min("c")).scalar()
    classes_ok = n_classes == F.lit(len(experts))
    picked = smallest_by_hash(
        w.filter(F.col("_winner").isNotNull()), min_count, split_hash(seed, key), key, ["_winner"]
    )
    keep_all = w.filter(~classes_ok)
    return picked.filter(classes_ok).unionByName(keep_all).drop("_winner")
