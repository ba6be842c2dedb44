"""Connected components of links by random contraction, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its component's least node) for every node of ``links`` (``a, b``, longs).

    In each round every node joins the first of its neighbours and itself, in an order of nodes by a hash
    that differs from round to round; links between nodes that have joined the same one fall away. In
    any graph that leaves a fixed share of the nodes at most, by expectation, so rounds grow with
    the logarithm of the nodes and all rounds together read a few times the links. Nulls and loops are
    left out. A hub's rows are aggregated before they move and split by the joins.
    """
    edges, steps = written(_unordered(links, "a", "b"), "links"), []
    while edges.limit(1).count():
        turn = F.lit(len(steps))
        place = lambda node: F.struct(F.xxhash64(turn, node).alias("h"), node.alias("n"))  # noqa: B023, E731
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min(place(F.col("v"))).alias("first"))
        step = written(first.select(F.col("u").alias("node"), F.least("first", place(F.col("u")))["n"].alias("joins")), "contraction")
        steps.append(step)
        end = lambda side: step.select(F.col("node").alias(side), F.col("joins").alias(f"{side}_joins"))  # noqa: B023, E731
        edges = written(_unordered(edges.join(end("u"), "u").join(end("v"), "v"), "u_joins", "v_joins"), "links")
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = steps[-1].withColumnRenamed("joins", "component")
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("joins"), F.col("component").alias("last"))
        out = step.join(later, "joins", "left").select("node", F.coalesce("last", "joins").alias("component"))
    out = written(out, "components")
    least = out.groupBy("component").agg(F.min("node").alias("least"))
    return out.join(least, "component").select("node", F.col("least").alias("component"))
