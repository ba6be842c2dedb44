"""Mix of sources to target weights by pivotal rounding of copy counts.

Every document of a source should be taken ``rate = target / size of the source`` times. The whole part
is taken at once; the rest is a probability. Two documents with open probabilities meet, and random
transfer moves expected words from one to the other until one of them is 0 or 1; expected copies of
each document and the expected words of both stay what they were. The open one goes on to the next
meeting. Groups of a source leave one open document each; these meet in ever fewer groups (a reduction
tree), so at its root a source's words differ from its target by less than one document.
Of rows that repeat id and text, the whole part of their probabilities' sum is taken outright; the rest is
one document's probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty, whole_rows, written

#: Documents in a group of the tree's first level, and groups that meet in one of the next.
GROUP, FAN_IN = 1024, 64
#: Rows, at most, that are numbered together where rows that repeat id and text are taken unequally often.
DEALT = 1024
LEVEL = "source string, doc_id long, size long, crc long, m long, h long, bucket long, whole long, extra long, p double, closed boolean"


def words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``source, source_size, n, target`` from ``source, source_size, n``.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all
    sizes; no target exceeds ``most`` times its source's size. Resharing the excess until nobody is
    above raises all open targets by one common factor; ordered by cap per weight, that factor is
    the first for which the next source stays below its cap.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    by_cap, everything = Window.orderBy("cap_per_weight", "turn"), Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    capped = (
        sizes.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", turn)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("factor", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("open", F.col("factor") * F.col("weight") <= F.col("cap"))
        .withColumn("common", F.min_by("factor", F.when(F.col("open"), F.struct("cap_per_weight", "turn"))).over(everything))
    )
    common = F.coalesce(F.when(F.col("common").isNotNull(), F.col("common") * F.col("weight")), F.col("cap"))
    return capped.select("source", "source_size", "n", F.least("cap", common).alias("target"))


def _uniform(h: np.ndarray, level: int) -> np.ndarray:
    """Numbers in [0, 1) fixed by the documents' hashes and the level."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) / float(2**53)


def pivot(size: list[float], p: list[float], u: list[float]) -> tuple[list[float], int]:
    """Probabilities after all meetings, and the index of the one left open (-1: none).

    Mass (probability times size) moves between the open document and the next; one direction or
    the other by chance, weighted so that no expectation changes.
    """
    p, held = list(p), -1
    for k in range(len(p)):
        if not 0.0 < p[k] < 1.0:
            continue
        if held < 0:
            held = k
            continue
        a, b, sa, sb = p[held], p[k], size[held], size[k]
        fill_a, drain_a = (1.0 - a) * sa, a * sa
        fill_b, drain_b = (1.0 - b) * sb, b * sb
        up, down = min(fill_a, drain_b), min(drain_a, fill_b)
        if u[k] * (up + down) < down:  # to the held one
            a, b = (1.0, b - up / sb) if fill_a < drain_b else (a + up / sa, 0.0) if drain_b < fill_a else (1.0, 0.0)
        else:
            a, b = (0.0, b + down / sb) if drain_a < fill_b else (a - down / sa, 1.0) if fill_b < drain_a else (0.0, 1.0)
        p[held], p[k] = a, b
        held = held if 0.0 < a < 1.0 else k if 0.0 < b < 1.0 else -1
    return p, held


def _meet(level: int, last: bool):
    def group(rows: pd.DataFrame) -> pd.DataFrame:
        # large documents first: the small ones after them close what they leave open
        rows = rows.assign(mass=-rows["size"]).sort_values(["mass", "h", "doc_id", "crc"], kind="stable", ignore_index=True).drop(columns="mass")
        u = _uniform(rows["h"].to_numpy(), level)
        p, held = pivot(rows["size"].astype(float).tolist(), rows["p"].tolist(), u.tolist())
        if last and held >= 0:
            p[held] = float(_uniform(rows["h"].to_numpy()[held : held + 1], -2)[0] < p[held])
            held = -1
        rows["p"], rows["closed"] = p, np.arange(len(rows)) != held
        rows["bucket"] //= FAN_IN
        return rows

    return group


def mix(docs: DataFrame, weights: list[float], share: float, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, size, crc, m, source_size, target, copies``.

    One row per distinct (id, source, text length in words, checksum) and number of copies; ``m`` rows of
    ``docs`` share these. Rows that repeat the first four differ by one copy at most, so that a source's
    taken words miss its target by less than one row's, however many rows are alike. Sizes are words; a null or empty text has none and is taken
    ``floor(rate)`` times. A null id or source is a value like any other. An empty table gives no
    rows. Other columns are not read. The same rows give the same mix on every run, in any order.

    Groups of a source are cut by hash to about ``GROUP`` documents whatever the source's share; only
    (id, size, checksum) rows move, and only one number (the largest source's row count) is gathered.
    """
    items = docs.select(
        F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"),
        words(text_col).alias("size"), F.crc32(text_or_empty(text_col).cast("binary")).alias("crc"),
    ).groupBy("source", "doc_id", "size", "crc").agg(F.count("*").alias("m"))
    items = written(items, "mix-items")
    goals = written(targets(items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n")), weights, share, most).withColumnRenamed("source", "goal_source"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    part = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.col("rate") - F.floor("rate"))
    hashed = F.xxhash64(F.lit(seed), "source", "doc_id", "size", "crc")
    same_source = F.col("source").eqNullSafe(F.col("goal_source"))
    rows = (
        items.join(goals.withColumn("rate", rate), same_source)
        .select("source", "doc_id", "size", "crc", "m", hashed.alias("h"), F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "crc"), F.ceil(F.col("n") / GROUP)).alias("bucket"), F.floor("rate").alias("whole"), (F.col("m") * part).alias("p"))
        .withColumn("extra", F.floor("p")).withColumn("p", F.col("p") - F.col("extra"))
    )
    widest = goals.agg(F.max("n")).first()[0] or 0
    buckets, level, done, open_rows = -(-widest // GROUP), 0, [], rows
    while True:
        last = buckets <= 1
        after = written(open_rows.withColumn("closed", F.lit(False)).groupBy("source", "bucket").applyInPandas(_meet(level, last), LEVEL), f"mix-level{level}")
        done.append(after.filter("closed"))
        if last:
            break
        open_rows, buckets, level = after.filter("not closed"), -(-buckets // FAN_IN), level + 1
    decided = done[0]
    for d in done[1:]:
        decided = decided.unionByName(d)
    more = F.col("extra") + F.col("p").cast("long")
    parts = F.array(F.struct(more.alias("m"), (F.col("whole") + 1).alias("copies")), F.struct((F.col("m") - more).alias("m"), F.col("whole").alias("copies")))
    decided = decided.select("source", "doc_id", "size", "crc", F.inline(F.filter(parts, lambda part: part["m"] > 0)))
    return decided.join(goals, same_source).select("source", "doc_id", "size", "crc", "m", "source_size", "target", "copies")


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as ``mixed`` (of :func:`mix`) takes it; all columns, in their order.

    Of rows that repeat id, source and text, those that come first where they are numbered get the larger
    number of copies; such rows are written once, numbered ``DEALT`` at a time and told of the counts before.
    """
    keyed = docs.select(
        whole_rows(docs), words(text_col).alias("__size"), F.crc32(text_or_empty(text_col).cast("binary")).alias("__crc"), F.col(id_col).cast("long").alias("__own"), F.col(source_col).cast("string").alias("__from")
    )
    plan = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__n"), F.col("crc").alias("__c")).agg(
        F.min("copies").alias("__low"), F.max("copies").alias("__high"), F.max_by("m", "copies").alias("__more")
    ).filter("__high > 0")
    on = keyed["__own"].eqNullSafe(plan["__id"]) & keyed["__from"].eqNullSafe(plan["__source"]) & (keyed["__size"] == plan["__n"]) & (keyed["__crc"] == plan["__c"])
    columns = [F.col("row")]
    out = keyed.join(plan.filter("__low = __high"), on).select(*columns, F.col("__high").alias("__copies"))
    uneven = written(plan.filter("__low < __high"), "mix-uneven")
    if uneven.limit(1).count():
        on = keyed["__own"].eqNullSafe(uneven["__id"]) & keyed["__from"].eqNullSafe(uneven["__source"]) & (keyed["__size"] == uneven["__n"]) & (keyed["__crc"] == uneven["__c"])
        rows = written(keyed.join(uneven, on).withColumn("__row", F.monotonically_increasing_id()).withColumn("__lot", F.expr(f"__row div {DEALT}")), "mix-uneven-rows")
        key = ["__id", "__source", "__n", "__c"]
        counts = rows.groupBy(*key, "__lot").agg(F.count("*").alias("count"))
        earlier = Window.partitionBy(*key).orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1)
        lots = counts.select(*[F.col(c).alias(f"{c}_of") for c in key], F.col("__lot").alias("__lot_of"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
        same = F.col("__lot") == F.col("__lot_of")
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
        number = F.row_number().over(Window.partitionBy(*key, "__lot").orderBy("__row")) + F.col("__before")
        dealt = rows.join(lots, same).withColumn("__number", number)
        out = out.unionByName(dealt.select(*columns, F.when(F.col("__number") <= F.col("__more"), F.col("__high")).otherwise(F.col("__low")).alias("__copies")).filter("__copies > 0"))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("row.*")
