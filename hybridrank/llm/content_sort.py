"""Exact de-duplication by sorting contents.

Sampled splitters cut the rows into ranges of normalised texts, each range is sorted by the whole texts'
bytes (on disk if need be), equal texts come to stand next to each other, and each text is compared in
full with the one before it. Only the splitters are bounded in length. A text can have rows on both sides
of a splitter only if the splitter was made from it; the runs of such texts are compared in full once more.

Built from DataFrame functions only; each text moves once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, partitions, text_or_empty, written

#: Leading characters of a text in a splitter, and sampled keys per range.
HEAD, SAMPLED = 128, 24
#: Characters of a key that rows of equal texts share: the leading ones and the digest.
SHARED = HEAD + 64


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), SPACES, " ")


def in_order(doc_id: Column) -> Column:
    """The id written so that strings sort as the numbers do, a null id last."""
    return F.coalesce(F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit("~"))


def range_key(norm: Column, digest: Column, doc_id: Column, place: Column) -> Column:
    """What ranges are cut by: leading characters, digest of the whole text, id, place in the table.

    Bounded in length, and different for each row, so that any group of equal texts can be cut. Rows of
    equal texts are neighbours in its order, by id; that they are equal is found from whole texts alone.
    """
    return F.concat(F.rpad(F.substring(norm, 1, HEAD), HEAD, " "), digest, in_order(doc_id), F.lpad(F.hex(place), 16, "0"))


def splitters(keys: DataFrame, n: int) -> list[str]:
    """At most ``n - 1`` keys that cut ``keys`` (one column ``key``, a sample) into even ranges."""
    ranked = keys.withColumns({"at": F.row_number().over(Window.orderBy("key")), "total": F.count("*").over(Window.partitionBy())})
    cut = F.floor(F.col("at") * n / F.col("total")) > F.floor((F.col("at") - 1) * n / F.col("total"))
    rows = ranked.filter(cut & (F.col("at") < F.col("total"))).select("key").distinct().collect()
    return sorted((r[0] for r in rows), key=lambda s: s.encode("utf-8"))


def sampled(rows: DataFrame, every: int) -> DataFrame:
    """About one in ``every`` rows, by their places in the table, so that rows that are alike are sampled like any others."""
    return rows.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0)


def range_of(key: Column, cuts: list[str]) -> Column:
    """How many of the sorted ``cuts`` are not above ``key``, by halving steps."""
    if not cuts:
        return F.lit(0)
    array = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(1 << b) for b in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(array, at + s - 1) <= key, at + s).otherwise(at))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space became one space; a null text
    counts as empty. Of equal texts the row with the smallest id stays; a null id comes after all
    others, and of rows that repeat the smallest id one stays. An empty table gives no rows. Other
    columns are not read.

    Copies are split over ranges by id and place, so a text that a third of all rows share is the work of
    a third of all tasks, with or without ids. What is gathered: the splitters, one bounded key per range.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("raw"), F.monotonically_increasing_id().alias("place"))

    def keyed(rows: DataFrame) -> DataFrame:
        rows = rows.select("doc_id", "place", F.regexp_replace("raw", SPACES, " ").alias("norm")).withColumn("sha", F.sha2("norm", 256))
        return rows.withColumn("key", range_key(F.col("norm"), F.col("sha"), F.col("doc_id"), F.col("place")))

    every = max(1, docs.count() // (n * SAMPLED))
    cuts = splitters(keyed(sampled(raw, every)).select("key"), n)
    ends = F.array(*[F.lit(c[:SHARED]) for c in cuts]).cast("array<string>")

    in_range = Window.partitionBy("part").orderBy("norm", "number", "place")
    shared = F.substring("key", 1, SHARED)
    compared = (
        keyed(raw)
        .withColumn("part", range_of(F.col("key"), cuts))
        # whether rows with this text may lie beyond an end of the range
        .withColumn("crosses", F.coalesce(F.get(ends, F.col("part") - 1) == shared, F.lit(False)) | F.coalesce(F.get(ends, F.col("part")) == shared, F.lit(False)))
        .select("part", "crosses", "doc_id", "place", "norm", "sha")
        .repartitionById(n, "part")
        .withColumn("number", in_order(F.col("doc_id")))
        .withColumn("same", F.coalesce(F.col("norm") == F.lag("norm").over(in_range), F.lit(False)))
        .withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(in_range))
        .select("part", "run", "doc_id", "sha", "same", F.when(F.col("crosses") & ~F.col("same"), F.col("norm")).alias("end_text"))
    )
    saved = written(compared, "content-sort")

    # of a text's runs in several ranges the first has its smallest id; at most two runs of a range are compared
    by_text = Window.partitionBy("end_text").orderBy("part")
    first = F.first(F.struct("part", "run")).over(by_text)
    goes_on = (
        saved.filter("end_text is not null").select("part", "run", first.alias("head"))
        .filter(F.col("head.part") < F.col("part"))
        .select("part", "run", F.col("head.part").alias("head_part"), F.col("head.run").alias("head_run"))
    )
    group = Window.partitionBy("group_part", "group_run")
    runs = (
        saved.groupBy("part", "run").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
        .join(F.broadcast(goes_on), ["part", "run"], "left")  # at most a row for each splitter
        .withColumns({"group_part": F.coalesce("head_part", "part"), "group_run": F.coalesce("head_run", "run")})
        .select("part", "run", F.min("least").over(group).alias("keep_id"), F.sum("n").over(group).alias("group_size"), F.col("head_part").isNull().alias("starts"))
    )
    return saved.drop("end_text").join(runs, ["part", "run"]).select(
        "doc_id", "keep_id", "group_size", (~F.col("same") & F.col("starts")).alias("kept"), F.col("sha").alias("text_sha256")
    )
