"""Shards along a Hilbert curve over several metadata columns.

Each dimension is quantised to ``2**bits`` cells, the cells' place on the Hilbert curve orders the
rows, and the order is cut into runs of equal row counts. Rows of one run lie close together in every
dimension at once, so files written per run have narrow ranges (or few values) in each of them and
readers can skip most files for a filter on any dimension.

Built from DataFrame functions only. Rows move once, without their texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, partitions, text_or_empty, whole_rows, written

#: Bytes a row takes besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class Dimension:
    """One axis of the curve.

    ``kind``: ``hash`` (equal values share a cell), ``log`` (cells are powers of two of a count) or
    ``range`` (equal steps between the column's least and greatest value). Null is cell 0.
    """

    column: str
    kind: str


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point with ``len(cells)`` coordinates of ``bits`` bits each.

    Per bit, from the highest, and per axis: a set bit reflects the first axis, an unset one swaps
    the lower bits of both axes; a Gray code over the axes and the interleaved bits give the index.
    """
    n = len(cells)
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def step(x: Column, s: Column) -> Column:
        first, own, low = F.get(x, F.lit(0)), F.get(x, s["i"]), s["q"] - 1
        swapped = first.bitwiseXOR(own).bitwiseAND(low)
        return F.when(
            own.bitwiseAND(s["q"]) != 0, F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))
        ).otherwise(F.transform(x, lambda v, k: F.when((k == 0) | (k == s["i"]), v.bitwiseXOR(swapped)).otherwise(v)))

    def gray(x: Column) -> Column:
        axes = [reduce(lambda a, b: a.bitwiseXOR(b), [F.get(x, F.lit(j)) for j in range(i + 1)]) for i in range(n)]
        return F.array(*axes)

    def interleave(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        flip = reduce(
            lambda a, b: a.bitwiseXOR(b),
            [F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(1, bits)],
            F.lit(0).cast("long"),
        )
        return let(flip, lambda t: reduce(
            lambda a, b: a.bitwiseOR(b),
            [F.shiftleft(F.shiftright(F.get(x, F.lit(i)).bitwiseXOR(t), b).bitwiseAND(F.lit(1).cast("long")), b * n + n - 1 - i) for b in range(bits) for i in range(n)],
        ))

    start = F.array(*[c.cast("long") for c in cells])
    if bits > 1:
        start = F.aggregate(steps, start, step)
    return let(let(start, gray), interleave)


def quantised(docs: DataFrame, dims: list[Dimension], bits: int) -> list[Column]:
    """A cell number for each dimension. ``range`` dimensions read the least and greatest value first."""
    top = (1 << bits) - 1
    spans = [d.column for d in dims if d.kind == "range"]
    ends = docs.agg(*[f(F.col(c).cast("double")).alias(f"{n}{k}") for k, c in enumerate(spans) for n, f in (("lo", F.min), ("hi", F.max))]).first() if spans else None
    out = []
    for d in dims:
        c = F.col(d.column)
        if d.kind == "hash":
            cell = F.pmod(F.xxhash64(c), F.lit(top + 1))
        elif d.kind == "log":
            cell = F.least(F.floor(F.log2(F.greatest(c.cast("double"), F.lit(0.0)) + 1)), F.lit(top))
        elif d.kind == "range":
            k = spans.index(d.column)
            lo, hi = ends[f"lo{k}"] or 0.0, ends[f"hi{k}"] or 0.0
            cell = F.least(F.floor((c.cast("double") - F.lit(lo)) * F.lit((top + 1) / max(hi - lo, 1.0))), F.lit(top))
        else:
            raise ValueError(f"unknown kind of dimension: {d.kind}")
        out.append(F.when(c.isNull(), F.lit(0)).otherwise(cell).cast("long"))
    return out


def shard(docs: DataFrame, n_shards: int, dims: list[Dimension], bits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve``.

    The law is ``rows``: shard sizes differ by one row at most. ``slot`` counts from 0 within the
    shard along the curve; ``curve`` is the place on the curve. Rows of one cell follow each other by
    id, then checksum, so reruns agree; a null id comes first, a null text counts as empty, and rows
    alike in all of these take neighbouring slots. An empty table gives no rows, and with fewer rows
    than shards some shards stay empty. Other columns are not read.

    A range exchange of (curve, id, size, checksum) orders the rows: one cell or source with a third
    of them is split by id. Only the row count of each partition is gathered.
    """
    ranked = _ranked(docs, n_shards, dims, bits, id_col, text_col, [])
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def _ranked(docs: DataFrame, n_shards: int, dims: list[Dimension], bits: int, id_col: str, text_col: str, also: list[Column]) -> DataFrame:
    """``doc_id, size, text_crc32, curve, rank, shard, slot`` and the columns ``also`` of each row, in files along the curve."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        hilbert_index(quantised(docs, dims, bits), bits).alias("curve"),
        *also,
    )
    order = ["curve", "doc_id", "text_crc32", "size"]
    ordered = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    saved = written(ordered.withColumn("part", F.shiftright("at", 33)).withColumn("pos", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at"), "sharding")
    by_part = Window.orderBy("part")
    starts = saved.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(by_part) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total")
    )
    rank, s = F.col("before") + F.col("pos"), F.lit(n_shards).cast("long")
    return (
        saved.join(F.broadcast(starts), "part")  # a row for each partition of the exchange
        .withColumns({"rank": rank, "shard0": F.floor(rank * s / F.col("total"))})
        # the quotient of two longs may be rounded up to the next shard
        .withColumn("shard", F.col("shard0") - F.when(F.col("shard0") * F.col("total") > F.col("rank") * s, 1).otherwise(0))
        .withColumn("slot", F.col("rank") - F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}"))
        .drop("part", "pos", "before", "total", "shard0")
    )


def write_shards(docs: DataFrame, n_shards: int, dims: list[Dimension], path: str, bits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` to ``path/shard=N/`` along the curve; each file holds one run of its shard.

    Every row has a slot of its own, so the files keep the law of :func:`shard`, repeated rows too. Where
    ``docs`` has a column ``shard``, the folders' name gets underscores in front. All columns are as they were.
    """
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    ranked = _ranked(docs, n_shards, dims, bits, id_col, text_col, [whole_rows(docs)])
    ranked.sortWithinPartitions("rank").select("row.*", F.col("shard").cast("int").alias(name)).write.partitionBy(name).parquet(path)
