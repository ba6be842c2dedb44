"""Near duplicates by a grouped prefix join of shingle sets.

A document's set holds its distinct runs of ``width`` words. All shingles have one global order, rare ones
first. Two sets with Jaccard similarity of at least ``t`` share a shingle within the first
``size - ceil(t * size) + 1`` of either, its prefix.

1. Documents with equal sets are one set. Sets with equal prefixes and sizes are one group.
2. Groups meet at shingles of their prefixes; sizes and places in the prefix rule most meetings out.
3. Group pairs expand to pairs of members. Those whose parities (which cells of hashes hold an odd number
   of a set's shingles) differ in more cells than linked sets can differ in shingles are ruled out, the
   others are verified over their whole sets.

Only components are asked for, so pairs whose ends are already linked through others needn't be verified:
first each group meets its neighbours (by size) and the hub at each shingle; then all pairs that are left,
those between different components, are verified. No link between different sets is lost by that.
A shingle's hub is the group that meets most others over its whole prefix: among near copies of one text
that is the text itself, or a copy with few changes, to which the others link.

Sets and shingles are told apart by 64-bit hashes. Those of words are polynomials, which long words of a
regular build make equal; so words beyond ``PLAIN`` bytes get a cryptographic hash.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_or_last, id_or_null, shuffles_dropped, text_or_empty, whole_rows, written
from .components import components
from .files import slices
from .kernels import PrefixHash, blocks, byte_codes, is_word_byte, lower_table, mix64, powers, runs_of

#: Cells of the sketch of shingle counts (two to this power), and of the blocks it is added up in.
SKETCH, SKETCH_BLOCK = 21, 16
#: Bytes of the longest word with a polynomial hash; of a text read at once, about.
PLAIN, PIECE = 256, 1 << 22


class Shingles:
    """Shingle sets of texts, as sorted 64-bit hashes."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.word, self.lower, self.codes = is_word_byte(), lower_table(), byte_codes()
        self.up, self.down = powers(1 << 20)
        with np.errstate(over="ignore"):
            self.place = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and where each text's begin and end among them."""
        data = self.lower[data]
        if len(data) >= len(self.up):
            self.up, self.down = powers(2 * len(data))
        with np.errstate(over="ignore"):
            starts, ends = runs_of(self.word[data], offsets)
            words = mix64(PrefixHash(data, self.codes, self.up, self.down).of(starts, ends) + (ends - starts).astype(np.uint64))
        for k in np.flatnonzero(ends - starts > PLAIN):
            words[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        return words, np.searchsorted(starts, offsets)

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of one long text, read in pieces that end at white space."""
        words, at = [], 0
        while at < len(data):
            end = min(len(data), at + PIECE)
            while end < len(data) and self.word[data[end]]:
                gap = np.flatnonzero(~self.word[data[end : end + PIECE]])
                end = end + int(gap[0]) if len(gap) else min(len(data), end + PIECE)
            words.append(self._words(data[at:end], np.array([0, end - at]))[0])
            at = end
        words = np.concatenate(words)
        return words, np.array([0, len(words)])

    def of(self, texts: pa.Array):
        """Row and set of each text."""
        width = self.width
        for row, data, offsets in blocks(texts):
            words, of_text = self._long(data) if len(offsets) == 2 and len(data) > PIECE else self._words(data, offsets)
            with np.errstate(over="ignore"):
                sums = np.zeros(max(len(words) - width + 1, 0), np.uint64)
                for k in range(width):
                    sums += words[k : k + len(sums)] * self.place[k]
                sums = mix64(sums)
                for k in range(len(offsets) - 1):
                    a, b = int(of_text[k]), int(of_text[k + 1])
                    if b - a >= width:
                        yield row + k, np.unique(sums[a : b - width + 1])
                    elif b > a:
                        short = (words[a:b] * self.place[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                        yield row + k, mix64(np.array([short], np.uint64))
                    else:
                        yield row + k, np.zeros(0, np.uint64)


def digest(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        mixed = mix64(shingles + np.arange(1, len(shingles) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return int(mix64(np.array([mixed.sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def _share(t: float) -> tuple[int, int]:
    """The threshold as a fraction of whole numbers."""
    return round(t * 100), 100


def prefix_length(n: int, t: float) -> int:
    part, whole = _share(t)
    return n - -(-part * n // whole) + 1


def _batch(schema: str, columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def parities(shingles: np.ndarray) -> bytes:
    """For each cell of hashes whether an odd number of the set's shingles fall into it; a cell for each shingle at least."""
    size = max(64, 1 << (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """Of two sets, by their parities: how many shingles at least only one of them holds."""
    x, y, most, least = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * len(a), 8 * len(b)
    if most < least:
        x, y, most, least = y, x, least, most
    while most > least:  # the parities of half as many cells
        most //= 2
        x = (x >> most) ^ (x & ((1 << most) - 1))
    return (x ^ y).bit_count()


SETS = "doc long, twin long, n long, id long, parities binary, cell int, counts binary"


def _sets(width: int):
    """Each document's set size and digest; and, at the end, how often the task saw the shingles of each cell."""

    def find(batches):
        kernel, counts = Shingles(width), np.zeros(1 << SKETCH, np.uint32)
        for batch in slices(batches, 1024):
            found = [s for _, s in kernel.of(batch.column("text"))]
            cells = np.concatenate([np.zeros(0, np.uint64), *found]) & np.uint64((1 << SKETCH) - 1)
            np.add.at(counts, cells.astype(np.int64), np.uint32(1))
            none = [None] * len(found)
            odd = [parities(s) if len(s) else None for s in found]
            yield _batch(SETS, [batch.column("doc"), batch.column("twin"), [len(s) for s in found], [digest(s) for s in found], odd, none, none])
        size = 1 << SKETCH_BLOCK
        for k in range(1 << (SKETCH - SKETCH_BLOCK)):
            part = counts[k * size : (k + 1) * size]
            if part.any():
                yield _batch(SETS, [[None], [None], [None], [None], [None], [k], [part.astype("<u4").tobytes()]])

    return find


def _add(key, table):
    total = np.zeros(1 << SKETCH_BLOCK, np.uint64)
    for chunk in table.column("counts").chunks:
        for raw in chunk:
            total += np.frombuffer(raw.as_buffer(), "<u4")
    rank = np.zeros(len(total), np.uint8)
    rank[total > 0] = np.log2(total[total > 0].astype(np.float64)).astype(np.uint8)
    return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "ranks": pa.array([rank.tobytes()], pa.binary())})


def _ranks(sets: DataFrame) -> np.ndarray:
    """A byte for each cell: the logarithm of how many shingles of the whole corpus fall into it."""
    size = 1 << SKETCH_BLOCK
    out = np.zeros(1 << SKETCH, np.uint8)
    for row in sets.filter("cell is not null").select("cell", "counts").groupBy("cell").applyInArrow(_add, "cell int, ranks binary").collect():
        out[row["cell"] * size : (row["cell"] + 1) * size] = np.frombuffer(row["ranks"], np.uint8)
    return out


def _ordered(s: np.ndarray, ranks: np.ndarray, t: float) -> np.ndarray:
    """The prefix of a set: rare cells first, then by hash."""
    p = prefix_length(len(s), t)
    return s[np.lexsort((s, ranks[(s & np.uint64((1 << SKETCH) - 1)).astype(np.int64)]))[:p]]


def _group(prefix: np.ndarray, n: int) -> int:
    with np.errstate(over="ignore"):
        return digest(np.append(prefix, np.uint64(n)))


MEMBERS = "id long, n long, grp long"
PREFIXES = "token long, grp long, n int, pos int"


def _members(width: int, t: float, sent):
    def find(batches):
        kernel, ranks, seen = Shingles(width), sent.value, set()
        for batch in batches:
            rows = []
            for _, s in kernel.of(batch.column("text")):
                if len(s) and (own := digest(s)) not in seen:
                    seen.add(own)
                    rows.append((own, len(s), _group(_ordered(s, ranks, t), len(s))))
            if rows:
                yield _batch(MEMBERS, zip(*rows, strict=True))
            if len(seen) > 1 << 20:
                seen.clear()

    return find


def _prefixes(width: int, t: float, sent):
    def find(batches):
        kernel, ranks, seen = Shingles(width), sent.value, set()
        for batch in slices(batches, 2048):
            tokens, groups, sizes, places = [], [], [], []
            for _, s in kernel.of(batch.column("text")):
                if not len(s):
                    continue
                prefix = _ordered(s, ranks, t)
                own = _group(prefix, len(s))
                if own in seen:
                    continue
                seen.add(own)
                tokens.append(prefix)
                groups.append(np.full(len(prefix), own, np.int64))
                sizes.append(np.full(len(prefix), len(s), np.int32))
                places.append(np.arange(len(prefix), dtype=np.int32))
            if tokens:
                yield _batch(PREFIXES, [np.concatenate(tokens).view(np.int64), np.concatenate(groups), np.concatenate(sizes), np.concatenate(places)])
            if len(seen) > 1 << 20:
                seen.clear()

    return find


def _possible(n1: Column, pos1: Column, n2: Column, pos2: Column, t: float) -> Column:
    """Whether sets of these sizes whose first common shingle has these places can reach ``t``."""
    part, whole = _share(t)
    n1, n2, pos1, pos2 = (c.cast("long") for c in (n1, n2, pos1, pos2))
    close = F.least(n1, n2) * whole >= F.greatest(n1, n2) * part
    return close & (F.least(n1 - pos1, n2 - pos2) * (part + whole) >= (n1 + n2) * part)


def _close(t: float):
    """Rows (a, b, n_a, n_b, odd_a, odd_b) to those pairs whose sets, by their sizes and parities, may reach ``t``."""
    part, whole = _share(t)

    def close(batches):
        for batch in slices(batches, 2048):
            a, b, n_a, n_b, odd_a, odd_b = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "odd_a", "odd_b"))
            keep = [k for k in range(len(a)) if least_apart(odd_a[k], odd_b[k]) * (whole + part) <= (n_a[k] + n_b[k]) * (whole - part)]
            if keep:
                yield _batch("a long, b long", [[a[k] for k in keep], [b[k] for k in keep]])

    return close


def _verify(width: int, t: float):
    """Rows (a, b, text_a, text_b) sorted by a to those pairs whose sets reach ``t``."""
    part, whole = _share(t)

    def verify(batches):
        kernel, last, left = Shingles(width), None, None
        for batch in slices(batches, 256):
            own, other, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            new = [k for k in range(len(own)) if k == 0 or own[k] != own[k - 1]]
            lefts = dict(zip(new, (s for _, s in kernel.of(batch.column("text_a").take(pa.array(new, pa.int64())))), strict=True))
            for k, right in kernel.of(batch.column("text_b")):
                if k in lefts:
                    last, left = own[k], lefts[k]
                if (last, other[k]) != (digest(left), digest(right)):
                    continue  # texts of one id whose hashes collide
                common = len(np.intersect1d(left, right, assume_unique=True))
                if common * whole >= part * (len(left) + len(right) - common):
                    out.append((last, other[k]))
            if out:
                yield _batch("a long, b long", zip(*out, strict=True))

    return verify


def _linked(pairs: DataFrame, reps: DataFrame, texts: DataFrame, width: int, t: float) -> DataFrame:
    """Those of ``pairs`` (``a, b``, digests) that verify over the whole texts of their representatives.

    Pairs grow faster than the input, and few of them are links; so texts move only for those that the
    parities of their sets, some bits a shingle, don't rule out.
    """
    side = lambda x: reps.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("parities").alias(f"odd_{x}"))
    pairs = written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(_close(t), "a long, b long"), "close-pairs")
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct().join(reps.select("id", "rep", "twin"), "id")
    # rows that repeat id and text are one, so that each set meets its own text once
    own = texts.join(needed.select("id", F.col("rep").alias("doc"), "twin"), ["doc", "twin"]).groupBy("id").agg(F.first("text").alias("text"))
    left = own.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = own.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(_verify(width, t), "a long, b long").distinct()


def _placed(docs: DataFrame, width: int, t: float, id_col: str, text_col: str) -> DataFrame:
    """For each row its id, a hash of its text, its set's size and hash, and its component (a set's hash) with the smallest id in it."""
    with shuffles_dropped(docs.sparkSession):
        return _found(docs, width, t, id_col, text_col)


def _found(docs: DataFrame, width: int, t: float, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(id_or_last(id_col).alias("doc"), text_or_empty(text_col).alias("text")).withColumn("twin", F.xxhash64("text"))
    found = written(rows.mapInArrow(_sets(width), SETS), "sets")
    sent = spark.sparkContext.broadcast(_ranks(found))
    sets = found.filter("cell is null").select("doc", "twin", "n", "id")
    first = F.min(F.struct("doc", "twin", "n", "parities")).alias("first")
    reps = found.filter("cell is null and n > 0").groupBy("id").agg(first).select("id", F.col("first.doc").alias("rep"), "first.twin", "first.n", "first.parities")
    reps = written(reps, "set-firsts")
    members = written(rows.select("text").mapInArrow(_members(width, t, sent), MEMBERS).distinct(), "members")

    at_token = Window.partitionBy("token").orderBy("n", "grp")
    met = (
        rows.select("text").mapInArrow(_prefixes(width, t, sent), PREFIXES)
        .withColumn("twin", F.lag("grp").over(at_token).eqNullSafe(F.col("grp"))).filter("not twin").drop("twin")
        .withColumns({"prev": F.lag(F.struct("grp", "n", "pos")).over(at_token), "meets": F.count("*").over(Window.partitionBy("token"))})
        .filter("meets > 1")
    )
    met = written(met.select("token", "grp", "n", "pos", "prev", "meets"), "prefix-meetings")

    # 1. neighbours: of a shingle's groups in order of size, and of a group's members; and a shingle's groups with its hub
    firsts = members.groupBy("grp").agg(F.min("id").alias("id"))
    chain = met.filter(_possible(F.col("n"), F.col("pos"), F.col("prev.n"), F.col("prev.pos"), t)).select("grp", F.col("prev.grp").alias("other"))
    weight = met.groupBy("grp").agg(F.sum("meets").alias("weight"))
    hubs = met.join(weight, "grp").groupBy("token").agg(F.max(F.struct("weight", "grp", "n", "pos")).alias("hub"))
    spokes = met.join(hubs, "token").filter(F.col("grp") != F.col("hub.grp"))
    spokes = spokes.filter(_possible(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), t)).select("grp", F.col("hub.grp").alias("other"))
    chain = chain.union(spokes).distinct()
    chain = (
        chain.join(firsts, "grp").select(F.col("id").alias("x"), F.col("other").alias("grp")).join(firsts, "grp").select("x", F.col("id").alias("y"))
    )
    in_group = Window.partitionBy("grp").orderBy("id")
    inner = members.withColumn("y", F.lag("id").over(in_group)).filter("y is not null").select(F.col("id").alias("x"), "y")
    pair = lambda df: df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    tried = written(pair(chain.union(inner)), "pairs")
    texts = rows.select("doc", "twin", "text")
    links = written(_linked(tried, reps, texts, width, t), "pair-links")
    stars = written(components(links), "components")

    # 2. whatever may still join two components
    own = lambda df: df.join(stars.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = own(members)
    open_tokens = met.select("token", "grp", "pos").join(placed, "grp").select("token", "id", "n", "pos", "component")
    spread = open_tokens.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    open_tokens = written(open_tokens.join(spread, "token"), "open-meetings")
    l, r = open_tokens.alias("l"), open_tokens.alias("r")
    apart = (F.col("l.id") < F.col("r.id")) & (F.col("l.component") != F.col("r.component"))
    may = _possible(F.col("l.n"), F.col("l.pos"), F.col("r.n"), F.col("r.pos"), t)
    rest = l.join(r, (F.col("l.token") == F.col("r.token")) & apart & may).select(F.col("l.id").alias("x"), F.col("r.id").alias("y"))
    l, r = placed.alias("l"), placed.alias("r")
    rest = rest.union(l.join(r, (F.col("l.grp") == F.col("r.grp")) & apart).select(F.col("l.id").alias("x"), F.col("r.id").alias("y")))
    rest = written(pair(rest).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = written(_linked(rest, reps, texts, width, t), "pair-links")
    if more.limit(1).count():
        stars = written(components(links.union(more)), "components")

    placed = reps.select("id", "rep").join(stars.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.join(placed.groupBy("component").agg(F.min("rep").alias("least")), "component").select("id", "component", "least")
    return sets.join(least, "id", "left")

def near_duplicates(docs: DataFrame, width: int = 5, t: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, set_id``.

    Words are runs of anything but ASCII white space after A-Z were lower-cased; a text of fewer than
    ``width`` words has one shingle, all of it; one without words (or null) has none and is alone. Sets
    link at a Jaccard similarity of ``t`` (whole hundredths) or more; ``component_id`` is the smallest id that links reach. Null
    ids come after all others, and a component without ids has null. Rows that repeat an id are told
    apart by their sets. ``set_id`` is the set's hash. An empty table gives no rows. Other columns
    are not read.

    Gathered and broadcast is one byte for each of the sketch's ``2**SKETCH`` cells, whatever the input.
    The sketch only orders shingles; any order gives the same links. It moves frequent shingles out of
    prefixes, so that a passage that many documents share rarely brings them together.
    """
    out = _placed(docs, width, t, id_col, text_col)
    alone = F.col("n") == 0
    return out.select(
        id_or_null(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"),
        id_or_null(F.when(alone, F.col("doc")).otherwise(F.col("least"))).alias("component_id"), F.when(~alone, F.col("id")).alias("set_id"),
    )


def one_of_each(docs: DataFrame, width: int = 5, t: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (of rows that repeat it, one); all columns as they are.

    Texts without words are alone, but of rows that repeat id and text one stays.
    """
    placed = _placed(docs, width, t, id_col, text_col)
    alone = placed.filter("n = 0").select("doc", "twin")
    first = placed.filter("n > 0").groupBy("component").agg(F.min(F.struct("doc", "twin")).alias("first")).select("first.doc", "first.twin")
    stay = alone.union(first).distinct()
    keyed = docs.select(whole_rows(docs), id_or_last(id_col).alias("doc"), F.xxhash64(text_or_empty(text_col)).alias("twin"))
    return keyed.join(stay, ["doc", "twin"], "left_semi").dropDuplicates(["doc", "twin"]).select("row.*")
